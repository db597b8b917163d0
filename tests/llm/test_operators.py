"""Every operator against a brute-force version, and in odd cases."""

import hashlib
import random
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import database, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conceptra.llm import common, embedding_dedup, exact_dedup, language_id, mixing, ngram_join, packing, registry, repeats, sentence_spans, sharding, token_counts
from conceptra.llm.common import components, cut, sample_share, word_hashes
from conceptra.llm import words as words_module
from conceptra.llm.words import word_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, keys string, n long"


def frame(spark, texts, **columns):
    """Documents with further columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 7, "k", 1) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


ODD = {0: None, 1: "", 2: " \n\t", 3: "a", 4: "one two three four five six. " * 3000, 5: "same text here, with some words in it.", 6: "same text here, with some words in it.", 7: "Ünïcode ß 東京 ☃ x", 8: "x" * 5000, 9: "1234 5678 !!!", 10: " same  text here, with some words in it."}


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


# shared helpers


def test_words_are_runs_of_other_bytes_than_white_space():
    texts = [b"a b  A\tb\xc2\xa0", b"", b"\n", b"a", b"b\x0b\x0ca"]
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [4, 0, 0, 1, 2]
    assert hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[5] != hashes[3]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(5, i) for i in range(400, 600)] + [(i, i + 1) for i in range(700, 740)] + [(3, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find({x for pair in links for x in pair}, links)
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in set(want) - set(got))


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def jobs_of(spark, run):
    """What run() returns, and the number of jobs it started."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, "counted")
    try:
        return run(), len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setJobGroup("others", "others")


def test_components_of_a_chain_start_few_jobs(spark, monkeypatch):
    rng = random.Random(2)
    names = rng.sample(range(-10_000, 10_000), 500)
    chain = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    found, jobs = jobs_of(spark, lambda: {tuple(r) for r in components(chain).collect()})
    assert found == {(n, min(names)) for n in names} and jobs <= 8
    # more links than one task joins: steps on all machines first, with the same result
    monkeypatch.setattr(common, "JOINED", 40)
    again, more = jobs_of(spark, lambda: {tuple(r) for r in components(chain).collect()})
    assert again | {(min(names), min(names))} == found and more > jobs


# 1: n-gram Jaccard join


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_join(texts):
    sets, holders, both = {i: shingle_set(t) for i, t in texts.items()}, defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for found in holders.values():
        for k, b in enumerate(found):
            for a in found[:k]:
                both[a, b] += 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    label = union_find(sets, links)
    return {i: (len(s), label[i]) for i, s in sets.items()}


def joined(spark, texts):
    rows = ngram_join.join_components(frame(spark, texts)).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def edited(rng, words, base, times):
    out = list(base)
    for _ in range(times):
        k = rng.randrange(len(out))
        out[k : k + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2) or ["y"]
    return out


def near_copies(seed=5, sizes=(1, 3, 5, 6, 9, 10, 20, 60, 200), groups=(2, 6, 90)):
    rng = random.Random(seed)
    words, texts = [f"w{i}" for i in range(2000)], []
    for n in sizes:
        for g in groups:
            base = [rng.choice(words) for _ in range(n)]
            texts += [" ".join(edited(rng, words, base, rng.choice([0, 0, 1, 2]) * max(1, n // 60))) for _ in range(g)]
    passage = [rng.choice(words) for _ in range(60)]
    texts += [" ".join([rng.choice(words) for _ in range(rng.choice([5, 12, 40]))] + passage + [rng.choice(words) for _ in range(rng.choice([0, 9]))]) for _ in range(150)]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_join_on_near_copies(spark):
    texts = near_copies()
    assert joined(spark, texts) == brute_join(texts)


def test_join_compares_all_that_leaders_leave(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    texts = near_copies(6, (6, 20, 60), (90,))
    assert joined(spark, texts) == brute_join(texts)


def test_join_odd(spark):
    assert joined(spark, ODD) == brute_join(ODD)


def test_join_of_nothing_and_of_repeated_rows(spark):
    assert joined(spark, {}) == {}
    twice = frame(spark, {3: "a b c d e f g", 4: "a b c d e f g"})
    assert sorted(r.component_id for r in ngram_join.join_components(twice.union(twice)).collect()) == [3] * 4


def test_join_without_ids(spark):
    df = frame(spark, ["a b c d e f", "a b c d e f"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert sorted((r.doc_id is None, r.component_id) for r in ngram_join.join_components(df).collect()) == [(False, 1), (True, None)]


def test_signatures_meet_for_all_linking_sets():
    """For random pairs at the threshold, whatever the classes of the tokens."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        base = rng.choice(2**62, 3 * n + 8, replace=False).astype(np.uint64)
        gone, more = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 4 + 1))
        x, y = base[:n], np.concatenate([base[gone:n], base[n : n + more]])
        both = n - gone
        if not both or 100 * both < 80 * (n + more):
            continue
        level = dict(zip(base.tolist(), rng.choice([1, 3, 64], len(base), p=rng.dirichlet([1, 1, 1])).tolist()))
        level |= {t: max(2, level[t]) for t in set(x.tolist()) & set(y.tolist())}
        keys = []
        for s in (x, y):
            known = np.sort(np.array([t for t in s.tolist() if level[t] > 1], np.uint64))
            keys.append(ngram_join.signatures(len(s), known, np.array([level[t] for t in known.tolist()])))
        assert set(x.tolist()) == set(y.tolist()) or keys[0] is not None and keys[1] is not None and set(keys[0].tolist()) & set(keys[1].tolist())


# 2: language ID


def test_language_id_is_right_on_held_out_texts(spark, documents):
    docs = documents
    found = language_id.predict(docs, language_id.learn(docs.filter(~language_id.held_out())))
    pairs = docs.filter(language_id.held_out()).join(found, "doc_id").select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in pairs) >= 0.95 * len(pairs)
    assert all(0 <= r.score <= 1 for r in pairs)


def test_language_id_odd(spark, documents):
    filters = language_id.learn(documents)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(frame(spark, ODD), filters).collect()}
    assert {i for i, lang in got.items() if lang == "und"} == {0, 1, 2, 9} and len(got) == len(ODD)
    assert {r.lang_pred for r in language_id.predict(frame(spark, ODD), language_id.learn(documents.limit(0))).collect()} == {"und"}
    assert language_id.predict(frame(spark, {}), filters).count() == 0
    assert language_id.keep_known(frame(spark, ODD)).count() == 7


@pytest.mark.parametrize("languages", [3, 64, 65, 150])
def test_filters_hold_all_that_was_put_in(languages):
    rng = np.random.default_rng(0)
    own = {f"l{i:03d}": rng.integers(0, 2**62, 3000).astype(np.uint64) for i in range(languages)}
    f = language_id.Filters(own)
    strange = f.masks(rng.integers(0, 2**62, 20000).astype(np.uint64))
    for i, name in enumerate(f.languages):
        bit = lambda masks: masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)  # noqa: E731, B023
        assert bit(f.masks(own[name])).all()
        assert abs(bit(strange).mean() - f.false_rate[i]) < 0.002


def plain_trigrams(text):
    text = text.lower()
    return [tuple(c if c.isalpha() else "" for c in (text[i - 1 : i], text[i], text[i + 1 : i + 2])) for i in range(len(text)) if text[i].isalpha()] if not text[:1].isalpha() else plain_trigrams(" " + text)


def test_language_id_decides_as_exact_sets_do(spark, documents):
    """The same rule with sets of trigrams in place of filters."""
    counts, sizes = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    rows = documents.collect()
    for r in rows:
        if r.lang is not None and r.text and zlib.crc32(str(r.doc_id).encode()) % 5:
            for g in plain_trigrams(r.text):
                counts[g][r.lang] += 1
    counts = {g: {lang: n for lang, n in own.items() if n >= language_id.MIN_COUNT} for g, own in counts.items()}
    for own in counts.values():
        for lang, n in own.items():
            sizes[lang] += n
    sets = defaultdict(set)
    for g, own in counts.items():
        most = max((n / sizes[lang] for lang, n in own.items()), default=0)
        for lang, n in own.items():
            if n / sizes[lang] >= language_id.RELATIVE * most:
                sets[lang].add(g)
    found = {r.doc_id: r.lang_pred for r in language_id.predict(documents, language_id.learn(documents.filter(~language_id.held_out()))).collect()}
    agreed = []
    for r in rows:
        grams = plain_trigrams(r.text or "")
        best = max(sorted(sets), key=lambda lang: sum(g in sets[lang] for g in grams)) if grams else "und"
        agreed.append(best == found[r.doc_id])
    assert np.mean(agreed) >= 0.99


def test_language_id_of_long_texts_and_rare_letters(spark, documents, monkeypatch):
    filters = language_id.learn(documents)
    texts = [r.text for r in documents.limit(40).collect() if r.text] + ["\U00030001\U00030002"]
    whole = filters.decide(texts)
    monkeypatch.setattr(language_id, "PART", 50)
    assert filters.decide(texts) == whole and whole[0][-1] != "und"


def test_samples_are_never_empty():
    assert sample_share(20_000, 10**15) >= 1 and sample_share(5, 3) == 1 << 62


# 3: sharding


def test_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill(names, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.25 * 1009
    weighted = np.bincount(sharding.fill(["a", "b"], 1009, [3, 1]))
    assert abs(weighted[0] / weighted[1] - 3) < 0.05


@pytest.mark.parametrize("args", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2), (["a"], 7, [0])])
def test_bad_tables(args):
    with pytest.raises(ValueError):
        sharding.fill(*args)


def plain_table(names, size):
    """Each shard in turn takes the first slot of its own order that is free."""
    orders = []
    for name in names:
        digest = hashlib.sha256(name.encode()).digest()
        start, step = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:16], "big") % (size - 1) + 1
        orders.append(iter([(start + k * step) % size for k in range(size)]))
    table = {}
    while len(table) < size:
        for i, order in enumerate(orders):
            if len(table) < size:
                table[next(slot for slot in order if slot not in table)] = i
    return [table[i] for i in range(size)]


def test_own_columns_of_the_same_names(spark, tmp_path):
    docs = frame(spark, ODD).selectExpr("doc_id", "text", "'mine' as slot", "doc_id as shard", "7 as salt")
    placed = sharding.place(docs, "doc_id", ["a", "b"], 7)
    assert placed.columns == ["doc_id", "text", "salt", "slot", "shard"] and {r.shard for r in placed.collect()} <= {"a", "b"}
    sharding.write(docs, "doc_id", str(tmp_path / "own"), ["a", "b"], 7)
    back = spark.read.parquet(str(tmp_path / "own"))
    assert {r.slot for r in back.collect()} == {"mine"} and {r.salt for r in back.collect()} == {7} and back.count() == len(ODD)
    assert sharding.place(docs.limit(0), "doc_id", ["a"], 7).count() == 0


def test_placement(spark, sf, tmp_path):
    rows = registry.queries()["op3_sharding"](spark, sf).collect()
    assert plain_table(["x", "y", "z"], 1009) == sharding.fill(["x", "y", "z"], 1009)
    table = plain_table(list(sharding.SHARDS)[:128], sharding.TABLE_SIZE)
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[table[slot]])
    docs = frame(spark, ODD)
    sharding.write(docs, "doc_id", str(tmp_path / "out"), ["a", "b"], 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)
    nulls = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r.slot for r in sharding.place(nulls, "text", ["a", "b"], 7).collect()} == {int(hashlib.md5(b"").hexdigest()[:15], 16) % 7}


# 4: mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def checked_mix(df):
    rows = mixing.mix(df).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    want = brute_targets({s: sum(r.size for r in own) for s, own in by.items()}) if rows else {}
    for s, own in by.items():
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sum(x.size for x in own) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) < 1
        assert all(0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0) for r in own)
        assert all(0 <= r.position < 1 for r in own if r.taken)
    return rows


def test_mixing(spark, documents):
    rows = checked_mix(documents)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(documents).collect()), key=str)
    ordered = [r.position for r in mixing.in_order(mixing.mix(documents)).collect() if r.position is not None]
    assert ordered == sorted(ordered)


def test_mixing_reshares_and_handles_null_sources(spark):
    texts = ["w " * n for n in (1, 2, 3, 500, 400, 0, 7, 90)]
    df = frame(spark, texts).withColumn("source", F.expr("element_at(array('a', 'b', 'b', 'c', 'd', 'e', null, 'a'), cast(doc_id + 1 as int))"))
    checked_mix(df)
    checked_mix(df.withColumn("doc_id", F.lit(None).cast("long")))


def test_mixing_odd(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    checked_mix(frame(spark, ODD))
    assert mixing.mix(frame(spark, {})).count() == 0
    nothing = mixing.mix(frame(spark, [None, ""])).collect()
    assert [(r.taken, r.target) for r in nothing] == [(0, 0.0)] * 2


def test_mix_as_texts(spark, documents):
    shares = {r.doc_id: r.taken for r in mixing.mix(documents).collect()}
    out = mixing.materialize(documents)
    assert out.columns == documents.columns
    taken, texts = defaultdict(int), {r.doc_id: r.text for r in documents.collect()}
    for r in out.collect():
        taken[r.doc_id] += len(r.text.split())
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert taken == {i: n for i, n in shares.items() if n}
    assert mixing.materialize(frame(spark, ODD)).columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_positions_follow_the_demand(spark):
    """Against numerical integrals of the schedules: a source that is taken three times follows its schedule once."""
    texts = ["w " * 10] * 30 + ["w " * 20] * 200 + ["w " * 30] * 40
    df = frame(spark, texts).withColumn("source", F.expr("case when doc_id < 30 then 'a' when doc_id < 230 then 'b' else 'c' end"))
    t = (np.arange(200_000) + 0.5) / 200_000
    own = mixing.shares(mixing.sized(df))
    seen = defaultdict(list)
    for r in own.select("source", "target", "source_size", "before", "taken", "size", mixing.occurrence(F.lit(1)).alias("p1"), mixing.occurrence(F.lit(2)).alias("p2"), mixing.occurrence(F.lit(3)).alias("p3")).collect():
        slope = mixing.SLOPES["abc".index(r.source)]
        demand = np.cumsum(1 - slope + 2 * slope * t) / 200_000
        for k in range(-(-r.taken // r.size) if r.size else 0):
            share = min(1, (k * r.source_size + r.before) / r.target)
            assert abs((r.p1, r.p2, r.p3)[k] - np.searchsorted(demand, share) / 200_000) < 1e-4
            seen[r.source].append((r.p1, r.p2, r.p3)[k])
    assert max(seen["a"]) > 0.9 and np.mean(seen["a"]) < 0.47 and np.mean(seen["b"]) > 0.53


def test_mix_as_texts_without_ids_and_with_repeated_rows(spark):
    texts = ["one two three four"] * 60 + ["five six"] * 40
    for df in (frame(spark, texts).withColumn("doc_id", F.lit(None).cast("long")), frame(spark, texts).withColumn("doc_id", F.pmod("doc_id", F.lit(3)))):
        df = df.withColumn("source", F.when(F.length("text") > 10, "a").otherwise("b"))
        taken = {r.source: r.n for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
        words = defaultdict(int)
        for r in mixing.materialize(df).collect():
            words[r.source] += len(r.text.split())
        assert words == taken


# 5: repeats


def brute_repeats(texts):
    seen, out = {}, {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if seen.setdefault(data[k : k + 100], (i, k)) != (i, k):
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def removed(spark, texts):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.dedup(frame(spark, texts)).collect()}


def repetitive(seed, n=200):
    rng = random.Random(seed)
    make = lambda k, letters="abcdefghij \n": "".join(rng.choice(letters) for _ in range(k))
    passages = [make(rng.choice([90, 99, 100, 101, 180, 400, 1500])) for _ in range(15)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            parts.append(rng.choice([make(rng.randrange(300)), p, p[rng.randrange(len(p)) :], rng.choice("ab") * rng.randrange(400), make(3) * rng.randrange(120), "é"]))
        texts.append("".join(parts))
    return dict(enumerate(texts + texts[:10]))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    texts = repetitive(seed)
    assert removed(spark, texts) == brute_repeats(texts)


def test_repeats_odd(spark, monkeypatch):
    assert removed(spark, ODD) == brute_repeats(ODD)
    assert removed(spark, {}) == {}
    monkeypatch.setattr(repeats, "PART_BYTES", 1000)
    texts = repetitive(3, 60)
    assert removed(spark, texts) == brute_repeats(texts)
    once = frame(spark, {1: "abc" * 50 + "xyz" * 60})
    assert {(r.n_removed, r.n_spans) for r in repeats.dedup(once.union(once)).collect()} == {brute_repeats({1: "abc" * 50 + "xyz" * 60})[1][1:3]}


def test_repeats_without_ids(spark):
    df = frame(spark, ["a" * 50 + "b" * 100, "a" * 50 + "b" * 100]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.n_removed for r in repeats.dedup(df).collect()] == [0, 0]


def test_maximal_repeats():
    rng = random.Random(4)
    base = "".join(rng.choice("abcd") for _ in range(130)).encode()
    texts = [b"x" + base + b"y", b"z" + base[:120] + b"q", base[5:], b"r" * 20]
    found = {length: {tuple(p) for p in where.tolist()} for length, where in repeats.maximal_repeats(texts, least=100)}
    assert found == {125: {(0, 6), (2, 0)}, 120: {(0, 1), (1, 1)}, 115: {(0, 6), (1, 6), (2, 0)}}


# 6: packing


def checked_pack(df, length=packing.LENGTH):
    from tokenizers import Tokenizer

    rows = packing.pack(df, packing.tokenizer_path(), length).collect()
    tokenizer, by, sequences = Tokenizer.from_file(packing.tokenizer_path()), defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for doc, text in df.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        pieces = sorted(by[doc], key=lambda r: r.start)
        assert [x for p in pieces for x in np.frombuffer(p.ids, "<u4").tolist()] == ids
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist() and {p.doc_tokens for p in pieces} == {len(ids)}
    short = 0
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
        assert sum(n for _, n in own) <= length
        short += sum(n for _, n in own) < length
    return short


def test_packing(spark, documents, monkeypatch):
    assert checked_pack(documents) <= 1
    monkeypatch.setattr(packing, "SHARD_TOKENS", 5000)
    monkeypatch.setattr(packing, "TASKS", 5)
    assert checked_pack(documents, 512) <= 5  # one a task


def test_texts_above_the_limit_are_tokenised_in_parts():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    texts = ["short one", "Ein längerer Text, der's. " * 40 + "<|endoftext|> END", None, "x" * 300 + " tail  ", "", "a b"]
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    for limit in (8, 50, 400, 1 << 20):
        found = [own.tolist() for _, ids, sizes in packing.encoded(path, pa.array(texts), limit) for own in np.split(ids, np.cumsum(sizes)[:-1])]
        assert found == want


_BITS = [*"abcdestrvmlZÉé'ßÿ÷ñ.,!#$(-190 \t\n\u0301\u0085ſΣ中ǅ", "<|endoftext|>", "<|", "'re", "'ll"]


@given(st.lists(st.lists(st.sampled_from(_BITS), max_size=30).map("".join), max_size=20))
@settings(max_examples=60, deadline=None)
def test_word_tokenizer(texts):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = word_tokenizer(path)
    ids, sizes = tokenizer(pa.array(texts, pa.string()))
    assert [own.tolist() for own in np.split(ids, np.cumsum(sizes)[:-1])][: len(texts)] == [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


TRICKY = ["don't  I'LL  stop. a,b ... %%%. 3.14, 7. x y z é. ́x", "<|endoftext|> <|ENDOFTEXT|> a<|endoftext|>b THE. É.", "ß. ÄÖ, İI. Σσς ΑΣ. 東京。x.", "\x0b\x0c\x1c\x85a\x85b", "it's. '' 'S ’s the.' ,. a.,. b.,", "x" * 5000 + ".", "é. àb"]


def test_words_are_merged_once(monkeypatch):
    from tokenizers import Tokenizer

    path, rng = packing.tokenizer_path(), random.Random(3)
    plain, letters = Tokenizer.from_file(path), "abcdeinorst" * 3 + "éßxyz"
    words = ["".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 5, 7, 8, 10, 11, 14, 15, 16, 20, 21, 39, 40, 41, 60]))) for _ in range(3000)] + ["don't", "A1b2", "東京", "\x00", "a\x00", "ﷺ" * 5, "the", "The"]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(120)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]

    def found():
        ids, sizes = encode(pa.array(texts))
        return [own.tolist() for own in np.split(ids, np.cumsum(sizes)[:-1])]

    encode, merged = words_module.WordTokenizer(path), []
    real = encode.merges.merged
    monkeypatch.setattr(encode.merges, "merged", lambda some: merged.append(len(some)) or real(some))
    assert found() == want and len(merged) <= len(words_module.LENGTHS) + 1
    first = sum(merged)
    merged.clear()
    # longer words and a few whose place others took
    assert found() == want and sum(merged) < 0.45 * first
    # hardly any place, and beginning anew at each call
    for name, value in (("PLACES", 3), ("REMEMBERED", 10)):
        monkeypatch.setattr(words_module, name, value)
        encode = words_module.WordTokenizer(path)
        assert found() == want and found() == want


def test_packing_odd(spark):
    assert checked_pack(frame(spark, [*ODD.values(), *TRICKY])) <= 1
    assert packing.pack(frame(spark, {}), packing.tokenizer_path()).count() == 0
    assert packing.pack(frame(spark, ["a"]).withColumn("doc_id", F.lit(None).cast("long")), packing.tokenizer_path()).first().doc_tokens == 2


def test_neighbours_are_the_best_by_bm25():
    import math

    rng = random.Random(3)
    words = [[rng.randrange(60) for _ in range(rng.randrange(1, 25))] for _ in range(300)]
    texts = words
    index = packing.Bm25(np.array([w for t in words for w in t], np.uint64), np.array([len(t) for t in words]))
    mean = sum(map(len, words)) / len(words)

    def score(q, d):
        total = 0.0
        for w in set(words[q]):
            df = sum(w in x for x in words)
            idf = math.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
            if w in words[d] and 1 < df <= packing.COMMON * len(texts):
                tf = words[d].count(w)
                total += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(words[d]) / mean))
        return total

    for q in range(0, len(texts), 20):
        used = np.zeros(len(texts), bool)
        used[[q, 5, 17]] = True
        want = {d: score(q, d) for d in range(len(texts)) if not used[d] and score(q, d) > 0}
        found = list(index.neighbours(q, used))
        assert sorted(found) == sorted(want)
        assert np.allclose([want[d] for d in found], sorted(want.values(), reverse=True), rtol=1e-4)


def test_texts_of_a_topic_share_windows(spark, monkeypatch):
    """Twelve rare topics, each dealt over 12 partitions; shards hold a sixth of the texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    common, topics = [word() for _ in range(60)], [[word() for _ in range(10)] for _ in range(12)]
    texts = {i: " ".join(rng.choice(topics[i % 12] if rng.random() < 0.5 else common) for _ in range(40)) for i in range(480)}
    monkeypatch.setattr(packing, "SHARD_TOKENS", 12_000)
    rows = packing.pack(frame(spark, texts).repartition(12), packing.tokenizer_path(), 1000).collect()
    found = defaultdict(lambda: defaultdict(int))
    for r in rows:
        found[r.sequence_id][r.doc_id % 12] += r.length
    pure = sum(max(t.values()) for t in found.values()) / sum(r.length for r in rows)
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values()) and pure > 0.6


def test_copies_meet_and_hot_ones_are_dealt(spark, monkeypatch):
    """Pairs of near copies lie in one shard; 400 equal texts fill several."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = {}
    for i in range(0, 200, 2):
        own = [word() for _ in range(80)]
        texts[i] = " ".join(own)
        texts[i + 1] = " ".join([word(), *own[1:]])
    hot = " ".join(word() for _ in range(80))
    texts |= dict.fromkeys(range(200, 600), hot)
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20_000)
    tokenised = cut(frame(spark, texts).repartition(12, "doc_id").select("doc_id", "text").mapInArrow(packing._tokenised(packing.tokenizer_path()), packing.TOKENISED))
    shard = {r.doc_id: (r.shard, r.tokens) for r in packing.dealt(tokenised, packing.ending(packing.tokenizer_path())).withColumn("shard", F.spark_partition_id()).collect()}
    assert sum(shard[i][0] == shard[i + 1][0] for i in range(0, 200, 2)) >= 90
    total, largest = sum(t for _, t in shard.values()), defaultdict(int)
    for s, t in shard.values():
        largest[s] += t
    assert len(largest) >= 5 and max(largest.values()) < 0.4 * total


def test_packing_agrees_between_runs(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 100_000)
    runs = [sorted(map(tuple, packing.pack(documents, packing.tokenizer_path()).drop("ids").collect())) for _ in range(2)]
    assert runs[0] == runs[1]


# 7: embeddings


def brute_vectors(rows):
    groups = defaultdict(list)
    for i, e, label in rows:
        if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            groups[label, len(e)].append((i, e))
    count, links = {i: 0 for i, _, _ in rows}, []
    for own in groups.values():
        x = np.array([e for _, e in own], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= embedding_dedup.THRESHOLD
        np.fill_diagonal(near, False)
        for (i, _), n in zip(own, near.sum(1)):
            count[i] = int(n)
        links += [(own[a][0], own[b][0]) for a, b in zip(*np.nonzero(np.triu(near)))]
    label = union_find(count, links)
    return {i: (n, label[i]) for i, n in count.items()}


def clusters(seed, n=1500, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dim))
    x = centres[rng.integers(0, 40, n)] + rng.standard_normal((n, dim)) * rng.choice([0.0, 0.1, 0.35], n)[:, None]
    return [(i, v.astype(np.float32).tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [1024, 64])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "LEAF", 64)
    rows = clusters(2)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = brute_vectors(rows)
    found, all_ = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.97 * all_
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)


def test_links_of_a_large_cloud_are_found():
    """A third of a label of 33,000 vectors in one cloud of mean cosine 0.94."""
    rng = np.random.default_rng(6)
    n, dim = 33_000, 128
    rows = rng.standard_normal((n, dim))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    inside = rng.permutation(n)[: n // 3]
    rows[inside] = rows[0] + rows[inside] * np.sqrt(1 / 0.94 - 1)
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    sample = rows[rng.random(n) < 0.25]
    row, key = embedding_dedup.Forest(sample, int(np.ceil(np.log2(n / embedding_dedup.LEAF))), share=0.25).leaves(rows)
    order = np.argsort(row, kind="stable")
    leaves = [set(k.tolist()) for k in np.split(key[order], np.cumsum(np.bincount(row, minlength=n))[:-1])]
    a, b = rng.choice(inside, 3000), rng.choice(inside, 3000)
    linked = [(i, j) for i, j in zip(a, b) if i != j and rows[i] @ rows[j] >= embedding_dedup.THRESHOLD]
    assert len(linked) > 1000 and np.mean([bool(leaves[i] & leaves[j]) for i, j in linked]) >= 0.97


def test_embeddings_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [1.0, 2.0], None), (7, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (9, [1.0, 2.0, 3.0], 1), (10, [2.0, 4.0], 1), (11, [inf, 1.0], 1), (12, [-1.0, -2.0], 1)]
    schema = "vec_id long, embedding array<float>, label int, members long, leaf long"
    df = spark.createDataFrame([(*r, 5, 5) for r in rows], schema)
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()} == brute_vectors(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    nameless = embedding_dedup.near_duplicates(df.filter("vec_id IN (7, 8, 10)").withColumn("vec_id", F.when(F.col("vec_id") != 7, F.col("vec_id")))).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in nameless) == [(0, 0), (8, 1), (10, 1)]


# 8: token counts


def brute_tokens(word, pieces):
    text = token_counts.MARK + word.decode("utf-8", "replace")
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        options = [(best[-1][0] + token_counts.BYTE_SCORE * size, -(-best[-1][1] + size))]
        options += [(best[s][0] + pieces[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in pieces]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(spark, documents):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.load_pieces(path)
    some = documents.limit(40)
    known = {}
    for r in some.join(token_counts.token_counts(some, path), "doc_id").collect():
        words = r.text.encode().split()
        for w in set(words) - set(known):
            known[w] = brute_tokens(w, pieces)
        assert (r.n_words, r.n_tokens) == (len(words), sum(known[w] for w in words))


def test_token_counts_odd(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, ODD), path).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[5] == got[6] == got[10] and got[8] > 0
    assert token_counts.token_counts(frame(spark, {}), path).count() == 0
    big = 2**60 + 1
    df = frame(spark, ["a", "b"]).withColumn("doc_id", F.when(F.col("doc_id") == 0, F.lit(big)))
    assert {r.doc_id for r in token_counts.token_counts(df, path).collect()} == {big, None}


# 9: exact dedup


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_oracles(spark, sf, key):
    same(registry.queries()[key](spark, sf), database(sf), registry.oracle_sql()[key])


def test_exact_dedup_odd(spark):
    df = frame(spark, ODD)
    index = exact_dedup.new_index(spark, 10)
    got = {r.id: (r.keep_id, r.members) for r in exact_dedup.dedup(df, index).collect()}
    assert {i for i in got if got[i] == (2, 3)} == {0, 1, 2} and {i for i in got if got[i] == (10, 3)} == {5, 6, 10}
    assert exact_dedup.keep_first(df).count() == len(ODD) - 4 and exact_dedup.keep_first(df).columns == df.columns
    none = exact_dedup.new_index(spark, 0)
    assert exact_dedup.dedup(frame(spark, {}), none).count() == 0
    none.drop()
    index.drop()


def test_index_persists_and_takes_new_data_only(spark):
    index = exact_dedup.new_index(spark, 10)
    exact_dedup.dedup(frame(spark, {1: "a b", 2: "c"}), index)
    again = {r.id: r.keep_id for r in exact_dedup.dedup(frame(spark, {7: "ab  ", 8: "d", 9: "d"}), index).collect()}
    assert again == {7: 1, 8: 8, 9: 8} and index.read().count() == 3
    before = sorted(map(tuple, index.read().collect()), key=str)
    index.compact()
    assert sorted(map(tuple, index.read().collect()), key=str) == before and len(index.read().inputFiles()) <= index.buckets
    plan = exact_dedup.digests(frame(spark, {1: "a"})).join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    index.drop()


def test_exact_dedup_without_ids(spark):
    df = frame(spark, ["a", "a", "b"]).withColumn("doc_id", F.when(F.col("doc_id") == 1, F.lit(1)).cast("long"))
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.keep_first(df).collect()) == [("1", "a"), ("None", "b")]
    low = frame(spark, {-(2**63): "z", 5: "z"})
    assert {r.keep_id for r in exact_dedup.alone(exact_dedup.digests(low)).collect()} == {-(2**63)}


def test_one_of_repeated_rows_stays(spark):
    df = frame(spark, ["a", "b", "b", "c"]).union(frame(spark, ["a", "b", "b", "c"]))
    assert sorted((r.doc_id, r.text) for r in exact_dedup.keep_first(df).collect()) == [(0, "a"), (1, "b"), (3, "c")]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


# 10: sentence spans


def plain_pieces(text):
    """The splitting rules, character by character."""
    sentences_, start, i = [], 0, 0
    while i < len(text):
        c, ends = text[i], False
        if c in ".!?…":
            j = i
            while j < len(text) and text[j] in ".!?…":
                j += 1
            ends, i = j == len(text) or text[j].isspace(), j
        elif c in "。！？":
            while i < len(text) and text[i] in "。！？":
                i += 1
            ends = True
        elif c == "\n":
            ends = True
        else:
            i += 1
        if ends:
            while i < len(text) and text[i].isspace():
                i += 1
            sentences_.append(text[start:i])
            start = i
    pieces = []
    for sentence in [*sentences_, text[start:]]:
        clauses = [sentence]
        if len(sentence) > 160:
            clauses, at = [], 0
            for i, c in enumerate(sentence):
                if c in ",;:" and (i + 1 == len(sentence) or sentence[i + 1] not in ",;:"):
                    i += 1
                    while i < len(sentence) and sentence[i].isspace():
                        i += 1
                    clauses.append(sentence[at:i])
                    at = i
            clauses.append(sentence[at:])
        for clause in clauses:
            while len(sentence) > 160 and len(clause) > 160:
                i = 160
                while i < len(clause) and not clause[i].isspace():
                    i += 1
                while i < len(clause) and clause[i].isspace():
                    i += 1
                pieces.append(clause[:i])
                clause = clause[i:]
            pieces.append(clause)
    return [p for p in pieces if p]


@given(st.lists(st.sampled_from([*"ab. .!?,;:\n…。！ ", "word ", "x" * 70, "3.14", "a b c d e f g h " * 9]), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_pieces(text):
    assert sentence_spans.sentences(text) == plain_pieces(text) and "".join(plain_pieces(text)) == text


def removed_by_all_runs(texts):
    """What is left of the texts when every run of pieces, however long, is compared with every other."""
    seen, left = {}, {}
    for i, text in sorted(texts.items()):
        own, gone = plain_pieces(text), set()
        for a in range(len(own)):
            for b in range(a + 2, len(own) + 1):
                run = tuple(s.strip() for s in own[a:b])
                if sum(map(len, run)) >= 120 and seen.setdefault(run, (i, a)) != (i, a):
                    gone |= set(range(a, b))
        left[i] = "".join(s for k, s in enumerate(own) if k not in gone)
    return left


def test_sentence_spans(spark):
    rng = random.Random(2)
    sentence = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(2, 9) for _ in range(rng.randrange(4, 14))) + rng.choice([". ", "! ", "?\n"])
    passage = "".join(sentence() for _ in range(8))
    texts = {i: "".join(sentence() for _ in range(rng.randrange(12))) + (passage if i % 3 == 0 else "") + "".join(sentence() for _ in range(rng.randrange(5))) for i in range(60)}
    want = removed_by_all_runs(texts)
    assert {r.doc_id: r.text for r in sentence_spans.dedup(frame(spark, texts)).collect()} == want
    assert sum(passage[100:300] in t for t in want.values()) == 1 and all(want[i] == texts[i] for i in texts if i % 3)


def test_sentence_spans_remove_every_repeated_run(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(2, 9) for _ in range(rng.choice([3, 8, 18, 50]))) + rng.choice([". ", ", ", ". "])
    passages = [[sentence() for _ in range(6)] for _ in range(5)] + [["a" * 99 + ". ", "b" * 49 + ". ", "c" * 49 + ". "]]
    texts = {i: [sentence() for _ in range(rng.randrange(4))] + rng.choice(passages) + [sentence() for _ in range(rng.randrange(4))] + rng.choice(passages)[rng.randrange(3) :] for i in range(40)}
    texts |= {50: [sentence(), *passages[5], sentence()], 51: [sentence(), *passages[5], sentence()]}
    texts = {i: "".join(own) for i, own in texts.items()}
    got = {r.doc_id: r.text for r in sentence_spans.dedup(frame(spark, texts)).collect()}
    assert got == removed_by_all_runs(texts) and "c" * 49 not in got[51]


def test_sentence_spans_odd(spark):
    got = {r.doc_id: (r.text, r.n_removed) for r in sentence_spans.dedup(frame(spark, ODD)).collect()}
    assert {i: t for i, (t, _) in got.items() if i != 4} == {i: t for i, t in ODD.items() if i != 4}
    assert got[4][1] > 2900
    assert sentence_spans.dedup(frame(spark, {})).count() == 0
    long = "one two three four five six seven eight nine ten eleven. eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen. and so on."
    df = frame(spark, [long, long, long]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert sorted((r.doc_id or 0, r.n_removed) for r in sentence_spans.dedup(df).collect()) == [(0, 0), (1, 0), (2, 3)]


def test_cut_keeps_rows(spark):
    df = spark.createDataFrame([(1, [1, 2], None)], "a long, b array<int>, c string")
    assert cut(df).collect() == df.collect() and cut(df.limit(0)).schema == df.schema


def test_a_text_of_20_mb(spark, tmp_path):
    """Through every operator, whole: the text's own repeats, words and tokens all count."""
    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=3_500_000)) + "."
    assert len(long) > 19_000_000
    frame(spark, [long, "short text of a few words", long[:5000]]).repartition(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = {name: registry.queries()[name](spark, str(tmp_path)).orderBy("doc_id").collect() for name in registry.queries() if name != "op7_embedding_dedup"}
    assert [r.n_shingles > 3_400_000 for r in found["op1_ngram_join"]] == [True, False, False]
    assert {r.doc_id for r in found["op2_language_id"]} == {0, 1, 2} and {r.doc_id for r in found["op3_sharding"]} == {0, 1, 2}
    assert found["op4_mixing"][0]["size"] == 3_500_000 and found["op5_repeats"][2].n_removed == 5000 and found["op5_repeats"][0].n_bytes == len(long)
    packed = [r for r in found["op6_packing"] if r.doc_id == 0]
    assert sum(r.length for r in packed) == packed[0].doc_tokens > 3_500_000
    assert found["op8_token_counts"][0].n_words == 3_500_000
    assert found["op9_exact_dedup"][0].text_sha256 == hashlib.sha256(long.replace(" ", "").encode()).hexdigest()
    assert "".join(r.text for r in found["op10_sentence_spans"] if r.doc_id == 0) == long
