"""The pipeline's stages, one after the other, against brute-force versions on odd and sample documents."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import ODD, union_find

import corpus_pipeline
from conceptra.llm import mixing

BLANK = r"[\x20\x09-\x0D]"


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """Sample documents with odd ones, near copies, repeated rows, rows without ids and one id used twice."""
    rng, docs = random.Random(9), spark.read.parquet(f"{sf}/documents.parquet")
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8)))
    texts = [(900_000 + i, t) for i, t in ODD.items()]
    for i in range(8):
        own = [word() for _ in range(80)]
        near = own.copy()
        near[40] = word()
        texts += [(910_000 + i, " ".join(own)), (920_000 + i if i % 2 else None, " ".join(near))]
    texts += [(930_000, "the same row twice, word for word")] * 2 + [(None, "no id at all here")] * 3 + [(None, "12 34 !!")] + [(940_000, "one id and"), (940_000, "two quite different texts")]
    odd = spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = tmp_path_factory.mktemp("pipeline")
    docs.unionByName(odd.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in docs.schema))).repartition(5).write.parquet(str(folder / "documents.parquet"))
    return folder


def texts_of(df):
    return sorted((str(r.doc_id), r.text) for r in df.select("doc_id", "text").collect())


def shingles(text):
    words = [w for w in re.split(BLANK + "+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_stages(spark, tables):
    docs = spark.read.parquet(str(tables / "documents.parquet"))
    columns, rows = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]

    def stage(number):
        nonlocal docs
        out = corpus_pipeline.STAGES[number][1](spark, docs, str(tables))
        path = str(tables / f"stage{number}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        return docs

    # texts without letters go
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    assert texts_of(stage(0)) == sorted((str(i), t) for i, t in rows) and docs.columns == columns
    # of equal texts the longest original stays, then the smallest id
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(BLANK, "", t)].append((-len(t), i is None, i or 0, i, t))
    rows = [min(own, key=lambda r: r[:3])[3:] for own in groups.values()]
    assert [i for i, _ in texts_of(stage(1))] == sorted(str(i) for i, _ in rows) and docs.columns == columns
    # of linked texts the smallest id stays; every document is compared with every other
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group, best = union_find(range(len(rows)), links), {}
    for k, (i, t) in enumerate(rows):
        best[group[k]] = min(best.get(group[k], (True, 2**63, "")), (i is None, i if i is not None else 2**62, t))
    assert sum(i != k for k, i in group.items()) >= 8
    assert [i for i, _ in texts_of(stage(2))] == sorted("None" if none else str(i) for none, i, _ in best.values()) and docs.columns == columns
    # every text is taken as often as the mix says, the last time in part
    before = defaultdict(list)
    for r in docs.collect():
        before[r.doc_id].append(r.text)
    wanted = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    words = defaultdict(int)
    for r in stage(3).collect():
        assert any(t.startswith(r.text) for t in before[r.doc_id])
        words[r.source] += len([w for w in re.split(BLANK + "+", r.text) if w])
    assert dict(words) == {s: n for s, n in wanted.items() if n} and docs.columns == columns
    # every token of every row lies in one place
    from tokenizers import Tokenizer

    from conceptra.llm import packing

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    packed, windows, ids = stage(4).collect(), defaultdict(list), defaultdict(list)
    for r in packed:
        windows[r.sequence_id].append((r.offset, r.length))
        ids[r.doc_id].append(r.length)
    for own in windows.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(n for _, n in own) <= packing.LENGTH
    texts = defaultdict(int)
    for r in spark.read.parquet(str(tables / "stage3")).collect():
        texts[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    assert {i: sum(n) for i, n in ids.items()} == texts
    whole = corpus_pipeline.run(spark, str(tables))
    assert whole.agg(F.sum("length")).first()[0] == sum(texts.values()) and whole.columns == docs.columns
