"""N-gram Jaccard join with token-combination prefixes.

The tokens of a text are the hashes of its distinct five-word shingles. All tokens have one global
order: by document frequency, then hash; tokens in ``FREQUENT`` documents or more form the frequent
class, ordered by hash. Of two texts at the threshold, each lacks at most a fifth of its tokens, so
(with n tokens, of which c come before the frequent ones):

* if c > n/5, the first n/5 + 1 tokens are indexed singly: one of them is shared;
* else the prefix is extended into the frequent class, where pairs of neighbouring tokens are
  indexed: a missing token breaks two such pairs and an additional one breaks one, which are at most
  2n/5 - 2c in all, so that one pair of 2n/5 - 2c + 2 frequent tokens is shared.

Tokens that occur in one document only come first in the order, so a text with more than n/5 of
these has no partner and leaves early. Equal sets are one class, represented by the smallest id.

Frequencies are counted on blocks: a batch of texts sends each bucket of tokens one compressed row
and gets back which of its tokens occur elsewhere; a token frequent within a batch stays there, so
that no bucket gathers a hot token's documents. Candidates of a key with few texts are compared with
the key's smallest and largest ids, which is all pairs of three; in larger keys every text is
compared with one leader a round, so that a group of near copies costs rows in proportion to its
size. What is still in another component after some rounds is compared in full. A parity sketch
(1,024 bits, each the parity of the tokens that fall on it) bounds the symmetric difference of two
sets from below and drops pairs that cannot link before their sets are fetched. Every other
candidate is verified on the exact counts of its hashes.

Null, empty and blank texts have no shingles and link with nothing. Repeated rows fall into one
class. Of several texts under one id the one with the most shingles (then the largest digest) is compared
with others; each row keeps the class of its own set. A row without an id is not compared; it comes back with nulls.
Only doc_id and text are read. A text above ``BATCH_BYTES`` is a batch of its own, whose arrays take
some dozens of bytes for each byte of it. No rows in: no rows out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, components, cut, discard, documents, gathered, keyed, mix64, release, small_batches, tidy, tidy_group, word_hashes

WORDS = 5
#: A pair links when PERCENT_OF * intersection >= PERCENT * union.
PERCENT, PERCENT_OF = 80, 100
#: Documents from which on a token belongs to the frequent class.
FREQUENT = 64
#: Bytes of text in a batch, and characters of text for each bucket of tokens.
BATCH_BYTES, BUCKET_CHARS = 6 << 20, 8 << 20
SKETCH_BITS = 1024

_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LENGTH = np.uint64(0xE7037ED1A0B428DB)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, repeats included, and their number for each text."""
    words, counts = word_hashes(texts)
    made = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    starts = np.cumsum(counts) - counts
    first = np.repeat(starts - (np.cumsum(made) - made), made) + np.arange(made.sum())
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    length = np.repeat(np.minimum(counts, WORDS), made)
    total = length.astype(np.uint64) * _LENGTH
    for k in range(WORDS):
        total += np.where(length > k, padded[first + k], np.uint64(0)) * _FACTORS[k]
    return mix64(total), made


def distinct(hashes: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, text number) pairs, by hash and then text."""
    owner = np.repeat(np.arange(len(made), dtype=np.uint16), made)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], owner[fresh]


_ZSTD = pa.Codec("zstd", 1)


def squeezed(data: bytes) -> bytes:
    """Compressed, with the size first: entropy coding halves what the shuffle's own compression leaves."""
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def whole(data: bytes) -> bytes:
    return _ZSTD.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Differences of sorted hashes by byte plane, so that the high planes compress to nothing."""
    steps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return squeezed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(whole(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _sketch(hashes: np.ndarray, owner: np.ndarray, by_text: np.ndarray, ends: np.ndarray, first: int) -> np.ndarray:
    """Parity sketches of up to 1,000 texts, as SKETCH_BITS / 64 longs each."""
    last = min(first + 1000, len(ends))
    own = by_text[ends[first - 1] if first else 0 : ends[last - 1]]
    at = (owner[own].astype(np.int64) - first) * SKETCH_BITS + (hashes[own] & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=(last - first) * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).reshape(last - first, -1)


_BLOCK = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary()), ("meta", pa.binary())])
BLOCK_SCHEMA = "bucket int, batch long, tokens binary, counts binary, owners binary, meta binary"


def _blocks(buckets: int):
    """Rows of a batch for every bucket of tokens, and one for itself (meta: ids, sizes and digests)."""

    def run(batches):
        number = 0
        for names, texts in gathered(batches, BATCH_BYTES):
            ids, n = names.to_numpy(zero_copy_only=False).astype(np.int64), len(texts)
            parts = [shingles(texts[c:d]) for c, d in chunks([len(t) for t in texts])]
            hashes, owner = distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            size = np.bincount(owner, minlength=n).astype(np.int64)
            by_text = np.argsort(owner, kind="stable")
            sums = []
            for salt in (1, 2):
                run_up = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes[by_text] + np.uint64(salt)), dtype=np.uint64)])
                ends = np.cumsum(size)
                sums.append((run_up[ends] - run_up[ends - size]).view(np.int64))
            edge = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] + np.uint64(1)) != 0)
            token, count = hashes[edge], np.diff(edge, append=len(hashes))
            hot = count >= FREQUENT
            keep = ~np.repeat(hot, count)
            sketch = np.concatenate([_sketch(hashes, owner, by_text, np.cumsum(size), c) for c in range(0, n, 1000)])
            key = (TaskContext.get().partitionId() << 32) | number
            number += 1
            bucket = ((token >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            kept_owner, upto = owner[keep], np.concatenate([[0], np.cumsum(np.where(hot, 0, count))])
            rows = []
            for k in range(buckets):
                s, e = cuts[k], cuts[k + 1]
                if e > s:
                    rows.append((k, key, pack(token[s:e]), squeezed(np.minimum(count[s:e], FREQUENT).astype(np.uint8).tobytes()), squeezed(kept_owner[upto[s] : upto[e]].tobytes()), None))
            meta = np.concatenate([ids, size, *sums, *sketch.T]).tobytes()
            own = int(mix64(np.array([key], np.uint64))[0] % np.uint64(buckets))
            rows.append((own, key, pack(token[hot]), squeezed(count[hot].astype(np.uint16).tobytes()), squeezed(owner[~keep].tobytes()), meta))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOCK.types)], schema=_BLOCK)

    return run


def _answers(table: pa.Table) -> pa.Table:
    """For one bucket: which tokens of every batch occur in several texts, and in how many (up to FREQUENT)."""
    rows = table.to_pylist()
    mine = [r for r in rows if r["meta"] is None]
    out = [(0, r["batch"], r["tokens"], r["counts"], r["owners"], r["meta"]) for r in rows if r["meta"] is not None]
    if mine:
        tokens = [unpack(r["tokens"]) for r in mine]
        counts = [np.frombuffer(whole(r["counts"]), np.uint8) for r in mine]
        every = np.concatenate(tokens)
        order = np.argsort(every, kind="stable")
        edge = np.flatnonzero(np.diff(every[order], prepend=every[order[:1]] + np.uint64(1)) != 0)
        total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), edge)
        found = np.empty(len(every), np.uint8)
        found[order] = np.repeat(np.minimum(total, FREQUENT).astype(np.uint8), np.diff(edge, append=len(every)))
        at = 0
        for r, token, count in zip(mine, tokens, counts):
            level = found[at : at + len(token)]
            at += len(token)
            take = (level > 1) & (count < FREQUENT)
            if take.any():
                owners = np.frombuffer(whole(r["owners"]), np.uint16)[np.repeat(take[count < FREQUENT], count[count < FREQUENT])]
                packed = squeezed(np.concatenate([level[take], count[take]]).tobytes())
                out.append((0, r["batch"], pack(token[take]), packed, squeezed(owners.tobytes()), None))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _BLOCK.types)] if out else [pa.array([], t) for t in _BLOCK.types], schema=_BLOCK)


def signatures(n: int, tokens: np.ndarray, level: np.ndarray) -> np.ndarray | None:
    """Index keys of a set of n tokens, given those that occur elsewhere; None if it cannot have a partner."""
    alone, lacking = n - len(tokens), (PERCENT_OF - PERCENT) * n // PERCENT_OF
    if alone > lacking:
        return None
    order = np.lexsort((tokens, level))
    tokens, rare = tokens[order], int(np.count_nonzero(level < FREQUENT))
    if alone + rare > lacking:
        return tokens[: lacking + 1 - alone]
    chain = tokens[rare:][: 2 * n // 5 - 2 * (alone + rare) + 2]
    pairs = mix64(chain[:-1] * _FACTORS[0] + chain[1:] * _FACTORS[1] + _LENGTH)
    return np.concatenate([tokens[:rare], pairs])


_SET = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64())), ("shared", pa.binary()), ("sketch", pa.list_(pa.int64()))])
SET_SCHEMA = "doc_id long, n long, d1 long, d2 long, keys array<long>, shared binary, sketch array<long>"


def _assembled(table: pa.Table) -> pa.Table:
    """For one batch: every text's size and digest and, where it may have partners, its keys and shared tokens."""
    token, level, owner = [], [], []
    for r in table.to_pylist():
        found = unpack(r["tokens"])
        if r["meta"] is not None:
            ids, size, d1, d2, *sketch = np.frombuffer(r["meta"], np.int64).reshape(4 + SKETCH_BITS // 64, -1)
            count, lv = np.frombuffer(whole(r["counts"]), np.uint16), np.full(len(found), FREQUENT, np.uint8)
        else:
            lv, count = np.frombuffer(whole(r["counts"]), np.uint8).reshape(2, -1)
        token.append(np.repeat(found, count))
        level.append(np.repeat(lv, count))
        owner.append(np.frombuffer(whole(r["owners"]), np.uint16))
    token, level, owner = map(np.concatenate, (token, level, owner))
    order = np.lexsort((token, owner))
    token, level = token[order], level[order]
    ends = np.cumsum(np.bincount(owner, minlength=len(ids)))
    keys, shared, sketches, start = [], [], [], 0
    for n, end, parity in zip(size.tolist(), ends.tolist(), np.stack(sketch, 1)):
        own = signatures(n, token[start:end], level[start:end]) if n else None
        keys.append(None if own is None else own.view(np.int64))
        shared.append(None if own is None else token[start:end].tobytes())
        sketches.append(None if own is None else parity)
        start = end
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip((ids, size, d1, d2, keys, shared, sketches), _SET.types)], schema=_SET)


def token_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest (d1, d2), index keys and shared tokens of every row."""
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    small_batches(docs.sparkSession)
    blocks = docs.mapInArrow(tidy(_blocks(max(8, -(-chars // BUCKET_CHARS)))), BLOCK_SCHEMA)
    return blocks.groupBy("bucket").applyInArrow(tidy_group(_answers), BLOCK_SCHEMA).groupBy("batch").applyInArrow(tidy_group(_assembled), SET_SCHEMA)


def _verified(batches):
    for pdf in batches:
        ok = []
        for x, y, n, m in zip(pdf["shared_a"], pdf["shared_b"], pdf["n_a"], pdf["n_b"]):
            both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            ok.append(PERCENT_OF * both >= PERCENT * (n + m - both))
        yield pdf.loc[np.array(ok, bool), ["a", "b"]]


def near(a: str, b: str, n: str, m: str):
    """Whether two sets of n and m tokens may link, by their sizes and sketches.

    A linking pair differs in a fifth of its union at most, and its union is (n + m) / 1.8 at most.
    """
    differ = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH_BITS // 64))
    return F.expr(f"{PERCENT_OF} * least({n}, {m}) >= {PERCENT} * greatest({n}, {m}) AND ({differ}) * {PERCENT_OF + PERCENT} <= {PERCENT_OF - PERCENT} * ({n} + {m})")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Sketches are compared first, and sets fetched for what is left."""
    small = sets.select("doc_id", "n", "sketch")
    x, y = (small.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    some = pairs.join(y, "b").join(x, "a").filter(near("sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b", "n_a", "n_b")
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("shared").alias(f"shared_{c}")) for c in "ab")
    return some.join(right, "b").join(left, "a").mapInPandas(_verified, "a long, b long")


#: Rounds of leaders at most, before what is left is compared in full.
ROUNDS = 8
#: A key of so many texts is done when they have met its smallest and largest ids.
FEW = 3


def _pairs(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linked(sets: DataFrame) -> DataFrame:
    """(node, component) of the linked ids among rows (doc_id, n, keys, shared, sketch) with distinct sets."""
    postings = cut(sets.select("doc_id", F.explode("keys").alias("key")))
    keys = postings.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("texts")).filter("low < high")
    active = cut(postings.join(cut(keys), "key"))
    few, many = active.filter(F.col("texts") <= FEW), active.filter(F.col("texts") > FEW)
    one = many.groupBy("doc_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    lead = few.select(*_pairs("low", "doc_id")).union(few.select(*_pairs("doc_id", "high"))).union(one.select(*_pairs("low", "doc_id"))).union(one.select(*_pairs("doc_id", "high")))
    found = cut(verify(lead.filter("a < b").distinct(), sets))
    release(sets.sparkSession)
    active, last = many.select("key", "doc_id"), None
    for turn in range(ROUNDS + 1):
        labels = cut(components(found))
        marked = active.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label"))
        marked = cut(marked)
        groups = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("g"), F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), "doc_id")).alias("one"))
        stat = groups.groupBy("key").agg(F.max(F.struct("g", "label", "one")).alias("main"), F.sum("g").alias("all"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
        stat = cut(stat.select("key", F.col("main.label").alias("main"), F.col("main.one").alias("leader"), (F.col("all") - F.col("main.g")).alias("minor")))
        rows = stat.agg(F.sum("minor")).first()[0]
        if not rows:
            return labels
        open_ = marked.join(stat, "key")
        minor = open_.filter("label != main")
        if turn == ROUNDS or last is not None and rows > 0.9 * last:
            small = sets.select("doc_id", "n", "sketch")
            x, y = minor.join(small, "doc_id").alias("x"), open_.join(small, "doc_id").alias("y")
            crossing = F.expr("x.key = y.key AND x.label != y.label AND (y.label = y.main OR x.doc_id < y.doc_id)")
            pairs = x.join(y, crossing & near("x.sketch", "y.sketch", "x.n", "y.n")).select(*_pairs("x.doc_id", "y.doc_id")).distinct()
            return components(found.union(cut(verify(pairs, sets))))
        last = rows
        # one leader for each text: the main component's, of the key where its hash is least
        pairs = minor.groupBy("doc_id").agg(F.min("leader").alias("leader")).select(*_pairs("doc_id", "leader.doc_id")).distinct()
        found = cut(found.union(verify(pairs, sets)))
        release(sets.sparkSession)
        active = open_.select("key", "doc_id")
    raise AssertionError("the last round returns")


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set) and component_id of every row."""
    spark = docs.sparkSession
    every = cut(token_sets(docs))
    release(spark)
    same = every.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id"))
    named = cut(every.select("doc_id", "n", "d1", "d2").join(same, ["n", "d1", "d2"], "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")))
    firsts = named.select("class_id").distinct().withColumnRenamed("class_id", "doc_id")
    sets = every.filter("keys IS NOT NULL").join(firsts, "doc_id", "left_semi")
    sets = cut(sets.groupBy("doc_id").agg(F.max(F.struct("n", "d1", "d2", "keys", "shared", "sketch")).alias("set")).select("doc_id", "set.n", "set.keys", "set.shared", "set.sketch"))
    discard(every)
    release(spark)
    found = linked(sets).withColumnRenamed("node", "class_id")
    rows = named.join(found, "class_id", "left").select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    none = F.lit(None).cast("long")
    return rows.union(docs.filter("doc_id IS NULL").select("doc_id", none, none, none))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(documents(spark, sf_dir))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS x FROM d
), u AS (
  SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id, doc_id AS reached FROM s UNION SELECT r.doc_id, l.b FROM r JOIN both_ways l ON l.a = r.reached
), c AS (
  SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(x) AS BIGINT) AS n_shingles, CASE WHEN len(x) > 0 THEN min(s.doc_id) OVER (PARTITION BY x) ELSE s.doc_id END AS class_id, component_id FROM s JOIN c ON c.doc_id = s.doc_id
"""


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates (that with the smallest id), all columns; for use as a pipeline stage.

    Rows are told apart by a number, so repeated rows and rows without ids are compared like all others.
    """
    rows = keyed(docs)
    found = join_components(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("doc_id").alias("key"), "component_id")
    several = found.groupBy("component_id").count().filter("count > 1").select("component_id")
    groups = cut(found.join(several, "component_id"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    first = groups.join(rows.select("key", F.col("row.doc_id").alias("id")), "key").groupBy("component_id").agg(least.alias("first")).select("component_id", "first.key")
    go = groups.join(first.withColumnRenamed("key", "stays"), "component_id").filter("key != stays").select("key")
    return rows.join(go, "key", "left_anti").select("row.*")
