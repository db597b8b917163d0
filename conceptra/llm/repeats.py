"""Substring deduplication with common-prefix interval trees over enhanced suffix arrays.

Every 100-byte window has an anchor, the leftmost of its 24-byte grams with the least hash, so that
equal windows have equal anchors at equal offsets. The windows with one anchor form a context of
175 bytes at most. Contexts are sent to buckets by their anchors' hashes: of equal contexts all but
the first are repeats as a whole; anchors with several distinct contexts have one copy of each
compared in a bucket. There a suffix array of the contexts with its longest common prefixes is
scanned with a stack; the intervals form a tree, and an interval of 100 bytes or more whose
occurrences are preceded by different bytes (or start a context) is a maximal repeat. Its
occurrences but the first (smallest doc_id, then smallest start) are removed. Any repeated window
extends to such a maximal repeat with the same occurrences, so exactly the bytes covered by a
100-byte string that also starts earlier are removed.

Null and empty texts have no bytes and stay; texts below 100 bytes stay. Repeated rows of one doc_id
have equal positions, so none is earlier. A row without an id is left as it is and repeats nothing.
Matches never cross texts. Only doc_id and text are read. No rows in: no rows out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, documents, gathered, mix64, release, rolling, small_batches, tidy, tidy_group
from .ngram_join import pack, squeezed, unpack, whole

WINDOW, GRAM = 100, 24
GRAMS = WINDOW - GRAM + 1
BATCH_BYTES, BUCKET_CHARS, BUCKET_CONTEXTS = 6 << 20, 8 << 20, 10_000
_POSITION = np.uint64((1 << 28) - 1)
#: A longer text is taken in overlapping parts.
PART_BYTES = 1 << 24


def anchors(data: np.ndarray, bounds: np.ndarray):
    """(first window, last window, anchor's position, anchor's hash, context's hash) of all contexts of texts laid end to end."""
    empty = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums, down = rolling(data)
    gram = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    rows = -(-len(gram) // GRAMS)
    key = np.full(rows * GRAMS, np.iinfo(np.uint64).max, np.uint64)
    key[: len(gram)] = gram & ~_POSITION | np.arange(len(gram), dtype=np.uint64)
    key = key.reshape(rows, GRAMS)
    up, back = np.minimum.accumulate(key, axis=1).ravel(), np.ascontiguousarray(np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1]).ravel()
    windows = len(data) - WINDOW + 1
    at = (np.minimum(back[:windows], up[GRAMS - 1 : GRAMS - 1 + windows]) & _POSITION).astype(np.int64)
    starts, ends = bounds[:-1], bounds[1:]
    change = np.zeros(len(data) + 1, np.int32)
    fits = ends - starts >= WINDOW
    np.add.at(change, starts[fits], 1)
    np.add.at(change, ends[fits] - WINDOW + 1, -1)
    valid = np.cumsum(change[:windows]) > 0
    fresh = np.ones(windows, bool)
    fresh[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    fresh[starts[fits]] = True
    first = np.flatnonzero(fresh & valid)
    done = np.ones(windows, bool)
    done[:-1] = fresh[1:] | ~valid[1:]
    last = np.flatnonzero(done & valid)
    place = at[first]
    size = (last - first + WINDOW).astype(np.uint64)
    context = mix64((sums[last + WINDOW] - sums[first]) * down[first] + size * np.uint64(0xD6E8FEB86659FD93) + (place - first).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    return first, last, place, gram[place], context


_BLOCK = pa.schema([("bucket", pa.int32()), ("anchor", pa.binary()), ("rest", pa.binary()), ("ids", pa.binary())])
BLOCK_SCHEMA = "bucket int, anchor binary, rest binary, ids binary"
_REST = np.dtype([("context", "<u8"), ("start", "<u4"), ("owner", "<u2"), ("span", "u1"), ("off", "u1")])


def _parts(text: bytes):
    """(offset, part) such that every window lies in exactly one part."""
    if len(text) <= PART_BYTES:
        return [(0, text)]
    return [(a, text[a : a + PART_BYTES + WINDOW - 1]) for a in range(0, max(1, len(text) - WINDOW + 1), PART_BYTES)]


def _blocks(buckets: int):
    def run(batches):
        for names, texts in gathered(batches, BATCH_BYTES):
            pieces = [(i, at, part) for i, text in enumerate(texts) for at, part in _parts(text)]
            anchor, rest = [], []
            for c, d in chunks([len(p[2]) for p in pieces]):
                some = pieces[c:d]
                bounds = np.cumsum([0, *(len(p[2]) for p in some)])
                first, last, place, gram, context = anchors(np.frombuffer(b"".join(p[2] for p in some), np.uint8), bounds)
                which = np.searchsorted(bounds, first, side="right") - 1
                rows = np.empty(len(first), _REST)
                rows["context"], rows["span"], rows["off"] = context, last - first, place - first
                rows["start"] = first - bounds[which] + np.array([p[1] for p in some], np.int64)[which]
                rows["owner"] = np.array([p[0] for p in some], np.int64)[which]
                anchor.append(gram)
                rest.append(rows)
            anchor, rest = np.concatenate(anchor), np.concatenate(rest)
            # an anchor is the least hash of many: mixed once more, all buckets get their share
            spread = mix64(anchor)
            order = np.argsort(spread, kind="stable")
            anchor, rest, spread = anchor[order], rest[order], spread[order]
            bucket = ((spread >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            ids = names.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rows = []
            for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                if e > s:
                    by = np.argsort(anchor[s:e], kind="stable")
                    # only the ids that this bucket's contexts belong to
                    some, at = np.unique(rest["owner"][s:e][by], return_inverse=True)
                    own = rest[s:e][by]
                    own["owner"] = at
                    rows.append((k, pack(anchor[s:e][by]), squeezed(np.ascontiguousarray(own.view(np.uint8).reshape(-1, _REST.itemsize).T).tobytes()), squeezed(ids[some].tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOCK.types)], schema=_BLOCK)

    return run


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("anchor", pa.int64())])
FOUND_SCHEMA = "doc_id long, start long, size int, anchor long"


def _sorted_out(table: pa.Table) -> pa.Table:
    """For one bucket: repeated contexts (anchor null) and contexts still to compare (with their anchor)."""
    anchor, rest, ids = [], [], []
    for a, r, i in zip(*(table.column(c).to_pylist() for c in ("anchor", "rest", "ids"))):
        anchor.append(unpack(a))
        rest.append(np.ascontiguousarray(np.frombuffer(whole(r), np.uint8).reshape(_REST.itemsize, -1).T).view(_REST).ravel())
        ids.append(np.frombuffer(whole(i), np.int64)[rest[-1]["owner"]])
    anchor, rest, ids = map(np.concatenate, (anchor, rest, ids))
    order = np.lexsort((rest["start"], ids, rest["context"], anchor))
    anchor, rest, ids = anchor[order], rest[order], ids[order]
    new_anchor, new_context = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
    new_anchor[1:] = anchor[1:] != anchor[:-1]
    new_context[1:] = new_anchor[1:] | (rest["context"][1:] != rest["context"][:-1])
    lead = np.flatnonzero(new_context)
    leader = lead[np.cumsum(new_context) - 1]
    repeat = (ids != ids[leader]) | (rest["start"] != rest["start"][leader])
    group = np.cumsum(new_anchor) - 1
    several = np.add.reduceat(new_context.astype(np.int64), np.flatnonzero(new_anchor)) > 1
    compare = new_context & several[group]
    take = np.flatnonzero(repeat | compare)
    mark = pa.array(anchor[take].view(np.int64), pa.int64(), mask=repeat[take])
    return pa.Table.from_arrays([pa.array(ids[take]), pa.array(rest["start"][take].astype(np.int64)), pa.array(rest["span"][take].astype(np.int32) + WINDOW), mark], schema=_FOUND)


_BODY = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("body", pa.binary())])
BODY_SCHEMA = "bucket int, doc_id long, start long, body binary"


def _bodies(buckets: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "wanted"))):
                data = (text or "").encode("utf-8", "replace")
                for w in wanted:
                    spread = int(mix64(np.array([w["anchor"]], np.int64).view(np.uint64))[0] % np.uint64(buckets))
                    rows.append((spread, doc, w["start"], data[w["start"] : w["start"] + w["size"]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BODY.types)] if rows else [pa.array([], t) for t in _BODY.types], schema=_BODY)

    return run


_STEPS = (7, 14, 28, 56, 112, 224)


class SuffixArray:
    """Prefix ranks of all positions of texts laid end to end with separators, by doubling."""

    def __init__(self, bodies: list[bytes]):
        sizes = np.array([len(b) for b in bodies], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.size = int((sizes + 1).sum())
        self.symbols = np.full(self.size + 2 * _STEPS[-1], 256, np.uint16)
        joined = np.frombuffer(b"".join(bodies), np.uint8)
        inside = np.ones(self.size, bool)
        inside[self.starts + sizes] = False
        self.symbols[: self.size][inside] = joined
        # bytes from a position to the end of its text
        self.left = np.repeat(self.starts + sizes, sizes + 1) - np.arange(self.size)
        key = np.zeros(self.size, np.uint64)
        for k in range(_STEPS[0]):
            key = key << np.uint64(9) | self.symbols[k : k + self.size].astype(np.uint64)
        self.ranks = {_STEPS[0]: self._rank(key)}
        for small, large in zip(_STEPS, _STEPS[1:]):
            self.ranks[large] = self._rank(self._pair(self.ranks[small], small))

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        step = np.zeros(len(key), np.uint32)
        key = key[order]
        step[1:] = key[1:] != key[:-1]
        out = np.empty(len(key), np.uint32)
        out[order] = np.cumsum(step) + 1
        return out

    @staticmethod
    def _pair(rank: np.ndarray, shift: int) -> np.ndarray:
        later = np.zeros(len(rank), np.uint32)
        later[: max(0, len(rank) - shift)] = rank[shift:]
        return rank.astype(np.uint64) << np.uint64(32) | later

    def prefix(self, at: np.ndarray, size: int) -> np.ndarray:
        """Keys that are equal exactly for positions with equal prefixes of this size (56 to 112)."""
        return self.ranks[56][at].astype(np.uint64) << np.uint64(32) | self.ranks[56][at + size - 56].astype(np.uint64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes, within the texts' ends."""
        out = np.zeros(len(a), np.int64)
        for step in reversed(_STEPS):
            inside = np.maximum(a, b) + out < self.size
            x, y = np.minimum(a + out, self.size - 1), np.minimum(b + out, self.size - 1)
            out += np.where(inside & (self.ranks[step][x] == self.ranks[step][y]), step, 0)
        for _ in range(_STEPS[0] - 1):
            out += self.symbols[a + out] == self.symbols[b + out]
        return np.minimum(out, np.minimum(self.left[a], self.left[b]))


def maximal_repeats(bodies: list[bytes], starts: list[np.ndarray] | None = None, least: int = WINDOW):
    """(length, positions) of every maximal repeat of ``least`` (56 to 112) bytes or more.

    Positions are (text number, offset) pairs. ``bodies`` are 223 bytes long at most; the start of a
    text counts as preceded by a byte of its own.
    """
    array = SuffixArray(bodies)
    at = np.flatnonzero(array.left >= least)
    if not len(at):
        return
    # groups of equal windows; those preceded by one and the same byte are no longer maximal to the left
    key = array.prefix(at, least)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    number = np.diff(edge, append=len(at))
    before = np.where(at > 0, array.symbols[at - 1], 256).astype(np.int64)
    own = before == 256
    low, high = np.minimum.reduceat(before, edge), np.maximum.reduceat(before, edge)
    diverse = ((low != high) | np.logical_or.reduceat(own, edge)) & (number > 1)
    keep = np.repeat(diverse, number)
    at, before = at[keep], before[keep]
    if not len(at):
        return
    order = np.argsort(array.ranks[_STEPS[-1]][at], kind="stable")
    at, before = at[order], before[order]
    lcp = np.concatenate([array.common(at[:-1], at[1:]), [0]]).tolist()
    text = np.searchsorted(array.starts, at, side="right") - 1
    offset = at - array.starts[text]
    # the interval tree, bottom up: an open interval is [length, first suffix]
    change = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] == 256))]).tolist()
    open_: list[list[int]] = []
    for i, common in enumerate(lcp):
        first = i
        while open_ and open_[-1][0] > common:
            length, first = open_.pop()
            if change[i] != change[first]:
                yield length, np.stack([text[first : i + 1], offset[first : i + 1]], 1)
        if common >= least and (not open_ or open_[-1][0] < common):
            open_.append([common, first])


def _compared(table: pa.Table) -> pa.Table:
    ids, start, bodies = table.column("doc_id").to_numpy(), table.column("start").to_numpy(), table.column("body").to_pylist()
    order = np.lexsort((start, ids))
    ids, start, bodies = ids[order], start[order], [bodies[i] for i in order]
    doc, at, size = [], [], []
    for length, where in maximal_repeats(bodies):
        d, s = ids[where[:, 0]], start[where[:, 0]] + where[:, 1]
        first = np.lexsort((s, d))[0]
        later = (d != d[first]) | (s != s[first])
        doc.append(d[later])
        at.append(s[later])
        size.append(np.full(int(later.sum()), length, np.int32))
    if not doc:
        return pa.Table.from_arrays([pa.array([], t) for t in _FOUND.types], schema=_FOUND)
    doc, at, size = united(*map(np.concatenate, (doc, at, size)))
    return pa.Table.from_arrays([pa.array(doc), pa.array(at), pa.array(size.astype(np.int32)), pa.nulls(len(doc), pa.int64())], schema=_FOUND)


def united(doc: np.ndarray, start: np.ndarray, size: np.ndarray):
    """The union of ranges, document by document. Nested repeats cover the same bytes again and again."""
    order = np.lexsort((start, doc))
    doc, start, size = doc[order], start[order], size[order].astype(np.int64)
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    # one axis for all documents: the ends reached so far within each
    span = int((start + size).max()) + 1
    reach = np.maximum.accumulate(number * span + start + size)
    fresh = np.concatenate([[True], (number * span + start)[1:] > reach[:-1]])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    return doc[first], start[first], reach[last] - number[first] * span - start[first]


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def runs(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of the union of intervals, each packed as start << 32 | size."""
    packed = np.sort(packed)
    start = packed >> 32
    reach = np.maximum.accumulate(start + (packed & 0xFFFFFFFF))
    fresh = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[fresh], reach[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(start) - 1]])]


def _removed(batches):
    for batch in batches:
        rows = []
        for doc, text, gone in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("gone")):
            data, removed, spans = (text or "").encode("utf-8", "replace"), 0, 0
            kept = hashlib.sha256()
            if gone.is_valid and len(gone):
                at, (first, last) = 0, runs(gone.values.to_numpy())
                spans, removed = len(first), int((last - first).sum())
                for s, e in zip(first.tolist(), last.tolist()):
                    kept.update(data[at:s])
                    at = e
                kept.update(data[at:])
            else:
                kept.update(data)
            rows.append((doc, len(data), removed, spans, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RESULT.types)] if rows else [pa.array([], t) for t in _RESULT.types], schema=_RESULT)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, size) of the byte ranges to remove; they overlap."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = docs.mapInArrow(tidy(_blocks(max(8, -(-chars // BUCKET_CHARS)))), BLOCK_SCHEMA)
    found = cut(blocks.groupBy("bucket").applyInArrow(tidy_group(_sorted_out), FOUND_SCHEMA))
    release(docs.sparkSession)
    open_ = found.filter("anchor IS NOT NULL")
    buckets = max(8, -(-open_.count() // BUCKET_CONTEXTS))
    wanted = open_.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "anchor")).alias("wanted"))
    bodies = docs.join(wanted, "doc_id").mapInArrow(tidy(_bodies(buckets)), BODY_SCHEMA)
    more = cut(bodies.groupBy("bucket").applyInArrow(tidy_group(_compared), FOUND_SCHEMA))
    release(docs.sparkSession)
    return found.filter("anchor IS NULL").union(more).select("doc_id", "start", "size")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    lists = spans(docs).groupBy("doc_id").agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("size").cast("long"))).alias("gone"))
    return docs.select("doc_id", "text").join(lists, "doc_id", "left").mapInArrow(tidy(_removed), RESULT_SCHEMA)


OP5_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)
), f AS (
  SELECT g, min(struct_pack(d := doc_id, i := i)) AS first FROM w GROUP BY g HAVING count(*) > 1
), r AS (
  SELECT w.doc_id, w.i FROM w JOIN f ON w.g = f.g WHERE w.doc_id <> f.first.d OR w.i <> f.first.i
), m AS (
  SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM r
), k AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY doc_id, run
), p AS (
  SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s
), c AS (
  SELECT p.doc_id, count(*) AS n_spans, sum(p.b - p.a) AS n_removed, max(p.b) AS last, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
