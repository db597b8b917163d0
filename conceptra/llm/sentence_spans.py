"""Substring deduplication by sliding sentence spans.

A sentence ends after marks such as ``.``, ``!`` and ``?`` that white space or the end of the text
follows, after full-width marks, and at line breaks; the white space that follows belongs to it. A
sentence of more than ``LONG_CHARS`` characters is cut further after commas, colons and semicolons, and
what is still longer before the first word that starts beyond that length: a passage is then several
pieces even where it has no sentence's end within. A run of consecutive pieces is a span if it has at
least ``MIN_SENTENCES`` of them and ``MIN_CHARS`` characters. Of the spans of a text, the shortest that
starts at each piece and the shortest that ends at each are hashed (128 bits): those inside a passage
cover all of it, so what any longer repeat would remove, they remove. They are counted over all
documents with map-side combination; of equal spans the first is that of the smallest (doc_id,
position). Pieces that any other occurrence covers are removed, all others stay as they are.

A text that holds no span, being of one piece or below ``MIN_CHARS`` characters, stays even where it
repeats as a whole; that is for exact deduplication. Null and empty texts have no spans and stay.
Pieces are compared without surrounding white space. Repeated rows of one doc_id hold the same positions,
so neither removes the other. A row without an id is left as it is and repeats nothing. Extra columns are
not read. A text is held whole by one worker, at some 100 bytes for each of its pieces. No rows in: no
rows out.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, small_batches, tidy

MIN_SENTENCES = 2
MIN_CHARS = 120
LONG_CHARS = 160

#: Fixed pattern: a sentence with its end marks and the white space after it, or what is left.
SENTENCE = re.compile(r"(?:[^.!?…。！？\n]++|[.!?…]++(?!\s|\Z))*+(?:[.!?…]++(?:\s++|\Z)|[。！？]++\s*+|\n\s*+)|.+", re.DOTALL)
#: Fixed pattern: a clause with its mark and the white space after it.
CLAUSE = re.compile(r"[^,;:]*[,;:]+\s*|[^,;:]+")


def sentences(text: str) -> list[str]:
    """Pieces whose concatenation is the text."""
    out = []
    for s in SENTENCE.findall(text):
        if len(s) <= LONG_CHARS:
            if s:
                out.append(s)
            continue
        for c in CLAUSE.findall(s):
            at = 0
            while len(c) - at > LONG_CHARS:
                word = _WORD.search(c, at + LONG_CHARS)
                if not word:
                    break
                out.append(c[at : word.end()])
                at = word.end()
            out.append(c[at:])
    return [s for s in out if s]


_WORD = re.compile(r"\s+")


def spans(pieces: list[str]) -> list[tuple[int, int, bytes]]:
    """(start, number of sentences, 16-byte hash) of the spans to compare."""
    bare = [p.strip() for p in pieces]
    own = [xxhash.xxh3_128_digest(b) for b in bare]
    upto, n = [0, *accumulate(map(len, bare))], len(bare)

    def enough(start: int, end: int) -> bool:
        return end - start >= MIN_SENTENCES and upto[end] - upto[start] >= MIN_CHARS

    found, end, start = {}, 0, 0
    for first in range(n):
        while end < n and not enough(first, end):
            end += 1
        if not enough(first, end):
            break
        found[first, end] = None
    for last in range(1, n + 1):
        while enough(start + 1, last):
            start += 1
        if enough(start, last):
            found[start, last] = None
    return [(a, b - a, xxhash.xxh3_128_digest(b"".join(own[a:b]))) for a, b in found]


SPAN_SCHEMA = "doc_id long, start int, n int, h1 long, h2 long"


def _span_rows(batches):
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        docs, starts, counts, hashes = [], [], [], []
        for doc, text in zip(ids, texts):
            text = text.as_py()
            if not text:
                continue
            found = spans(sentences(text))
            docs += [doc] * len(found)
            for s, n, h in found:
                starts.append(s)
                counts.append(n)
                hashes.append(h)
        halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        columns = [pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(counts, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n", "h1", "h2"])


def span_table(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInArrow(tidy(_span_rows), SPAN_SCHEMA)


def repeated(found: DataFrame) -> DataFrame:
    """(doc_id, start, n) of every span that also occurs earlier."""
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    # written first, so that a hot span's rows are dealt by nothing but the join, which can split them
    return found.join(cut(first), ["h1", "h2"]).filter("doc_id != first.doc_id OR start != first.start").select("doc_id", "start", "n")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("n_chars_removed", pa.int64()), ("text", pa.string())])
RESULT_SCHEMA = "doc_id long, n_sentences long, n_removed long, n_chars_removed long, text string"


def _apply(batches):
    for batch in batches:
        rows = []
        for doc, text, gone in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            pieces = sentences(text) if text else []
            if not gone:
                rows.append((doc, len(pieces), 0, 0, text))
                continue
            change = np.zeros(len(pieces) + 1, np.int64)
            for span in gone:
                change[span["start"]] += 1
                change[span["start"] + span["n"]] -= 1
            covered = np.cumsum(change[:-1]) > 0
            kept = "".join(p for p, c in zip(pieces, covered) if not c)
            rows.append((doc, len(pieces), int(covered.sum()), len(text) - len(kept), kept))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RESULT.types)] if rows else [pa.array([], t) for t in _RESULT.types], schema=_RESULT)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_chars_removed and what is left of the text, for every row."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = cut(span_table(docs))
    lists = repeated(found).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    return docs.join(lists, "doc_id", "left").mapInArrow(tidy(_apply), RESULT_SCHEMA)


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
