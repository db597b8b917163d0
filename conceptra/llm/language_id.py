"""Language identification with bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of the letter trigrams (with word edges) that belong to it; the
filters are stored as slices, so that one table slot holds a bit mask of languages (a further word of
bits for each 64 of them) and the AND of an n-gram's slots gives all languages that contain it. A text's
hits per language are popcounts over its n-grams, corrected by each filter's false-positive rate; the
largest corrected count decides.

Learning: from texts with a known language, thinned by a hash of the id to about ``SAMPLE_ROWS`` rows.
All n-grams that occur ``MIN_COUNT`` times there in a language count, and the filters grow with the
largest number of them. An n-gram belongs to a language if its share there is at least ``RELATIVE`` of
its largest share in any.

A null text, or one without letters, gets ``und`` and score 0; so does every text if nothing could
be learned. Ties go to the language that sorts first. Texts are taken ``PART`` characters at a time, so
a very long one needs no more memory than others. Repeated rows get equal results; only doc_id, text
and (for learning) lang are read. No rows in: no rows out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, mix64, sample_share, small_batches, tidy

SAMPLE_ROWS = 20_000
RELATIVE = 0.2
MIN_COUNT = 3
#: Bits of the least number of slots; there are more where a language has more than a quarter as many n-grams.
SLOT_BITS = 18
HASHES = 3
#: Characters of text whose n-grams are held at once.
PART = 1 << 20
UNKNOWN = "und"

_LETTERS: np.ndarray | None = None


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of all texts (each centred on a letter; other characters count as an edge), and the count of each text."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join([*lowered, ""])).encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTERS[np.minimum(points, 0x10FFFF)]
    clean = np.where(letter, points, 0).astype(np.uint64)
    middle = np.flatnonzero(letter[1:-1]) + 1
    packed = clean[middle - 1] << np.uint64(42) | clean[middle] << np.uint64(21) | clean[middle + 1]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return packed, np.diff(np.searchsorted(middle, ends, side="right"), prepend=0)


def parts(text: str) -> list[str]:
    """A long text cut where a trigram would see an edge anyway: before a character that is no letter."""
    out, at = [], 0
    while len(text) - at > PART:
        end = at + PART
        while end < len(text) and text[end].isalpha():
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


class Filters:
    """The sliced filters: ``table[:, slot]`` is the mask of languages with that bit set."""

    def __init__(self, per_language: dict[str, np.ndarray], bits: int = SLOT_BITS, hashes: int = HASHES):
        self.languages, self.hashes = sorted(per_language), hashes
        self.bits = max(bits, int(4 * max(map(len, per_language.values()), default=0)).bit_length())
        self.table = np.zeros((max(1, -(-len(self.languages) // 64)), 1 << self.bits), np.uint64)
        fill = []
        for i, name in enumerate(self.languages):
            word, bit = self.table[i // 64], np.uint64(1 << i % 64)
            for slots in self.slots(per_language[name]):
                word[slots] |= bit
            fill.append(np.count_nonzero(word & bit) / len(word))
        self.false_rate = np.array(fill) ** hashes

    def slots(self, packed: np.ndarray):
        h = mix64(packed)
        low, step = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        for k in range(self.hashes):
            yield ((low + np.uint64(k) * step) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def masks(self, packed: np.ndarray) -> np.ndarray:
        """A row of masks for each 64 languages."""
        out = None
        for slots in self.slots(packed):
            out = self.table[:, slots] if out is None else out & self.table[:, slots]
        return out

    def seen(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, those of each text in each language's filter)."""
        packed, counts = grams(texts)
        seen = np.zeros((len(texts), len(self.languages)), np.int64)
        if len(packed) and self.languages:
            masks, ends = self.masks(packed), np.cumsum(counts)
            for i in range(len(self.languages)):
                upto = np.concatenate([[0], np.cumsum((masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64))])
                seen[:, i] = upto[ends] - upto[ends - counts]
        return counts, seen

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        texts = [t if isinstance(t, str) else "" for t in texts]
        counts, seen = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)), np.int64)
        short = [i for i, t in enumerate(texts) if len(t) <= PART]
        if short:
            counts[short], seen[short] = self.seen([texts[i] for i in short])
        for i in set(range(len(texts))) - set(short):
            for part in parts(texts[i]):
                some = self.seen([part])
                counts[i] += some[0][0]
                seen[i] += some[1][0]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        hits = np.maximum(0, (seen - counts[:, None] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))
        best, total = hits.argmax(1), hits.sum(1)
        score = np.where(total > 0, hits.max(1) / np.maximum(total, 1e-12), 0.0)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, counts)]
        return names, np.clip(score, 0, 1).tolist()


def _gram_counts(batches):
    totals: dict[str, dict[int, int]] = {}
    for batch in batches:
        by: dict[str, list[str]] = {}
        for text, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            by.setdefault(name, []).extend(parts(text))
        for name, texts in by.items():
            for a, b in chunks([len(t) for t in texts], PART):
                keys, n = np.unique(grams(texts[a:b])[0], return_counts=True)
                own = totals.setdefault(name, {})
                for k, c in zip(keys.tolist(), n.tolist()):
                    own[k] = own.get(k, 0) + c
    for name, own in totals.items():
        columns = [pa.array([name] * len(own), pa.string()), pa.array(np.fromiter(own, np.int64, len(own))), pa.array(np.fromiter(own.values(), np.int64, len(own)))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Filters:
    """Filters from rows (doc_id, text, lang)."""
    small_batches(labelled.sparkSession)
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    total = labelled.select("doc_id", "lang").filter("lang IS NOT NULL").count()
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < sample_share(sample_rows, total))
    counted = picked.select("text", "lang").mapInArrow(tidy(_gram_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    found = counted.toArrow().combine_chunks()
    if not found.num_rows:
        return Filters({})
    names, lang = np.unique(np.array(found.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    gram, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    share = n / np.bincount(lang, weights=n)[lang]
    _, at = np.unique(gram, return_inverse=True)
    most = np.zeros(at.max() + 1)
    np.maximum.at(most, at, share)
    own = share >= RELATIVE * most[at]
    return Filters({str(name): gram[own & (lang == i)].astype(np.uint64) for i, name in enumerate(names)})


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every row. The filters go along with the tasks; their size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = [], []
            for a, b in chunks([len(t) if t else 0 for t in texts], PART):
                n, s = model.decide(texts[a:b])
                names += n
                scores += s
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, learn(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows whose text has a language, all columns; for use as a pipeline stage.

    Decided row by row as the rows go by, whatever their ids. Where nothing could be learned, nothing is rejected.
    """
    filters = learn(docs.filter(~held_out()))
    if not filters.languages:
        return docs
    shared, text = docs.sparkSession.sparkContext.broadcast(filters), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts, known = batch.column(text).to_pylist(), []
            for a, b in chunks([len(t) if t else 0 for t in texts], PART):
                known += [name != UNKNOWN for name in shared.value.decide(texts[a:b])[0]]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
