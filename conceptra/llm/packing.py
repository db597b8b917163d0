"""Packing of tokenised documents into windows, filled by lexical retrieval from a sharded BM25 index.

Documents are put in an order in which similar ones are neighbours. A tree of splits by two means each,
fitted on a sample of bounded size, gives a cell for each document's word counts. Of a document's
``SKETCH`` least hashes of runs of ``RUN`` tokens, the rarest one that another document shares is its
home; a home lies in one cell, that of its first document, and one of more than ``GROUP`` documents is
dealt over several by a hash of the row, so that no copy, however frequent, makes a large shard. Each task takes a range of this order with its share of all tokens and indexes
``SHARD_TOKENS`` of them at a time. So the work grows in proportion to the corpus and a shard has a
bounded size; only the sample and the sizes of the cells reach the driver.

A window starts with a seed document (or what is left of the one that was cut last) and takes the
seed's unused neighbours of the shard in order of their BM25 scores until it is full; the last one is
cut, and its rest starts the next window. When no neighbour is left, the next unused document in the
order of homes is taken and becomes the seed. Terms are words; those in more than ``COMMON`` of a
shard's documents are left out of the scores, which they would hardly change. A window that is open
when a shard ends goes on with the next shard of the task; only the last one of a task can stay short.

Each document ends with ``END``. Null text counts as empty: only the end token. Repeated rows are packed
each. Texts above ``CHUNK_BYTES`` are tokenised in parts cut at white space, so their length is bounded
by what one row can hold. Documents that are equal in everything keep a fixed order by their place in
the tokenised files, so a task that is run again places them alike. Only doc_id and text are read,
whatever else the columns are called. No rows in: no rows out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import CHUNK_BYTES, SPACE, chunks, cut, discard, documents, mix64, rolling, sample_share, small_batches, tidy
from .words import ending, runs, word_tokenizer

LENGTH, END = 4096, 2
#: Tokens of an index shard, shards from which on a task gets several, and tasks below which it gets one.
SHARD_TOKENS, TASKS, SHARDS_OF_TASK = 1_500_000, 2000, 64
K1, B = 1.2, 0.75
#: Share of a shard's documents above which a term is left out.
COMMON = 0.2
#: Tokens of a run (a power of two), runs in a sketch, and documents of a home that stay together.
RUN, SKETCH, GROUP = 8, 16, 64
#: Places of the vectors that choose a cell, levels of the tree of cells, and documents that it is fitted on.
WIDTH, LEVELS, SAMPLE = 1024, 8, 4096
#: Neighbours sorted at once.
TOP = 64


def _parts(column: pa.Array, limit: int):
    """Parts (column, first row, whether it goes on with the row before) of about ``limit`` bytes; long texts are cut at white space."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in chunks(sizes, limit):
        if sizes[a] <= limit:
            yield column.slice(a, b - a), a, False
            continue
        raw, at = np.frombuffer(column[a].as_buffer(), np.uint8), 0
        while at < len(raw):
            end = min(at + limit, len(raw))
            while end < len(raw) and not SPACE[raw[end : end + limit]].any():
                end = min(end + limit, len(raw))
            if end < len(raw):
                end += int(SPACE[raw[end : end + limit]].argmax())
            yield pa.array([raw[at:end].tobytes()], pa.binary()), a, at > 0
            at = end


def encoded(path: str, column: pa.Array, limit: int = CHUNK_BYTES):
    """Slices of a text column as (first row, ids of their texts one after the other, number of ids of each text)."""
    encode, held = word_tokenizer(path), None
    for part, row, more in _parts(column, limit):
        ids, counts = encode(part)
        if more:
            held = (held[0], [*held[1], ids], held[2] + counts)
            continue
        if held:
            yield held[0], np.concatenate(held[1]), held[2]
        held = row, [ids], counts
    if held:
        yield held[0], np.concatenate(held[1]), held[2]


def sketches(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least hashes of the runs of each text, at most ``SKETCH`` distinct ones, and their number for each text."""
    if len(ids) < RUN:
        return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    # runs of 1, 2, 4, .. tokens: two neighbouring ones make one of twice the length
    packed, factor = ids.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15
    for k in (1 << i for i in range(RUN.bit_length() - 1)):
        packed = packed[:-k] * np.uint64(factor) + packed[k:]
        factor = factor * factor % (1 << 64)
    hashes, ends = mix64(packed), np.cumsum(sizes)
    # a share of the hashes that holds enough of the least ones of each text
    runs = np.maximum(1, sizes - RUN + 1)
    share = np.minimum(3.0 * SKETCH / runs, 1.0) * float(2**64)
    limit = np.minimum(share, float(2**64 - 2**11)).astype(np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(hashes)]
    some = np.flatnonzero((hashes <= limit[owner]) & (np.arange(len(hashes)) + RUN <= ends[owner]))
    hashes, owner = hashes[some], owner[some]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    least = np.arange(len(owner)) - np.searchsorted(owner, owner) < SKETCH
    return hashes[least].view(np.int64), np.bincount(owner[least], minlength=len(sizes))


_ZSTD = pa.Codec("zstd", 1)


def packed_ids(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The ids of each document, compressed: they are written once and shuffled twice."""
    data, ends = memoryview(ids.tobytes()), (np.cumsum(sizes) * ids.itemsize).tolist()
    return pa.array([_ZSTD.compress(data[a:b], asbytes=True) for a, b in zip([0, *ends], ends)], pa.binary())


def packed_rows(found: np.ndarray) -> pa.Array:
    return pa.array([_ZSTD.compress(row.tobytes(), asbytes=True) for row in found], pa.binary())


def unpacked_ids(column: pa.Array, sizes: np.ndarray, kind) -> list[np.ndarray]:
    """What ``packed_ids`` was given, document by document."""
    width = np.dtype(kind).itemsize
    return [np.frombuffer(_ZSTD.decompress(c, n * width), kind) for c, n in zip(column.to_pylist(), sizes.tolist())]


def kind_of(ends: np.ndarray):
    return np.uint32 if len(ends) > 1 << 16 else np.uint16


TOKENISED = "key long, doc_id long, tokens long, ids binary, sketch array<long>"


def _tokenised(path: str):
    """Rows with their key (partition << 32 | place in it), token ids and sketch."""

    def run(batches):
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, ids, sizes in encoded(path, batch.column("text")):
                n, (hashes, found) = len(sizes), sketches(ids, sizes)
                ended = np.insert(ids, np.cumsum(sizes), ids.dtype.type(END))
                columns = [
                    pa.array(np.arange(key, key + n)), batch.column("doc_id").slice(first, n).cast(pa.int64()), pa.array(sizes + 1),
                    packed_ids(ended, sizes + 1), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found)]).astype(np.int32)), pa.array(hashes)),
                ]
                key += n
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "tokens", "ids", "sketch"])

    return run


def words_of(ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, a word being the ids up to one that ends it, and their number for each text."""
    last = ends[ids]
    borders = np.cumsum(sizes)[sizes > 0] - 1
    last[borders] = True
    at = np.flatnonzero(last)
    sums, down = rolling(ids)
    first = np.concatenate([[0], at[:-1] + 1]) if len(at) else at
    return mix64((sums[at + 1] - sums[first]) * down[first]), np.diff(np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)])))


class Bm25:
    """An inverted index over the terms of a shard's documents, given as hashes and their number for each document."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        # one number for a word and its document: plain numbers are sorted much faster than an order of them is found
        coded = pa.array(hashes).dictionary_encode()
        number = np.empty(len(coded.dictionary), np.uint64)
        number[np.argsort(coded.dictionary.to_numpy())] = np.arange(len(number), dtype=np.uint64)
        both = np.sort(number[coded.indices.to_numpy()] << np.uint64(32) | np.repeat(np.arange(n, dtype=np.uint64), sizes))
        fresh = np.flatnonzero(np.diff(both, prepend=~both[:1]))
        times = np.diff(fresh, append=len(both)).astype(np.float32)
        both = both[fresh]
        self.owner, term = (both & np.uint64((1 << 32) - 1)).astype(np.int64), (both >> np.uint64(32)).astype(np.int64)
        self.size = np.bincount(term, minlength=1)
        self.start = np.cumsum(self.size) - self.size
        idf = np.log1p((n - self.size + 0.5) / (self.size + 0.5)).astype(np.float32)
        norm = (K1 * (1 - B + B * sizes / max(1.0, sizes.mean() if n else 0.0))).astype(np.float32)
        self.weight = idf[term] * times * np.float32(K1 + 1) / (times + norm[self.owner])
        # terms of each document
        useful = (self.size > 1) & (self.size <= COMMON * n)
        own = np.flatnonzero(useful[term])
        own = own[np.argsort(self.owner[own], kind="stable")]
        self.terms, self.n = term[own], n
        self.upto = np.concatenate([[0], np.cumsum(np.bincount(self.owner[own], minlength=n))])

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[self.upto[seed] : self.upto[seed + 1]]
        at = runs(self.start[terms], self.size[terms])
        return np.bincount(self.owner[at], self.weight[at], self.n)

    def neighbours(self, seed: int, used: np.ndarray):
        """Unused documents that share terms with the seed, best first, ties by their order."""
        score = self.scores(seed)
        score[used] = 0
        some = np.flatnonzero(score > 0)
        if len(some) > 4 * TOP:
            least = np.partition(score[some], len(some) - TOP)[len(some) - TOP]
            best = some[score[some] >= least]
            yield from best[np.argsort(-score[best], kind="stable")].tolist()
            some = some[score[some] < least]
        yield from some[np.argsort(-score[some], kind="stable")].tolist()


class Windows:
    """Windows filled one after the other; ``number`` is the open one."""

    def __init__(self, first: int, length: int):
        self.number, self.offset, self.length = first, 0, length

    def place(self, size: int) -> tuple[list[tuple[int, int, int, int]], bool]:
        """Pieces (start, length, window, offset) of a document, and whether its rest opened a window."""
        pieces, start, closed = [], 0, False
        while start < size:
            part = min(size - start, self.length - self.offset)
            pieces.append((start, part, self.number, self.offset))
            start, self.offset = start + part, self.offset + part
            if self.offset == self.length:
                self.number, self.offset, closed = self.number + 1, 0, True
        return pieces, closed

    def fill(self, index: Bm25, sizes: np.ndarray):
        """(document, its pieces) for all documents of a shard."""
        used = np.zeros(len(sizes), bool)
        for first in range(len(sizes)):
            if used[first]:
                continue
            used[first] = True
            yield first, self.place(int(sizes[first]))[0]
            seed = first if self.offset else None
            while seed is not None:
                for doc in index.neighbours(seed, used):
                    used[doc] = True
                    pieces, closed = self.place(int(sizes[doc]))
                    yield doc, pieces
                    if closed:
                        # the document whose rest opened the window is the next seed
                        seed = doc if self.offset else None
                        break
                else:
                    seed = None


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def _packed(length: int, with_ids: bool, ends: np.ndarray):
    """Pieces of a partition's documents, a shard at a time."""

    def pieces(rows: pa.Table, windows: Windows):
        names, sizes = rows.column("doc_id").to_pylist(), rows.column("tokens").to_numpy()
        data = unpacked_ids(rows.column("ids"), sizes, kind_of(ends))
        out = []
        for doc, found in windows.fill(Bm25(*words_of(np.concatenate([d[:-1] for d in data]), sizes - 1, ends)), sizes):
            ids, tokens = data[doc].astype("<u4"), int(sizes[doc])
            for start, size, number, offset in found:
                part = ids[start : start + size].tobytes()
                out.append((names[doc], start, size, zlib.crc32(part), tokens, number, offset, part if with_ids else None))
        for a in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 1000]), _PIECE.types)], schema=_PIECE)

    def run(batches):
        windows, held, tokens = Windows(TaskContext.get().partitionId() << 32, length), [], 0
        for batch in batches:
            sizes = batch.column("tokens").to_pylist()
            for a, b in chunks(sizes, SHARD_TOKENS // 8):
                held.append(batch.slice(a, b - a))
                tokens += sum(sizes[a:b])
                if tokens >= SHARD_TOKENS:
                    yield from pieces(pa.Table.from_batches(held), windows)
                    held, tokens = [], 0
        if held:
            yield from pieces(pa.Table.from_batches(held), windows)

    return run


def vectors(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Unit vectors of the square roots of the texts' word counts, words dealt over ``WIDTH`` places."""
    found = np.bincount(np.repeat(np.arange(len(sizes)) * WIDTH, sizes) + (hashes % np.uint64(WIDTH)).astype(np.int64), minlength=len(sizes) * WIDTH)
    found = np.sqrt(found.reshape(len(sizes), WIDTH).astype(np.float32))
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), np.float32(1e-9))


class Tree:
    """Splits of the space of vectors by two means each, fitted on a sample; ``cells`` gives 0 .. 2**LEVELS - 1."""

    def __init__(self, sample: np.ndarray):
        self.ways, self.least = np.zeros((1 << LEVELS, WIDTH), np.float32), np.zeros(1 << LEVELS, np.float32)
        rng, at = np.random.default_rng(7), np.ones(len(sample), np.int64)
        for node in range(1, 1 << LEVELS):
            own = sample[at == node]
            if len(own) < 2:
                continue
            means = own[rng.choice(len(own), 2, replace=False)]
            for _ in range(8):
                first = own @ (means[0] - means[1]) > (means[0] @ means[0] - means[1] @ means[1]) / 2
                if first.all() or not first.any():
                    break
                means = np.stack([own[first].mean(0), own[~first].mean(0)])
            self.ways[node], self.least[node] = means[0] - means[1], (means[0] @ means[0] - means[1] @ means[1]) / 2
            at[at == node] = 2 * node + (own @ self.ways[node] <= self.least[node])

    def cells(self, found: np.ndarray) -> np.ndarray:
        at, over, every = np.ones(len(found), np.int64), found @ self.ways.T, np.arange(len(found))
        for _ in range(LEVELS):
            at = 2 * at + (over[every, at] <= self.least[at])
        return at - (1 << LEVELS)


def _of_batches(batches, columns: list[str], ends: np.ndarray, make):
    """Rows of ``make(vectors)`` beside the given columns."""
    for batch in batches:
        for a, b in chunks(batch.column("tokens").to_pylist(), 1 << 19):
            part = batch.slice(a, b - a)
            sizes = part.column("tokens").to_numpy()
            data = [ids[:-1] for ids in unpacked_ids(part.column("ids"), sizes, kind_of(ends))]
            for c in range(0, len(data), 500):
                own = part.slice(c, 500)
                found = make(vectors(*words_of(np.concatenate(data[c : c + 500]), sizes[c : c + 500] - 1, ends)))
                yield pa.RecordBatch.from_arrays([*(own.column(n) for n in columns), found], [*columns, "made"])


def fitted(tokenised: DataFrame, rows: int, ends: np.ndarray) -> Tree:
    """A tree fitted on the documents of the ``SAMPLE`` least hashes."""
    share = sample_share(2 * SAMPLE, rows)
    hashed = F.pmod(F.xxhash64("key"), F.lit(1 << 62))
    some = tokenised.select("tokens", "ids", hashed.alias("hash")).filter(F.col("hash") < share)
    # a vector has few different values; compressed, the sample takes little of the driver's memory
    made = some.mapInArrow(lambda batches: _of_batches(batches, ["hash"], ends, packed_rows), "hash long, made binary")
    found = made.orderBy("hash").limit(SAMPLE).toArrow().column("made").to_pylist()
    sample = np.empty((len(found), WIDTH), np.float32)
    for row, vector in zip(sample, found):
        row[:] = np.frombuffer(_ZSTD.decompress(vector, row.nbytes), np.float32)
    return Tree(sample)


def celled(tokenised: DataFrame, rows: int, ends: np.ndarray) -> DataFrame:
    """(key, tokens, sketch, cell) of tokenised rows."""
    spark = tokenised.sparkSession
    tree = spark.sparkContext.broadcast(fitted(tokenised, rows, ends))
    coded = tokenised.select("key", "tokens", "ids", "sketch").mapInArrow(
        lambda batches: tidy(lambda rows: _of_batches(batches, ["key", "tokens", "sketch"], ends, lambda found: pa.array(tree.value.cells(found))))(batches), "key long, tokens long, sketch array<long>, made long"
    )
    return coded.withColumnRenamed("made", "cell")


def places(coded: DataFrame) -> DataFrame:
    """(key, tokens, cell, home): the order of all documents is by cell, then home, then key."""
    runs = coded.select("key", "cell", F.explode("sketch").alias("run"))
    shared = runs.groupBy("run").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("key", "cell")).alias("first")).filter("texts > 1")
    homes = runs.select("key", "run").join(shared, "run").groupBy("key").agg(F.min(F.struct("texts", "run", "first.cell")).alias("at"))
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("at.texts") / GROUP))
    home = F.when(F.col("at").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("at.run", part))
    return coded.select("key", "tokens", "cell").join(homes, "key", "left").select("key", "tokens", F.coalesce("at.cell", "cell").alias("cell"), home.alias("home"))


def dealt(tokenised: DataFrame, ends: np.ndarray) -> DataFrame:
    """Tokenised rows, similar ones next to each other, in tasks of about equally many tokens.

    A cell is a range of the order as long as its tokens, and a home's place in it is drawn by its hash.
    """
    total, rows = tokenised.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    shards = -(-total // SHARD_TOKENS)
    tasks = max(1, min(shards, TASKS), -(-shards // SHARDS_OF_TASK))
    coded = cut(celled(tokenised, rows, ends))
    found = cut(places(coded))
    discard(coded)
    # at most 2**LEVELS rows
    cells = found.groupBy("cell").agg(F.sum("tokens").alias("words")).withColumn("base", F.sum("words").over(W.orderBy("cell")) - F.col("words"))
    at = F.col("base") + F.col("words") * (F.shiftrightunsigned("home", 11) / F.lit(float(1 << 53)))
    task = F.least(F.floor(at * (tasks / max(1, total))), F.lit(tasks - 1)).cast("int")
    found = found.join(F.broadcast(cells), "cell").select("key", "cell", "home", task.alias("task"))
    return tokenised.select("key", "doc_id", "tokens", "ids").join(found, "key").repartitionById(tasks, "task").sortWithinPartitions("cell", "home", "key").select("doc_id", "tokens", "ids")


def pack(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece: where it comes from (doc_id, start, length, doc_tokens), where it goes (sequence_id, offset), its ids."""
    small_batches(docs.sparkSession)
    tokenised = cut(docs.select("doc_id", "text").mapInArrow(tidy(_tokenised(path)), TOKENISED))
    ends = ending(path)
    return dealt(tokenised, ends).mapInArrow(tidy(_packed(length, with_ids, ends)), PIECE_SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path(), with_ids=False).drop("ids")
