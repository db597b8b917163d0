"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _libc = ctypes.CDLL("libc.so.6")
    # Arrays of a few megabytes come and go all the time: keep their memory (up to 64 MB) while a task
    # runs, instead of having each page made anew. M_MMAP_THRESHOLD is -3, M_TRIM_THRESHOLD -1.
    _libc.mallopt(-3, 32 << 20)
    _libc.mallopt(-1, 64 << 20)
except (OSError, AttributeError):  # another C library: only slower
    _libc = None

#: Text whose bytes are turned into arrays at once; larger texts are taken alone.
CHUNK_BYTES = 1 << 21
#: Rows of a part of a batch.
MOST_ROWS = (1 << 16) - 1

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's. On one machine an own one where none is set, as in tests."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="checkpoint-")
    return _own_dir


_own_dir: str | None = None


def cut(df: DataFrame, **options) -> DataFrame:
    """The same rows with the lineage cut: written to the shared folder as Parquet and read again.

    Columnar files are a fraction of what ``checkpoint()`` writes for the same rows, and later steps
    read only the columns they need. ``options`` are those of the writer.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """(key, row): every row as a struct, whatever its columns are called, with a key of its own.

    The key is doc_id where every row has one of its own. Otherwise rows are numbered, and written, so
    that the numbers stay the same however often they are read.
    """
    shared = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL")
    if shared.isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("key"), F.struct("*").alias("row"))
    return cut(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")))


def trim() -> None:
    """Gives memory that is not in use back to the machine: a worker that waits holds nothing that others need."""
    global _powers, _inverses
    _powers, _inverses = _powers[:1].copy(), _inverses[:1].copy()
    pa.default_memory_pool().release_unused()
    if _libc:
        _libc.malloc_trim(0)


def tidy(run):
    """A function of batches that gives its memory back at the end."""

    def tidied(batches):
        yield from run(batches)
        trim()

    return tidied


def tidy_group(run):
    """The same for a function of a group's table."""

    def tidied(table):
        out = run(table)
        trim()
        return out

    return tidied


#: Rows of an Arrow batch where the session has Spark's default: a batch of texts is held by the executor and its worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Makes batches of whole texts small, unless the session was told otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def discard(df: DataFrame) -> None:
    """Deletes the files of a frame that ``cut`` returned and that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("cut-"):
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def release(spark: SparkSession) -> None:
    """Lets the driver drop the shuffle files of frames that are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, limit: int):
    """Parts of a batch (doc_id, text) as (doc_ids, texts as bytes) of about ``limit`` bytes, so that a batch is never held twice.

    A part has at most 65,535 rows, whose numbers fit in 16 bits.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    for a, b in ((x, min(x + MOST_ROWS, end)) for start, end in chunks(sizes, limit) for x in range(start, end, MOST_ROWS)):
        yield batch.column("doc_id").slice(a, b - a), [t.encode("utf-8", "replace") if t else b"" for t in batch.column("text").slice(a, b - a).to_pylist()]


def gathered(batches, limit: int):
    """What ``slices`` gives, over all batches together: (doc_ids, texts as bytes) of about ``limit`` bytes and at most 65,535 rows."""
    names, held, size = [], [], 0
    for batch in batches:
        for some, texts in slices(batch, max(1, limit // 16)):
            more = sum(map(len, texts))
            if held and (size + more > limit or len(held) + len(texts) > MOST_ROWS):
                yield pa.concat_arrays(names), held
                names, held, size = [], [], 0
            names.append(some)
            held += texts
            size += more
    if held:
        yield pa.concat_arrays(names), held


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sample_share(wanted: int, total: int) -> int:
    """Which hashes below 2**62 to take for about ``wanted`` of ``total`` rows; never none."""
    return max(1, min(1 << 62, (wanted << 62) // max(1, total)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, np.uint64)
_inverse = pow(_BASE, -1, 1 << 64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers = np.full(size, _BASE, np.uint64)
        _inverses = np.full(size, _inverse, np.uint64)
        _powers[0] = _inverses[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverses, out=_inverses)
        if size > 4 * CHUNK_BYTES:  # a very long text; do not keep its tables
            kept = _powers, _inverses
            _powers, _inverses = _powers[:1].copy(), _inverses[:1].copy()
            return kept[0][:n], kept[1][:n]
    return _powers[:n], _inverses[:n]


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For bytes, (sums, inverse powers): the hash of data[s:e] is (sums[e] - sums[s]) * inverses[s]."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text.

    A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; with ``lower``, A-Z count as a-z.
    """
    joined = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    if lower:
        joined = LOWER[joined]
    space = SPACE[joined]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums, down = rolling(joined)
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    upto = np.searchsorted(starts, bounds)
    return hashes, np.diff(upto, prepend=0)


def chunks(sizes: list[int], limit: int = CHUNK_BYTES):
    """Slices (start, end) of consecutive items that hold about ``limit`` together."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


#: Links that one task joins; more of them are brought below that by steps on all machines first.
JOINED = 1 << 19


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) of the links a[i], b[i].

    In each round the roots take the smallest root that a link shows them; two rounds halve the roots
    of a component at least, so that a long chain takes as few rounds as a star.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _joined(batches):
    """``joined`` for all links (u, v) of a task."""
    parts = [[batch.column(c).to_numpy(zero_copy_only=False) for c in "uv"] for batch in batches]
    if parts:
        nodes, least = joined(*map(np.concatenate, zip(*parts)))
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(least[at : at + (1 << 16)])], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node of the links: (node, component).

    Up to ``JOINED`` links are joined by one task: a step on all machines has several shuffles, and what
    the driver keeps of their tasks adds up where there are many partitions. More links go through
    large-star and small-star steps in turn, which keep the components and end in stars around their
    smallest nodes, until so few are left or nothing changes; each step is two shuffles of at most as
    many rows as there are links, and minima are combined before the shuffle, so that one node with very
    many links is no bottleneck. Nodes without links do not appear. No links: no rows.
    """
    links = cut(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now[0] <= JOINED:
            return links.coalesce(1).mapInArrow(tidy(_joined), "node long, component long")
        if now == state:
            break
        state = now
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        links = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        hop = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        links = cut(hop.union(least).distinct())
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
