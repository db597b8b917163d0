"""Near-duplicate embeddings by a forest of random-projection trees.

Every tree splits recursively at the median of projections on random directions (one direction per
level, a threshold per node); vectors close to a threshold go to both sides. Vectors are compared
within leaves, label by label, in double precision; the trees' links are united. The trees are fitted
on a sample of about ``SAMPLE_ROWS`` distinct vectors; all vectors are indexed.

A tree goes on splitting below the nodes that the sample can tell apart, as deep as the largest label
asks: there the thresholds are those of the last node with ``LEAST_SAMPLES`` sample rows, along a new
direction at each level, so that leaves stay small while the model does not grow with the data.

Splits would part most links inside a large cloud of near copies. The sample therefore also shows the
clouds that are larger than a part of a leaf: all vectors within ``COVER`` of a cloud's centre share one
more leaf, so that its links are counted whole. A cloud with too few vectors in the sample is not seen.

Equal vectors of a label are one class. Large leaves are compared in pairs of blocks. Links are
counted where they are found, never listed: a pair that shares several leaves counts in the first of
them, and components come from each block's spanning stars.

A vector that is null, empty, zero, or holds null or non-finite components links with nothing, and
so does a null label or id; it still gets its row. Vectors of different length do not link. Repeated rows
are vectors of their own. Only vec_id, embedding and label are read. No rows in: no rows out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, sample_share

THRESHOLD = 0.93
TREES, SPILL, LEAF, BLOCK = 8, 0.06, 512, 1024
SAMPLE_ROWS, LEAST_SAMPLES = 32_768, 8
#: Cosine to a cloud's centre that brings a vector into its leaf; at mean cosine c of a cloud's pairs it is about sqrt(c).
COVER = 0.88


def clouds(sample: np.ndarray, least: int) -> np.ndarray:
    """Centres of the groups whose vectors link with ``least`` others of the sample, the densest first."""
    rows = sample.astype(np.float32)
    count = np.concatenate([(rows[a : a + BLOCK] @ rows.T >= THRESHOLD).sum(axis=1) for a in range(0, len(rows), BLOCK)]) - 1
    dense, centres = np.flatnonzero(count >= least), []
    dense = dense[np.argsort(-count[dense], kind="stable")]
    while len(dense):
        centre = sample[rows @ rows[dense[0]] >= THRESHOLD].mean(axis=0)
        centre /= np.sqrt((centre * centre).sum())
        centres.append(centre)
        covered = sample[dense] @ centre >= THRESHOLD
        covered[0] = True
        dense = dense[~covered]
    return np.array(centres).reshape(-1, sample.shape[1])


class Forest:
    """Trees for vectors of one length, fitted on sample rows (already of length 1)."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL, seed: int = 7, share: float = 1.0):
        draw = np.random.default_rng(seed)
        # without splits every leaf is whole
        self.clouds = clouds(sample, max(LEAST_SAMPLES, int(LEAF * share / 4))) if depth else np.zeros((0, sample.shape[1]))
        self.trees = []
        for _ in range(trees):
            levels, node, known = [], np.zeros(len(sample), np.int64), 0
            for level in range(depth):
                direction = draw.standard_normal(sample.shape[1])
                at = sample @ direction
                if len(sample) >= LEAST_SAMPLES << level:
                    known = level
                cuts = np.zeros((3, 1 << known))
                for k in range(1 << known):
                    own = at[node == k]
                    cuts[:, k] = np.quantile(own, [0.5 - spill, 0.5, 0.5 + spill]) if len(own) else 0.0
                if len(sample) >= LEAST_SAMPLES << level + 1:
                    node = node * 2 + (at > cuts[1, node])
                levels.append((direction, cuts, level - known))
            self.trees.append(levels)

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, tree << 40 | leaf) of every leaf that a row falls into, by tree; clouds count down from -1."""
        out_row, out_key = [], []
        for a in range(0, len(rows) if len(self.clouds) else 0, BLOCK):
            row, cloud = np.nonzero(rows[a : a + BLOCK] @ self.clouds.T >= COVER)
            out_row.append(row + a)
            out_key.append(-1 - cloud)
        for t, levels in enumerate(self.trees):
            row, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for direction, (low, _, high), below in levels:
                at, from_ = (rows @ direction)[row], node >> below
                left, right = at <= high[from_], at > low[from_]
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            out_row.append(row)
            out_key.append(t << 40 | node)
        return np.concatenate(out_row), np.concatenate(out_key)


def unit(lists: list) -> np.ndarray:
    rows = np.array(lists, np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable():
    """Whether a vector can link."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))


def _routed(forests: dict[int, Forest]):
    def run(batches):
        for batch in batches:
            by_size: dict[int, list[int]] = {}
            vectors = batch.column("embedding").to_pylist()
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            for size, rows in by_size.items():
                forest = forests.get(size)
                if forest:
                    row, key = forest.leaves(unit([vectors[i] for i in rows]))
                else:  # a length that the sample does not hold: one leaf
                    row, key = np.arange(len(rows)), np.zeros(len(rows), np.int64)
                order = np.lexsort((key, row))
                keys = np.split(key[order], np.cumsum(np.bincount(row, minlength=len(rows)))[:-1])
                picked = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(picked.column(c) for c in ("class_id", "label", "members", "embedding")), pa.array([size] * len(rows), pa.int32()), pa.array([k.tolist() for k in keys], pa.list_(pa.int64()))], ["class_id", "label", "members", "embedding", "dim", "leaves"])

    return run


_FOUND = pa.schema([("class_id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _compared(table: pa.Table) -> pa.Table:
    """Within a leaf, one block against another (or itself): links per class and stars that keep the components."""
    table = table.combine_chunks()
    if not table.num_rows:
        return pa.Table.from_arrays([pa.array([], t) for t in _FOUND.types], schema=_FOUND)
    block, first, second, leaf = (table.column(c).to_numpy() for c in ("block", "bi", "bj", "leaf"))
    ids, members = table.column("class_id").to_numpy(), table.column("members").to_numpy()
    rows, leaves = unit(table.column("embedding").to_pylist()), table.column("leaves").to_pylist()
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    near = rows[left] @ rows[right].T >= THRESHOLD
    if first[0] == second[0]:
        np.fill_diagonal(near, False)
    out = []
    if near.any():
        # the smallest linked id, handed on until nothing changes
        label = ids.copy()
        while True:
            a = np.where(near, label[right][None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            new = label.copy()
            new[left] = np.minimum(new[left], a)
            b = np.where(near, new[left][:, None], np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max)
            new[right] = np.minimum(new[right], b)
            if (new == label).all():
                break
            label = new
        # pairs that already met in an earlier leaf
        known: dict[int, int] = {}
        at, col = [], []
        for i, own in enumerate(leaves):
            for k in own:
                if k < leaf[0]:
                    at.append(i)
                    col.append(known.setdefault(k, len(known)))
        if known:
            holds = np.zeros((len(ids), len(known)), np.float32)
            holds[at, col] = 1
            near &= holds[left] @ holds[right].T == 0
        count = np.zeros(len(ids), np.int64)
        count[left] += near @ members[right]
        if first[0] != second[0]:
            count[right] += members[left] @ near
        some = np.flatnonzero((count > 0) | (label != ids))
        out = [ids[some], count[some], label[some]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out or ([], [], []), _FOUND.types)], schema=_FOUND)


def fit(classes: DataFrame, total: int, largest: int) -> dict[int, Forest]:
    """Forests by vector length, from a thinned sample. Depth follows the largest label."""
    share = sample_share(SAMPLE_ROWS, total)
    rows = classes.filter(F.pmod(F.xxhash64("class_id"), F.lit(1 << 62)) < share).select("embedding").limit(2 * SAMPLE_ROWS).toArrow().column(0).to_pylist()
    depth = max(0, int(np.ceil(np.log2(max(1, largest / LEAF)))))
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r), []).append(r)
    return {size: Forest(unit(own), depth, share=share / (1 << 62)) for size, own in by_size.items()}


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id of every row (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("usable", usable())
    # two hashes stand for a vector: 128 bits
    rows = cut(rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), F.reverse("embedding"))))
    fine = rows.filter("usable")
    same = cut(fine.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("members")))
    classes = fine.join(same, ["label", "h1", "h2"]).filter("vec_id = class_id")
    # of several vectors with one id the one with the largest hash is compared
    classes = cut(classes.groupBy("class_id").agg(F.max(F.struct("h1", "h2", "label", "members", "embedding")).alias("v")).select("class_id", "v.label", "v.members", "v.embedding"))
    per_label = classes.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
    forests = spark.sparkContext.broadcast(fit(classes, per_label[0] or 0, per_label[1] or 0))

    def route(batches):
        yield from _routed(forests.value)(batches)

    kind = vectors.schema["label"].dataType.simpleString()
    routed = cut(classes.mapInArrow(route, f"class_id long, label {kind}, members long, embedding array<double>, dim int, leaves array<long>"))
    spread = routed.withColumn("leaf", F.explode("leaves"))
    sizes = spread.groupBy("label", "dim", "leaf").count().filter("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    spread = spread.join(sizes, ["label", "dim", "leaf"]).withColumn("block", F.pmod(F.xxhash64("class_id", "leaf"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = spread.select("class_id", "label", "dim", "leaf", "members", "embedding", "leaves", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    found = cut(pairs.groupBy("label", "dim", "leaf", "bi", "bj").applyInArrow(_compared, "class_id long, links long, other long"))
    counts = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    groups = components(found.filter("class_id != other").select(F.col("class_id").alias("a"), F.col("other").alias("b")))
    named = same.join(counts, "class_id", "left").join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
    named = named.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"), F.lit(True).alias("usable"))
    every = rows.select("vec_id", "label", "h1", "h2", "usable").join(named, ["label", "h1", "h2", "usable"], "left")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
