"""Mixing sources to target weights along a training run (native).

Every source has a weight and a schedule that says how its share moves over the run. The integral of
the schedule is the source's cumulative token demand; an occurrence of a document that starts after a
share of its source's target gets the position at which the demand reaches that share, found by
inverting the integral: a source that is taken several times follows its schedule once over the whole
run, not once a pass. Documents are range-sorted by position.

Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating, and share all words.
A target stops at ``MAX_PASSES`` times its source's words; the excess goes to the others by weight
until none is above. All documents of a source are taken for the whole passes; for the rest, the
documents in an order drawn from their ids' hashes up to the target, the last one in part. A schedule
is a slope between -1 and 1 for each weight: the share at position t is proportional to 1 - s + 2 s t.

Null text has size 0 and takes 0. A null source is a source of its own. Repeated rows are rows of
their own. With no words at all, every target is 0. No rows in: no rows out. Only doc_id, text and
source are read. Texts go through whole, within one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, documents, keyed

WEIGHTS = (5.0, 2.0, 1.0)
#: Slopes of the schedules by weight: the heaviest sources fade out, the others fade in.
SLOPES = (-0.5, 0.5, 0.5)
MAX_PASSES = 3
#: Rows of a source whose order is found within one window; larger sources get several ranges.
RANGE_ROWS = 2000


def sized(docs: DataFrame, *more: str) -> DataFrame:
    r"""(doc_id, source, size) and further columns: size counts the runs of characters other than space and \x09-\x0D."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.cast("long").alias("size"), *more)


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source, rows, source_size, weight, target. The table of sources is a small dimension."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    every = W.partitionBy(F.lit(0))
    ranked = per.withColumn("i", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("i"), F.lit(len(WEIGHTS))) + 1))
    cap = F.col("source_size") * F.lit(float(MAX_PASSES))
    ranked = ranked.withColumn("cap", cap).withColumn("level", cap / F.col("weight"))
    # sources in the order in which a rising level fills them; those before the first that is not full are full
    filling = every.orderBy("level", "i")
    before, rest = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    share = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("share", share)
    water = F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", "i", "share"))).over(every)["share"]
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), F.pmod(F.col("i"), F.lit(len(SLOPES))) + 1)
    return ranked.select("source", "rows", "source_size", "weight", slope.alias("slope"), F.least(F.col("weight") * F.coalesce(water, F.lit(0.0)), "cap").alias("target"))


def position(share, slope):
    """Where in [0, 1] the demand (1 - s) t + s t^2 reaches a share; a slope of 0 is an even schedule."""
    t = (-(1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) / (2 * slope)
    return F.when(slope == 0, share).otherwise(t + F.lit(0.0))  # no negative zero


def shares(sizes: DataFrame, *more: str) -> DataFrame:
    """Sized rows with source_size, target, slope, taken, and ``before``: the words of their source that come before in each pass.

    ``more`` is the name of a column that numbers the rows, if there is one: rows without ids are ordered by it.
    """
    named = F.concat_ws("/", F.coalesce("doc_id", *more).cast("string"), F.col("size").cast("string"))
    # 52 bits of a digest that every database knows
    at = F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    sizes = cut(sizes.withColumn("at", at))
    goal = cut(targets(sizes))
    key = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    side = goal.withColumnRenamed("source", "of")
    rows = sizes.join(side, key("source", "of")).drop("of")
    rows = rows.withColumn("part", F.floor(F.col("at") * F.ceil(F.col("rows") / F.lit(RANGE_ROWS))))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    base = F.sum("words").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(F.col("source").alias("of"), F.col("part").alias("of_part"), F.coalesce(base, F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "part").orderBy("at", "doc_id", "size", *more).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(parts, key("source", "of") & (F.col("part") == F.col("of_part"))).withColumn("before", F.col("inside") + F.col("base"))
    whole = F.floor(F.col("target"))
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    extra = whole - passes * F.col("source_size")
    taken = (passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), extra - F.col("before")))).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", "slope", taken.alias("taken"), "before", "at", *more)


def occurrence(number):
    """Position in the run of an occurrence (from 1) of a document with shares."""
    return position(F.least(F.lit(1.0), ((number - 1) * F.col("source_size") + F.col("before")) / F.col("target")), F.col("slope"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position of every document.

    ``position`` lies in [0, 1) where the document first appears in the run; null if none of it is taken.
    """
    rows = shares(sized(docs))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, occurrence(F.lit(1))).alias("position"), "at")


def in_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by position; what is not taken comes after, spread by its hash."""
    key = F.coalesce(F.col("position"), 1 + F.col("at"))
    return mixed.withColumn("key", key).repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").drop("key")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(mix(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken", "position")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(source AS VARCHAR) AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), o AS (
  SELECT *, CAST('0x' || substr(md5(concat_ws('/', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0 AS at FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][i % 3 + 1] AS weight, [-0.5::DOUBLE, 0.5, 0.5][i % 3 + 1] AS slope, source_size * 3.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, cap / weight AS level FROM w
), h AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY level, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY level, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM l
), t AS (
  SELECT *, least(weight * coalesce((SELECT share FROM h WHERE share <= level ORDER BY level, i LIMIT 1), 0.0::DOUBLE), cap) AS target FROM h
), b AS (
  SELECT o.*, t.source_size, t.target, t.slope, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS passes,
    CAST(coalesce(sum(o.size) OVER (PARTITION BY o.source ORDER BY o.at, o.doc_id, o.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, CAST(passes * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * source_size - before)) AS BIGINT) AS taken, least(1.0::DOUBLE, before / target) AS part FROM b
)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN (-(1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * part)) / (2 * slope) + 0.0 END AS position FROM k
"""


def materialize(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``, in training order: a row for each pass, the last one cut to the words taken.

    A cut text keeps its first words with the white space between them. ``n_chars`` follows the text,
    where there is one. Rows are told apart by a number, so repeated rows and rows without ids each get
    their own share.
    """
    rows = keyed(docs)
    taken = shares(sized(rows.select("row.doc_id", "row.source", "row.text", "key"), "key"), "key").filter("taken > 0").drop("doc_id", "source")
    rows = rows.join(taken, "key")
    passes = F.ceil(F.col("taken") / F.col("size"))
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), passes)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("pass") - 1) * F.col("size"))
    first = F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)")), F.lit(1), words.cast("int"))
    text = F.when(words < F.col("size"), F.array_join(first, "")).otherwise(F.col("row.text"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    rows = rows.select(F.struct(*(c.alias(n) for n, c in columns.items())).alias("row"), occurrence(F.col("pass")).alias("when"), "key")
    return rows.repartitionByRange("when", "key").sortWithinPartitions("when", "key").select("row.*")
