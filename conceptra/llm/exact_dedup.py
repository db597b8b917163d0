"""Exact deduplication against a persistent digest index (native).

The index is a table bucketed and sorted by digest. A batch of new rows is reduced to one winner per
digest, anti-joined with the index by sort-merge (the index side needs no shuffle) and what is left
is appended. Digests are taken of the text without the characters ``[\\x20\\x09-\\x0D]``. A bucket
gets a file with every append; ``compact`` makes them one sorted file a bucket again.

Null text counts as empty, and empty texts are equal to each other. Of equal texts the row with the
most code points in its original text wins, then the smallest id, then the smallest row number where
rows have one; an earlier batch always wins over a later one. Repeated rows are counted each; rows
without an id give way to those with one. An empty batch leaves the index as it is. Only the id and
text columns are read, so other columns may have any name. Texts go through whole, within one row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, keyed

#: Characters that do not count when texts are compared (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a bucket, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 32_768
INDEX_SCHEMA = "digest string, keep_id long, keep_row long, points long, members long"


def digests(df: DataFrame, id_col: str | Column = "doc_id", text_col: str | Column = "text", row_col: str | Column | None = None) -> DataFrame:
    """(id, row, digest, points) of every row; row numbers are optional and tell apart rows that are equal in the rest."""
    column = lambda c: F.col(f"`{c}`") if isinstance(c, str) else c
    text = F.coalesce(column(text_col), F.lit(""))
    row = F.lit(None).cast("long") if row_col is None else column(row_col)
    return df.select(column(id_col).alias("id"), row.alias("row"), F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256).alias("digest"), F.length(text).cast("long").alias("points"))


class DigestIndex:
    """A table (digest, keep_id, keep_row, points, members), bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def create(self) -> DigestIndex:
        """Makes the empty table where there is none yet."""
        if not self.exists():
            self._add(self.spark.createDataFrame([], INDEX_SCHEMA))
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def _add(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.table)

    def append(self, batch: DataFrame) -> None:
        """Adds the winners among digested rows whose digest the index does not hold yet.

        ``members`` is the number of rows with that digest in the batch that brought it.
        """
        self.create()
        # the complement orders whole numbers the other way round without overflow
        best = batch.groupBy("digest").agg(F.max(F.struct("points", F.bitwise_not("id").alias("low"), F.bitwise_not("row").alias("first"))).alias("best"), F.count(F.lit(1)).alias("members"))
        fresh = best.select("digest", F.bitwise_not("best.low").alias("keep_id"), F.bitwise_not("best.first").alias("keep_row"), "best.points", "members")
        self._add(fresh.join(self.read().select("digest").hint("merge"), "digest", "left_anti"))

    def lookup(self, batch: DataFrame) -> DataFrame:
        """Digested rows with the id (and number) of the row that stays and the number of members.

        The index is met by each digest once, by sort-merge along its buckets; the rows of a digest,
        which may be very many, then meet what was found in a join that can be split. What was found is
        written, so the result no longer needs the index.
        """
        hits = cut(batch.select("digest").distinct().join(self.read().select("digest", "keep_id", "keep_row", "members").hint("merge"), "digest"))
        return batch.join(hits, "digest")

    def compact(self) -> None:
        """Writes the index anew with one sorted file a bucket, then takes the old one's place."""
        other = DigestIndex(self.spark, f"{self.table}__compact", self.buckets)
        other.drop()
        other._add(self.read())
        self.drop()
        self.spark.sql(f"ALTER TABLE {other.table} RENAME TO {self.table}")


def dedup(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Appends a batch to the index; (id, digest, points, keep_id, members) of every row of the batch."""
    batch = cut(digests(df, id_col, text_col))
    index.append(batch)
    return index.lookup(batch)


def new_index(spark: SparkSession, rows: int) -> DigestIndex:
    """An empty index of its own name for about so many rows."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", max(8, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))).create()


def alone(batch: DataFrame) -> DataFrame:
    """What ``lookup`` gives for digested rows that are deduplicated among themselves, by an index that is then dropped."""
    index = new_index(batch.sparkSession, batch.count())
    try:
        index.append(batch)
        return index.lookup(batch)
    finally:
        index.drop()


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alone(cut(digests(documents(spark, sf_dir))))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", F.col("members").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h, length(coalesce(text, '')) AS points FROM documents
), g AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS n FROM d
)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each text, all columns; for use as a pipeline stage. Rows are told apart by a number, not by their ids."""
    rows = keyed(docs)
    found = alone(cut(digests(rows, F.col("row.doc_id"), F.col("row.text"), "key")))
    stay = found.filter("row = keep_row").select(F.col("row").alias("key"))
    return rows.join(stay, "key", "left_semi").select("row.*")
