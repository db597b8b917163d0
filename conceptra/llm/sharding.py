"""Sharding with a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size, given by an offset and a
step drawn from its name. The shards take turns and claim their most preferred free slot until the
table is full; a key belongs to the shard in the slot that its hash points to. Shares differ by one
slot at most for equal weights, and few keys move when a shard comes or goes.

The table's size is a parameter, so the broadcast table is bounded whatever the input holds. A null
key goes to the slot of the empty string; repeated keys share a shard; no rows in, no rows out. Texts
are not read, so their length does not matter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(128))


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> list[int]:
    """For each slot the index of its shard. A shard of weight w claims w slots a turn."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime not below the number of shards")
    turns = weights or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("weights must be positive, one per shard")
    draw = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in draw]
    step = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 if size > 2 else 1 for d in draw]
    table, free = [-1] * size, size
    while free:
        for i, turn in enumerate(turns):
            for _ in range(min(turn, free)):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % size
                table[at[i]] = i
                free -= 1
            if not free:
                break
    return table


def slot(key, size: int):
    """Slot of a key column: the first 60 bits of its MD5, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size))


def _placed(df: DataFrame, key: str, shards: list[str], size: int, weights: list[int] | None) -> tuple[DataFrame, str, str]:
    """``df`` with two more columns of names that it does not have, and these names."""
    spark, own = df.sparkSession, "_" * (1 + max(map(len, df.columns)))
    table = [(i, shards[s]) for i, s in enumerate(fill(shards, size, weights))]
    looked = spark.createDataFrame(table, f"`{own}slot` long, `{own}shard` string")
    return df.withColumn(f"{own}slot", slot(F.col(f"`{key}`"), size)).join(F.broadcast(looked), f"{own}slot"), f"{own}slot", f"{own}shard"


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> DataFrame:
    """``df`` with the columns slot and shard, in place of own ones of these names; a broadcast lookup, no shuffle."""
    placed, at, name = _placed(df, key, shards, size, weights)
    return placed.select(*(F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")), F.col(at).alias("slot"), F.col(name).alias("shard"))


def write(df: DataFrame, key: str, path: str, shards: list[str], size: int = TABLE_SIZE, files_per_shard: int = 8) -> None:
    """One folder per shard; rows of a shard are salted over several writers, so a large shard is no single task.

    All columns are kept but an own one called shard, which the folders' names replace.
    """
    placed, at, name = _placed(df, key, shards, size, None)
    placed = placed.withColumn(at, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if "map" not in df.schema[c].dataType.simpleString())), F.lit(files_per_shard)))
    placed = placed.repartition(max(1, len(shards) * files_per_shard), name, at)
    placed.select(*(F.col(f"`{c}`") for c in df.columns if c != "shard"), F.col(name).alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(path)


def op3_sql() -> str:
    """The table is given as a list; the tests hold an own one against it."""
    table = ", ".join(map(str, fill(list(SHARDS))))
    slots = f"SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {TABLE_SIZE} AS slot FROM documents"
    return f"SELECT doc_id, source, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, slot, printf('shard-%03d', ([{table}])[slot + 1]) AS shard FROM ({slots})"


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    return place(docs, "doc_id", list(SHARDS)).select("doc_id", "source", "n_chars", "slot", "shard")
