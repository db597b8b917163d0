"""The corpus pipeline: from raw documents to packed training sequences.

Every stage reads all rows that its predecessor kept, as Parquet. All but the last return the columns
of ``documents``. Rows whose text has no language go; of equal texts one stays; of near duplicates one
stays; the sources are mixed to their targets, texts being repeated or cut as the mix takes them; and
what is taken is tokenised and packed into windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from conceptra.llm import exact_dedup, language_id, mixing, ngram_join, packing
from conceptra.llm.common import cut, documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.materialize(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixed), ("packing", packed)]

#: Language identification and the similarity join cannot be put in SQL; tests/llm holds a brute-force version against the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
