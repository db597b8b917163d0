"""Queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import op7_embedding_dedup
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .language_id import op2_language_id
from .mixing import OP4_SQL, op4_mixing
from .ngram_join import OP1_SQL, op1_ngram_join
from .packing import op6_packing
from .repeats import OP5_SQL, op5_repeats
from .sentence_spans import op10_sentence_spans
from .sharding import op3_sharding, op3_sql
from .token_counts import op8_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_language_id, op3_sharding, op4_mixing, op5_repeats, op6_packing, op7_embedding_dedup, op8_token_counts, op9_exact_dedup, op10_sentence_spans)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op3_sharding": op3_sql(), "op4_mixing": OP4_SQL, "op5_repeats": OP5_SQL, "op9_exact_dedup": OP9_SQL}
