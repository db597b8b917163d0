"""Data sources as streams: an extension, the language itself has no word for time that goes on.

A model runs over streams as it does over files wherever Structured Streaming has the operators:
projections, filters, stream-static joins and cubes over event-time windows. Incremental concepts
can be refreshed from a stream batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from ..lang import ast as A
from ..lang.errors import WrongConcept
from ..lang.model import Model
from ..sources import files


def read(spark: SparkSession, source: A.DataSource, base: str | None = None, schema: str | None = None) -> DataFrame:
    """A stream of the files that arrive in the source's folder.

    ``@Watermark(column = "ts", delay = "10 minutes")`` on the source bounds how late rows may come.
    The schema is that of the files there now, unless given or declared.
    """
    path, kind = files.full_path(source.path, base), source.format.lower()
    schema = schema or files.declared(source)
    static = spark.read.format(kind).options(**files.options(source)).load(path).schema if schema is None else schema
    frame = files.project(spark.readStream.format(kind).options(**files.options(source)).schema(static).load(path), source)
    note = source.annotation("Watermark")
    return frame.withWatermark(note.get("column").value, note.get("delay").value) if note else frame


def engine(spark: SparkSession, model: Model | str, live: list[str], base: str | None = None, **options) -> Engine:
    """An engine in which the named sources are streams."""
    model = Model.parse(model) if isinstance(model, str) else model
    streams = {}
    for name in live:
        definition = model.concept(name)
        if not isinstance(definition, A.DataSource):
            raise WrongConcept(f"{name} is no data source")
        streams[name] = read(spark, definition, base)
    return Engine(spark, model, base=base, sources=streams, **options)


def refresh(spark: SparkSession, model: Model, source: str, stream: DataFrame, checkpoint: str, base: str | None = None, trigger: dict | None = None):
    """Appends every batch of a stream to the tables of the concepts that have the strategy Append."""

    def batch(rows: DataFrame, _: int) -> None:
        own = Engine(rows.sparkSession, model, base=base, sources={source: rows})
        for name, definition in model.concepts.items():
            note = definition.annotation("Materialized")
            if note and note.get("strategy") == A.Lit.of("Append"):
                from ..operators.materialize import target

                own.concept(name).write.mode("append").saveAsTable(target(definition))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
