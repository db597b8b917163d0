"""Data sources: files of a format, their declared columns taken by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import cast, type_text
from ..lang import ast as A
from ..lang.errors import NotFound, Unsupported

FORMATS = ("CSV", "JSON", "PARQUET", "ORC", "XML", "AVRO")


def full_path(path: str, base: str | None) -> str:
    return path if base is None or "://" in path or path.startswith("/") else f"{base.rstrip('/')}/{path}"


def options(source: A.DataSource) -> dict[str, str]:
    """What ``@Source(header = false, delimiter = ";")`` says to the reader."""
    note = source.annotation("Source")
    return {k: str(v.value).lower() if isinstance(v.value, bool) else str(v.value) for k, v in note.values if isinstance(v, A.Lit)} if note else {}


def declared(source: A.DataSource) -> str | None:
    """A schema for text formats, if every column has a type; reading then needs no pass to infer one."""
    if source.attributes and all(a.type is not None for a in source.attributes):
        return ", ".join(f"`{a.name}` {type_text(a.type)}" for a in source.attributes)
    return None


#: Rows of local Parquet and ORC sources, by session, declaration, path and the state of its files.
_frames: dict[tuple, DataFrame] = {}
_local: dict[int, tuple[SparkSession, bool]] = {}


def _state(spark: SparkSession, path: str) -> tuple | None:
    """Names, sizes and times of the files at a local path without folders in it; None if that can't be told cheaply."""
    if id(spark) not in _local or _local[id(spark)][0] is not spark:
        _local[id(spark)] = spark, spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")
    if not path.startswith("/") or not _local[id(spark)][1]:
        return None
    try:
        if not os.path.isdir(path):
            found = os.stat(path)
            return found.st_mtime_ns, found.st_size
        inside = [(e.name, e.is_dir(), e.stat()) for e in os.scandir(path)]
    except OSError:  # the reader says what is wrong
        return None
    return None if any(folder for _, folder, _ in inside) else tuple(sorted((name, found.st_mtime_ns, found.st_size) for name, _, found in inside))


def as_sql(spark: SparkSession, source: A.DataSource, base: str | None) -> str | None:
    """A query of a source's rows that needs no session, or None where its format can't be named in a query."""
    if source.format not in ("PARQUET", "ORC") or options(source):
        return None
    path = full_path(source.path, base).replace("`", "``")
    names = ", ".join(f"{cast(f'`{a.name}`', a.type)} AS `{a.name}`" if a.type is not None else f"`{a.name}`" for a in source.attributes)
    return f"SELECT {names} FROM {source.format.lower()}.`{path}`"


def read(spark: SparkSession, source: A.DataSource, base: str | None = None) -> DataFrame:
    """A source's rows.

    Parquet and ORC files name their columns' types; local ones are opened once for each state of the
    path. Of text formats, sources whose columns all have types are read without a pass to infer
    them (CSV: as text, cast by name); otherwise the files are read once more for that.
    """
    if source.format not in FORMATS:
        raise Unsupported(f"format {source.format}; there are {', '.join(FORMATS)}")
    given, path = options(source), full_path(source.path, base)
    key = None
    if source.format in ("PARQUET", "ORC") and not given and (state := _state(spark, path)):
        key = (id(spark), source.format, path, source.attributes, state)
        if key in _frames and _frames[key].sparkSession is spark:
            return _frames[key]
    reader = spark.read
    if source.format == "CSV":
        reader = reader.option("header", "true")
        if declared(source) is None:
            reader = reader.option("inferSchema", "true")
    if source.format == "XML" and "rowTag" not in given:
        reader = reader.option("rowTag", "row")
    reader = reader.options(**given)
    if source.format == "JSON" and (schema := declared(source)):
        reader = reader.schema(schema)
    try:
        frame = reader.format(source.format.lower()).load(path)
    except Exception as e:
        if source.format == "AVRO" and "AVRO" in str(e).upper():
            raise Unsupported("AVRO needs Spark's external avro package, which this session does not have") from e
        raise
    frame = project(frame, source)
    if key:
        _frames[key] = frame
    return frame


def project(frame: DataFrame, source: A.DataSource) -> DataFrame:
    """The declared columns, cast to their types where these are given; ``@NotNull`` ones lose rows without a value nowhere."""
    missing = [a.name for a in source.attributes if a.name not in frame.columns]
    if missing:
        raise NotFound(f"{source.name} has no columns {', '.join(missing)}")
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    return frame.selectExpr(*(f"{cast(quoted(a.name), a.type)} AS {quoted(a.name)}" if a.type is not None else quoted(a.name) for a in source.attributes))
