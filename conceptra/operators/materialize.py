"""Materialisation of concepts as tables, views and snapshots, whole or incrementally.

Tables of plain formats know no row-level changes, so every incremental strategy but Append writes
what the table will hold to a staging table, drops the target and gives the staging table its name. A
staging table is registered only when all its rows are written. A run that is lost before the drop
leaves the target as it was; one that is lost after it leaves the whole staging table, which the next
run, or ``recover``, makes the target before it does anything else. The target's rows are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang import ast as A
from ..lang.errors import ModelError, Unsupported, WrongArity, WrongType

STRATEGIES = ("InsertDelete", "Append", "Merge", "InsertOverrideMerge")
OPERATORS = ("=", ">", ">=", "<", "<=", "in", "between")


def _text(note: A.Annotation, key: str, default=None):
    value = note.get(key)
    if value is None:
        return default
    if isinstance(value, A.Name):
        return value.name
    if isinstance(value, A.Dotted):
        return value.name
    if not isinstance(value, A.Lit) or not isinstance(value.value, str):
        raise WrongType(f"{key} must be a text or a name")
    return value.value


def condition(operator: str, key: str, value: A.Node) -> A.Node:
    """Which rows of the target an incremental run is about."""
    items = value.items if isinstance(value, A.ListOf) else (value,)
    if operator == "in":
        return A.InList(A.Name(key), A.ListOf(items))
    if operator == "between":
        if not isinstance(value, A.ListOf):
            raise WrongType("between needs a list of two values")
        if len(items) < 2:
            raise WrongArity("between needs two values")
        return A.Between(A.Name(key), items[0], items[1])
    if operator not in OPERATORS:
        raise Unsupported(f"operator {operator}")
    return A.Binary(operator, A.Name(key), value)


def _filter(engine, node: A.Node, columns: list[str]) -> str:
    """The condition over the target's own columns; unknown counts as false."""
    resolved = node.rewrite(lambda n: A.Column("", (n.name,)) if isinstance(n, A.Name) and n.name in columns else None)
    return f"coalesce({engine.lowering.show(resolved)}, FALSE)"


def recover(spark, table: str) -> None:
    """Ends or undoes a swap that was lost halfway: without a target the staging table is it, else it goes."""
    staging = f"{table}__staging"
    if spark.catalog.tableExists(staging):
        if spark.catalog.tableExists(table):
            spark.sql(f"DROP TABLE {staging}")
        else:
            spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")


def _swap(engine, table: str, rows: DataFrame) -> None:
    staging = f"{table}__staging"
    rows.write.mode("overwrite").saveAsTable(staging)
    engine.spark.sql(f"DROP TABLE IF EXISTS {table}")
    engine.spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")


def _once(rows: DataFrame, key: str, table: str) -> None:
    twice = rows.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ModelError(f"{table}: several new rows have the key {twice[0][0]}")


def _written(engine, table: str, rows: DataFrame):
    """New rows in a table of their own, so that checking their keys does not compute them again; and how to drop it."""
    name = f"{table}__new"
    rows.write.mode("overwrite").saveAsTable(name)
    return engine.spark.table(name), lambda: engine.spark.sql(f"DROP TABLE IF EXISTS {name}")


def target(definition: A.Definition) -> str:
    note = definition.annotation("Materialized")
    return _text(note, "TargetName", definition.name) if note else definition.name


def write(engine, name: str, value: A.Node | None, full: bool) -> str:
    """Materialises one concept; the name of its table or view."""
    definition = engine.model.concept(name)
    note, table = definition.annotation("Materialized"), target(definition)
    kind = _text(note, "type", "Table")
    if kind == "View":
        _view(engine, name, table)
        return table
    if kind not in ("Table", "MaterializedView", "Incremental"):
        raise Unsupported(f"materialisation as {kind}")
    recover(engine.spark, table)
    if kind != "Incremental" or full or not engine.spark.catalog.tableExists(table):
        rows = _rows(engine, definition, note, value)[0] if kind == "Incremental" and not full else engine.concept(name)
        _swap(engine, table, rows)
        return table
    rows, test, key = _rows(engine, definition, note, value)
    strategy, old = _text(note, "strategy", "InsertDelete"), engine.spark.table(table)
    rows = rows.select(*old.columns)
    if strategy == "Append":
        rows.write.mode("append").saveAsTable(table)
    elif strategy == "InsertDelete":
        _swap(engine, table, old.filter(~F.expr(_filter(engine, test, old.columns))).unionByName(rows))
    elif strategy in ("Merge", "InsertOverrideMerge"):
        new, drop = _written(engine, table, rows)
        try:
            _once(new, key, table)
            kept = old.join(new.select(key), key, "left_anti").select(*old.columns) if strategy == "Merge" else old.filter(~F.expr(_filter(engine, test, old.columns)))
            _swap(engine, table, kept.unionByName(new))
        finally:
            drop()
    else:
        raise Unsupported(f"strategy {strategy}; there are {', '.join(STRATEGIES)}")
    return table


def _view(engine, name: str, table: str) -> None:
    """A view in the catalog that outlives the session, its parents as parts of its text.

    Where the text needs what only this session has (a frame given for a source, a function, a format
    that cannot be named in a query), the view is a temporary one.
    """
    text = engine.whole_sql(name)
    if text is None:
        engine.concept(name).createOrReplaceTempView(table)
    else:
        engine.spark.sql(f"CREATE OR REPLACE VIEW {table} AS {text}")


def _rows(engine, definition: A.Definition, note: A.Annotation, value: A.Node | None):
    """(rows the run is about, condition, key)."""
    select, test, key = _select(engine, definition, note, value)
    return engine.spark.sql(engine.lowering.query(select)), test, key


def _select(engine, definition: A.Definition, note: A.Annotation, value: A.Node | None):
    """(query of the run, condition, key): the condition filters before anything is aggregated."""
    value = value if value is not None else note.get("Default")
    if value is None:
        raise ModelError(f"{definition.name}: an incremental run needs a value")
    key = _text(note, "uniqueKey")
    if not key:
        raise ModelError(f"{definition.name}: an incremental run needs a uniqueKey")
    test = condition(_text(note, "operator", "="), key, value)
    parts = engine.model.normal(definition)
    where = test if parts["where"] is None else A.AllOf((test, parts["where"]))
    return engine.model.select(**{**parts, "where": _kept(where, test)}, outer=None), test, key


def _kept(where: A.Node, test: A.Node) -> A.Node:
    """An equality of the run must stay a filter and not become the attribute's value."""
    if isinstance(test, A.Binary) and test.op == "=":
        return where.rewrite(lambda n: A.InList(test.left, A.ListOf((test.right,))) if n is test else None)
    return where


def delete(engine, table: str, where: A.Node) -> None:
    """DELETE FROM table WHERE ..: keeps the rows for which the condition is not true."""
    recover(engine.spark, table)
    old = engine.spark.table(table)
    _swap(engine, table, old.filter(~F.expr(_filter(engine, where, old.columns))))


def _wanted(engine, only: list[str] | None) -> list[str]:
    return [n for n, d in engine.model.concepts.items() if d.annotation("Materialized") and not d.params and (only is None or n in only)]


def run(engine, value: A.Node | None, full: bool, only: list[str] | None) -> list[str]:
    wanted, done = _wanted(engine, only), []
    for name in engine.model.order(wanted):
        definition = engine.model.concept(name)
        if name in wanted:
            table = write(engine, name, value, full)
            done.append(table)
            kind = _text(definition.annotation("Materialized"), "type", "Table")
            if kind != "View":
                engine.use(name, engine.spark.table(table))
    return done


def script(engine, value: A.Node | None, full: bool, only: list[str] | None = None) -> list[str]:
    """What ``run`` does, as statements; tables that are read stand by their names. Merges need a table format with row-level changes."""
    wanted, out, tables = _wanted(engine, only), [], {}
    for name in engine.model.order(wanted):
        definition = engine.model.concept(name)
        if name not in wanted:
            continue
        note, table = definition.annotation("Materialized"), target(definition)
        kind = _text(note, "type", "Table")
        if kind not in ("View", "Table", "MaterializedView", "Incremental"):
            raise Unsupported(f"materialisation as {kind}")
        if kind != "Incremental" or full:
            text = engine.whole_sql(name, tables, strict=True)
            out.append(f"CREATE OR REPLACE VIEW {table} AS\n{text}" if kind == "View" else f"CREATE OR REPLACE TABLE {table} AS\n{text}")
        else:
            select, test, key = _select(engine, definition, note, value)
            text = engine.whole_sql(select, tables, strict=True)
            columns = list(select.names)
            where = _filter(engine, test, columns)
            strategy = _text(note, "strategy", "InsertDelete")
            match = f"t.`{key}` <=> n.`{key}`"
            if strategy not in STRATEGIES:
                raise Unsupported(f"strategy {strategy}; there are {', '.join(STRATEGIES)}")
            if strategy == "InsertDelete":
                out.append(f"DELETE FROM {table} WHERE {where}")
            if strategy in ("InsertDelete", "Append"):
                out.append(f"INSERT INTO {table} BY NAME\n{text}")
            else:
                gone = f"\nWHEN NOT MATCHED BY SOURCE AND {where} THEN DELETE" if strategy == "InsertOverrideMerge" else ""
                out.append(f"MERGE INTO {table} AS t USING (\n{text}) AS n ON {match}\nWHEN MATCHED THEN UPDATE SET *\nWHEN NOT MATCHED THEN INSERT *{gone}")
        tables[name] = table
    return out


__all__ = ["run", "script", "write", "delete", "recover", "condition", "target"]
