"""Scalar and aggregate functions of the language as Spark SQL text."""

from __future__ import annotations

from ..lang import ast as A
from ..lang.errors import Unsupported

#: Functions that Spark has under the same name and with the same meaning.
SAME = {"concat", "length", "upper", "lower", "substring", "replace", "mod", "round", "abs", "sqrt", "coalesce"}
UNITS = {"microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year"}


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(node: A.Lit) -> str:
    v = node.value
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, str):
        return text(v)
    return f"CAST('{v!r}' AS DOUBLE)" if isinstance(v, float) else f"({v})" if v < 0 else str(v)


def type_text(t: A.TypeName) -> str:
    """Spark's name of a type; float holds doubles."""
    if t.name == "list":
        return f"ARRAY<{type_text(t.item)}>"
    if t.name == "map":
        return "STRUCT<" + ", ".join(f"`{n}`: {type_text(f)}" for n, f in t.fields) + ">"
    return {"int": "INT", "float": "DOUBLE", "boolean": "BOOLEAN", "string": "STRING"}[t.name]


def cast(value: str, t: A.TypeName) -> str:
    """A cast; string(n) keeps the first n characters."""
    plain = f"CAST({value} AS {type_text(t)})"
    return f"substring({plain}, 1, {t.size})" if t.name == "string" and t.size is not None else plain


def scalar(name: str, nodes: tuple[A.Node, ...], args: list[str]) -> str:
    if name in SAME:
        return f"{name}({', '.join(args)})"
    if name == "like":
        return f"({args[0]} LIKE {args[1]})"
    if name == "cast":
        return cast(args[0], nodes[1])
    if name == "trunc":
        return f"(CASE WHEN {args[0]} < 0 THEN ceil({args[0]}) ELSE floor({args[0]}) END)"
    if name in ("ceil", "floor"):
        if len(nodes) == 2 and isinstance(nodes[1], A.Lit) and isinstance(nodes[1].value, str):
            unit = nodes[1].value.lower()
            if unit not in UNITS:
                raise Unsupported(f"{name} to the unit {unit}")
            low = f"date_trunc('{unit}', {args[0]})"
            if name == "floor":
                return low
            return f"(CASE WHEN {low} = {args[0]} THEN {low} ELSE timestampadd({unit.upper()}, 1, {low}) END)"
        return f"{name}({', '.join(args)})"
    if name in ("current_time", "current_date", "current_timestamp"):
        return f"{name}()"
    raise Unsupported(f"function {name}")


def aggregate(name: str, nodes: tuple[A.Node, ...], args: list[str]) -> str:
    once = bool(nodes) and nodes[0] == A.Lit("DISTINCT", "str")
    if not args:
        return "count(1)"
    return f"{name}(DISTINCT {args[1]})" if once else f"{name}({args[0]})"
