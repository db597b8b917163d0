"""Comparisons with all or any rows of a query, and UNIQUE, without comparing every row with every row.

A query that does not refer to the outer rows is reduced to one row: how many rows and values it has,
and its least and greatest value. These decide all comparisons but equality with any, which stays a
semi join along the equality (inequality to all: an anti join). Queries that refer to outer rows become
semi and anti joins along their own equalities.
"""

from __future__ import annotations


def compared(left: str, op: str, column: str) -> str:
    return f"({left} {op} {column})"


def as_condition(quantifier: str, test: str, rows) -> str:
    """For a conjunct of WHERE, where unknown counts as false. ``rows(condition)`` is the query with that filter."""
    if quantifier == "any":
        return f"EXISTS ({rows(test)})"
    return f"NOT EXISTS ({rows(f'NOT coalesce({test}, FALSE)')})"


def as_value(quantifier: str, test: str, rows) -> str:
    """With three values, for any other place."""
    sure, value, other = (test, "TRUE", "FALSE") if quantifier == "any" else (f"NOT {test}", "FALSE", "TRUE")
    return f"(CASE WHEN EXISTS ({rows(sure)}) THEN {value} WHEN EXISTS ({rows(f'{test} IS NULL')}) THEN NULL ELSE {other} END)"


def reduced(quantifier: str, left: str, op: str, query: str, column: str) -> str:
    """The comparison with a query that stands alone, with three values."""

    def one(what: str) -> str:
        return f"(SELECT {what} FROM ({query}) AS `__q`)"

    rows, values, low, high = one("count(1)"), one(f"count({column})"), one(f"min({column})"), one(f"max({column})")
    equal = f"EXISTS (SELECT 1 FROM ({query}) AS `__q` WHERE {column} = {left})"
    # whether some value passes (any) or fails (all)
    if quantifier == "any":
        sure = {"=": equal, "<>": f"({left} <> {low} OR {left} <> {high})", "<": f"{left} < {high}", "<=": f"{left} <= {high}", ">": f"{left} > {low}", ">=": f"{left} >= {low}"}[op]
        value, other = "TRUE", "FALSE"
    else:
        sure = {"=": f"({left} <> {low} OR {left} <> {high})", "<>": equal, "<": f"{left} >= {low}", "<=": f"{left} > {low}", ">": f"{left} <= {high}", ">=": f"{left} < {high}"}[op]
        value, other = "FALSE", "TRUE"
    return f"(CASE WHEN {rows} = 0 THEN {other} WHEN {sure} THEN {value} WHEN {left} IS NULL OR {values} < {rows} THEN NULL ELSE {other} END)"


def reduced_condition(quantifier: str, left: str, op: str, query: str, column: str) -> str:
    """The same for a conjunct of WHERE; equality is left where the planner makes joins of it."""
    equal = f"EXISTS (SELECT 1 FROM ({query}) AS `__q` WHERE {column} = {left})"
    if (quantifier, op) == ("any", "="):
        return equal
    if (quantifier, op) == ("all", "<>"):
        counts = f"(SELECT named_struct('n', count(1), 'k', count({column})) FROM ({query}) AS `__q`)"
        known = f"({counts}.n = 0 OR {left} IS NOT NULL AND {counts}.n = {counts}.k)"
        return f"{known} AND NOT {equal}"
    return reduced(quantifier, left, op, query, column)


def unique(query: str, columns: list[str]) -> str:
    """Whether no two rows without nulls are equal."""
    names = ", ".join(columns)
    filled = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"NOT EXISTS (SELECT 1 FROM ({query}) WHERE {filled} GROUP BY {names} HAVING count(1) > 1)"
