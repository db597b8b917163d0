"""Window functions and their frames as Spark SQL text."""

from __future__ import annotations

from ..lang import ast as A
from ..lang.errors import WrongType
from .catalog import RANKING


def bound(node: A.Node, side: str, show) -> str:
    """A frame's bound: 0 is the current row; a lower bound counts rows before it, an upper one rows after it."""
    if isinstance(node, A.Lit) and node.kind in ("int", "float"):
        if node.value == 0:
            return "CURRENT ROW"
        if node.value < 0:
            return f"{-node.value} {'FOLLOWING' if side == 'PRECEDING' else 'PRECEDING'}"
        return f"{node.value} {side}"
    if isinstance(node, A.Interval):
        return f"{show(node)} {side}"
    raise WrongType("a frame's bound must be a literal")


def frame(kind: str, bounds, show) -> str:
    """With one bound alone: a lower one ends at the current row, an upper one starts with the partition."""
    low, high = bounds
    if low is None and high is None:
        return ""
    start = bound(low, "PRECEDING", show) if low is not None else "UNBOUNDED PRECEDING"
    end = bound(high, "FOLLOWING", show) if high is not None else "CURRENT ROW"
    return f" {kind} BETWEEN {start} AND {end}"


def window(node: A.Window, args: list[str], show) -> str:
    parts = []
    if node.partition:
        parts.append("PARTITION BY " + ", ".join(map(show, node.partition)))
    if node.order:
        parts.append("ORDER BY " + ", ".join(show(o.key) + (" DESC" if o.descending else " ASC") for o in node.order))
    elif node.function in RANKING:
        parts.append("ORDER BY NULL")
    spec = " ".join(parts)
    if node.function not in RANKING:
        spec += frame("ROWS", node.rows, show) if node.rows else frame("RANGE", node.range, show) if node.range else ""
    call = f"{node.function}({', '.join(args)})" if args or node.function != "count" else "count(1)"
    return f"{call} OVER ({spec})"
