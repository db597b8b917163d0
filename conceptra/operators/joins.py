"""Joins: parents are folded from left to right, in the way that their ``@Optional`` marks ask for."""

from __future__ import annotations

WORDS = {"inner": "INNER JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN", "cross": "CROSS JOIN"}


def fold(parts: list[tuple[str, str, list[tuple[str, str]]]]) -> str:
    """FROM text of (join, relation AS alias, [(left, right)]) parts; only keys go to ON, all else is filtered later."""
    out = parts[0][1]
    for join, relation, keys in parts[1:]:
        on = " AND ".join(f"{a} = {b}" for a, b in keys)
        out += f"\n{WORDS[join]} {relation}" + (f" ON {on}" if on else "" if join == "cross" else " ON TRUE")
    return out
