"""Union, intersection and difference: distinct, by name in the order of the first part; ALL on request."""

from __future__ import annotations

WORDS = {"union": "UNION", "intersect": "INTERSECT", "minus": "EXCEPT"}


def combine(kind: str, parts: list[str], names: list[str], every: bool = False) -> str:
    """Left fold over relations."""
    columns = ", ".join(f"`{n}`" for n in names)
    word = WORDS[kind] + (" ALL" if every else "")
    out = f"SELECT {columns} FROM {parts[0]}"
    for part in parts[1:]:
        out = f"({out})\n{word}\nSELECT {columns} FROM {part}"
    return out
