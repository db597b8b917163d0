"""Names and arities of the language's functions (fixed values)."""

from __future__ import annotations

#: name: (least, most) arguments; None: any number.
SCALARS = {
    "concat": (1, None), "like": (2, 2), "length": (1, 1), "upper": (1, 1), "lower": (1, 1), "substring": (2, 3), "replace": (3, 3),
    "cast": (2, 2), "mod": (2, 2), "round": (1, 2), "ceil": (1, 2), "floor": (1, 2), "trunc": (1, 1), "abs": (1, 1), "sqrt": (1, 1),
    "coalesce": (1, None), "current_time": (0, 0), "current_date": (0, 0), "current_timestamp": (0, 0),
}
#: With "DISTINCT" as an additional first argument, the values are taken once each.
AGGREGATES = {"sum": (1, 1), "count": (0, 1), "avg": (1, 1), "min": (1, 1), "max": (1, 1)}
WINDOWS = {
    "sum": (1, 1), "count": (0, 1), "avg": (1, 1), "min": (1, 1), "max": (1, 1), "row_number": (0, 0), "rank": (0, 0), "dense_rank": (0, 0),
    "percent_rank": (0, 0), "cume_dist": (0, 0), "lead": (1, 3), "lag": (1, 3), "ntile": (1, 1), "first_value": (1, 1), "last_value": (1, 1),
    "nth_value": (2, 2),
}
#: Window functions whose frame has no meaning and that need an order.
RANKING = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "lead", "lag", "ntile"}


def fits(arity: tuple[int, int | None], n: int) -> bool:
    return arity[0] <= n and (arity[1] is None or n <= arity[1])
