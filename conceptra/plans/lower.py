"""Resolved relations as Spark SQL over views, one view a concept; Catalyst does the rest."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import types as T

from ..functions.catalog import AGGREGATES, SCALARS
from ..functions.scalars import aggregate, cast, literal, scalar
from ..functions.windows import window
from ..lang import ast as A
from ..lang.errors import Unsupported, WrongType
from ..lang.model import Named, Output, Select, SetOperation, TableCall, aggregates
from ..operators import joins, quantified, sets


def quoted(*names: str) -> str:
    return ".".join("`" + n.replace("`", "``") + "`" for n in names)


class Lowering:
    """``view(name)``: the text that stands for a named relation; ``schema(name)``: its Spark schema."""

    def __init__(self, view: Callable[[str], str], schema: Callable[[object], T.StructType | None], call: Callable[[str], str], table_call: Callable[[A.FunctionConcept], str], every: bool = False):
        self.view, self.schema, self.call, self.table_call, self.every = view, schema, call, table_call, every
        self.sources: list[dict] = []

    def relation(self, r: A.Node) -> str:
        if isinstance(r, Named):
            return self.view(r.name)
        return f"({self.query(r)})"

    def query(self, r: A.Node) -> str:
        if isinstance(r, SetOperation):
            return sets.combine(r.kind, [self.relation(p) for p in r.parts], list(r.names), self.every)
        return self.select(r)

    # select

    def select(self, s: Select, extra: Callable[[list[str]], str] | None = None) -> str:
        """``extra`` makes a filter of the outputs' texts; the result then has a constant in their place."""
        inputs = {}
        for source in s.sources:
            if isinstance(source.relation, TableCall):
                names = [a.name for a in source.relation.concept.attributes if a.has("Input")]
                inputs |= {A.Column(source.alias, (n,)): arg for n, arg in zip(names, source.relation.args)}
        if inputs:  # what goes into a table function is known without it
            s = s.rewrite(lambda n: inputs.get(n))
        self.sources.append({src.alias: src.relation for src in s.sources})
        try:
            return self._select(s, extra)
        finally:
            self.sources.pop()

    def _select(self, s: Select, extra) -> str:
        parts = []
        for i, src in enumerate(s.sources):
            if isinstance(src.relation, TableCall):
                call = f"{self.table_call(src.relation.concept)}({', '.join(map(self.show, src.relation.args))})"
                text = f"{'LATERAL ' if i else ''}{call} AS {quoted(src.alias)}"
            else:
                text = f"{self.relation(src.relation)} AS {quoted(src.alias)}"
            parts.append((src.join, text, [(quoted(src.alias, k), self.show(v)) for k, v in src.keys]))
        origin, where = joins.fold(parts), self.condition(s.where) if s.where is not None else ""
        s, keys, staged = self.staged(s)
        if staged:
            # window functions below aggregates: computed first, the parents going along as structs
            rows = [f"struct({quoted(src.alias)}.*) AS {quoted(src.alias)}" for src in s.sources]
            rows += [f"{text} AS {quoted(name)}" for name, text in keys.items()]
            origin = f"(SELECT {', '.join(rows)} FROM {origin}" + (f" WHERE {where}" if where else "") + ")"
            origin = f"(SELECT *, {', '.join(f'{text} AS {quoted(name)}' for name, text in staged.items())} FROM {origin})"
            where = ""
        shown = [o for o in s.outputs if not o.private]
        if extra:
            more = extra([self.show(o.value) for o in shown])
            where = f"({where}) AND {more}" if where else more
            columns = "1"
        else:
            columns = ", ".join(f"{self.show(o.value)} AS {quoted(o.name)}" for o in shown)
        out = f"SELECT {'DISTINCT ' if s.distinct and not extra else ''}{columns}\nFROM {origin}"
        if where:
            out += f"\nWHERE {where}"
        if s.group:
            # a bare literal would be taken for a column's number
            out += "\nGROUP BY " + ", ".join(f"coalesce({self.show(g)})" if isinstance(g, A.Lit) else self.show(g) for g in s.group)
        if s.having is not None:
            out += f"\nHAVING {self.condition(s.having)}"
        if s.order and not extra:
            out += "\nORDER BY " + ", ".join((quoted(o.value) if isinstance(o.value, str) else self.show(o.value)) + (" DESC" if o.descending else " ASC") for o in s.order)
        if s.limit is not None:
            out += f"\nLIMIT {s.limit}"
        if s.offset is not None:
            out += f"\nOFFSET {s.offset}"
        return out

    def staged(self, s: Select) -> tuple[Select, dict[str, str], dict[str, str]]:
        """The select over window functions that are columns, with the texts of its keys and of these functions."""
        found: dict[A.Node, str] = {}

        def inside(node: A.Node):
            if isinstance(node, A.Window) and not aggregates(node):
                return A.Column("", (found.setdefault(node, f"__w{len(found)}"),))
            return None

        def change(node: A.Node):
            if isinstance(node, Select):
                return node
            if isinstance(node, A.Call) and node.function in AGGREGATES:
                return dataclasses.replace(node, args=tuple(a.rewrite(inside) for a in node.args))
            return None

        new = dataclasses.replace(
            s, outputs=tuple(Output(o.name, o.value.rewrite(change), o.private) for o in s.outputs), having=s.having.rewrite(change) if s.having is not None else None,
            group=tuple(g.rewrite(inside) for g in s.group), order=tuple(dataclasses.replace(o, value=o.value if isinstance(o.value, str) else o.value.rewrite(change)) for o in s.order),
        )
        if s.group and any(isinstance(n, A.Window) for g in s.group for n in g.walk()):
            # outputs that repeat a group's window function
            new = dataclasses.replace(new, outputs=tuple(Output(o.name, o.value.rewrite(lambda n: A.Column("", (found[n],)) if n in found else None), o.private) for o in new.outputs))
        keys: dict[A.Node, str] = {}

        def key(node: A.Node):
            return A.Column("", (keys[node],)) if node in keys else None

        if found:
            # keys as columns of their own, so that a window's partitioning is seen to serve the groups, too
            own = [A.Column("", (name,)) for name in found.values()]
            keys |= {g: f"__g{i}" for i, g in enumerate(new.group) if not isinstance(g, A.Lit) and not any(g.contains(w) for w in own)}
            new = dataclasses.replace(
                new, outputs=tuple(Output(o.name, o.value.rewrite(key), o.private) for o in new.outputs), having=new.having.rewrite(key) if new.having is not None else None,
                group=tuple(key(g) or g for g in new.group), order=tuple(dataclasses.replace(o, value=o.value if isinstance(o.value, str) else o.value.rewrite(key)) for o in new.order),
            )
        return new, {name: self.show(g) for g, name in keys.items()}, {name: self.show(node.rewrite(key)) for node, name in found.items()}

    def simple(self, s: Select) -> bool:
        """Whether a filter on the outputs can join the query's own."""
        windows = any(isinstance(n, A.Window) for o in s.outputs for n in o.value.walk())
        return not (s.group or s.having or s.limit is not None or s.offset is not None or windows or any(aggregates(o.value) for o in s.outputs))

    # expressions

    def condition(self, node: A.Node) -> str:
        """A filter: quantified conjuncts become semi and anti joins."""
        if isinstance(node, A.AllOf):
            return " AND ".join(f"({self.condition(i)})" for i in node.items)
        if isinstance(node, A.Binary) and node.op == "and":
            return f"({self.condition(node.left)}) AND ({self.condition(node.right)})"
        if isinstance(node, A.Quantified):
            return self.quantified(node, quantified.as_condition, quantified.reduced_condition)
        if isinstance(node, A.InQuery):
            return self.within(node)
        if isinstance(node, A.Not) and isinstance(node.operand, A.InQuery):
            found = node.operand
            # a join that can be shuffled, where NOT IN would send the whole query to every task
            return self.condition(A.Quantified(found.operand, "!=", "all", found.query)) if self.alone(found.query) else f"(NOT {self.within(found)})"
        return self.show(node)

    def within(self, node: A.InQuery) -> str:
        return f"({self.show(node.operand)} IN ({self.select(node.query)}))"

    def alone(self, query: A.Node) -> bool:
        return len(query.names) == 1 and not self.free(query)

    def free(self, node: A.Node, own: frozenset = frozenset()) -> bool:
        """Whether a part of a query refers to parents other than its own."""
        if isinstance(node, Select):
            own = own | {src.alias for src in node.sources}
        if isinstance(node, A.Column) and node.alias and node.alias not in own:
            return True
        return isinstance(node, A.Row) and node.alias not in own or any(self.free(c, own) for c in node.children())

    def quantified(self, node: A.Quantified, form, alone) -> str:
        left, op = self.show(node.operand), {"!=": "<>"}.get(node.op, node.op)
        if len(node.query.names) != 1:
            raise WrongType("a query to compare with must have one column")
        if not self.free(node.query):
            return alone(node.quantifier, left, op, self.select(node.query), quoted("__q", node.query.names[0]))
        if self.simple(node.query):
            # the comparison is built where the query's own columns are known
            def rows(make):
                return self.select(node.query, lambda shown: make(quantified.compared(left, op, shown[0])))
        else:
            inner, column = self.select(node.query), quoted("__q", node.query.names[0])

            def rows(make):
                return f"SELECT 1 FROM ({inner}) AS `__q` WHERE {make(quantified.compared(left, op, column))}"

        mark = "\0"
        return form(node.quantifier, mark, lambda text: rows(lambda test: text.replace(mark, test)))

    def show(self, node: A.Node) -> str:
        if isinstance(node, A.Column):
            return quoted(node.alias, *node.path) if node.alias else quoted(*node.path)
        if isinstance(node, A.Lit):
            return literal(node)
        if isinstance(node, A.Row):
            return f"struct({quoted(node.alias)}.*)"
        if isinstance(node, A.Binary):
            return self.binary(node)
        if isinstance(node, A.AllOf):
            return "(" + " AND ".join(map(self.show, node.items)) + ")"
        if isinstance(node, A.Not):
            return f"(NOT {self.show(node.operand)})"
        if isinstance(node, A.Minus):
            return f"(- {self.show(node.operand)})"
        if isinstance(node, A.Between):
            return f"({self.show(node.operand)} BETWEEN {self.show(node.low)} AND {self.show(node.high)})"
        if isinstance(node, A.InList):
            return f"({self.show(node.operand)} IN ({', '.join(map(self.show, node.items.items))}))" if node.items.items else "FALSE"
        if isinstance(node, A.InQuery):
            # as a value it is unknown where a null could be what is looked for
            return self.show(A.Quantified(node.operand, "=", "any", node.query)) if self.alone(node.query) else self.within(node)
        if isinstance(node, A.Exists):
            return f"EXISTS ({self.select(node.query)})"
        if isinstance(node, A.Unique):
            return quantified.unique(self.select(node.query), [quoted(n) for n in node.query.names])
        if isinstance(node, A.Quantified):
            return self.quantified(node, quantified.as_value, quantified.reduced)
        if isinstance(node, Select):
            return f"({self.select(node)})"
        if isinstance(node, A.IfElse):
            return f"(CASE WHEN {self.show(node.condition)} THEN {self.show(node.yes)} ELSE {self.show(node.no)} END)"
        if isinstance(node, A.Case):
            return "(CASE " + " ".join(f"WHEN {self.show(c)} THEN {self.show(v)}" for c, v in node.branches) + f" ELSE {self.show(node.default)} END)"
        if isinstance(node, A.ListOf):
            return f"array({', '.join(map(self.show, node.items))})"
        if isinstance(node, A.MapOf):
            return f"map({', '.join(self.show(x) for pair in node.pairs for x in pair)})"
        if isinstance(node, A.Item):
            return self.item(node)
        if isinstance(node, A.Interval):
            return f"INTERVAL '{node.value}' {node.unit.upper()}" + (f" TO {node.to.upper()}" if node.to else "")
        if isinstance(node, A.Window):
            return window(node, list(map(self.show, node.args)), self.show)
        if isinstance(node, A.Call):
            args = [self.show(a) if not isinstance(a, A.TypeName) else "" for a in node.args]
            if node.function in AGGREGATES:
                return aggregate(node.function, node.args, args)
            if node.function in SCALARS:
                return scalar(node.function, node.args, args)
            return f"{self.call(node.function)}({', '.join(args)})"
        raise Unsupported(f"{type(node).__name__} in a query")

    def binary(self, node: A.Binary) -> str:
        null = A.Lit(None, "NoneType")
        if node.op in ("=", "!=") and null in (node.left, node.right):
            other = node.left if node.right == null else node.right
            return f"({self.show(other)} IS {'NOT ' if node.op == '!=' else ''}NULL)"
        left, right = self.show(node.left), self.show(node.right)
        if node.op == "-":
            kinds = {self.kind(node.left), self.kind(node.right)}
            if kinds == {"timestamp"}:  # seconds, as a number
                return f"((unix_micros(CAST({left} AS TIMESTAMP)) - unix_micros(CAST({right} AS TIMESTAMP))) / 1000000)"
            if kinds == {"date"}:
                return f"datediff({left}, {right})"
        op = {"!=": "<>", "and": "AND", "or": "OR"}.get(node.op, node.op)
        return f"({left} {op} {right})"

    def item(self, node: A.Item) -> str:
        text, kind = self.show(node.base), self.type(node.base)
        for key in node.keys:
            inner = None
            if isinstance(node.base, A.ListOf) or isinstance(kind, T.ArrayType):
                text, inner = f"get({text}, {self.show(key)})", getattr(kind, "elementType", None)
            elif isinstance(kind, T.StructType) and isinstance(key, A.Lit) and isinstance(key.value, str):
                text, inner = f"{text}.{quoted(key.value)}", kind[key.value].dataType if key.value in kind.names else None
            else:
                text, inner = f"{text}[{self.show(key)}]", getattr(kind, "valueType", None)
            kind = inner
        return text

    # types, as far as a subtraction or an item needs them

    def type(self, node: A.Node):
        if isinstance(node, A.Column):
            for level in reversed(self.sources):
                if node.alias in level:
                    kind = self.schema(level[node.alias])
                    for step in node.path:
                        kind = kind[step].dataType if isinstance(kind, T.StructType) and step in kind.names else None
                    return kind
        if isinstance(node, A.MapOf):
            return T.MapType(T.StringType(), T.NullType())
        if isinstance(node, (A.IfElse, A.Case)):
            values = [node.yes, node.no] if isinstance(node, A.IfElse) else [*(v for _, v in node.branches), node.default]
            return next((k for k in map(self.type, values) if k is not None), None)
        if isinstance(node, (A.Call, A.Window)):
            name = node.function
            if name in ("min", "max", "coalesce", "lead", "lag", "first_value", "last_value", "nth_value"):
                return next((k for k in map(self.type, node.args) if k is not None), None)
            if name in ("ceil", "floor") and len(node.args) == 2 and isinstance(node.args[1], A.Lit) and isinstance(node.args[1].value, str) or name == "current_timestamp":
                return T.TimestampType()
            if name == "current_date":
                return T.DateType()
            if name == "cast":
                return T.StringType() if node.args[1].name == "string" else None
        return None

    def kind(self, node: A.Node) -> str:
        return {T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp", T.DateType: "date"}.get(type(self.type(node)), "")


__all__ = ["Lowering", "quoted", "cast"]
