"""Syntax trees as frozen dataclasses, with find and replace over any node."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    def children(self) -> Iterator[Node]:
        for f in dataclasses.fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children():
            yield from child.walk()

    def find(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def find_all(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def contains(self, part: Node) -> bool:
        return any(n == part for n in self.walk())

    def rewrite(self, change: Callable[[Node], Node | None]) -> Node:
        """The tree with every node for which ``change`` returns one replaced; replacements are not entered."""
        new = change(self)
        if new is not None:
            return new
        fields = {f.name: _map(getattr(self, f.name), change) for f in dataclasses.fields(self)}
        return dataclasses.replace(self, **fields) if any(fields[k] is not getattr(self, k) for k in fields) else self

    def replace(self, old: Node, new: Node) -> Node:
        return self.rewrite(lambda n: new if n == old else None)


def _nodes(value) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, tuple):
        for v in value:
            yield from _nodes(v)


def _map(value, change):
    if isinstance(value, Node):
        return value.rewrite(change)
    if isinstance(value, tuple):
        new = tuple(_map(v, change) for v in value)
        return new if any(a is not b for a, b in zip(new, value)) else value
    return value


# expressions


@dataclass(frozen=True)
class Lit(Node):
    """int, float, bool, str or None."""

    value: object
    kind: str = ""  # tells 1 from 1.0 and true

    @staticmethod
    def of(value) -> Lit:
        return Lit(value, type(value).__name__)


@dataclass(frozen=True)
class TypeName(Node):
    """int, float, boolean, string(size), list<item> or map<fields>."""

    name: str
    size: int | None = None
    item: TypeName | None = None
    fields: tuple[tuple[str, TypeName], ...] = ()


@dataclass(frozen=True)
class Interval(Node):
    """A span such as 3 months, or '1-6' year to month; made with the API, the language has no text for it.

    ``precision`` is the number of digits of the leading and of the fractional unit; both are kept whole.
    """

    value: object
    unit: str
    to: str | None = None
    precision: tuple[int, ...] = ()


@dataclass(frozen=True)
class Name(Node):
    name: str


@dataclass(frozen=True)
class Dotted(Node):
    """a.b.c"""

    chain: tuple[str, ...]
    name: str


@dataclass(frozen=True)
class ListOf(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class MapOf(Node):
    pairs: tuple[tuple[Node, Node], ...]


@dataclass(frozen=True)
class Item(Node):
    base: Node
    keys: tuple[Node, ...]


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class AllOf(Node):
    """A conjunction of several operands."""

    items: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    operand: Node


@dataclass(frozen=True)
class Minus(Node):
    operand: Node


@dataclass(frozen=True)
class Between(Node):
    operand: Node
    low: Node
    high: Node


@dataclass(frozen=True)
class InList(Node):
    operand: Node
    items: Node


@dataclass(frozen=True)
class InQuery(Node):
    operand: Node
    query: Node


@dataclass(frozen=True)
class Quantified(Node):
    """operand op all/any query"""

    operand: Node
    op: str
    quantifier: str
    query: Node


@dataclass(frozen=True)
class Exists(Node):
    query: Node


@dataclass(frozen=True)
class Unique(Node):
    query: Node


@dataclass(frozen=True)
class IfElse(Node):
    condition: Node
    yes: Node
    no: Node


@dataclass(frozen=True)
class Case(Node):
    branches: tuple[tuple[Node, Node], ...]
    default: Node


@dataclass(frozen=True)
class Call(Node):
    function: object  # a name or a Lambda
    args: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Method(Node):
    chain: tuple[str, ...]
    args: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Lambda(Node):
    params: tuple[str, ...]
    body: Node


@dataclass(frozen=True)
class OrderBy(Node):
    key: Node
    descending: bool = False


@dataclass(frozen=True)
class Window(Node):
    function: str
    args: tuple[Node, ...] = ()
    partition: tuple[Node, ...] = ()
    order: tuple[OrderBy, ...] = ()
    rows: tuple[Node | None, Node | None] | None = None
    range: tuple[Node | None, Node | None] | None = None


# concepts


@dataclass(frozen=True)
class Annotation(Node):
    name: str
    values: tuple[tuple[str, Node], ...] = ()

    def get(self, key: str):
        return dict(self.values).get(key)


@dataclass(frozen=True)
class Attribute(Node):
    name: str
    value: Node | None = None
    annotations: tuple[Annotation, ...] = ()
    type: TypeName | None = None

    def has(self, annotation: str) -> bool:
        return any(a.name == annotation for a in self.annotations)


@dataclass(frozen=True)
class Reference(Node):
    """name, $expression, either with [parameter: value] or without."""

    name: object  # a str, or an expression for its text
    params: tuple[tuple[str, Node], ...] = ()


@dataclass(frozen=True)
class Parent(Node):
    relation: Node
    alias: str | None = None
    keys: tuple[tuple[str, Node], ...] = ()
    annotations: tuple[Annotation, ...] = ()

    @property
    def optional(self) -> bool:
        return any(a.name == "Optional" for a in self.annotations)


@dataclass(frozen=True)
class Query(Node):
    """An anonymous concept."""

    attributes: tuple[Node, ...] = ()
    parents: tuple[Parent, ...] = ()
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None
    order: tuple[OrderBy, ...] = ()
    limit: int | None = None
    offset: int | None = None
    annotations: tuple[Annotation, ...] = ()


@dataclass(frozen=True)
class Procedure(Node):
    """< statement; ... > in the place of a relation."""

    body: Node


@dataclass(frozen=True)
class Definition(Node):
    name: str = ""
    annotations: tuple[Annotation, ...] = field(default=(), kw_only=True)
    params: tuple[str, ...] = field(default=(), kw_only=True)

    def annotation(self, name: str) -> Annotation | None:
        return next((a for a in self.annotations if a.name == name), None)


@dataclass(frozen=True)
class Concept(Definition):
    attributes: tuple[Node, ...] = ()
    parents: tuple[Parent, ...] = ()
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None
    order: tuple[OrderBy, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class Inherited(Definition):
    parents: tuple[Parent, ...] = ()
    added: tuple[Attribute, ...] = ()
    removed: tuple[Node, ...] = ()
    where: Node | None = None
    order: tuple[OrderBy, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class Cube(Definition):
    metrics: tuple[Node, ...] = ()
    dimensions: tuple[Node, ...] = ()
    parents: tuple[Parent, ...] = ()
    where: Node | None = None
    having: Node | None = None
    order: tuple[OrderBy, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class InheritedCube(Definition):
    parent: Parent | None = None
    metrics: tuple[Attribute, ...] = ()
    removed_metrics: tuple[Node, ...] = ()
    dimensions: tuple[Attribute, ...] = ()
    removed_dimensions: tuple[Node, ...] = ()
    where: Node | None = None
    having: Node | None = None
    order: tuple[OrderBy, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class Relationship(Definition):
    """concept N between P, Q"""

    parents: tuple[Parent, ...] = ()
    where: Node | None = None


@dataclass(frozen=True)
class AttributeList(Definition):
    """concept attributes N"""

    attributes: tuple[Node, ...] = ()
    parents: tuple[Parent, ...] = ()


@dataclass(frozen=True)
class FunctionConcept(Definition):
    attributes: tuple[Attribute, ...] = ()
    parents: tuple[Parent, ...] = ()
    function: object = ""


@dataclass(frozen=True)
class SetConcept(Definition):
    kind: str = "union"  # or intersect, minus
    parents: tuple[Parent, ...] = ()


@dataclass(frozen=True)
class DataSource(Definition):
    attributes: tuple[Attribute, ...] = ()
    format: str = "PARQUET"
    path: str = ""


# statements


@dataclass(frozen=True)
class Function(Node):
    name: str
    params: tuple[str, ...]
    body: Node


@dataclass(frozen=True)
class Block(Node):
    statements: tuple[Node, ...] = ()


@dataclass(frozen=True)
class VarDef(Node):
    name: str
    value: Node | None = None


@dataclass(frozen=True)
class Assign(Node):
    name: str
    value: Node


@dataclass(frozen=True)
class Step(Node):
    """x++ or x--"""

    name: str
    by: int


@dataclass(frozen=True)
class AddToList(Node):
    name: str
    value: Node


@dataclass(frozen=True)
class AddToMap(Node):
    name: str
    key: Node
    value: Node


@dataclass(frozen=True)
class Return(Node):
    value: Node | None = None


@dataclass(frozen=True)
class Break(Node):
    pass


@dataclass(frozen=True)
class Continue(Node):
    pass


@dataclass(frozen=True)
class IfThen(Node):
    condition: Node
    yes: Node
    no: Node | None = None


@dataclass(frozen=True)
class For(Node):
    start: Node | None
    condition: Node | None
    step: Node | None
    body: Node


@dataclass(frozen=True)
class ForEach(Node):
    names: tuple[str, ...]
    collection: Node
    body: Node


@dataclass(frozen=True)
class While(Node):
    condition: Node
    body: Node
    first: bool = False  # do .. while


@dataclass(frozen=True)
class Run(Node):
    """A call as a statement."""

    call: Node


@dataclass(frozen=True)
class ConceptStatement(Node):
    concept: Node


# resolved leaves


@dataclass(frozen=True)
class Column(Node):
    """A column of a parent in the query, by the alias it has there."""

    alias: str
    path: tuple[str, ...]


@dataclass(frozen=True)
class Row(Node):
    """All columns of a parent as one value."""

    alias: str
