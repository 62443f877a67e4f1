"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    """Any expression."""


@dataclass(frozen=True)
class Literal(Expr):
    value: object  # int, float, str, bool or None
    kind: str  # int, decimal, string, bool, null, timestamp
    text: str


@dataclass(frozen=True)
class Name(Expr):
    parts: tuple[str, ...]
    ordinal: bool = False


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    item: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str  # + - * / % ||
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Quantified(Expr):
    op: str
    left: Expr
    which: str  # ALL or ANY
    query: Query


@dataclass(frozen=True)
class Between(Expr):
    item: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass(frozen=True)
class InList(Expr):
    item: Expr
    items: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class InQuery(Expr):
    item: Expr
    query: Query
    negated: bool


@dataclass(frozen=True)
class Like(Expr):
    item: Expr
    pattern: Expr
    escape: str | None
    negated: bool


@dataclass(frozen=True)
class IsNull(Expr):
    item: Expr
    negated: bool


@dataclass(frozen=True)
class IsDistinct(Expr):
    left: Expr
    right: Expr
    negated: bool


@dataclass(frozen=True)
class Not(Expr):
    item: Expr


@dataclass(frozen=True)
class Logical(Expr):
    op: str  # AND or OR
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False
    order: tuple[SortItem, ...] = ()


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class SortItem:
    item: Expr
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class SelectItem:
    item: Expr | None  # None: all columns of `qualifier`, or all
    alias: str | None = None
    qualifier: tuple[str, ...] = ()


class Relation:
    """Any relation."""


@dataclass(frozen=True)
class Table(Relation):
    parts: tuple[str, ...]
    alias: str | None = None


@dataclass(frozen=True)
class Derived(Relation):
    query: Query
    alias: str | None = None


@dataclass(frozen=True)
class Aliased(Relation):
    relation: Relation
    alias: str


@dataclass(frozen=True)
class Join(Relation):
    left: Relation
    right: Relation
    how: str  # inner, left, right, full, cross
    on: Expr | None = None
    using: tuple[str, ...] = ()


@dataclass(frozen=True)
class Select:
    items: tuple[SelectItem, ...]
    distinct: bool = False
    relation: Relation | None = None
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None


@dataclass(frozen=True)
class SetOperation:
    op: str  # UNION, INTERSECT, EXCEPT
    all: bool
    left: object
    right: object


@dataclass(frozen=True)
class Query:
    term: object  # Select, SetOperation or Query
    order: tuple[SortItem, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Use:
    catalog: str | None
    schema: str


@dataclass(frozen=True)
class Insert:
    table: tuple[str, ...]
    columns: tuple[str, ...]
    query: Query


@dataclass(frozen=True)
class Show:
    what: str  # CATALOGS, SCHEMAS, TABLES, COLUMNS, PARTITIONS, CREATE TABLE, CREATE VIEW
    name: tuple[str, ...] = ()
    like: str | None = None
    escape: str | None = None
    where: Expr | None = None
    order: tuple[SortItem, ...] = field(default=())
    limit: int | None = None
