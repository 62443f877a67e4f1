"""Expressions of the dialect as Columns.

Operators whose meaning depends on types (integer division, + on strings, strings against numbers) are resolved here,
from the operands' types; what remains is plain Column expressions, which stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import AGGREGATES, SCALARS
from ..operators.quantified import not_in, quantified
from ..sql.lexer import SqlError
from ..sql.tree import (
    Between, Binary, Call, Case, Compare, Expr, InList, InQuery, IsDistinct, IsNull, Like, Literal, Logical, Name, Not, Quantified, Query, Unary,
)
from ..types import INTEGERS, NUMBERS, TIMES, as_text, parse_time
from .scope import Scope, fresh


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: T.DataType


def default_name(e: Expr) -> str:
    """The name of an output column without alias."""
    match e:
        case Name():
            return e.parts[-1]
        case Literal(kind="string"):
            return f"COL_{e.value}"
        case Literal(kind="timestamp"):
            return f"COL_{e.value}"
        case Literal():
            return f"COL_{e.text}"
        case Call():
            return f"COL_{e.name}"
        case Binary() | Compare() | Logical() | IsDistinct():
            return f"{default_name(e.left)}_{default_name(e.right)}"
        case Not():
            return f"NOT_{default_name(e.item)}"
        case Unary():
            return f"{e.op}{default_name(e.item)}"
        case Case():
            return "CASE"
        case Quantified():
            return default_name(e.left)
        case Between() | InList() | InQuery() | Like() | IsNull():
            return default_name(e.item)
    raise SqlError(f"no name for {e}")


def children(e: Expr) -> list[Expr]:
    match e:
        case Binary() | Compare() | Logical() | IsDistinct():
            return [e.left, e.right]
        case Not() | Unary() | IsNull() | InQuery():
            return [e.item]
        case Quantified():
            return [e.left]
        case Between():
            return [e.item, e.low, e.high]
        case InList():
            return [e.item, *e.items]
        case Like():
            return [e.item, e.pattern]
        case Call():
            return [*e.args, *(s.item for s in e.order)]
        case Case():
            return [x for pair in e.whens for x in pair] + ([e.otherwise] if e.otherwise else [])
    return []


def has_query(e: Expr) -> bool:
    return isinstance(e, (InQuery, Quantified)) or any(map(has_query, children(e)))


def is_aggregate(e: Expr) -> bool:
    return isinstance(e, Call) and e.name.upper() in AGGREGATES


def aggregates_in(e: Expr) -> list[Call]:
    return [e] if is_aggregate(e) else [a for c in children(e) for a in aggregates_in(c)]


def number_literal(e: Expr):
    """The value of a literal, or None."""
    return e.value if isinstance(e, Literal) else None


class Compiler:
    """Compiles expressions over `scope`; `replaced` maps subexpressions (by `key`) to columns made before.

    `subquery` compiles a query to a one-column DataFrame.
    """

    def __init__(self, scope: Scope, subquery: Callable[[Query], DataFrame], replaced: dict | None = None, stray: Callable | None = None) -> None:
        self.scope, self.subquery, self.replaced, self.stray = scope, subquery, replaced or {}, stray

    def key(self, e: Expr):
        """Equal for expressions that mean the same, however their columns and functions are spelled."""
        match e:
            case Name():
                try:
                    return ("name", self.field(e).inner)
                except SqlError:
                    return ("name?", tuple(p.lower() for p in e.parts))
            case Literal():
                return ("literal", e.kind, e.value)
            case Call():
                order = tuple((self.key(s.item), s.descending, s.nulls_first) for s in e.order)
                return ("call", e.name.upper(), e.distinct, e.star, *(self.key(a) for a in e.args), *order)
        extra = [getattr(e, a) for a in ("op", "negated", "escape", "which") if hasattr(e, a)]
        query = getattr(e, "query", None)
        return (type(e).__name__, *extra, query, *(self.key(c) for c in children(e)))

    def field(self, e: Name):
        exact = getattr(e, "exact", None)  # a column of *
        if exact is not None:
            return exact
        if e.ordinal and len(e.parts) == 1 and not self.scope.matching(e.parts):
            digits = "".join(c for c in e.parts[0] if c.isdigit())
            at = int(digits)
            if at >= len(self.scope.fields):
                raise SqlError(f"no column {at}")
            return self.scope.fields[at]
        return self.scope.find(e.parts)

    def column(self, e: Expr) -> Column:
        return self.typed(e).column

    def condition(self, e: Expr) -> Column:
        found = self.typed(e)
        return found.column if isinstance(found.kind, T.BooleanType) else found.column.cast("boolean")

    def typed(self, e: Expr) -> Typed:
        if self.replaced:
            found = self.replaced.get(self.key(e))
            if found is not None:
                return found
        return self._typed(e)

    def _of(self, column: Column) -> Typed:
        return Typed(column, self.scope.df.select(column).schema[0].dataType)

    def _typed(self, e: Expr) -> Typed:
        match e:
            case Literal():
                return self.literal(e)
            case Name():
                field = self.field(e)
                if self.stray:
                    return self.stray(field)
                return Typed(field.column, field.kind)
            case Unary(op="-"):
                item = self.typed(e.item)
                return Typed(-item.column, item.kind)
            case Unary():
                return self.typed(e.item)
            case Binary():
                return self.arithmetic(e.op, self.typed(e.left), self.typed(e.right))
            case Case():
                return self.case(e)
            case Call():
                return self.call(e)
        return Typed(self.predicate(e), T.BooleanType())

    @staticmethod
    def literal(e: Literal) -> Typed:
        match e.kind:
            case "int":
                return Typed(F.lit(e.value).cast("long"), T.LongType())
            case "decimal":
                return Typed(F.lit(float(e.value)), T.DoubleType())
            case "string":
                return Typed(F.lit(e.value), T.StringType())
            case "bool":
                return Typed(F.lit(e.value), T.BooleanType())
            case "timestamp":
                return Typed(F.coalesce(parse_time(F.lit(e.value)), F.to_timestamp(F.lit(e.value))), T.TimestampType())
        return Typed(F.lit(None), T.NullType())

    def arithmetic(self, op: str, a: Typed, b: Typed) -> Typed:
        x, y = a.column, b.column
        text = isinstance(a.kind, T.StringType) or isinstance(b.kind, T.StringType)
        if op == "||" or op == "+" and text:
            return Typed(F.concat(as_text(x, a.kind), as_text(y, b.kind)), T.StringType())
        if text:  # numbers written as text; others are null
            a, b = (Typed(v.column.try_cast("double"), T.DoubleType()) if isinstance(v.kind, T.StringType) else v for v in (a, b))
            x, y = a.column, b.column
        if isinstance(a.kind, TIMES) or isinstance(b.kind, TIMES):
            return self.time_arithmetic(op, a, b)
        a, b = (Typed(v.column.cast("int"), T.IntegerType()) if isinstance(v.kind, T.BooleanType) else v for v in (a, b))
        x, y = a.column, b.column
        whole = isinstance(a.kind, INTEGERS) and isinstance(b.kind, INTEGERS)
        match op:
            case "+":
                return self._of(x + y)
            case "-":
                return self._of(x - y)
            case "*":
                return self._of(x * y)
            case "/":
                return Typed(F.call_function("div", x, F.nullif(y, F.lit(0).cast(b.kind))), T.LongType()) if whole else self._of(F.try_divide(x, y))
            case "%":
                return self._of(F.try_mod(x, y))
        raise SqlError(f"unknown operator {op}")

    def time_arithmetic(self, op: str, a: Typed, b: Typed) -> Typed:
        """Timestamps count in seconds: plus or minus a number, or the difference of two."""
        seconds = lambda v: F.unix_timestamp(v.column) if isinstance(v.kind, TIMES) else v.column
        if isinstance(a.kind, TIMES) and isinstance(b.kind, TIMES):
            if op != "-":
                raise SqlError(f"timestamps can't be combined by {op}")
            return Typed(seconds(a) - seconds(b), T.LongType())
        if op not in "+-" or op == "-" and not isinstance(a.kind, TIMES):
            raise SqlError(f"a timestamp can't be combined by {op}")
        value = seconds(a) + seconds(b) if op == "+" else seconds(a) - seconds(b)
        return Typed(F.timestamp_seconds(value.cast("long")), T.TimestampType())

    def compare(self, op: str, a: Typed, b: Typed) -> Column:
        x, y = self.alike(a, b)
        return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    @staticmethod
    def alike(a: Typed, b: Typed) -> tuple[Column, Column]:
        """Both sides in one type: a string and a number compare as strings, a string and a time as times."""
        kinds = (a.kind, b.kind)
        if any(isinstance(k, T.StringType) for k in kinds):
            if any(isinstance(k, (*NUMBERS, T.BooleanType)) for k in kinds):
                return as_text(a.column, a.kind), as_text(b.column, b.kind)
            for k in kinds:
                if isinstance(k, (*TIMES, T.DateType)):
                    return tuple(v.column.try_cast(k) if isinstance(v.kind, T.StringType) else v.column for v in (a, b))
        return a.column, b.column

    def predicate(self, e: Expr) -> Column:
        match e:
            case Not(item=InQuery() as inner):
                return self.predicate(replace(inner, negated=not inner.negated))
            case Not(item=Not() as inner):
                return self.condition(inner.item)
            case Not(item=Logical() as inner) if has_query(inner):  # so that NOT reaches the subquery's comparison
                return self.predicate(Logical("OR" if inner.op == "AND" else "AND", Not(inner.left), Not(inner.right)))
            case Not():
                return ~self.condition(e.item)
            case Logical(op="AND"):
                return self.condition(e.left) & self.condition(e.right)
            case Logical():
                return self.condition(e.left) | self.condition(e.right)
            case Compare():
                return self.compare(e.op, self.typed(e.left), self.typed(e.right))
            case Quantified():
                return quantified(e.op, self.typed(e.left), e.which, self.subquery(e.query), self.compare, Typed)
            case Between():
                item = self.typed(e.item)
                found = self.compare(">=", item, self.typed(e.low)) & self.compare("<=", item, self.typed(e.high))
            case InList():
                found = self.in_list(self.typed(e.item), [self.typed(i) for i in e.items], e.items)
            case InQuery():
                return self.in_query(self.typed(e.item), self.subquery(e.query), e.negated)
            case Like():
                found = self.like(e)
            case IsNull():
                found = self.column(e.item).isNull()
            case IsDistinct():
                x, y = self.alike(self.typed(e.left), self.typed(e.right))
                found = ~x.eqNullSafe(y)
            case _:
                raise SqlError(f"can't compile {e}")
        return ~found if e.negated else found

    def in_list(self, item: Typed, items: list[Typed], trees) -> Column:
        literals = all(isinstance(t, Literal) for t in trees)
        same = all(isinstance(i.kind, T.StringType) == isinstance(item.kind, T.StringType) and not isinstance(i.kind, TIMES) for i in items)
        if literals and same:
            return item.column.isin(*(i.column for i in items))
        found = self.compare("=", item, items[0])
        for other in items[1:]:
            found = found | self.compare("=", item, other)
        return found

    def in_query(self, item: Typed, rows: DataFrame, negated: bool) -> Column:
        kind = rows.schema[0].dataType
        x, y = self.alike(item, Typed(F.col(rows.columns[0]), kind))
        rows = rows.select(y.alias(fresh("in")))
        return not_in(x, rows) if negated else x.isin(rows)

    def like(self, e: Like) -> Column:
        item, pattern = self.typed(e.item), self.typed(e.pattern)
        text, form = as_text(item.column, item.kind), as_text(pattern.column, pattern.kind)
        if e.escape is not None:
            if len(e.escape) != 1:
                raise SqlError("ESCAPE takes one character")
            return F.like(text, form, F.lit(e.escape))
        if isinstance(e.pattern, Literal) and e.pattern.kind == "string":
            return text.like(e.pattern.value.replace("\\", "\\\\"))  # a backslash stands for itself
        return F.like(text, F.replace(form, F.lit("\\"), F.lit("\\\\")))

    def case(self, e: Case) -> Typed:
        branches = [self.typed(r) for _, r in e.whens] + ([self.typed(e.otherwise)] if e.otherwise else [])
        texts = any(isinstance(b.kind, T.StringType) for b in branches)
        values = [as_text(b.column, b.kind) if texts and not isinstance(b.kind, T.NullType) else b.column for b in branches]
        found = None
        for (when, _), value in zip(e.whens, values):
            found = F.when(self.condition(when), value) if found is None else found.when(self.condition(when), value)
        return self._of(found.otherwise(values[-1]) if e.otherwise else found)

    def call(self, e: Call) -> Typed:
        if is_aggregate(e):
            raise SqlError(f"{e.name} isn't allowed here")
        known = SCALARS.get(e.name.upper())
        if known is None:
            raise SqlError(f"unknown function {e.name}")
        if len(e.args) != known.arity or e.star or e.distinct:
            raise SqlError(f"{e.name} takes {known.arity} arguments")
        if e.name.upper() == "SUBSTR":
            for arg in e.args[1:]:
                if isinstance(arg, Unary) and arg.op == "-" and isinstance(arg.item, Literal):
                    raise SqlError("SUBSTR takes no negative bounds")
        return self._of(known.build(*(self.column(a) for a in e.args)))
