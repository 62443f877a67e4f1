"""Queries of the dialect as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import AGGREGATES
from ..functions.aggregate import ordered_sum
from ..sql.lexer import SqlError
from ..sql.tree import (
    Aliased, Compare, Derived, Expr, Join, Literal, Logical, Name, Query, Relation, Select, SelectItem, SetOperation, SortItem, Table,
)
from .expressions import Compiler, Typed, aggregates_in, children, default_name
from .scope import Field, Scope, fresh, scope_of

#: (name parts, request conditions of the WHERE clause, lower-cased column -> text) -> (DataFrame, full name)
Lookup = Callable[[tuple[str, ...], dict[str, str]], tuple[DataFrame, tuple[str, ...]]]


class QueryCompiler:
    def __init__(self, spark, lookup: Lookup, hint: int | None = None) -> None:
        self.spark, self.lookup, self.hint = spark, lookup, hint

    # results

    def frame(self, query: Query) -> DataFrame:
        """The result, with the names it is shown by (they may repeat)."""
        scope = self.query(query)
        columns = [f.column.cast("int") if isinstance(f.kind, T.NullType) else f.column for f in scope.fields]
        return scope.df.select(*columns).toDF(*(f.name for f in scope.fields))

    def one_column(self, query: Query) -> DataFrame:
        scope = self.query(query)
        first = scope.fields[0]
        return scope.df.select(first.column)

    def compiler(self, scope: Scope, replaced: dict | None = None, stray=None) -> Compiler:
        return Compiler(scope, self.one_column, replaced, stray)

    # queries

    def query(self, query: Query) -> Scope:
        if isinstance(query.term, Select):
            scope = self.select(query.term, query.order)
        else:
            scope = self.term(query.term)
            if query.order:
                scope = Scope(self.sorted(scope.df, query.order, self.compiler(scope)), scope.fields)
        return scope if query.limit is None else Scope(scope.df.limit(query.limit), scope.fields)

    def term(self, term) -> Scope:
        match term:
            case Select():
                return self.select(term, ())
            case Query():
                return self.query(term)
            case SetOperation():
                return self.set_operation(term)
        raise SqlError(f"can't compile {term}")

    def set_operation(self, term: SetOperation) -> Scope:
        left, right = self.term(term.left), self.term(term.right)
        if len(left.fields) != len(right.fields):
            raise SqlError(f"{term.op} of {len(left.fields)} and {len(right.fields)} columns")
        a = left.df.select(*(f.column for f in left.fields))
        b = right.df.select(*(f.column for f in right.fields))
        match term.op, term.all:
            case "UNION", True:
                df = a.union(b)
            case "UNION", False:
                df = a.union(b).distinct()
            case "INTERSECT", every:
                df = a.intersectAll(b) if every else a.intersect(b)
            case _, every:
                df = a.exceptAll(b) if every else a.subtract(b)
        out = scope_of(df)
        return Scope(out.df, tuple(replace(f, name=g.name) for f, g in zip(out.fields, left.fields)))

    @staticmethod
    def sort_column(item: SortItem, column: Column) -> Column:
        """Nulls are least unless stated."""
        first = item.nulls_first if item.nulls_first is not None else not item.descending
        if item.descending:
            return column.desc_nulls_first() if first else column.desc_nulls_last()
        return column.asc_nulls_first() if first else column.asc_nulls_last()

    def sorted(self, df: DataFrame, order: tuple[SortItem, ...], compiler: Compiler) -> DataFrame:
        keys = [self.sort_column(s, compiler.column(s.item)) for s in order if not isinstance(s.item, Literal)]  # constants don't sort
        return df.orderBy(*keys) if keys else df

    # selects

    def select(self, s: Select, order: tuple[SortItem, ...]) -> Scope:
        if s.relation is None:
            scope = Scope(self.spark.range(1).select(), ())
        else:
            scope = self.relation(s.relation, _requests(s.where))
        if s.where is not None:
            scope = Scope(scope.df.filter(self.compiler(scope).condition(s.where)), scope.fields)
        items = self.expanded(s.items, scope)
        aggregates = [a for i in items for a in aggregates_in(i.item)] + ([a for a in aggregates_in(s.having)] if s.having else [])
        aggregates += [a for o in order for a in aggregates_in(o.item)]
        if s.group or aggregates:
            compiler = self.aggregated(scope, s, items, aggregates, order)
        else:
            compiler = self.compiler(scope)
        df = compiler.scope.df
        if s.having is not None:
            df = df.filter(compiler.condition(s.having))
        fields, columns, shown = [], [], {}
        for item in items:
            found = compiler.typed(item.item)
            table = ()
            if isinstance(item.item, Name) and item.alias is None:
                table = compiler_field(scope, item.item).table
            field = Field(item.alias or default_name(item.item), fresh(), found.kind, table)
            fields.append(field)
            columns.append(found.column.alias(field.inner))
            shown.setdefault(compiler.key(item.item), Typed(field.column, field.kind))
        if not order:
            out = df.select(*columns)
            return Scope(out.distinct() if s.distinct else out, tuple(fields))
        return self.select_sorted(df, s, order, compiler, tuple(fields), columns, shown)

    def select_sorted(self, df: DataFrame, s: Select, order, compiler: Compiler, fields, columns, shown) -> Scope:
        """ORDER BY sees output columns first, then repeats of output expressions, then, unless DISTINCT, the input."""
        keys, hidden = [], []
        out = df.select(*columns)
        output = Scope(out, fields)
        for o in order:
            if isinstance(o.item, Literal):
                continue
            found = shown.get(compiler.key(o.item)) if not isinstance(o.item, Name) or len(o.item.parts) > 1 else None
            if found is None:
                try:
                    found = self.compiler(output).typed(o.item)
                except SqlError:
                    if compiler.key(o.item) in shown:
                        found = shown[compiler.key(o.item)]
                    elif s.distinct:
                        raise
                    else:
                        inner = fresh("o")
                        hidden.append(compiler.column(o.item).alias(inner))
                        found = Typed(F.col(inner), T.NullType())
            keys.append(self.sort_column(o, found.column))
        if hidden:
            out = df.select(*columns, *hidden)
        if s.distinct:
            out = out.distinct()
        if keys:
            out = out.orderBy(*keys)
        return Scope(out.select(*(f.column for f in fields)) if hidden else out, fields)

    @staticmethod
    def expanded(items: tuple[SelectItem, ...], scope: Scope) -> list[SelectItem]:
        out = []
        for item in items:
            if item.item is not None:
                out.append(item)
                continue
            for field in scope.of_table(item.qualifier) if item.qualifier else scope.fields:
                out.append(SelectItem(_Exact((*field.table, field.name), False, field), None))
        if not out:
            raise SqlError("nothing is selected")
        return out

    def aggregated(self, scope: Scope, s: Select, items, aggregates, order) -> Compiler:
        """Groups `scope`; the compiler returned takes group expressions and aggregates as columns, and of other
        columns any value of the group."""
        inner = self.compiler(scope)
        keys, columns, replaced = [], [], {}
        for e in s.group:
            found, name = inner.typed(e), fresh("g")
            # a bare constant would be read as a position
            column = F.when(F.rand(0) >= 0, found.column) if isinstance(e, Literal) else found.column
            keys.append(column.alias(name))
            replaced[inner.key(e)] = Typed(F.col(name), found.kind)
        for call in aggregates:
            key = inner.key(call)
            if key not in replaced:
                name, column = fresh("a"), self.aggregate(call, inner)
                columns.append(column.alias(name))
                replaced[key] = Typed(F.col(name), scope.df.agg(column).schema[0].dataType)
        strays: dict[str, str] = {}

        def stray(field: Field) -> Typed:
            key = ("name", field.inner)
            if key in replaced:
                return replaced[key]
            return Typed(F.col(strays[field.inner]), field.kind)

        outer = [i.item for i in items] + ([s.having] if s.having is not None else []) + [o.item for o in order]
        for e in outer:
            for field in self.stray_fields(e, inner, replaced):
                if field.inner not in strays:
                    strays[field.inner] = fresh("f")
                    columns.append(F.first(field.column).alias(strays[field.inner]))
        if not columns:
            columns = [F.count(F.lit(1)).alias(fresh("n"))]
        df = scope.df.groupBy(*keys).agg(*columns) if keys else scope.df.agg(*columns)
        return self.compiler(Scope(df, scope.fields), replaced, stray)

    @staticmethod
    def stray_fields(e: Expr, compiler: Compiler, replaced: dict) -> list[Field]:
        if compiler.key(e) in replaced:
            return []
        if isinstance(e, Name):
            try:
                return [compiler.field(e)]
            except SqlError:
                return []  # an output name in ORDER BY; unknown names fail when compiled
        return [f for c in children(e) for f in QueryCompiler.stray_fields(c, compiler, replaced)]

    @staticmethod
    def aggregate(call, compiler: Compiler) -> Column:
        name = call.name.upper()
        if call.star:
            if name != "COUNT":
                raise SqlError(f"{call.name}(*) isn't known")
            return F.count(F.lit(1))
        if len(call.args) != 1:
            raise SqlError(f"{call.name} takes one argument")
        if aggregates_in(call.args[0]):
            raise SqlError("aggregates can't be nested")
        found = compiler.typed(call.args[0])
        if call.order and name == "SUM" and isinstance(found.kind, T.StringType):
            directions = {s.descending for s in call.order}
            if len(directions) > 1 or any(s.nulls_first is not None and s.nulls_first == s.descending for s in call.order):
                raise SqlError("ORDER BY in SUM takes one direction, nulls being least")
            if call.distinct and [compiler.key(s.item) for s in call.order] != [compiler.key(call.args[0])]:
                raise SqlError("SUM(DISTINCT) can be ordered by its argument only")
            return ordered_sum(found.column, [compiler.column(s.item) for s in call.order], directions.pop(), call.distinct)
        return AGGREGATES[name](found.column, found.kind, call.distinct)

    # relations

    def relation(self, r: Relation, requests: dict[str, str]) -> Scope:
        match r:
            case Table():
                df, full = self.lookup(r.parts, requests)
                scope = scope_of(df.repartition(self.hint) if self.hint else df, full)
                return scope.aliased(r.alias) if r.alias else scope
            case Derived():
                scope = self.query(r.query)
                return scope.aliased(r.alias) if r.alias else scope
            case Aliased():
                return self.relation(r.relation, requests).aliased(r.alias)
            case Join():
                return self.join(r, requests)
        raise SqlError(f"can't compile {r}")

    def join(self, r: Join, requests: dict[str, str]) -> Scope:
        left, right = self.relation(r.left, requests), self.relation(r.right, requests)
        fields = left.fields + right.fields
        if r.how == "cross":
            return Scope(left.df.crossJoin(right.df), fields)
        if r.on is not None:
            # the condition's names are looked up in both sides; compiling types needs them in one frame
            both = Scope(left.df.crossJoin(right.df), fields)
            return Scope(left.df.join(right.df, self.compiler(both).condition(r.on), r.how), fields)
        pairs = [(left.find((n,)), right.find((n,))) for n in r.using]
        compiler = self.compiler(left)
        on = reduce(lambda a, b: a & b, (compiler.compare("=", Typed(a.column, a.kind), Typed(b.column, b.kind)) for a, b in pairs))
        df = left.df.join(right.df, on, r.how)
        keys = []
        for a, b in pairs:
            if r.how == "full":
                name = fresh("u")
                df = df.withColumn(name, F.coalesce(a.column, b.column))
                keys.append(Field(a.name, name, a.kind, a.table))
            else:
                keys.append(b if r.how == "right" else a)
        used = {f.inner for pair in pairs for f in pair}
        return Scope(df, (*(replace(k, name=n) for k, n in zip(keys, r.using)), *(f for f in fields if f.inner not in used)))


class _Exact(Name):
    """A column of `*`, known without its name."""

    def __init__(self, parts: tuple[str, ...], ordinal: bool, field: Field) -> None:
        super().__init__(parts, ordinal)
        object.__setattr__(self, "exact", field)


def compiler_field(scope: Scope, name: Name) -> Field:
    return getattr(name, "exact", None) or Compiler(scope, None).field(name)


def _requests(where: Expr | None) -> dict[str, str]:
    """column = 'text' conditions that every row must meet: what sources may take as parameters."""
    match where:
        case Logical(op="AND"):
            return _requests(where.left) | _requests(where.right)
        case Compare(op="=", left=Name() as name, right=Literal(kind="string") as text):
            return {name.parts[-1].lower(): text.value}
        case Compare(op="=", left=Literal(kind="string") as text, right=Name() as name):
            return {name.parts[-1].lower(): text.value}
    return {}
