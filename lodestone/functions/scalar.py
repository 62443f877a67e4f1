"""Scalar functions: name -> number of arguments and builder of a Column from Columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scalar:
    arity: int
    build: Callable[..., Column]


SCALARS: dict[str, Scalar] = {}


def register(name: str, arity: int, build: Callable[..., Column]) -> None:
    """Adds or replaces a function; `build` gets a Column for each argument."""
    SCALARS[name.upper()] = Scalar(arity, build)


def _double(build: Callable[..., Column]) -> Callable[..., Column]:
    return lambda *args: build(*(a.cast("double") for a in args))


def _log(build: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """With IEEE results where Spark gives null: -Infinity at 0, NaN below."""

    def log(x: Column) -> Column:
        return F.when(x > 0, build(x)).when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(build(x))

    return _double(log)


def _substr(text: Column, begin: Column, end: Column) -> Column:
    """0-based, `end` exclusive; bounds outside the text are cut."""
    begin, end = F.greatest(begin, F.lit(0)).cast("int"), F.greatest(end, F.lit(0)).cast("int")
    return F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0)))


register("ABS", 1, F.abs)
for _name, _build in {
    "SQRT": F.sqrt, "POW": F.pow, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ASIN": F.asin, "ACOS": F.acos, "ATAN": F.atan,
    "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh, "ASINH": F.asinh, "ACOSH": F.acosh, "ATANH": F.atanh,
    "CEIL": lambda x: F.ceil(x).cast("double"), "CEILING": lambda x: F.ceil(x).cast("double"), "FLOOR": lambda x: F.floor(x).cast("double"), "ROUND": F.round,
}.items():
    register(_name, 2 if _name == "POW" else 1, _double(_build))
for _name, _build in {"LN": F.ln, "LOG10": F.log10, "LOG2": F.log2}.items():
    register(_name, 1, _log(_build))
register("LOG", 2, lambda x, base: SCALARS["LN"].build(x) / F.nullif(SCALARS["LN"].build(base), F.lit(0.0)))
register("RAND", 0, lambda: F.rand())
register("RANDOM", 0, lambda: F.rand())
register("E", 0, lambda: F.lit(math.e))
register("PI", 0, lambda: F.lit(math.pi))
register("LENGTH", 1, lambda s: F.octet_length(s.cast("string")).cast("long"))
register("LOWER", 1, F.lower)
register("UPPER", 1, F.upper)
register("REVERSE", 1, lambda s: F.reverse(s.cast("string")))
register("CONCAT", 2, F.concat)
register("SUBSTR", 3, _substr)
register("REPLACE", 3, lambda s, a, b: F.replace(s, a, b))
register("NOW", 0, lambda: F.date_trunc("SECOND", F.current_timestamp()))
for _name, _build in {"DAY": F.dayofmonth, "MONTH": F.month, "YEAR": F.year, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}.items():
    register(_name, 1, _build)
