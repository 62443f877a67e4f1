"""The dialect's type names, their Spark types, and casts that never fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK_TYPES: dict[str, T.DataType] = {
    "STRING": T.StringType(), "FLOAT64": T.DoubleType(), "FLOAT32": T.FloatType(), "INT8": T.ByteType(), "UINT8": T.ShortType(),
    "INT16": T.ShortType(), "UINT16": T.IntegerType(), "INT32": T.IntegerType(), "UINT32": T.LongType(), "INT64": T.LongType(),
    "UINT64": T.DecimalType(20, 0), "BOOL": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "DATE": T.DateType(),
}

_NAMES: dict[type, str] = {
    T.StringType: "STRING", T.DoubleType: "FLOAT64", T.FloatType: "FLOAT32", T.ByteType: "INT8", T.ShortType: "INT16", T.IntegerType: "INT32",
    T.LongType: "INT64", T.BooleanType: "BOOL", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.DateType: "DATE",
}

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType)


def type_of_name(name: str) -> T.DataType:
    """The Spark type of a dialect type name, in any case."""
    try:
        return SPARK_TYPES[name.strip().upper()]
    except KeyError:
        raise ValueError(f"unknown column type {name!r}") from None


def name_of_type(kind: T.DataType) -> str:
    """The dialect's name of a Spark type; other types keep Spark's name."""
    return _NAMES.get(type(kind), kind.simpleString().upper())


# formats without a weekday, tried in turn on texts whose weekday and repeated blanks have been removed
_TIME_FORMATS = ("MMM d HH:mm:ss z yyyy", "MMM d HH:mm:ss Z yyyy", "dd MMM yy HH:mm z", "dd MMM yy HH:mm Z", "dd-MMM-yy HH:mm:ss z", "dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss Z")


def parse_time(text: Column) -> Column:
    """A timestamp in whole seconds from the accepted text formats, or null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]+,? +(?=[A-Za-z0-9])", ""), " +", " ")
    months = F.concat(F.lit(""), F.regexp_extract(F.trim(text), r"^([A-Z][a-z]{2}) +\d", 0))  # text that starts with a month has no weekday to drop
    whole = F.when(months != "", F.regexp_replace(F.trim(text), " +", " ")).otherwise(bare)
    tries = [F.try_to_timestamp(text), *[F.try_to_timestamp(whole, F.lit(f)) for f in _TIME_FORMATS]]
    return F.date_trunc("SECOND", F.coalesce(*tries))


def lenient(text: Column, kind: T.DataType, strict: bool = False) -> Column:
    """`text` as `kind`; what doesn't parse, or is missing, is the type's zero (null where `strict`)."""

    def zero(parsed: Column, value) -> Column:
        return parsed if strict else F.coalesce(parsed, F.lit(value).cast(kind))

    if isinstance(kind, T.StringType):
        return zero(text, "")
    if isinstance(kind, T.BooleanType):
        return text.try_cast("boolean") if strict else F.coalesce(text != "", F.lit(False))
    if isinstance(kind, T.TimestampType):
        return zero(parse_time(text), "1970-01-01 00:00:00")
    if isinstance(kind, T.DateType):
        return zero(F.to_date(parse_time(text)), "1970-01-01")
    return zero(F.trim(text).try_cast(kind), 0)


def as_text(column: Column, kind: T.DataType) -> Column:
    """A value's text in comparisons with strings and in concatenation: whole doubles have no decimals."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return F.when(whole, column.cast("long").cast("string")).otherwise(column.cast("string"))
    return column.cast("string")
