"""Payloads as JSON: one text for one value, and dates that survive the way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, MapType, StringType, StructField, StructType, TimestampNTZType, TimestampType

#: Fixed value: the key that marks a date.
DATE = "$date"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
_DATES = (TimestampType, TimestampNTZType, DateType)


def canonical(text: Column) -> Column:
    """JSON text with the keys of every object in their order and no white space between, at any depth; null if it is no JSON.

    Of keys that repeat in an object the parser takes none: such texts give null.
    """
    return F.to_json(F.try_parse_json(text))


def encoded(c: Column, kind: DataType) -> Column:
    """The value with every date, at any depth, in an object of its own: {"$date": ISO text in UTC}."""
    if isinstance(kind, _DATES):
        text = F.date_format(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()), ISO)
        return F.when(c.isNotNull(), F.struct(text.alias(DATE)))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: encoded(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: encoded(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[encoded(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def _marked(kind: DataType) -> DataType:
    if isinstance(kind, _DATES):
        return StructType([StructField(DATE, StringType())])
    if isinstance(kind, ArrayType):
        return ArrayType(_marked(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(kind.keyType, _marked(kind.valueType))
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _marked(f.dataType)) for f in kind.fields])
    return kind


def _decoded(c: Column, kind: DataType) -> Column:
    if isinstance(kind, _DATES):
        return F.try_to_timestamp(c[DATE]).cast(kind)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _decoded(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: _decoded(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_decoded(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def serialized(c: Column, kind: DataType) -> Column:
    """JSON of a value of that type, dates marked, keys in the type's order."""
    return F.to_json(encoded(c, kind))


def deserialized(text: Column, kind: DataType) -> Column:
    """The value of that type that a serialized() text holds; null if it is no JSON."""
    return _decoded(F.from_json(text, _marked(kind), {"mode": "PERMISSIVE"}), kind)
