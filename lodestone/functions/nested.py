"""Values of any nesting made fit for JSON, as one expression built along the column's type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso(c: Column, kind: T.DataType) -> Column:
    """Dates and times in ISO 8601: microseconds only where there are some, an offset where the type has a zone (the session's)."""
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    fraction = F.date_format(c, "SSSSSS")
    text = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)))
    return F.concat(text, F.date_format(c, "xxx")) if isinstance(kind, T.TimestampType) else text


def _plain(kind: T.DataType) -> bool:
    """Whether JSON has all that a type is made of."""
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) and _plain(kind.valueType)
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind)
    return not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType))


def json_safe(c: Column, kind: T.DataType, drop: frozenset[str] = frozenset()) -> Column:
    """``c`` with dates and times as ISO texts and bytes as base64 at any depth, and without struct fields named in ``drop``.

    Nulls stay nulls: of a value, an element or a field.  Map keys that are dates become texts as well.
    """
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return iso(c, kind)
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if _plain(kind) and not drop:
        return c
    if isinstance(kind, T.StructType):
        kept = [f for f in kind if f.name not in drop]
        if not kept:
            return F.lit(None).cast("string")
        return F.when(c.isNotNull(), F.struct(*(json_safe(c.getField(f.name), f.dataType, drop).alias(f.name) for f in kept)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: json_safe(x, kind.elementType, drop))
    if isinstance(kind, T.MapType):
        own = F.transform_values(c, lambda k, v: json_safe(v, kind.valueType, drop))
        return own if _plain(kind.keyType) else F.transform_keys(own, lambda k, v: json_safe(k, kind.keyType, drop))
    return c


def properties_json(df: DataFrame, columns: list[str], drop: frozenset[str] = frozenset()) -> Column:
    """The columns, but those in ``drop``, as one JSON text; properties that are null are left out, at any depth."""
    return F.to_json(F.struct(*(json_safe(F.col(f"`{c}`"), df.schema[c].dataType, drop).alias(c) for c in columns if c not in drop)))
