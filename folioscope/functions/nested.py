"""Nested values: redaction by name, and payloads that come back as the records they were."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "[redacted]"


def redacted(value: Column, kind: T.DataType, names: Collection[str], mask: str = MASK) -> Column:
    """The value with whatever stands under one of the names (in any case) replaced by the mask, at any depth.

    Only the type is walked while planning; rows are read by the expression that it gives.  Null
    values stay null.  A masked field is a string; a masked map value is the mask if values are
    strings, else null.
    """
    hidden = {n.lower() for n in names}
    if isinstance(kind, T.StructType):
        fields = [F.when(value[f.name].isNotNull(), F.lit(mask)) if f.name.lower() in hidden else redacted(value[f.name], f.dataType, names, mask) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*[x.alias(f.name) for x, f in zip(fields, kind.fields, strict=True)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted(x, kind.elementType, names, mask))
    if isinstance(kind, T.MapType):
        instead = F.lit(mask) if isinstance(kind.valueType, T.StringType) else F.lit(None)
        return F.transform_values(value, lambda k, v: F.when(F.lower(k.cast("string")).isin(sorted(hidden)), instead).otherwise(redacted(v, kind.valueType, names, mask)))
    return value


def without_secrets(rows: DataFrame, names: Collection[str], mask: str = MASK) -> DataFrame:
    """All columns of rows, redacted."""
    return rows.select(*[(F.when(F.col(f.name).isNotNull(), F.lit(mask)) if f.name.lower() in {n.lower() for n in names} else redacted(F.col(f.name), f.dataType, names, mask)).alias(f.name) for f in rows.schema.fields])


def to_payload(rows: DataFrame, key: str) -> DataFrame:
    """key, payload: each record's other columns as JSON, nulls included."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key]), {"ignoreNullFields": "false"}).alias("payload"))


def from_payload(rows: DataFrame, key: str, schema: T.StructType) -> DataFrame:
    """The records that `to_payload` was given; schema: theirs.  A payload that can't be read fails."""
    inner = T.StructType([f for f in schema.fields if f.name != key])
    read = rows.select(key, F.from_json("payload", inner, {"mode": "FAILFAST"}).alias("r"))
    return read.select(*[F.col(key) if f.name == key else F.col("r")[f.name].alias(f.name) for f in schema.fields])
