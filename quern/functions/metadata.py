"""Metadata as JSON: parsed to VARIANT, read by path, and renamed between camelCase and snake_case at every level."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parsed(text: Column) -> Column:
    """The JSON as VARIANT; null for what is none, and for what is no object."""
    v = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def at(meta: Column, path: str, kind: str = "string") -> Column:
    """The value at a path like ``$.device.os`` or ``$.items[0].sku``; null where there is none or it does not convert."""
    return F.try_variant_get(meta, path, kind)


def snake(name: str) -> str:
    """sourceId and HTTPPort are source_id and http_port."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def camel(name: str) -> str:
    """source_id is sourceId; names without an underscore stay."""
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def _type(kind: T.DataType, name) -> T.DataType:
    if isinstance(kind, T.StructType):
        fields = [T.StructField(name(f.name), _type(f.dataType, name), f.nullable, f.metadata) for f in kind.fields]
        if len({f.name for f in fields}) < len(fields):
            raise ValueError(f"two fields of {[f.name for f in kind.fields]} get one name")
        return T.StructType(fields)
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_type(kind.elementType, name), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _type(kind.valueType, name), kind.valueContainsNull)
    return kind


def renamed(df: DataFrame, name=snake) -> DataFrame:
    """All columns, and the fields of structs within them at any depth, under ``name(old)``. Keys of maps and VARIANTs are data and stay.

    A cast renames fields by place, so no value is touched.
    """
    kind = _type(df.schema, name)
    return df.select(*(F.col(f"`{f.name}`").cast(to.dataType).alias(to.name) if f.dataType != to.dataType else F.col(f"`{f.name}`").alias(to.name) for f, to in zip(df.schema.fields, kind.fields, strict=True)))


def payload(chunks: DataFrame) -> DataFrame:
    """Chunks as payload rows: (chunkId, workspaceId, ..., metadata) with camelCase names, metadata as JSON text."""
    out = renamed(chunks, camel)
    return out.withColumn("metadata", F.to_json("metadata")) if "metadata" in out.columns else out


def from_payload(rows: DataFrame) -> DataFrame:
    """Payload rows as chunks: snake_case names, metadata as VARIANT, an object without fields where it is no JSON object."""
    out = renamed(rows, snake)
    return out.withColumn("metadata", F.coalesce(parsed(F.col("metadata")), F.parse_json(F.lit("{}")))) if "metadata" in out.columns else out
