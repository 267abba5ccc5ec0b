"""Masking of personal data in tables that leave the team."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# fixed values: parts of a column name that mark personal data
PERSONAL = ("email", "phone", "name", "firstname", "lastname", "address")
MASK = "[REDACTED]"


def is_personal(name: str) -> bool:
    return any(word in name.lower() for word in PERSONAL)


def _masked(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[
            (F.lit(MASK) if is_personal(f.name) else _masked(c[f.name], f.dataType)).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(c, lambda e: _masked(e, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if isinstance(kind.valueType, T.StringType):
            def mask(k: Column, v: Column) -> Column:
                found = F.lit(False)
                for word in PERSONAL:
                    found = found | F.contains(F.lower(k), F.lit(word))
                return F.when(found, F.lit(MASK)).otherwise(v)
            return F.transform_values(c, mask)
        return F.transform_values(c, lambda _, v: _masked(v, kind.valueType))
    return c


def mask_personal(df: DataFrame) -> DataFrame:
    """Replace every personal column, at any depth; a null is masked too."""
    return df.select(*[
        (F.lit(MASK) if is_personal(f.name) else _masked(F.col(f"`{f.name}`"), f.dataType)).alias(f.name)
        for f in df.schema.fields])
