"""UNION ALL of inputs whose schemas are equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..errors import BindError


def check_same_schema(frames: dict[str, DataFrame], *, nullability: bool = True) -> None:
    """Raise unless names, types, order and (``nullability``) nullability of all are equal; metadata is ignored."""
    (first, base), *rest = frames.items()
    for name, df in rest:
        if len(df.schema) != len(base.schema):
            raise BindError(f"UNION ALL: '{first}' has {len(base.schema)} columns, '{name}' has {len(df.schema)}")
        for a, b in zip(base.schema, df.schema, strict=True):
            if a.name != b.name:
                raise BindError(f"UNION ALL: the column '{a.name}' of '{first}' is '{b.name}' in '{name}'")
            if a.dataType != b.dataType:
                raise BindError(f"UNION ALL: '{a.name}' is {a.dataType.simpleString()} in '{first}', {b.dataType.simpleString()} in '{name}'")
            if nullability and a.nullable != b.nullable:
                raise BindError(f"UNION ALL: '{a.name}' may be null in one of '{first}' and '{name}' only")


def union_all(frames: dict[str, DataFrame], *, nullability: bool = True) -> DataFrame:
    """All rows of all inputs; no shuffle."""
    check_same_schema(frames, nullability=nullability)
    return reduce(DataFrame.union, frames.values())
