"""Schema conversion: columns renamed, put in order and cast to a target schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindError


def convert(df: DataFrame, target: T.StructType, renamed: dict[str, str] | None = None, *, strict: bool = True) -> DataFrame:
    """``df`` in the schema ``target``; ``renamed`` maps target names to source names.

    All target columns may be null. A value that its target type can't hold is an
    error (``strict``) or null. Nulls stay null. Source columns that no target
    column takes are left out.
    """
    out = []
    for f in target:
        source = (renamed or {}).get(f.name, f.name)
        if source not in df.columns:
            raise BindError(f"'{f.name}' takes the column '{source}', which the input does not have")
        value = F.col(f"`{source}`")
        out.append((value.cast(f.dataType) if strict else value.try_cast(f.dataType)).alias(f.name))
    return df.select(*out)


def match_columns(source: T.StructType, target: T.StructType, aliases: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """Target name to source name: equal names, then names equal without case, then ``aliases`` of the target's."""
    names = [f.name for f in source]
    lower = {n.lower(): n for n in names}
    found = {}
    for f in target:
        options = (f.name, *(aliases or {}).get(f.name, ()))
        hit = next((n for n in options if n in names), None) or next((lower[n.lower()] for n in options if n.lower() in lower), None)
        if hit is None:
            raise BindError(f"no column of the input fits '{f.name}'")
        found[f.name] = hit
    return found
