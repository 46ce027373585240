"""JSON messages to columns and back, as strictly as pipelines need it."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError

#: Type names of declared schemas.
DECLARED = {
    "int64": T.LongType(), "int32": T.IntegerType(), "float64": T.DoubleType(), "float32": T.FloatType(),
    "utf8": T.StringType(), "string": T.StringType(), "boolean": T.BooleanType(), "bool": T.BooleanType(),
}


def declared_schema(text: str) -> T.StructType:
    """A schema file: a list (or ``{"fields": [..]}``) of name, type and nullable."""
    raw = json.loads(text)
    rows = raw.get("fields") if isinstance(raw, dict) else raw
    if not isinstance(rows, list) or not rows:
        raise ConfigError("a schema file is a list of fields")
    out = []
    for f in rows:
        kind = DECLARED.get(str(f.get("type", f.get("data_type", ""))).lower())
        if kind is None or not f.get("name"):
            raise ConfigError(f"the schema field {f} has no name or a type other than {', '.join(sorted(DECLARED))}")
        out.append(T.StructField(f["name"], kind, bool(f.get("nullable", True))))
    if len({f.name for f in out}) != len(out):
        raise ConfigError("a schema names a field twice")
    return T.StructType(out)


def load_schema(path: str | Path) -> T.StructType:
    return declared_schema(Path(path).read_text(encoding="utf-8"))


def decode_json(df: DataFrame, schema: T.StructType, value: str = "value", *, strict: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One object a message; a message that does not fit fails the query.

    Absent and null are null, unknown fields are passed over, of a repeated field
    the last counts, whole numbers fit floating columns. ``strict`` also refuses
    what stands behind the object and other types in text columns, and nulls in
    columns that are declared without.
    """
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    text = F.col(value).cast("string")
    options = {"mode": "FAILFAST"}
    rows = df.select(*keep, text.alias("__v"), F.from_json(text, loose, options).alias("__r"))
    fail = lambda why: F.raise_error(F.concat(F.lit(why + ": "), F.substring("__v", 1, 200)))
    texts = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    if strict:
        rows = rows.withColumn("__r", F.when(~F.col("__v").rlike(r"(?s)^\s*\{.*\}\s*$"), fail("not one JSON object").cast(loose)).otherwise(F.col("__r")))
        if texts:
            as_variant = ", ".join(f"`{n}` variant" for n in texts)
            rows = rows.withColumn("__w", F.from_json("__v", as_variant, options))
    out = []
    for f in schema:
        c = F.col(f"__r.`{f.name}`")
        if strict and f.name in texts:
            kind = F.schema_of_variant(F.col(f"__w.`{f.name}`"))
            c = F.when(kind.isNotNull() & ~kind.isin("STRING", "VOID"), fail(f"'{f.name}' is no text").cast(f.dataType)).otherwise(c)
        if strict and not f.nullable:
            c = F.when(c.isNull(), fail(f"'{f.name}' is null").cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return rows.select(*keep, *out)


def encode_json(df: DataFrame, key: str) -> DataFrame:
    """``key, value``: the key as text and all columns as a JSON object, nulls included.

    A null key and a floating number that is not finite fail the query.
    """
    if key not in df.columns:
        raise ConfigError(f"the output has no column '{key}'")
    columns = []
    for f in df.schema:
        if not isinstance(f.dataType, T.LongType | T.IntegerType | T.DoubleType | T.StringType | T.BooleanType):
            raise ConfigError(f"'{f.name}' is {f.dataType.simpleString()}, which a message can't hold")
        columns.append(_finite(F.col(f"`{f.name}`"), f).alias(f.name))
    if not isinstance(df.schema[key].dataType, T.LongType | T.IntegerType | T.StringType):
        raise ConfigError(f"the key '{key}' is {df.schema[key].dataType.simpleString()}; a long, an int or a text is needed")
    own = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"the key '{key}' is null")).cast("string")).otherwise(F.col(key).cast("string"))
    return df.select(own.alias("key"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def _finite(c: Column, f: T.StructField) -> Column:
    if not isinstance(f.dataType, T.DoubleType):
        return c
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"'{f.name}' is not a finite number")).cast("double")).otherwise(c)
