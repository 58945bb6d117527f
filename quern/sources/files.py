"""CSV and JSON-lines import and export with typed, checked fields.

Text form of values: NULL is ``\\N`` in CSV; bytes are hexadecimal; booleans are 1/0 (read: also t, true,
f, false); timestamps are microseconds since the epoch (read: also YYYY-MM-DD[ HH:MM:SS]); decimals are
strings in JSON and round half away from zero when read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.scalar import from_micros, micros

NULL = "\\N"
BAD = "_bad"


class ImportFailed(ValueError):
    """More bad records than an import allows, or a header that does not fit."""


def parse_field(s: Column, kind: T.DataType) -> Column:
    """A value from its text; NULL if it does not parse."""
    t = F.trim(s)
    if isinstance(kind, T.StringType):
        return s
    if isinstance(kind, T.BinaryType):
        return F.when(s.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(s))
    if isinstance(kind, T.BooleanType):
        low = F.lower(t)
        return F.when(low.isin("1", "t", "true"), True).when(low.isin("0", "f", "false"), False)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        read = F.when(t.rlike(r"^-?\d+$"), from_micros(t.try_cast("bigint"))).when(t.rlike(r"^\d{4}-\d\d-\d\d( \d\d:\d\d:\d\d)?$"), t.try_cast("timestamp_ntz"))
        return read.cast(kind)
    if isinstance(kind, T.DecimalType):
        return F.round(t.try_cast("decimal(38,18)"), kind.scale).try_cast(kind)
    return t.try_cast(kind)


def show_field(x: Column, kind: T.DataType) -> Column:
    """The text of a value."""
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(x))
    if isinstance(kind, T.BooleanType):
        return x.cast("int").cast("string")
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return micros(x).cast("string")
    return x.cast("string")


def checked(raw: DataFrame, schema: T.StructType, is_null, max_errors: int) -> DataFrame:
    """Typed rows; raises if more than ``max_errors`` rows hold a field that does not parse or a NULL where none may be."""
    values, bad = [], F.lit(False)
    for f in schema.fields:
        s = F.col(f"`{f.name}`")
        null = is_null(s)
        v = F.when(~null, parse_field(s, f.dataType))
        values.append(v.cast(f.dataType).alias(f.name))
        bad = bad | (~null & v.isNull()) | (null if not f.nullable else F.lit(False))
    typed = raw.select(*values, bad.alias(BAD))
    errors = typed.where(BAD).count()
    if errors > max_errors:
        raise ImportFailed(f"{errors} bad records, {max_errors} allowed")
    return typed.where(~F.col(BAD)).drop(BAD)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ",", header: bool = True, max_errors: int = 0) -> DataFrame:
    """Rows of a CSV file; with a header, columns may come in any order."""
    names = schema.names
    if header:
        first = spark.read.option("header", True).option("sep", delimiter).csv(path)
        if sorted(first.columns) != sorted(names):
            raise ImportFailed(f"header {first.columns} does not match {names}")
        names = first.columns
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(text).option("header", header).option("sep", delimiter).option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    return checked(raw, schema, lambda s: s.isNull() | (s == NULL), max_errors)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    out = df.select([F.coalesce(show_field(F.col(f"`{f.name}`"), f.dataType), F.lit(NULL)).alias(f.name) for f in df.schema.fields])
    out.write.option("header", header).option("sep", delimiter).option("escape", '"').option("emptyValue", "").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, max_errors: int = 0) -> DataFrame:
    """Rows of a JSON-lines file; an object must have exactly the schema's fields."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    text = T.StructType([T.StructField(n, T.StringType()) for n in schema.names])
    keys = F.sort_array(F.json_object_keys("value"))
    raw = lines.select(F.from_json("value", text).alias("r"), F.coalesce(keys != F.array(*[F.lit(n) for n in sorted(schema.names)]), F.lit(True)).alias("odd"))
    odd = raw.where("odd").count()
    if odd > max_errors:
        raise ImportFailed(f"{odd} objects do not have exactly the columns of the table")
    return checked(raw.where("NOT odd").select("r.*"), schema, lambda s: s.isNull(), max_errors - odd)


def write_jsonl(df: DataFrame, path: str) -> None:
    keep = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType, T.StringType)
    fields = [F.col(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, keep) else show_field(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
