"""Scalar semantics of a MySQL-flavoured engine as column expressions.

Spark's own functions differ in the cases below; everything here is built-in, so it stays in codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PRECISION = 18


def bigint(x: Column) -> Column:
    """Integer operands count as 64-bit in arithmetic."""
    return x.cast("bigint")


def add(a: Column, b: Column) -> Column:
    return bigint(a) + bigint(b)


def subtract(a: Column, b: Column) -> Column:
    return bigint(a) - bigint(b)


def multiply(a: Column, b: Column) -> Column:
    return bigint(a) * bigint(b)


def negate(a: Column) -> Column:
    return -bigint(a)


def divide(a: Column, b: Column) -> Column:
    """Floating-point quotient; NULL for a zero divisor."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def int_divide(a: Column, b: Column) -> Column:
    """Integer quotient, truncated toward zero; NULL for a zero divisor."""
    q = bigint(a) - F.try_mod(bigint(a), bigint(b))
    return F.try_divide(q.cast("decimal(20,0)"), bigint(b).cast("decimal(20,0)")).cast("bigint")


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; NULL for a zero divisor."""
    return F.try_mod(a, b)


def decimal_type_of_sum(p1: int, s1: int, p2: int, s2: int) -> T.DecimalType:
    s = max(s1, s2)
    return T.DecimalType(min(MAX_PRECISION, max(p1 - s1, p2 - s2) + s + 1), s)


def decimal_type_of_product(p1: int, s1: int, p2: int, s2: int) -> T.DecimalType:
    return T.DecimalType(min(MAX_PRECISION, p1 + p2), min(MAX_PRECISION, s1 + s2))


def decimal_divide(a: Column, b: Column, scale: int) -> Column:
    """Exact decimal quotient, rounded half away from zero at ``scale`` + 4; NULL for a zero divisor.

    The quotient of whole numbers is taken with its remainder, so there is only one rounding.
    """
    out = min(MAX_PRECISION, scale + 4)
    n = F.abs(a.cast("decimal(38,6)") * F.lit(10**out).cast("decimal(20,0)")).cast("decimal(38,6)")
    d = F.abs(b.cast("decimal(24,6)"))
    whole = F.floor(F.try_divide(n, d).cast("decimal(38,6)")).cast("decimal(30,0)")
    # correct the guess of the quotient by its remainder, then round
    rest = n - whole * d
    whole = whole + F.when(rest < 0, -1).when(rest >= d, 1).otherwise(0)
    rest = n - whole * d
    whole = whole + F.when(rest * 2 >= d, 1).otherwise(0)
    sign = F.when((a < 0) != (b < 0), -1).otherwise(1)
    return F.when(b == 0, None).otherwise((whole * sign).cast("decimal(30,0)") / F.lit(10**out).cast("decimal(20,0)")).cast(T.DecimalType(MAX_PRECISION, out))


def like(x: Column, pattern: str) -> Column:
    """Case-insensitive LIKE with % and _ only; a backslash is an ordinary character."""
    return x.ilike(pattern.replace("\\", "\\\\"))


def byte_length(x: Column) -> Column:
    return F.octet_length(x).cast("bigint")


def char_length(x: Column) -> Column:
    return F.char_length(x).cast("bigint")


def as_text(x: Column, kind: T.DataType) -> Column:
    """CAST to text: booleans are 1 or 0, timestamps their microseconds since the epoch."""
    if isinstance(kind, T.BooleanType):
        return x.cast("int").cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(x).cast("string")
    return x.cast("string")


def concat(*parts: tuple[Column, T.DataType]) -> Column:
    """Concatenation of any types; NULL if any part is."""
    return F.concat(*[as_text(c, k) for c, k in parts])


def substring(s: Column, start: Column | int, length: Column | int) -> Column:
    """Characters from a 1-based start: nothing for 0, from the end (at most to the first) if negative; nothing for a length of 0 or less."""
    a = F.lit(start) if isinstance(start, int) else start
    n = F.lit(length) if isinstance(length, int) else length
    at = F.when(a > 0, a).otherwise(F.greatest(F.lit(1), F.char_length(s) + a + 1))
    return F.when(s.isNull() | a.isNull() | n.isNull(), None).when((a == 0) | (n <= 0), F.lit("")).otherwise(F.substring(s, at, n))


def to_int(x: Column, kind: T.DataType) -> Column:
    """CAST to a 64-bit integer: fractions round half away from zero, text is trimmed and parsed."""
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.round(x, 0).cast("bigint")
    if isinstance(kind, T.StringType):
        return F.trim(x).cast("bigint")
    return x.cast("bigint")


def to_bool(x: Column, kind: T.DataType) -> Column:
    """CAST to boolean: numbers by being non-zero, text only '1', '0', 'true', 'false'."""
    if isinstance(kind, T.StringType):
        t = F.lower(F.trim(x))
        return F.when(t.isin("1", "true"), True).when(t.isin("0", "false"), False)
    return x != 0


def date(s: str) -> Column:
    """Midnight of a strict YYYY-MM-DD date."""
    return F.to_timestamp_ntz(F.lit(s), F.lit("yyyy-MM-dd"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(n: Column) -> Column:
    return F.timestamp_micros(n).cast("timestamp_ntz")


def extract(part: str, ts: Column) -> Column:
    return F.extract(F.lit(part), ts).cast("bigint")


def shift(ts: Column, n: int, unit: str) -> Column:
    """ts plus n YEAR, MONTH or DAY; the day is clamped to the month's end."""
    if unit.upper() == "DAY":
        return ts + F.make_dt_interval(days=F.lit(n))
    return ts + F.make_ym_interval(*((F.lit(n), F.lit(0)) if unit.upper() == "YEAR" else (F.lit(0), F.lit(n))))


def decimal_sum(x: Column, scale: int) -> Column:
    return F.sum(x).cast(T.DecimalType(MAX_PRECISION, scale))


def decimal_avg(x: Column, scale: int) -> Column:
    return F.avg(x).cast(T.DecimalType(MAX_PRECISION, min(scale + 4, MAX_PRECISION)))
