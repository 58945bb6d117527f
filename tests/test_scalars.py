"""Scalar helpers by table."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import scalar as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_substring(spark):
    h = F.lit("hello")
    assert one(spark, S.substring(h, 0, 2), S.substring(h, -9, 3), S.substring(h, -3, 2), S.substring(h, 2, 3), S.substring(h, 2, 0), S.substring(F.lit(None).cast("string"), 1, 1)) == ("", "hel", "ll", "ell", "", None)


@pytest.mark.parametrize("a,b,scale,want", [("1.25", "3", 2, "0.416667"), ("-1.00", "3", 2, "-0.333333"), ("2.00", "-3", 2, "-0.666667"), ("1.00", "0", 2, None), ("0.000001", "2", 2, "0.000001")])
def test_decimal_divide(spark, a, b, scale, want):
    got = one(spark, S.decimal_divide(F.lit(a).cast("decimal(12,6)"), F.lit(b).cast("decimal(12,2)"), scale))[0]
    assert (str(got) if got is not None else None) == want


def test_casts(spark):
    assert one(spark, S.to_int(F.lit(2.5), T.DoubleType()), S.to_int(F.lit(-2.5), T.DoubleType()), S.to_int(F.lit(" 7 "), T.StringType())) == (3, -3, 7)
    assert one(spark, S.to_bool(F.lit("True"), T.StringType()), S.to_bool(F.lit("yes"), T.StringType()), S.to_bool(F.lit(0), T.IntegerType())) == (True, None, False)
    assert one(spark, S.divide(F.lit(1), F.lit(0)), S.int_divide(F.lit(-7), F.lit(2)), S.modulo(F.lit(-7), F.lit(2))) == (None, -3, -1)


def test_concat_and_like(spark):
    assert one(spark, S.concat((F.lit(True), T.BooleanType()), (F.lit("x"), T.StringType())), S.concat((F.lit("x"), T.StringType()), (F.lit(None), T.StringType()))) == ("1x", None)
    assert one(spark, S.like(F.lit("A\\b"), "a\\_"), S.like(F.lit("ABC"), "a%c")) == (True, True)
