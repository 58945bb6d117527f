"""CSV and JSON lines: fields, headers and bad records."""

import pytest
from pyspark.sql import types as T

from quern.sources import files

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("ok", T.BooleanType()), T.StructField("at", T.TimestampNTZType()), T.StructField("price", T.DecimalType(6, 2)), T.StructField("raw", T.BinaryType())])


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("ok,id,price,at,raw\nt,1,1.005,2024-01-31,41\nfalse,2,\\N,1000000,\\N\n\\N,3,-2.345,2024-01-01 10:00:00,ff00\n")
    got = sorted(map(tuple, files.read_csv(spark, str(path), SCHEMA).collect()))
    assert [str(r[3]) for r in got] == ["1.01", "None", "-2.35"]
    assert [r[1] for r in got] == [True, False, None]
    assert str(got[1][2]) == "1970-01-01 00:00:01" and got[2][4] == b"\xff\x00"


def test_bad_records(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("id,ok,at,price,raw\n1,maybe,\\N,1,\\N\n2,1,\\N,1,\\N\n\\N,1,\\N,1,\\N\n")
    with pytest.raises(files.ImportFailed):
        files.read_csv(spark, str(path), SCHEMA, max_errors=1)
    assert [r["id"] for r in files.read_csv(spark, str(path), SCHEMA, max_errors=2).collect()] == [2]
    with pytest.raises(files.ImportFailed):
        files.read_csv(spark, str(path), T.StructType(SCHEMA.fields[:2]))


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "7", "ok": true, "at": 5, "price": "1.10", "raw": "0a"}\n{"id": 8, "ok": null, "at": null, "price": null}\n')
    with pytest.raises(files.ImportFailed):
        files.read_jsonl(spark, str(path), SCHEMA)
    got = files.read_jsonl(spark, str(path), SCHEMA, max_errors=1).collect()
    assert [(r["id"], r["ok"], str(r["price"]), r["raw"]) for r in got] == [(7, True, "1.10", b"\n")]
