"""How queries are declared: a builder over the tables of a folder, and the same query as ANSI SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quern.engine.normalize import normalize

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

Build = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Build] = {}
        self.sql: dict[str, str] = {}

    def text(self, name: str, sql: str, other: str | None = None) -> None:
        """A query in the engine's dialect; ``other`` is its ANSI text where that differs."""
        self.queries[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
        self.sql[name] = other or sql

    def build(self, sql: str | None = None):
        """Register a DataFrame builder under its function's name."""

        def keep(f: Build) -> Build:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep

    def include(self, other: Catalogue) -> None:
        self.queries |= other.queries
        self.sql |= other.sql


_schemas: dict[tuple[str, int], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table.  Its schema is read from the files once for each change time of the path."""
    path = f"{sf_dir}/{name}.parquet"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    changed = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getModificationTime()
    if (path, changed) not in _schemas:
        _schemas[path, changed] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path, changed]).parquet(path)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the tables that it names, which are read from ``sf_dir``."""
    for name in NAMES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(normalize(sql))
