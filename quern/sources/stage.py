"""Materialised intermediate tables in the folder that all executors share.

A stage is a Parquet folder, so its lineage is cut and a lost executor costs nothing that was
written: readers go back to the shared files.  The folder is ``spark.checkpoint.dir`` of the session.
Where that is unset, a local session uses a temporary folder and any other one its warehouse.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_local: list[str] = []


def stage_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="quern-stage-"))
        return _local[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def stage(df: DataFrame, label: str, done: Iterable[DataFrame] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it.

    ``done``: stages that nothing but ``df`` needed; they are deleted once ``df`` is written.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/quern-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(drop_stages)
    _made[path] = spark
    release(*done)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of plans that are done
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stage_path"] = path
    return out


def release(*stages: DataFrame) -> None:
    """Delete stages whose readers are all done; anything else is left as it is."""
    for df in stages:
        _drop(df.__dict__.get("_stage_path"))


def staged() -> set[str]:
    """The folders of all stages that this process has not deleted yet."""
    return set(_made)


def drop_stages(paths: Iterable[str] | None = None) -> None:
    """Delete these stages, or every one of this process; results that still read them must be done."""
    for path in list(_made if paths is None else paths):
        _drop(path)


def _drop(path: str | None) -> None:
    spark = _made.pop(path, None)
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: its folders go with the cluster's shared folder
        return
