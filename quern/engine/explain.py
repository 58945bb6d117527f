"""EXPLAIN as rows: one for each node of the physical plan."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

SCHEMA = "node_id int, parent_id int, operation string, detail string, est_rows long, estimate_source string, build_side string, actual_rows long, time_ms double"


def plan_rows(df: DataFrame, run: bool = False) -> DataFrame:
    """Nodes of the plan of ``df``, with row counts and the whole time if ``run``."""
    spark = df.sparkSession
    q = df._jdf.queryExecution()
    took = None
    if run:
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        took = (time.time() - began) * 1000
    stats = q.optimizedPlan().stats()
    count = stats.rowCount()
    estimate = int(count.get().toString()) if count.isDefined() else None
    rows: list[tuple] = []

    def walk(node, parent):
        me = len(rows)
        text = node.simpleString(200)
        side = "right" if "BuildRight" in text else "left" if "BuildLeft" in text else None
        metric = node.metrics().get("numOutputRows")
        actual = int(metric.get().value()) if run and metric.isDefined() else None
        rows.append((me, parent, node.nodeName(), text, estimate if me == 0 else None, ("stats" if estimate is not None else "default") if me == 0 else None, side, actual, took if me == 0 else None))
        inner = node.children()
        kids = [inner.apply(i) for i in range(inner.size())]
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            kids = [node.executedPlan()]
        for k in kids:
            walk(k, me)

    walk(q.executedPlan(), None)
    return spark.createDataFrame(rows, SCHEMA)
