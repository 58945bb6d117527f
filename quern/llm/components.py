"""Connected components of link tables, without collecting links anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.stage import stage


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (u, v) and the smallest node of each one's component, inside one task."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v); root is the smallest node of the component.

    Alternating large-star and small-star rounds; each takes minima by a pre-aggregated groupBy and a
    join, so a hub is split like any skewed join key.  Rounds are stages in the shared folder and end
    when a round changes no link.
    """
    links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = links.union(links.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        links = stage(small, "links", [links])
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v")).distinct())
