"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of each source are dealt into blocks by a hash of their id.  A source's target is met by
whole passes over its blocks and one partial pass over a random permutation of them; only the block at
the end of the partial pass is cut between documents.  All block uses of all sources then go down a
binary tree over the output shards: at every node a random half of the uses that are there goes left.
The numbers of uses of each source that go left are thus one draw from the multivariate hypergeometric
law, exact quotas are kept at every node, and the shards get disjoint permuted blocks.  Rows are
shuffled inside a shard by a hash.  Every random choice is a hash of a seed and an id, so reruns agree.

Only aggregates by source and block are shuffled; documents are never sorted by source, whose hottest
may hold any share of the rows.  The tables by source and block are bounded: ``MAX_BLOCKS`` a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.text import md5_key, n_words
from quern.operators.joins import join_checked
from quern.sources.stage import stage

WEIGHTS = (5, 2, 1)  # repeating over the sources, by code point, NULL last
SHARE = 1.5  # of all sizes
MOST = 2  # times its size that a source may be taken
BLOCK_WORDS = 50_000
MAX_BLOCKS = 16_384
SHARDS = 8
SEED = "mix-1"
KEY_BITS, SLICES = 60, 1024


@dataclass
class Mix:
    """``sources``: a row for each source; ``blocks``: for each source and block, with its place in the permutation and its shards."""

    sources: DataFrame
    blocks: DataFrame


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    Water filling: with the sources in order of cap over weight, let ``level`` be the largest of
    (what is left of the budget) / (weights that are left) over all cuts; a target is the smaller of
    its cap and weight * level.  Without words every target is 0.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / weights_left)
    return by.select("source", "source_size", F.least("cap", F.col("weight") * F.max("level").over(whole)).alias("target"))


def doc_key(seed: str = SEED) -> Column:
    return md5_key(seed, F.col("doc_id"))


def block_of(n_blocks: Column, key: Column) -> Column:
    return F.pmod(key, n_blocks)


def halved(uses: DataFrame, key: Column) -> DataFrame:
    """``uses`` one level down the tree: at each node the half with the smaller keys goes left.

    Ranks are exact but no task sorts a node: keys are cut into SLICES ranges, whose sizes (a table of
    SLICES rows a node) give the rank at which each begins, and only a range is sorted.
    """
    cut = uses.withColumn("key", key).withColumn("slice", F.shiftright("key", KEY_BITS - SLICES.bit_length() + 1))
    sizes = cut.groupBy("node", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("node").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("node", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("node")).alias("all"))
    place = F.row_number().over(Window.partitionBy("node", "slice").orderBy("key", F.col("source").asc_nulls_last(), "block", "use"))
    cut = join_checked(cut.withColumn("place", place), stage(sizes, "mix-slices"), ["node", "slice"])
    return cut.withColumn("node", F.col("node") * 2 + (F.col("before") + F.col("place") > F.ceil(F.col("all") / 2)).cast("int")).select(*uses.columns)


def plan_mix(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block_words=BLOCK_WORDS, shards=SHARDS, seed=SEED) -> Mix:
    """Plan from materialised rows of (doc_id, source, size)."""
    levels = max(0, (shards - 1).bit_length())
    src = source_targets(sizes, weights, share, most)
    src = src.withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("source_size") / block_words))).cast("long"))
    src = src.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    src = stage(src.withColumn("rest", F.when(F.col("passes") < most, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0)), "mix-sources")

    dealt = join_checked(sizes, src, ["source"]).withColumn("key", doc_key(seed))
    dealt = dealt.withColumn("block", block_of(F.col("n_blocks"), F.col("key")))
    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    order = Window.partitionBy("source").orderBy(md5_key(seed, "order", F.col("source"), F.col("block")), "block")
    blocks = join_checked(blocks, src, ["source"])
    blocks = blocks.withColumn("end", F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("start", F.col("end") - F.col("block_size"))
    part = F.when(F.col("rest") <= F.col("start"), 0).when(F.col("rest") >= F.col("end"), 2).otherwise(1)  # none, cut, whole
    blocks = blocks.withColumn("part", part)

    # the tree: every use of a block goes down by random halves
    uses = blocks.select("source", "block", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("use"), "passes", "part")
    uses = uses.where((F.col("use") <= F.col("passes")) | ((F.col("use") == F.col("passes") + 1) & (F.col("part") > 0))).withColumn("node", F.lit(0))
    uses = stage(uses, "mix-uses")
    for level in range(levels):
        uses = stage(halved(uses, md5_key(seed, f"level{level}", F.col("source"), F.col("block"), F.col("use"))), "mix-uses", [uses])
    to = uses.groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("use", "node"))), lambda u: F.pmod(u["node"], F.lit(shards))).alias("shards"))
    blocks = blocks.select("source", "block", "start", "part").join(to.select(F.col("source").alias("s"), F.col("block").alias("b"), "shards"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    blocks = stage(blocks, "mix-blocks")

    # where the partial pass ends inside its last block: the document key up to which it takes
    cut = join_checked(dealt, stage(blocks.where("part = 1").select("source", F.col("block").alias("cut_block"), "start"), "mix-cut"), ["source"]).where("block = cut_block")
    keys = cut.groupBy("source", "key", "rest", "start").agg(F.sum("size").alias("key_size"))
    gap = F.abs(F.col("rest") - F.col("start") - F.sum("key_size").over(Window.partitionBy("source").orderBy("key")))
    ends = keys.withColumn("gap", gap).groupBy("source").agg(F.min_by("key", F.struct("gap", "key")).alias("last"), F.min("gap").alias("gap"), F.max(F.col("rest") - F.col("start")).alias("none"))
    ends = ends.select("source", F.when(F.col("gap") < F.col("none"), F.col("last")).otherwise(F.lit(-1)).alias("last_key"))
    src = stage(src.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-ends")
    return Mix(src, blocks)


def with_copies(sized: DataFrame, mix: Mix, seed: str = SEED) -> DataFrame:
    """Add source_size, target, copies (times a document is taken) and shards (one for each copy) to rows with doc_id, source and size."""
    out = join_checked(sized, mix.sources, ["source"])
    out = out.withColumn("key", doc_key(seed)).withColumn("block", block_of(F.col("n_blocks"), F.col("key")))
    out = join_checked(out, mix.blocks, ["source", "block"])
    more = (F.col("part") == 2) | ((F.col("part") == 1) & (F.col("key") <= F.col("last_key")))
    out = out.withColumn("copies", F.col("passes") + F.coalesce(more, F.lit(False)).cast("long"))
    out = out.withColumn("shards", F.slice(F.coalesce("shards", F.array().cast("array<int>")), 1, F.greatest(F.col("copies"), F.lit(0)).cast("int")))
    return out.drop("n_blocks", "passes", "rest", "last_key", "key", "block", "start", "part")


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of every document."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def mix_documents(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix itself: every copy of a taken document with its columns, ``mix_shard`` and ``mix_order``.

    The rows are laid out by shard and, as its local shuffle, by mix_order; a large shard may take several
    partitions, in order.  A NULL source is a source of its own, a NULL
    or empty text has size 0 and goes with its block, rows that repeat a doc_id are taken alike, an
    empty table gives an empty mix.  Columns of ``docs`` named mix_shard or mix_order are replaced.
    """
    mix = plan_mix(stage(sizes_of(docs), "mix-sizes"), seed=seed, **options)
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("mix_shard", "mix_order")])
    out = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), kept.alias("doc"))
    out = with_copies(out, mix, seed).select("doc", "doc_id", F.posexplode("shards").alias("copy", "mix_shard"))
    out = out.select("doc.*", "mix_shard", md5_key(seed, "row", F.col("doc_id"), F.col("copy")).alias("mix_order"))
    return out.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards for every document.

    A NULL source is a source of its own, a NULL or empty text has size 0, rows that repeat a doc_id are taken
    alike; an empty table gives no rows.
    """
    sizes = stage(sizes_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix-sizes")
    out = with_copies(sizes, plan_mix(sizes))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), F.concat_ws(",", F.col("shards").cast("array<string>")).alias("shards"))


OP9_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s0),
s2 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
       FROM s1 WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM s2),
src AS (SELECT *, target - passes * source_size AS rest0, CAST(greatest(1, least({MAX_BLOCKS}, ceil(source_size / {BLOCK_WORDS}::DOUBLE))) AS BIGINT) AS n_blocks
        FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(2, floor(target / source_size)) AS BIGINT) ELSE 0 END AS passes FROM s3)),
dealt AS (SELECT d.*, s.source_size, s.target, s.passes, CASE WHEN s.passes < 2 THEN s.rest0 ELSE 0 END AS rest, d.key % s.n_blocks AS block
          FROM sizes d JOIN src s ON d.source IS NOT DISTINCT FROM s.source),
b0 AS (SELECT source, block, passes, rest, sum(size) AS bs,
              CAST('0x' || substr(md5('{SEED}:order:' || coalesce(source, 'null') || ':' || block), 1, 15) AS BIGINT) AS o
       FROM dealt GROUP BY source, block, passes, rest),
b1 AS (SELECT *, sum(bs) OVER (PARTITION BY source ORDER BY o, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fin FROM b0),
b2 AS (SELECT source, block, fin - bs AS start, CASE WHEN rest <= fin - bs THEN 0 WHEN rest >= fin THEN 2 ELSE 1 END AS part, passes FROM b1),
u0 AS (SELECT source, block, u.use, 0 AS node FROM b2, (VALUES (1), (2)) u(use) WHERE u.use <= passes OR (u.use = passes + 1 AND part > 0)),
""" + "".join(
    f"""u{i + 1} AS (SELECT source, block, use, node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY CAST('0x' || substr(md5('{SEED}:level{i}:' || coalesce(source, 'null') || ':' || block || ':' || use), 1, 15) AS BIGINT), source ASC NULLS LAST, block, use) > ceil(count(*) OVER (PARTITION BY node) / 2.0) THEN 1 ELSE 0 END AS node FROM u{i}),
"""
    for i in range((SHARDS - 1).bit_length())
) + f"""sh AS (SELECT source, block, list(node % {SHARDS} ORDER BY use) AS shards FROM u{(SHARDS - 1).bit_length()} GROUP BY source, block),
k0 AS (SELECT d.source, d.key, d.rest - b.start AS need, sum(d.size) AS ks FROM dealt d JOIN b2 b ON d.source IS NOT DISTINCT FROM b.source AND d.block = b.block AND b.part = 1 GROUP BY 1, 2, 3),
k1 AS (SELECT *, abs(need - sum(ks) OVER (PARTITION BY source ORDER BY key)) AS gap FROM k0),
ends AS (SELECT source, CASE WHEN min(gap) < max(need) THEN (list(key ORDER BY gap, key))[1] ELSE -1 END AS last_key FROM k1 GROUP BY source),
fin AS (SELECT d.doc_id, d.size, d.source_size, d.target, d.passes + CASE WHEN b.part = 2 OR (b.part = 1 AND d.key <= e.last_key) THEN 1 ELSE 0 END AS copies, sh.shards
        FROM dealt d JOIN b2 b ON d.source IS NOT DISTINCT FROM b.source AND d.block = b.block
        LEFT JOIN sh ON d.source IS NOT DISTINCT FROM sh.source AND d.block = sh.block
        LEFT JOIN ends e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * copies AS BIGINT) AS taken,
       coalesce(array_to_string(shards[1:copies], ','), '') AS shards FROM fin
"""
