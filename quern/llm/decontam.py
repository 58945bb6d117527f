"""Benchmark decontamination by winnowing.

Of every run of ``WINDOW - GRAM + 1`` consecutive GRAM-word hashes the smallest is kept, for benchmark
items and documents alike, so two texts that share WINDOW consecutive words share a kept hash: no span
of that length is missed.  Documents that share one are extended: their WINDOW-word windows are compared
with those of the items, word by word.  Items shorter than a window are one window of their own length.
Documents keep one row each until they match, so only fingerprints of the benchmark and rows of matching
documents are ever shuffled.  A hit is a place and the number of a span; the items that have the span
are looked up once for each document and span.  Rows are known by 128 bits of their text, since hits
depend on the text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.text import text_key
from quern.operators.joins import BROADCAST_IDS, BROADCAST_ROWS
from quern.sources.stage import stage

WINDOW, GRAM = 13, 6
KEY = ["ka", "kb"]
#: Words are runs of digits, a-z after lower-casing A-Z, and anything that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where lower() would also change letters outside A-Z, each character is mapped instead.
OTHER_UPPER = r"[^\x00-\x7F&&[\p{javaUpperCase}\p{javaTitleCase}]]"


def ascii_lower(text: Column) -> Column:
    return F.when(text.rlike(OTHER_UPPER), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def item_words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def gram_hashes(w: Column, n: int) -> Column:
    count = F.size(w) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def winnow(h: Column, n: int) -> Column:
    """The smallest of every ``n`` consecutive hashes; none if there are fewer than n."""
    count = F.size(h) - (n - 1)
    picked = F.transform(F.sequence(F.lit(1), count), lambda i: F.least(*[F.element_at(h, i + k) for k in range(n)]))
    return F.when(count > 0, F.array_distinct(picked)).otherwise(F.array().cast("array<bigint>"))


def windows(words_of: DataFrame, keys: list[str], length: Column | int) -> DataFrame:
    """keys, start (from 1), len, span (the words joined by a space) of every window of ``length`` words."""
    length = F.lit(length) if isinstance(length, int) else length
    rows = words_of.select(*keys, "w", length.alias("len")).where("len > 0 AND size(w) >= len")
    rows = rows.select(*keys, "w", "len", F.explode(F.expr("sequence(1, size(w) - len + 1)")).alias("start"))
    return rows.select(*keys, "start", "len", F.array_join(F.expr("slice(w, start, len)"), " ").alias("span"))


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def item_hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stages: (doc_id, ka, kb, n_words, n_rows: rows that share these); (ka, kb, start, len, span_id) of every window of a text that an item has; (span_id, items)."""
    hashed = lambda df: df.withColumn("g", gram_hashes(F.col("w"), gram))  # noqa: E731  a column, so that it is computed once
    items = stage(hashed(bench.select("item_id", item_words(F.col("text")).alias("w"))), "bench-words")
    own = F.least(F.lit(window), F.size("w"))
    spans = windows(items, ["item_id"], own).groupBy("len", "span").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    spans = stage(spans.withColumn("span_id", F.monotonically_increasing_id()), "bench-spans")
    short = [r["len"] for r in spans.select("len").where(F.col("len") < window).distinct().orderBy("len").collect()]  # fewer than ``window`` values
    prints = winnow(F.col("g"), window - gram + 1)
    lone = [gram_hashes(F.col("w"), n) for n in short]
    # fingerprints of items: of whole windows by winnowing, of short items their one hash
    marks = F.concat(prints, *[F.when(F.size("w") == n, h).otherwise(F.array().cast("array<bigint>")) for n, h in zip(short, lone)])
    marks = stage(items.select(F.explode(marks).alias("h")).distinct(), "bench-prints", [items])

    words_of = hashed(docs.select("doc_id", *text_key(F.col("text")), item_words(F.col("text")).alias("w")))
    marked = words_of.select("doc_id", *KEY, F.size("w").cast("long").alias("n_words"), F.concat(prints, *lone).alias("h"))
    # the first hash of a row, or NULL if it has none, counts the row
    seen = marked.select("doc_id", *KEY, "n_words", F.posexplode_outer("h").alias("at", "h")).join(small_side(marks.withColumn("hit", F.lit(True))), "h", "left")
    seen = seen.groupBy("doc_id", *KEY, "n_words").agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"), F.count_if(F.coalesce(F.col("at") == 0, F.lit(True))).alias("n_rows"))
    seen = stage(seen, "marked", [marks])

    # extend: all windows of the texts that share a fingerprint, compared by their words
    ids = stage(seen.where("hit").select(*KEY).distinct(), "candidates")
    near = docs.select("text", *text_key(F.col("text"))).join(small_side(ids, BROADCAST_IDS), KEY, "left_semi").dropDuplicates(KEY)
    near = near.select(*KEY, item_words(F.col("text")).alias("w"), F.explode(F.array(*[F.lit(n) for n in [*short, window]])).alias("n"))
    found = windows(near, KEY, F.col("n")).join(small_side(spans.drop("items")), ["span", "len"]).select(*KEY, "start", "len", "span_id")
    return seen, stage(found, "hits", [ids]), spans.select("span_id", "items")


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, ka and kb (of the text), n_words, n_hit, n_items, items_sha256, contaminated of every row.

    A NULL or empty text has no words and is clean; an item without words has no window.  Rows that repeat
    a doc_id, equal or not, and rows with a NULL doc_id are documents of their own.  Without items every
    document is clean; an empty table gives no rows.
    """
    seen, hits, spans = item_hits(docs, bench, window, gram)
    runs = hits.groupBy(*KEY, "start").agg((F.max("len") + F.col("start")).alias("stop"))
    so_far = F.max("stop").over(Window.partitionBy(*KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(so_far, F.lit(0))))
    covered = runs.select(*KEY, fresh.alias("fresh")).groupBy(*KEY).agg(F.sum("fresh").cast("long").alias("n_hit"))
    found = hits.select(*KEY, "span_id").distinct().join(small_side(spans), "span_id").select(*KEY, F.explode("items").alias("item"))
    found = found.groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = stage(covered.join(found, KEY), "hit-docs", [hits])
    out = seen.join(small_side(both), KEY, "left")
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", *KEY, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, share: float = 0.05) -> DataFrame:
    """The rows of ``docs`` without those of which at least this share of the words, and one window, is hit; with all their columns."""
    hit = contamination(docs, bench).where((F.col("n_hit") > 0) & (F.col("n_hit") >= share * F.col("n_words")))
    bad = stage(hit.select(F.col("ka").alias("__ka"), F.col("kb").alias("__kb")).distinct(), "contaminated")
    a, b = text_key(F.col("text"))
    return docs.join(small_side(bad, BROADCAST_IDS), (a == F.col("__ka")) & (b == F.col("__kb")), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row.

    A NULL or empty text has no words and is clean; rows that repeat a doc_id or have none are documents of
    their own; an empty table gives no rows.
    """
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop(*KEY)


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, list(item ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN t ON d.r = t.r
"""
