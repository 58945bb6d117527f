"""Quality rules with adaptive thresholds.

Fixed rules (``base_failed``) come first.  For the other rules mergeable quantile summaries of every
measure are built for each language and source, each language and the whole (partial summaries merge
before and after the shuffle, so a hot source is pre-aggregated).  Limits are the quartiles of a
document's own group plus SPREADS times its spread; no limit is a constant:

* quartiles of a group are shrunk to those of its language, and these to those of the whole, by PRIOR
  documents, so that small or one-sided groups lean on the larger ones;
* the spread is the distance of the quartiles and the measure's own grain in the group (one symbol, one
  repeated line or one repeated five-word window in a document of median length), so it is never zero;
* the mean word length has a limit on both sides, which is wider for documents shorter than the median,
  as the spread of a mean is; one symbol, repeated line or window alone is never too many.

NULL languages and sources are groups of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.text import words
from quern.operators.joins import BROADCAST_IDS, join_checked
from quern.sources.stage import stage

ACCURACY = 10_000
SPREADS = 6.0
PRIOR = 16
#: Measures whose quartiles and medians are summarised.
QUARTILES = ("mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio")
MEDIANS = ("n_words", "n_lines")
GROUP = ["lang", "source"]


def repeat_words(w: Column, n: int = 5) -> Column:
    """Words that lie in an ``n``-word window found twice or more in the array ``w``.

    Windows are compared by 64-bit hashes.  Only arrays with an equal pair are sorted.  With the start
    positions of all repeated windows in order, each adds the smaller of n and the distance to the next.
    """
    count = F.size(w) - (n - 1)
    grams = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))
    return grams


def covered_words(grams: Column, n: int = 5) -> Column:
    """Words covered by windows whose hash occurs twice or more in ``grams`` (the hashes by start position)."""
    ranked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["g"] == F.get(s, b)["g"], F.lit(False))
        return F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (same(k, k - 1) | same(k, k + 1)).alias("dup"))), lambda x: x["dup"]), lambda x: x["i"]))

    def cover(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, b: a + b)

    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  evaluates value once
    return bind(bind(ranked, starts), cover).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, a and b (128 bits of text, lang and source), n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = lambda *salt: F.xxhash64(*salt, text, *GROUP)
    out = docs.select("doc_id", "lang", "source", text.alias("text"), words(F.col("text")).alias("w"), key().alias("a"), key(F.lit(1)).alias("b"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(
        "doc_id", "lang", "source", "a", "b",
        F.size("w").cast("long").alias("n_words"),
        (F.char_length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"), repeat_words(F.col("w")).alias("grams"),
    )
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).withColumn("n_lines", F.size("lines").cast("long"))
    out = out.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), covered_words(F.col("grams"))).otherwise(F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return out.drop("lines", "grams").withColumn("base_failed", failed)


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
    }


def summaries(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, docs, and for every measure its quantiles (quartiles 1 and 3, or the median) as columns."""
    points = {k: [0.25, 0.75] for k in QUARTILES} | {k: [0.5] for k in MEDIANS}
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), *[F.percentile_approx(k, p, ACCURACY).alias(k) for k, p in points.items()])
    return out.select(*by, "docs", *[F.get(k, F.lit(i)).cast("double").alias(f"{k}{i}") for k, p in points.items() for i in range(len(p))])


def shrunk(own: DataFrame, parent: DataFrame, by: list[str]) -> DataFrame:
    """``own`` with each quantile drawn to the parent's (without ``by``: one row), which counts as PRIOR documents."""
    names = [c for c in own.columns if c not in (*GROUP, "docs")]
    if by:
        both = join_checked(own, parent.select(*by, *[F.col(c).alias(f"up_{c}") for c in names]), by)
    else:
        row = parent.first()
        both = own.select("*", *[F.lit(row[c]).cast("double").alias(f"up_{c}") for c in names])
    return both.select(*[c for c in own.columns if c not in names], *[((F.col("docs") * F.col(c) + PRIOR * F.col(f"up_{c}")) / (F.col("docs") + PRIOR)).alias(c) for c in names])


def limits(measured: DataFrame) -> DataFrame:
    """For each language and source the limits of its documents, from the documents that pass the fixed rules.

    low, high: quartiles of the mean word length; per_root: what to add to or take from them for a document
    of ``long`` words or more; symbols, lines, repeats: the largest shares.
    """
    rows = measured.where("NOT base_failed").select(*GROUP, *[r.alias(k) for k, r in ratios().items()], *MEDIANS)
    lang = stage(shrunk(summaries(rows, ["lang"]), summaries(rows, []), []), "limits-lang")
    own = shrunk(summaries(rows, GROUP), lang, ["lang"])
    wide = lambda k, unit: F.col(f"{k}1") - F.col(f"{k}0") + unit
    share = lambda k, unit: F.col(f"{k}1") + SPREADS * wide(k, unit)
    n, m = F.greatest(F.col("n_words0"), F.lit(1.0)), F.greatest(F.col("n_lines0"), F.lit(1.0))
    own = own.select(*GROUP, F.col("mean_word0").alias("low"), F.col("mean_word1").alias("high"), (SPREADS * wide("mean_word", F.lit(1.0) / F.sqrt(n))).alias("per_root"), n.alias("long"), share("symbol_ratio", F.lit(1.0) / n).alias("symbols"), share("dup_line_ratio", F.lit(1.0) / m).alias("lines"), share("repeat_ratio", F.lit(10.0) / n).alias("repeats"))
    return stage(own, "limits", [lang])


def judge(docs: DataFrame) -> DataFrame:
    """The measures of every document and ``kept``.

    A NULL or empty text has no words and fails.  A group without a passing document has no limits, and
    none of its documents is kept.  Rows that repeat a doc_id are judged each; an empty table gives none.
    """
    measured = stage(measures(docs), "rules")
    out = join_checked(measured, limits(measured), GROUP, "left")
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    room = F.col("per_root") * F.greatest(F.lit(1.0), F.sqrt(F.col("long") / n))
    fits = (mean <= F.col("high") + room) & (mean >= F.col("low") - room)
    for count, alone, share, of in (("n_symbols", 1, "symbols", n), ("n_dup_lines", 1, "lines", F.greatest(F.col("n_lines"), F.lit(1))), ("n_repeat_words", 10, "repeats", n)):
        fits = fits & (F.col(count) - alone <= F.col(share) * of)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; rows are known by 128 bits of what they are judged by."""
    key = lambda *salt: F.xxhash64(*salt, F.coalesce("text", F.lit("")), *GROUP)
    bad = judge(docs).where("NOT kept").select(F.col("a").alias("__a"), F.col("b").alias("__b")).distinct()
    bad = stage(bad, "rejected")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad
    return docs.join(bad, (key() == F.col("__a")) & (key(F.lit(1)) == F.col("__b")), "left_anti")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Exact quartiles stand for the summaries, which are exact for groups smaller than their accuracy.
OP7_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM d) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON w.r = c.r),
b AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed, word_chars / greatest(n_words, 1) AS mw, n_symbols / greatest(n_words, 1) AS sr,
             n_dup_lines / greatest(n_lines, 1) AS dl, n_repeat_words / greatest(n_words, 1) AS rr, greatest(n_words, 1) AS nw, greatest(n_lines, 1) AS nl FROM m),
""" + "".join(
    f"{t} AS (SELECT {by}count(*) AS docs, " + ", ".join([f"quantile_disc({k}, {p}) AS {k}{i}" for k in ("mw", "sr", "dl", "rr") for i, p in enumerate((0.25, 0.75))] + [f"CAST(quantile_disc({k}, 0.5) AS DOUBLE) AS {k}0" for k in ("nw", "nl")]) + f" FROM b WHERE NOT base_failed{group}),\n"
    for t, by, group in (("qa", "", ""), ("ql", "lang, ", " GROUP BY lang"), ("qg", "lang, source, ", " GROUP BY lang, source"))
) + "".join(
    f"{t} AS (SELECT {by}" + ", ".join(f"(o.docs * o.{q} + {PRIOR} * u.{q}) / (o.docs + {PRIOR}) AS {q}" for q in ("mw0", "mw1", "sr0", "sr1", "dl0", "dl1", "rr0", "rr1", "nw0", "nl0")) + f" FROM {own} o JOIN {up} u ON {on}),\n"
    for t, by, own, up, on in (("sl", "o.lang, ", "ql", "qa", "true"), ("sg", "o.lang, o.source, ", "qg", "sl", "o.lang IS NOT DISTINCT FROM u.lang"))
) + f"""f AS (SELECT *, greatest(nw0, 1.0::DOUBLE) AS n0, greatest(nl0, 1.0::DOUBLE) AS m0 FROM sg),
l AS (SELECT lang, source, mw0, mw1, {SPREADS}::DOUBLE * (mw1 - mw0 + 1.0::DOUBLE / sqrt(n0)) AS per_root, n0, sr1 + {SPREADS}::DOUBLE * (sr1 - sr0 + 1.0::DOUBLE / n0) AS symbols,
             dl1 + {SPREADS}::DOUBLE * (dl1 - dl0 + 1.0::DOUBLE / m0) AS lines, rr1 + {SPREADS}::DOUBLE * (rr1 - rr0 + 10.0::DOUBLE / n0) AS repeats FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(mw <= mw1 + per_root * greatest(1.0::DOUBLE, sqrt(n0 / nw)) AND mw >= mw0 - per_root * greatest(1.0::DOUBLE, sqrt(n0 / nw))
         AND n_symbols - 1 <= symbols * nw AND n_dup_lines - 1 <= lines * nl AND n_repeat_words - 10 <= repeats * nw, false) AS kept
FROM b LEFT JOIN l ON b.lang IS NOT DISTINCT FROM l.lang AND b.source IS NOT DISTINCT FROM l.source
"""
