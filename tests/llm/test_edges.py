"""NULLs, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import random

import pytest
from pyspark.sql import functions as F

from quern.llm import blocks, decontam, jaccard, langid, mixing, rules, suffix, tokens, toxicity, weaklabels
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 5000}" for k in range(60_000))
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, LONG, "en", "a", len(LONG)), (5, "same text here " * 40, None, "b", 1), (6, "same text here " * 40, None, "b", 1), (6, "same text here " * 40, None, "b", 1), (None, "same text here " * 40, "de", "b", 1), (7, "é ß 漢字 🙂 \u0000 end", "de", "c", 9)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for clash in ("size", "key", "block", "w", "bucket", "part", "root", "rep", "spans", "start", "mix_shard", "__salt", "held_out", "target"):
        docs = docs.withColumn(clash, F.lit("x"))
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same text here"), (4, " ".join(f"word{k}" for k in range(20)))], "item_id long, text string").withColumn("h", F.lit(1))
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    return docs, bench, labels


OPERATORS = {
    "tokens": lambda d, b, t: tokens.token_counts(d),
    "suffix": lambda d, b, t: suffix.apply_spans(d, suffix.repeated_spans(d)),
    "suffix_rows": lambda d, b, t: suffix.remove_repeats(d),
    "jaccard": lambda d, b, t: jaccard.linked_components(d),
    "jaccard_rows": lambda d, b, t: jaccard.drop_near_copies(d),
    "toxicity": lambda d, b, t: toxicity.toxicity(d, t),
    "quality": lambda d, b, t: weaklabels.quality(d),
    "rules": lambda d, b, t: rules.judge(d),
    "rules_rows": lambda d, b, t: rules.keep_good(d),
    "decontam": lambda d, b, t: decontam.contamination(d, b),
    "decontam_rows": lambda d, b, t: decontam.drop_contaminated(d, b),
    "mixing": lambda d, b, t: mixing.mix_documents(d),
    "langid": lambda d, b, t: langid.identify(d, *langid.prototypes(d.where("lang IS NOT NULL AND text IS NOT NULL"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(tables, name):
    docs, bench, labels = tables
    got = OPERATORS[name](docs, bench, labels)
    n = len(got.collect())
    if name.endswith("_rows"):
        assert got.columns == docs.columns
    elif name != "mixing":
        assert n == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, tables, name):
    docs, bench, labels = (t.limit(0) for t in tables)
    assert OPERATORS[name](docs, bench, labels).collect() == []


def test_values(tables):
    docs, bench, labels = tables
    got = {r["doc_id"]: r for r in jaccard.linked_components(docs).collect()}
    assert [got[k]["component_id"] for k in (1, 2, 3, 4, 5, 6, None)] == [1, 2, 3, 4, 5, 5, None]
    assert [got[k]["n_shingles"] for k in (1, 2, 3)] == [0, 0, 0]
    got = {r["doc_id"]: r for r in suffix.apply_spans(docs, suffix.repeated_spans(docs)).collect()}
    assert got[5]["n_removed"] == got[5]["n_bytes"] == 600 and got[None]["n_removed"] == 600 and got[1]["n_bytes"] == 0
    got = {r["doc_id"]: r for r in decontam.contamination(docs, bench).collect()}
    assert got[5]["n_hit"] == 120 and got[5]["contaminated"] and got[4]["n_hit"] == 12 * 20 and not got[4]["contaminated"] and got[1]["n_words"] == 0
    got = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    assert got[5]["base_failed"] and got[2]["base_failed"] and not got[1]["kept"]
    scored = langid.identify(docs, *langid.prototypes(docs.where("lang IS NOT NULL AND text IS NOT NULL"))).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in scored}[1] == "und"


def test_pages_edges(spark):
    df = spark.createDataFrame([(1, None, "<b>" * 5000 + "x" + "</div>" * 5000), (1, None, "<p " + "a" * 50_000), (2, "u", "</p></p><article><p>&#x41;&am;</article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert blocks.extract(df).count() == 3
    assert blocks.extract(df.limit(0)).collect() == []


def test_suffix_rows_of_one_id(spark):
    """Unequal texts of one doc_id or without one, which share strings with others in differing contexts."""
    shared = " ".join(f"s{k}" for k in range(160))
    data = [(1, f"one {shared} end"), (1, "short"), (1, f"{'x' * 900} other {shared[:500]} y"), (None, f"null {shared} z"), (None, f"{shared[100:520]}"), (None, None), (2, "plain " * 20), (2, "tail " + "q" * 801)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for hot in (1, 500):
        got = [tuple(r) for r in suffix.apply_spans(df, suffix.repeated_spans(df, hot=hot)).drop("kept").collect()]
        want = [(i, *row[1:]) for (i, _), row in zip(data, brute.repeated_bytes([(k, t) for k, (_, t) in enumerate(data)]))]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_suffix_long_texts_are_hashed_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    shared = "".join(rng.choices("abcdef ", k=1500))
    data = [(1, "p" * 37 + shared), (2, shared[:900] + "zz" * 600), (3, "".join(rng.choices("ghij", k=5000)))]
    texts = [t.encode() for _, t in data]
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    for t in texts:
        starts = [at + p for at, part in suffix.segments(t, 400) for p in range(len(part) - 399)]
        assert starts == list(range(len(t) - 399))
