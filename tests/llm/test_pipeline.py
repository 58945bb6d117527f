"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from quern.llm import decontam, jaccard, mixing, rules, suffix
from quern.sources.stage import stage
from tests.conftest import DATA
from tests.llm import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "mixing sources"]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, DATA), "test")
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
        if name == "n-gram Jaccard join":
            assert jaccard.linked_components(docs).where("component_id <> doc_id").isEmpty()
        if name == "suffix-array dedup":
            assert suffix.repeated_spans(docs, corpus_pipeline.PASSAGE, corpus_pipeline.PASSAGE_GRAM).count() <= 2  # new neighbours of what was cut may repeat
        if name == "benchmark decontamination":
            assert decontam.contamination(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").isEmpty()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r["n"] for r in mixed.groupBy("doc_id").agg({"*": "count"}).toDF("doc_id", "n").select("n").distinct().collect()} <= {1, 2}


def test_run_equals_plain_versions(spark, duck):
    """Every row of run(), against the SQL of the native operators and brute force for the others, stage by stage."""
    con = duck.cursor()
    rows = con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()
    about = {r[0]: r[2:] for r in rows}

    def held(texts):
        con.execute("CREATE OR REPLACE TEMP TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
        con.executemany("INSERT INTO temp.documents VALUES (?, ?, ?, ?)", [(i, t, *about[i]) for i, t in texts])

    texts = [r[:2] for r in rows]
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({rules.OP7_SQL}) WHERE kept").fetchall()}
    texts = brute.near_copies_gone([x for x in texts if x[0] in good])
    texts = brute.without_repeats(texts, corpus_pipeline.PASSAGE)
    held(texts)
    leaked = {r[0] for r in con.execute(f"SELECT doc_id FROM ({decontam.OP8_SQL}) WHERE n_hit > 0").fetchall()}
    texts = [x for x in texts if x[0] not in leaked]
    held(texts)
    shards = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, shards FROM ({mixing.OP9_SQL})").fetchall()}
    want = sorted((i, t, int(s)) for i, t in texts for s in shards[i].split(",") if s)
    got = sorted((r["doc_id"], r["text"], r["mix_shard"]) for r in corpus_pipeline.run(spark, DATA).collect())
    assert len(good) < len(rows) and leaked and got == want


def test_near_copies_need_less_than_the_texts(spark, monkeypatch):
    """The second stage on documents that all have near copies: the first of each stays, and its working tables are smaller than the texts."""
    import os
    import random

    from quern.llm import components
    from quern.sources import stage as stages

    rng = random.Random(9)
    base = [" ".join(str(rng.randrange(10**5)) for _ in range(1500)) for _ in range(40)]
    data = [(100 * k + c, f"{text} copy{c}", "en", "s") for k, text in enumerate(base) for c in range(4)]
    before, most = stages.staged(), [0]

    def measured(df, label, done=()):
        out = stages.stage(df, label)  # with the tables that it replaces
        mine = [p.removeprefix("file://") for p in stages.staged() - before]
        most[0] = max(most[0], sum(os.path.getsize(f"{p}/{f}") for p in mine for f in os.listdir(p)))
        stages.release(*done)
        return out

    monkeypatch.setattr(jaccard, "stage", measured)
    monkeypatch.setattr(components, "stage", measured)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, corpus_pipeline.near_copies(spark, docs, DATA).collect())) == data[::4]
    assert 0 < most[0] < sum(len(x[1]) for x in data)
