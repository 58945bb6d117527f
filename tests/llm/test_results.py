"""Operators on the smallest tables and on made ones, against SQL, brute force, libraries or known answers."""

import random

import pytest

from quern.llm import batches, blocks, decontam, jaccard, langid, mixing, rules, suffix, tokens, toxicity, weaklabels
from quern.sources.stage import stage
from tests.conftest import DATA
from tests.llm import brute


def rows(df):
    return sorted(map(tuple, df.collect()))


def documents(spark, cols=("doc_id", "text")):
    return spark.read.parquet(f"{DATA}/documents.parquet").select(*cols)


@pytest.mark.parametrize("query,sql", [(rules.op7_quality_rules, rules.OP7_SQL), (decontam.op8_decontaminate, decontam.OP8_SQL), (mixing.op9_mix_sources, mixing.OP9_SQL)])
def test_sql_twins(spark, duck, query, sql):
    df = query(spark, DATA)
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in df.columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want


def test_limits_follow_the_group(spark):
    """The same text is kept where its measures are usual and dropped where they are not; limits differ by group."""
    rng = random.Random(5)
    plain = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 6))) for _ in range(200))
    marked = lambda: " ".join(w + ("#" if rng.random() < 0.3 else "") for w in plain().split())
    long_ = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(11, 16))) for _ in range(200))
    rows_ = [(k, plain(), "en", "prose") for k in range(300)] + [(1000 + k, marked(), "en", "code") for k in range(300)] + [(2000 + k, long_(), "de", "prose") for k in range(300)]
    odd, wide = marked(), long_()
    rows_ += [(5000, odd, "en", "prose"), (5001, odd, "en", "code"), (5002, wide, "en", "prose"), (5003, wide, "de", "prose"), (5004, plain(), "de", "prose"), (5005, "one # symbol in a short text is not yet too many", "en", "prose")]
    got = {r["doc_id"]: r["kept"] for r in rules.judge(spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string")).collect()}
    assert [got[k] for k in range(5000, 5006)] == [False, True, False, True, False, True]
    assert sum(got[k] for k in (*range(300), *range(1000, 1300), *range(2000, 2300))) == 900


def test_limits_are_no_constants(spark):
    found = rules.limits(stage(rules.measures(spark.read.parquet(f"{DATA}/documents.parquet")), "rules")).drop("lang", "source")
    assert found.distinct().count() >= 0.9 * found.count() > 10  # of small groups some may be alike


def test_decontamination_keeps_every_row(spark, duck):
    """Repeated rows and NULL doc_ids, with and without hits, as in SQL."""
    item = " ".join(f"b{k}" for k in range(20))
    data = [(1, f"x {item} y")] * 3 + [(1, "other text")] + [(None, f"one {item}")] * 2 + [(None, "two " + " ".join(f"c{k}" for k in range(20))), (None, None), (None, ""), (2, None), (2, None), (3, "short"), (3, "words")]
    docs, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontam.contamination(docs, bench).drop("ka", "kb")
    con = duck.cursor()
    for name, rows_, of in (("documents", data, "doc_id BIGINT"), ("benchmark", [(7, item)], "item_id BIGINT")):
        con.execute(f"CREATE TEMP TABLE {name} ({of}, text VARCHAR)")
        con.executemany(f"INSERT INTO temp.{name} VALUES (?, ?)", rows_)
    cursor = con.execute(decontam.OP8_SQL)
    names = [d[0] for d in cursor.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in got.columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in got.collect()) == want and len(want) == len(data)


def test_mix_is_shuffled(spark):
    """Rows lie in the order of shard and mix_order, over all partitions."""
    got = [(r["mix_shard"], r["mix_order"]) for r in mixing.mix_documents(documents(spark, ("doc_id", "text", "source"))).collect()]
    assert len(got) > 100 and len({s for s, _ in got}) > 1 and got == sorted(got)


def made_documents():
    """Real texts, near copies of one, short and empty ones."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    out = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = f"x{rng.randint(0, 9999)}"
        out.append((1000 + k, " ".join(w)))
    return [*out, (5000, None), (5001, ""), (5002, "One two"), (5003, "one  TWO"), (5004, "x" * 3000), (5005, " \n ")]


@pytest.mark.parametrize("tile", [16, 512])
def test_jaccard(spark, tile):
    data = [tuple(r) for r in documents(spark).collect()] + made_documents()
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(jaccard.linked_components(df, tile=tile)) == brute.jaccard_components(data)


def test_jaccard_turns_hold_the_copied_texts(spark, monkeypatch):
    """Texts that go to tiles are copied a turn at a time, by their bytes; a bitmap instead of broadcast ids changes nothing."""
    rng = random.Random(12)
    base = [" ".join(str(rng.randrange(10**5)) for _ in range(60)) for _ in range(60)]
    data = [(10 * k + c, f"{text} copy{c}" + f" {text}" * (20 if k < 20 else 1)) for k, text in enumerate(base) for c in range(4)]
    whole = sum(len(t) for _, t in data)
    copied = []
    with_texts = jaccard.with_texts

    def seen(texts, rows):
        out = with_texts(texts, rows)
        copied.append(sum(len(r["text"]) for r in out.select("text").collect()))
        return out

    monkeypatch.setattr(jaccard, "with_texts", seen)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 10)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 10)
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(jaccard.linked_components(df, turn=0.4)) == brute.jaccard_components(data)
    assert len(copied) == 3 and max(copied) < 0.7 * whole and sum(copied) == whole


def test_jaccard_in_turns(spark):
    """Small parts and many turns of the cross tiles give the same classes; rows that repeat a doc_id with another text are one node."""
    data = [tuple(r) for r in documents(spark).collect()] + made_documents()
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(jaccard.linked_components(df, tile=16, part=20_000, turn=0.1)) == brute.jaccard_components(data)
    twice = df.union(df.where("doc_id BETWEEN 1000 AND 1119").selectExpr("doc_id", "concat(text, ' and more')"))
    assert {r["component_id"] for r in jaccard.linked_components(twice).where("doc_id BETWEEN 1000 AND 1119").collect()} == {1000}


def test_jaccard_holds_no_whole_sets(spark, monkeypatch):
    """Where every document has near copies, the working tables together never reach the size of the texts."""
    import os

    from quern.llm import components
    from quern.sources import stage as stages

    rng = random.Random(8)
    base = [" ".join(str(rng.randrange(10**5)) for _ in range(1500)) for _ in range(60)]
    data = [(100 * k + c, f"{text} copy{c}") for k, text in enumerate(base) for c in range(4)]
    before, most = stages.staged(), [0]

    def measured(df, label, done=()):
        out = stages.stage(df, label)  # with the tables that it replaces
        mine = [p.removeprefix("file://") for p in stages.staged() - before]
        most[0] = max(most[0], sum(os.path.getsize(f"{p}/{f}") for p in mine for f in os.listdir(p)))
        stages.release(*done)
        return out

    monkeypatch.setattr(jaccard, "stage", measured)
    monkeypatch.setattr(components, "stage", measured)
    got = rows(jaccard.linked_components(spark.createDataFrame(data, "doc_id long, text string")))
    assert got == [(i, 1497, i // 100 * 100) for i, _ in data]
    assert 0 < most[0] < sum(len(t) for _, t in data)


@pytest.mark.parametrize("hot", [2, 2000])
def test_suffix(spark, hot):
    data = [tuple(r) for r in documents(spark).limit(60).collect()] + made_documents()
    data += [(6000 + k, f"{'ab' * k}{data[0][1][:700]}{k}") for k in range(9)] + [(6100, "é" * 700)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(suffix.apply_spans(df, suffix.repeated_spans(df, hot=hot)).drop("kept")) == brute.repeated_bytes(data)


def test_suffix_keeps_the_rest_as_text(spark):
    shared = " ".join(f"s{k}" for k in range(150))
    df = spark.createDataFrame([(1, f"first {shared} end", "x", 5), (2, f"other {shared} tail é", "y", 5), (3, shared, "z", 5), (4, None, "w", 5)], "doc_id long, text string, source string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["source"], r["n_chars"]) for r in suffix.remove_repeats(df).collect()}
    assert got[1][0].startswith("first") and "s75" not in got[1][0] and got[1][2] == len(got[1][0])
    assert 3 not in got and got[4] == (None, "w", 5)


def test_multikey_sort():
    rng = random.Random(1)
    import numpy as np

    keys = [tuple(rng.randint(0, 3) for _ in range(4)) for _ in range(300)]
    cols = np.array(keys, np.uint64)
    items, run = suffix.multikey_sort(300, lambda level, some: cols[some, level], 4)
    assert [keys[i] for i in items] == sorted(k for k in keys if keys.count(k) > 1)
    assert len(set(run)) == len({k for k in keys if keys.count(k) > 1})


def test_anchors_meet():
    """Equal windows have their anchors at the same offset."""
    rng = random.Random(2)
    shared = bytes(rng.randrange(97, 123) for _ in range(450))
    a, b = b"q" * 333 + shared + b"z" * 200, shared[:420] + b"w" * 300
    d, lo, hi, at, gram, _, _ = suffix.anchors_of([a, b])
    of = lambda doc, p: next((int(x - p), int(g)) for i, l, h, x, g in zip(d, lo, hi, at, gram) if i == doc and l <= p <= h)
    for p in range(21):
        assert of(0, 333 + p) == of(1, p)


def test_tokens_match_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    texts = [r["text"] for r in documents(spark).limit(40).collect()] + ["it's  we'll   x\n\n  y<|endoftext|> a <|endoftext|><|endo 're don't   ", "", "   ", "a" * 300, "é🙂漢字 ١٢٣ ²½  　x\t\r\n  z", "'s 't'll '"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, len(t.encode()), n, n > 512) for i, t in enumerate(texts) for n in [len(library.encode(t, add_special_tokens=False).ids)]]
    assert rows(tokens.token_counts(df)) == want
    counter = tokens.loaded(tokens.VOCABULARY)
    for t in texts[38:]:
        table = counter.prefix_table(t)
        for i in range(0, len(t) + 1, 1 + len(t) // 300):
            assert counter.count_at(t, table, i) == len(library.encode(t[:i], add_special_tokens=False).ids)
    cut = counter.longest_prefix(texts[0], 50)
    assert counter.count(texts[0][:cut]) <= 50


def test_language(spark):
    docs = documents(spark, ("doc_id", "lang"))
    truth = dict(map(tuple, docs.collect()))
    got = langid.op10_language_id(spark, DATA).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_toxicity(spark):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = [r for r in toxicity.op5_toxicity(spark, DATA).collect() if r["doc_id"] in truth]
    assert sum(r["predicted"] != truth[r["doc_id"]] for r in got) <= 0.1 * len(got)


def test_toxicity_of_held_out_documents(spark):
    """Recall of either label on documents that nothing was learned from."""
    d = f"{DATA.rsplit('/', 1)[0]}/sf0.1"  # smaller tables hold out too few toxic documents
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [(truth[r["doc_id"]], r["predicted"]) for r in toxicity.op5_toxicity(spark, d).collect() if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [p for t, p in got if t == 1], [p for t, p in got if t == 0]
    assert len(toxic) >= 50 and sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_languages_in_many_scripts(spark):
    """Cyrillic, Greek, Devanagari and Arabic beside Latin; counts of more languages than a task holds."""
    rng = random.Random(6)
    scripts = {"ru": (0x430, 32), "el": (0x3B1, 25), "hi": (0x905, 50), "ar": (0x627, 28), "en": (97, 26), "bg": (0x430, 32)}
    words_of = {}
    for lang, (first, n) in scripts.items():
        letters = rng.sample(range(first, first + n), min(n, 18))
        words_of[lang] = ["".join(chr(rng.choice(letters)) for _ in range(rng.randint(2, 8))) for _ in range(120)]
    data = [(k, " ".join(rng.choices(words_of[lang], k=40)), lang) for k, lang in enumerate(list(scripts) * 60)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    train = df.where("doc_id % 3 <> 0").union(spark.createDataFrame([(9000 + k, f"zq{k} wx", f"x{k}") for k in range(40)], df.schema))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df.where("doc_id % 3 = 0"), *langid.prototypes(train)).collect()}
    assert sum(got[k] == lang for k, _, lang in data if k in got) >= 0.95 * len(got)


def test_disguised_words(spark):
    """Look-alikes, signs, blanks and repeated letters come back to the word, and are scored."""
    rng = random.Random(4)
    good = ["the", "house", "with", "green", "windows", "stands", "near", "water", "where", "children", "play", "often", "and", "nobody", "minds"]
    make = lambda *w: " ".join([*rng.choices(good, k=20), *w, *rng.choices(good, k=20)])
    data = [(k, make(("idiot", "stupid")[k % 2]) if k % 5 == 0 else make()) for k in range(400)]
    forms = ["1d10t", "i.d.i.o.t", "i d i o t", "iiidiooot", "st00pid st*pid stupiiid", "s t u p i d", "5tup1d", "st-u-p-id"]
    docs = spark.createDataFrame(data + [(1000 + k, make(f)) for k, f in enumerate(forms)] + [(2000 + k, make()) for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    assert [f for k, f in enumerate(forms) if not got[1000 + k]] == []
    assert not any(got[2000 + k] for k in range(20))


def test_disguises_at_the_gates():
    """Long tokens, doubled letters, spaced runs over line ends or of two letters."""
    import numpy as np

    from quern.llm.langid import CODES, letter_codes

    text = " " + "the idiot and the stupid moron said that a poop is good and well all see books " * 50
    code = letter_codes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
    counts = np.bincount(code[:-2] * CODES**2 + code[1:-1] * CODES + code[2:], minlength=CODES**3)
    words = ["idiot", "stupid", "moron", "poop"]
    reader = toxicity.Reader(counts, {w: k for k, w in enumerate(words)})
    found = lambda t: {words[k] for k in reader.features(t)}
    for form in ("iidiioott", "IiDdIOT", "x" * 30 + "-1d10t-" + "y" * 30, "i" * 65 + "diot", "1d10t" + "".join(f"{k}/" for k in range(40)), "q" + "zk" * 60 + "idiot" + "vb" * 60, "i\nd\ni\no\nt", "i d\n\ni o t"):
        assert "idiot" in found(form), form
    for form in ("stuupid", "stuuppidd", "so-" + "stup1d" + "wzx" * 30):
        assert "stupid" in found(form), form
    assert "moron" in found("mmoorroonn") and "poop" in found("p o o p")
    assert not found("good well all books") and not found("x x x x x") and not found("zk" * 60)


def test_quality(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = [r for r in weaklabels.op6_quality_classifier(spark, DATA).collect() if r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) >= 0.85 * len(got)


def test_quality_finds_the_labellers_accuracies():
    """A made mixture: good documents, a fault that two labellers see, one that a single labeller sees."""
    import numpy as np

    rng = np.random.default_rng(1)
    n, kinds = 40_000, len(weaklabels.LABELLERS)
    true = rng.choice(3, n, p=[0.85, 0.1, 0.05])
    bad = np.full((3, kinds), 0.005)
    bad[1, [1, 5]], bad[2, 3] = (0.8, 0.7), 0.9
    nothing = rng.random((n, kinds)) < 0.1
    v = np.where(rng.random((n, kinds)) < bad[true], -1, np.where(nothing, 0, 1)).astype(np.int8)
    patterns, count = np.unique(weaklabels.pattern(v), return_counts=True)
    share, p = weaklabels.estimate(weaklabels.unpattern(patterns), count.astype(float))
    assert abs(share[0] - 0.86) < 0.03 and abs(p[0, :, 0] - 0.005).max() < 0.01
    two = share[1:] @ (p[1:, 1, 0] * p[1:, 5, 0])
    assert abs(two - 0.1 * 0.8 * 0.7) < 0.01
    found = weaklabels.posterior(v, share, p) >= 0.5
    assert (found == (true == 0)).mean() > 0.97


def test_quality_by_held_out_labels(spark):
    """Recall of either class on documents outside the sample that the scorer is fitted to."""
    d = f"{DATA.rsplit('/', 1)[0]}/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    sample = {r["doc_id"] for r in weaklabels.sampled(docs, 400).collect()}
    got = [(truth[r["doc_id"]], r["predicted"]) for r in weaklabels.quality(docs, 400).collect() if r["doc_id"] in truth and r["doc_id"] not in sample]
    good, bad = [p for t, p in got if t == 1], [p for t, p in got if t == 0]
    assert sum(good) >= 0.95 * len(good) and bad.count(0) >= 0.75 * len(bad) and len(bad) > 15


def test_pages():
    rng = random.Random(99)
    labeller = blocks.trained()
    wrong = seen = 0
    for _ in range(200):
        page, labels = blocks.made_page(rng)
        got = labeller.label(blocks.block_inputs([blocks.blocks_of(page)]))[0]
        seen += len(labels)
        wrong += sum(a != b for a, b in zip(got, labels))
    assert wrong <= 0.01 * seen


def test_page_text(spark):
    page = '<html><head><title>t</title></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">buy now</div><article><h1>A &amp; B</h1><p>One  <b>two</b>three &eacute;\n x<br>y<p>Last one.</p><script>var a="</p>";</script></article><section class="comments"><div class="comment">nice post thanks</div></section><footer>&copy; me</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in blocks.extract(df).collect()}
    assert got[1] == ("A & B One two" + "three é x y Last one.", len("A & B One twothree é x y Last one."))
    assert got[2] == got[3] == ("", 0)


HAND_LABELLED = [
    ("<div><div><div><p>First paragraph of the page here.</p><p>Second one follows it.</p></div></div></div>", "First paragraph of the page here. Second one follows it."),
    ("<html><body><div><div><div>First paragraph of the page here.</div><div>Second one follows it with more words.</div></div></div></body></html>", "First paragraph of the page here. Second one follows it with more words."),
    ("<p>one two three", "one two three"),
    ("just some text without any tags at all", "just some text without any tags at all"),
    ("<html><body>plain body text only</body></html>", "plain body text only"),
    ('<html><body><article><h1>A</h1><p>Text2 with inline <b>abc</b> end</p><aside class="related"><p>Related stuff</p></aside><p>After it more text.</p></article></body></html>', "A Text2 with inline abc end After it more text."),
    ('<html><body><nav><a href="/">Home</a><a href="/b">About</a></nav><div class="post"><h1>Title of it</h1><p>Real text, with <button>Click me</button> in it.</p></div><footer>Copyright 2020</footer></body></html>', "Title of it Real text, with in it."),
]


def test_pages_from_outside_the_grammar(spark):
    df = spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(HAND_LABELLED)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in blocks.extract(df).collect()}
    assert [got[k] for k in range(len(HAND_LABELLED))] == [t for _, t in HAND_LABELLED]


def test_pages_give_their_article(spark):
    """Every page of sf0.1 gives the blocks inside its article element."""
    import re

    d = f"{DATA.rsplit('/', 1)[0]}/sf0.1"
    got = {r["page_id"]: r["text"] for r in blocks.op1_html_extraction(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        inside = re.search(r"<article[^>]*>(.*?)</article>", r["html"] or "", re.S)
        assert got[r["page_id"]] == (" ".join(blocks.blocks_of(inside[1])[0]) if inside else ""), r["page_id"]


def test_pieces():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 30, "c", "d" * 5]})
    assert [p.num_rows for p in batches.pieces([b], 12)] == [2, 1, 2]
