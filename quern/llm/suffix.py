"""Suffix-array dedup: removes every byte covered by a LENGTH-byte string that also starts elsewhere.

A sparse suffix array stands for the full one.  Of every LENGTH-byte window the GRAM-byte gram with the
smallest hash (the first of equal ones) is its anchor; equal windows have their anchors at the same
offset, so only suffixes that start at anchors need to meet, about two for LENGTH - GRAM bytes of text.
An anchor's context is all windows that it stands for.

1. Anchors are counted by gram; grams that occur once are done.
2. Equal contexts (128 bits of the bytes, 64 of the gram) are pre-aggregated to one representative; one
   that occurs twice is covered whole.
3. Of grams with several contexts the representatives' suffixes are range-partitioned by their leading
   token with sampled splitters.  Each bucket is sorted by token and gram, read in whole grams of about
   CHUNK bytes, and its windows are sorted locally by multikey quicksort (the next eight bytes of every
   still tied window at a time), so neighbours that stay tied are equal byte by byte.  Suffixes with equal
   leading tokens never straddle a splitter, so there is nothing to compare across a boundary.
4. Grams with more than HOT different contexts would be one bucket; their windows are dealt out by 128
   bits of window hash instead, so any number of contexts of one gram is spread.

Rows are known by 128 bits of their text, since what is removed depends on the text alone: rows that
repeat a doc_id, or have none, are told apart, and copies of a text share its spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.batches import pieces, texts_of
from quern.llm.hashing import Prefix, join_texts, mix
from quern.llm.text import text_key
from quern.operators.joins import BROADCAST_IDS, BROADCAST_ROWS
from quern.sources.stage import stage

LENGTH, GRAM = 400, 128
HOT = 500
CHUNK = 2 << 20  # bytes of contexts that a bucket sorts at once
SEGMENT = 64 << 20  # bytes of a text that are hashed at once
POSITION = 28  # bits of a position in a piece of text
KEY = ["ka", "kb"]
SAME = ["gram", "c1", "c2"]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive elements."""
    n = len(x) - w + 1
    blocks = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """doc (index), lo and hi (first and last window), at (anchor), gram hash, two context hashes; positions are within the text."""
    data, starts = join_texts(texts)
    none = np.zeros(0, np.int64)
    if len(data) <= length:
        return (none,) * 7
    hashes = Prefix(data)
    at = np.arange(len(data) - gram + 1)
    h = hashes.runs(at, at + gram)
    keyed = (h >> np.uint64(POSITION)) << np.uint64(POSITION) | at.astype(np.uint64)
    low = (sliding_min(keyed, length - gram + 1) & np.uint64((1 << POSITION) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(low)]
    inside = np.flatnonzero(np.arange(len(low)) + length <= starts[doc + 1] - 1)
    if not len(inside):
        return (none,) * 7
    a = low[inside]
    head = np.concatenate([[True], (a[1:] != a[:-1]) | (inside[1:] != inside[:-1] + 1)])
    first = np.flatnonzero(head)
    lo, hi, a = inside[first], inside[np.concatenate([first[1:], [len(inside)]]) - 1], a[first]
    offset = (a - lo).astype(np.uint64)
    c1, c2 = (mix(x.runs(lo, hi + length) + offset) for x in (hashes, Prefix(data, 1)))
    d = doc[lo]
    base = starts[d]
    return d, lo - base, hi - base, a - base, h[a].view(np.int64), c1.view(np.int64), c2.view(np.int64)


def segments(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Overlapping parts of a text, and where they start, that have each of its windows once."""
    for at in range(0, max(1, len(text) - length + 1), SEGMENT):
        yield at, text[at : at + SEGMENT + length - 1]


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """ka, kb, lo, ahead (last window - lo), at (anchor - lo), gram, c1, c2."""
    names = ["ka", "kb", "lo", "ahead", "at", *SAME]

    def run(batches):
        for b in pieces(batches):
            texts = texts_of(b)
            parts = [(0, texts, np.arange(len(texts)))] if max(map(len, texts), default=0) <= SEGMENT else [(at, [part], np.array([k])) for k, t in enumerate(texts) for at, part in segments(t, length)]
            for base, some, rows in parts:
                d, lo, hi, a, g, c1, c2 = anchors_of(some, length, gram)
                of = pa.array(rows[d])
                yield pa.RecordBatch.from_arrays([b.column("ka").take(of), b.column("kb").take(of), pa.array(lo + base), pa.array((hi - lo).astype(np.int16)), pa.array((a - lo).astype(np.int16)), *[pa.array(x) for x in (g, c1, c2)]], names=names)

    return docs.select("text", *text_key(F.col("text"))).mapInArrow(run, "ka long, kb long, lo long, ahead short, at short, gram long, c1 long, c2 long")


def multikey_sort(n: int, tokens, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Items 0..n-1 whose ``levels`` tokens all equal another's, in order, and the run of each.

    A multikey quicksort that splits all open runs at once: items are ordered by run and token, runs end
    where the token changes, and runs of one item are closed.  tokens(level, items) are read only for
    items that are still tied, and a level at which all ties stay costs no sort.
    """
    items, run = np.arange(n), np.zeros(n, np.int64)
    for level in range(levels):
        t = tokens(level, items)
        if level and not ((t[1:] != t[:-1]) & (run[1:] == run[:-1])).any():
            continue
        order = np.lexsort((t, run)) if level else np.argsort(t, kind="stable")
        items, run, t = items[order], run[order], t[order]
        head = np.concatenate([[True], (run[1:] != run[:-1]) | (t[1:] != t[:-1])])[: len(items)]
        run = np.cumsum(head) - 1
        tied = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
        items, run = items[tied], run[tied]
        if not len(items):
            break
    return items, run


def spans_of(row: np.ndarray, p: np.ndarray, length: int):
    """Rows, starts and stops of the runs of window starts ``p`` (any order)."""
    order = np.lexsort((p, row))
    row, p = row[order], p[order]
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (p[1:] != p[:-1] + 1)])[: len(row)])
    last = np.concatenate([head[1:], [len(row)]]) - 1 if len(head) else head
    return row[head], p[head], p[last] + length


def windows_in(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in it of every window of joined texts."""
    count = np.maximum(0, np.diff(starts) - 1 - length + 1)
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def repeated_windows(grams: np.ndarray, offset: np.ndarray, texts: list[bytes], length: int):
    """(row, start, stop) of what repeats among contexts: ``grams`` and ``offset`` (of the anchor) by row; starts are from the anchor."""
    data, starts = join_texts(texts)
    row, within = windows_in(starts, length)
    begin = starts[row] + within
    place = np.unique(grams, return_inverse=True)[1][row] * (2 * length) + offset[row] - within  # gram and distance to its anchor
    ahead = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(len(data), np.uint64)
    for k in range(8):
        eight = eight << np.uint64(8) | ahead[k : k + len(data)]
    cuts = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]  # the last two may overlap

    def tokens(level, items):
        return place[items].astype(np.uint64) if level == 0 else eight[begin[items] + cuts[level - 1]]

    items, _ = multikey_sort(len(row), tokens, len(cuts) + 1)
    return spans_of(row[items], within[items] - offset[row[items]], length)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def new_in_task(batches, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows whose ``names`` are new in this task: a map-side combine of copies."""
    seen: set[tuple] = set()
    for b in batches:
        fresh = []
        for key in zip(*[b.column(c).to_pylist() for c in names]):
            fresh.append(key not in seen)
            seen.add(key)
        yield b if all(fresh) else b.filter(pa.array(fresh))


def context_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """gram, c1, c2, token (of the suffix), hot, offset (of the anchor) and bytes of the contexts in ``wanted``."""

    def once(batches):
        return new_in_task(batches, KEY)

    def cut(batches):
        def parts():
            for b in pieces(batches):
                lists = b.column("cuts")
                of = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
                flat = pa.RecordBatch.from_struct_array(lists.flatten())
                lo, ahead, at = (flat.column(c).to_numpy().astype(np.int64) for c in ("lo", "ahead", "at"))
                texts = texts_of(b)
                found = [texts[d][s:e] for d, s, e in zip(of.tolist(), lo.tolist(), (lo + ahead + length).tolist())]
                lead = np.array([int.from_bytes(x[k : k + 8].ljust(8, b"\0"), "big") for x, k in zip(found, at.tolist())], np.uint64) ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays([*[flat.column(c) for c in SAME], pa.array(lead.view(np.int64)), flat.column("hot"), pa.array(at.astype(np.int32)), pa.array(found, pa.binary())], names=[*SAME, "token", "hot", "offset", "bytes"])

        return new_in_task(parts(), SAME)

    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct(*SAME, "hot", "lo", "ahead", "at")).alias("cuts"))
    lists = stage(lists, "cuts")
    texts = docs.select("text", *text_key(F.col("text"))).join(small(lists.select(*KEY), BROADCAST_IDS), KEY, "left_semi")
    texts = texts.select("text", *KEY).mapInArrow(once, "text string, ka long, kb long")
    cuts = texts.join(lists, KEY).mapInArrow(cut, "gram long, c1 long, c2 long, token long, hot boolean, offset int, bytes binary")
    return stage(cuts, "context-bytes", [lists])


def matched(cuts: DataFrame, length: int) -> DataFrame:
    """gram, c1, c2, from, to (bytes from the anchor) of what repeats among contexts of a gram that is not hot."""

    def grams(table: pa.Table):
        g = table.column("gram").to_numpy()
        ends = np.flatnonzero(np.concatenate([g[1:] != g[:-1], [True]])) + 1
        size = np.cumsum(pc.binary_length(table.column("bytes")).to_numpy().astype(np.int64))
        at = 0
        while at < len(g):  # whole grams, about CHUNK bytes at once
            to = int(ends[min(np.searchsorted(ends, max(at + 1, np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK))), len(ends) - 1)])
            some = table.slice(at, to - at)
            at = to
            keys = np.stack([some.column(c).to_numpy() for c in SAME])
            some = some.filter(pa.array(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))).combine_chunks()  # copies are neighbours
            row, start, stop = repeated_windows(some.column("gram").to_numpy(), some.column("offset").to_numpy().astype(np.int64), some.column("bytes").to_pylist(), length)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[some.column(c).combine_chunks().take(rows) for c in SAME], pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=[*SAME, "from", "to"])

    def match(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size < CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column("gram").to_numpy()
            edges = np.flatnonzero(g[1:] != g[:-1])
            if len(edges):  # the last gram may go on in the next batch
                cut = int(edges[-1]) + 1
                yield from grams(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield from grams(pa.Table.from_batches(held).combine_chunks())

    # a given number of buckets: sorting costs far more than reading, so buckets must not be merged by their bytes
    buckets = int(cuts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = cuts.where("NOT hot").select(*SAME, "token", "offset", "bytes").repartitionByRange(buckets, "token", "gram").sortWithinPartitions("token", *SAME)
    return near.mapInArrow(match, "gram long, c1 long, c2 long, from int, to int")


def dealt(cuts: DataFrame, length: int) -> DataFrame:
    """The same for hot grams, by window."""

    def deal(batches):
        for b in batches:
            parts = b.column("bytes").to_pylist()
            data, starts = join_texts(parts)
            row, within = windows_in(starts, length)
            begin = starts[row] + within
            offset = b.column("offset").to_numpy()[row] - within
            w1, w2 = (mix(Prefix(data, k).runs(begin, begin + length) + offset.astype(np.uint64)).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), *[b.column(c).take(pa.array(row)) for c in SAME], pa.array((-offset).astype(np.int32))], names=["w1", "w2", *SAME, "from"])

    hot = cuts.where("hot").select(*SAME, "offset", "bytes").dropDuplicates(SAME)
    windows = stage(hot.mapInArrow(deal, "w1 long, w2 long, gram long, c1 long, c2 long, from int"), "hot-windows")
    twice = windows.groupBy("w1", "w2", "gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    by = windows.join(twice, ["w1", "w2", "gram"]).groupBy(*SAME).agg(F.array_sort(F.collect_list("from")).alias("p"))
    # runs of window starts: a start without a predecessor, and the last before the next such start
    heads = F.filter("p", lambda x: ~F.array_contains("p", x - 1))
    tails = F.filter("p", lambda x: ~F.array_contains("p", x + 1))
    by = by.select(*SAME, F.explode(F.arrays_zip(heads.alias("h"), tails.alias("t"))).alias("s"))
    return by.select(*SAME, F.col("s")["h"].alias("from"), (F.col("s")["t"] + length).alias("to"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """ka, kb (of the text) and the repeated byte spans: a sorted array of (start, stop), which may overlap."""
    anchors = stage(anchor_rows(docs, length, gram), "anchors")
    shared = stage(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    live = stage(anchors.join(shared, "gram", "left_semi"), "live", [anchors, shared])

    reps = live.groupBy(*SAME).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "lo", "ahead", "at")).alias("rep"))
    reps = stage(reps.select(*SAME, "n", "rep.*"), "contexts")
    several = reps.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gram", (F.col("k") > hot).alias("hot"))
    several = stage(several, "several")
    wanted = reps.join(small(several), "gram")
    cuts = context_bytes(docs, wanted, length)
    found = matched(cuts, length)
    if not several.where("hot").isEmpty():
        found = found.union(dealt(cuts, length))
    whole = reps.where("n > 1").select(*SAME, F.lit(True).alias("full"), F.lit(0).alias("from"), F.lit(0).alias("to"))
    found = stage(found.select(*SAME, F.lit(False).alias("full"), "from", "to").union(whole), "found", [reps, several, cuts])

    hits = live.join(found, SAME)
    at = F.col("lo") + F.col("at")
    start = F.when(F.col("full"), F.col("lo")).otherwise(at + F.col("from"))
    stop = F.when(F.col("full"), F.col("lo") + F.col("ahead") + length).otherwise(at + F.col("to"))
    spans = hits.select(*KEY, start.alias("start"), stop.alias("stop")).distinct()
    return stage(spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")), "spans", [live, found])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (with ka and kb as __ka and __kb, which are dropped) and __spans; spans are broadcast while they are few."""
    spans = spans.select(F.col("ka").alias("__a"), F.col("kb").alias("__b"), F.col("spans").alias("__spans"))
    n, held = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__spans")), F.lit(0))).first()
    spans = F.broadcast(spans) if n + held <= BROADCAST_IDS else spans
    return docs.join(spans, (F.col("__ka") == F.col("__a")) & (F.col("__kb") == F.col("__b")), "left").drop("__a", "__b", "__ka", "__kb")


def keyed(docs: DataFrame) -> DataFrame:
    a, b = text_key(F.col("text"))
    return docs.withColumns({"__ka": a, "__kb": b})


def cut_out(text: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """What is left of a text without its spans, and the number of maximal removed runs."""
    kept, end, runs = [], 0, 0
    for x in spans:
        runs += x["start"] > end or not runs
        kept.append(text[end : max(end, x["start"])])
        end = max(end, x["stop"])
    return b"".join([*kept, text[end:]]), runs


def apply_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) of every row of ``docs``."""
    wide = with_spans(keyed(docs.select("doc_id", "text")), spans)

    def run(batches):
        for b in pieces(batches):
            texts = texts_of(b)
            out = {"n_bytes": [len(t) for t in texts], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for t, s in zip(texts, b.column("__spans").to_pylist()):
                left, runs = cut_out(t, s) if s else (t, 0)
                out["n_removed"].append(len(t) - len(left))
                out["n_spans"].append(runs)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_sha256"]), pa.array(out["kept"], pa.binary())], names=["doc_id", *out])

    return wide.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes taken out of text (and n_chars, where it exists, counted anew).

    What is left of a cut character is dropped; a document of which nothing is left is dropped.
    """
    names = docs.columns
    wide = with_spans(keyed(docs), repeated_spans(docs, length, gram))

    def run(batches):
        for b in pieces(batches):
            texts, lengths, stay = b.column("text").to_pylist(), [], []
            for i, s in enumerate(b.column("__spans").to_pylist()):
                if s:
                    texts[i] = cut_out(texts[i].encode(), s)[0].decode("utf-8", "ignore")
                stay.append(not s or bool(texts[i]))
                lengths.append(len(texts[i] or ""))
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            if "n_chars" in names and pa.types.is_integer(b.column("n_chars").type):
                k = names.index("n_chars")
                changed = pa.array([bool(s) for s in b.column("__spans").to_pylist()])
                cols[k] = pc.if_else(changed, pa.array(lengths, b.column("n_chars").type), b.column("n_chars"))
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(stay))

    return wide.mapInArrow(run, docs.schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A NULL or short text has nothing to remove.  Matches may be anywhere, in the same document too, but
    never cross documents.  Rows that repeat a doc_id, equal or not, and rows with a NULL doc_id are
    documents of their own.  An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_spans(docs, repeated_spans(docs)).drop("kept")
