"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.  The votes of all documents
are counted by pattern (a table of bounded size, whatever the input), and expectation-maximisation
estimates the shares of good documents and of several kinds of bad ones, and every labeller's accuracy on
each, from the patterns alone, without true labels; one kind of bad for all would take the most frequent
fault for badness and the others for errors of their labellers.  The posterior of a document's pattern is
its soft label; a linear model over hashed words, word shapes, word pairs and the size is fitted to the soft
labels of a bounded sample and scores every document.  Votes are no input of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.hashing import SEPARATOR, Prefix, join_texts, mix
from quern.llm.batches import pieces, texts_of
from quern.llm.text import md5_key

#: At most so many documents are fitted to, the smallest by a hash of doc_id.
SAMPLE = 8_000
HASHED = 1 << 12  # hashed words, and as many hashed word shapes and pairs of words
TWICE = 3 * HASHED  # a word after itself
SIZES = TWICE + 1  # by the binary logarithm of the number of words
FEATURES = SIZES + 34  # the last is the offset
ROUNDS = 200
WRONG = 0.01  # a labeller finds fault with at most this share of the good documents, as is assumed of it

#: Name, measure, good up to, bad from (bad below good: the measure must be large).
LABELLERS = (
    ("length", "words", 30, 2),
    ("symbols", "symbol_share", 0.03, 0.15),
    ("word_length", "mean_word", 9.5, 14.0),
    ("repeats", "top_word", 0.12, 0.3),
    ("variety", "distinct_share", 0.3, 0.15),
    ("bars", "bar_share", 0.02, 0.2),
    ("capitals", "capital_share", 0.2, 0.5),
    ("lines", "dup_line_share", 0.05, 0.3),
    ("sentence", "word_run", 3.0, 1.5),
)
MEASURES = tuple(m for _, m, _, _ in LABELLERS)

_shape = np.arange(256, dtype=np.uint8)
_shape[ord("a") : ord("z") + 1] = ord("a")
_shape[ord("A") : ord("Z") + 1] = ord("A")
_shape[ord("0") : ord("9") + 1] = ord("0")
_shape[128:] = ord("a")


def measure(text: bytes) -> tuple[float, ...]:
    """The measures of a text, in the order of MEASURES; zeros without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(MEASURES)
    chars = sum(map(len, words))
    marks = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">", b"{", b"}", b"=")))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = sum(w.isupper() for w in words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    top = max(seen.values()) / n if n >= 20 else 0.0
    variety = min(1.0, len(seen) / min(n, 200))
    return (float(n), marks / chars, chars / n, top, variety, words.count(b"|") / n, upper / n, 1 - len(set(lines)) / len(lines), n / (same + n / 4))


def votes(values: np.ndarray) -> np.ndarray:
    """1 good, -1 bad, 0 nothing, for rows of measures."""
    out = np.zeros(values.shape, np.int8)
    for k, (_, _, good, bad) in enumerate(LABELLERS):
        v = values[:, k]
        out[:, k] = np.where(v >= good, 1, np.where(v <= bad, -1, 0)) if bad < good else np.where(v <= good, 1, np.where(v >= bad, -1, 0))
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1]))


def unpattern(p: np.ndarray) -> np.ndarray:
    return (p[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


def estimate(v: np.ndarray, count: np.ndarray, rounds: int = ROUNDS):
    """Shares of the classes and P(vote | class) of every labeller (class, labeller, vote + 1) by expectation-maximisation over vote patterns.

    Class 0 is good, class k + 1 a kind of bad that starts from the documents that labeller k finds bad.  A
    fault that only one labeller sees could as well be its error; WRONG bounds how often it errs.
    """
    kinds = v.shape[1]
    share = np.array([0.8, *[0.2 / kinds] * kinds])
    p = np.empty((kinds + 1, kinds, 3))
    p[:] = (0.01, 0.19, 0.8)
    p[1:] = (0.05, 0.15, 0.8)
    p[np.arange(kinds) + 1, np.arange(kinds)] = (0.9, 0.05, 0.05)
    hot = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(np.float64)
    for _ in range(rounds):
        of = classes(v, share, p) * count[:, None]
        new = np.maximum(of.sum(axis=0), 1e-9)
        sums = np.einsum("rc,rlv->clv", of, hot) + 0.5
        p = sums / sums.sum(axis=2, keepdims=True)
        over = np.maximum(0, p[0, :, 0] - WRONG)
        p[0, :, 0] -= over
        p[0, :, 2] += over
        new = new / new.sum()
        if np.abs(new - share).max() < 1e-9:
            break
        share = new
    return share, p


def classes(v: np.ndarray, share: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The posterior of every class for rows of votes."""
    at = np.arange(v.shape[1])
    z = np.log(p[:, at, v.astype(int) + 1]).sum(axis=2).T + np.log(np.maximum(share, 1e-12))
    z = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    return z / z.sum(axis=1, keepdims=True)


def posterior(v: np.ndarray, share: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The posterior of good."""
    return classes(v, share, p)[:, 0]


def hashed_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and weight: shares of hashed words, shapes and pairs among the words of a text, its size and the offset."""
    data, starts = join_texts(texts)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SEPARATOR[data], [True]]).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    h = Prefix(data).runs(first, last)
    # a shape is the word with letters and digits by kind, its first and last four bytes
    shape = Prefix(_shape[data])
    head, tail = np.minimum(last, first + 4), np.maximum(first, last - 4)
    form = (shape.runs(first, head) * np.uint64(3) + shape.runs(tail, last)) % np.uint64(HASHED)
    row = np.searchsorted(starts, first, "right") - 1
    two = np.flatnonzero(row[1:] == row[:-1]) if len(row) else row
    pair = np.where(h[two] == h[two + 1], TWICE, 2 * HASHED + (mix(h[two] * np.uint64(3) + h[two + 1]) % np.uint64(HASHED)).astype(np.int64))
    n = np.bincount(row, minlength=len(texts))
    every = np.arange(len(texts))
    rows = np.concatenate([row, row, row[two], every, every])
    at = np.concatenate([(h % np.uint64(HASHED)).astype(np.int64), HASHED + form.astype(np.int64), pair, SIZES + np.ceil(np.log2(n + 1)).astype(np.int64), np.full(len(texts), FEATURES - 1)])
    weight = np.ones(len(rows))
    words = len(row) * 2 + len(two)
    weight[:words] = 1 / np.maximum(n, 1)[rows[:words]]
    return rows, at, weight


def compact(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The features of one text and their weights, at most FEATURES of them."""
    _, at, weight = hashed_features([text])
    found, place = np.unique(at, return_inverse=True)
    return found.astype(np.int32), np.bincount(place, weight).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, steps: int = 600, rate: float = 0.5) -> np.ndarray:
    """Weights of the hashed linear scorer for soft labels, by Adagrad over batches in a fixed order."""
    w = np.zeros(FEATURES, np.float64)
    seen = np.full(len(w), 1e-8)
    if not len(rows):
        return w
    order = np.random.default_rng(5).permutation(len(rows))
    for step in range(steps):
        k = step * 128 % len(order)
        some = order[k : k + 128]
        x = np.zeros((len(some), FEATURES), np.float32)
        for r, i in enumerate(some):
            x[r, rows[i][0]] = rows[i][1]
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - soft[some]) / len(some) + 1e-5 * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` doc_ids, the smallest by a hash."""
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(md5_key("quality", F.col("doc_id")), "doc_id").limit(sample)


def quality(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score (0 to 1, higher: better), predicted (1 good), posterior (of the votes alone) of every row.

    A NULL or empty text has no words and is bad to the labeller of lengths; where none was in the sample,
    its score is that of the offset.
    Rows that repeat a doc_id are scored each; an empty table gives no rows.
    """

    def voted(batches):
        sums: dict[int, int] = {}
        for b in pieces(batches):
            k, n = np.unique(pattern(votes(np.array([measure(t) for t in texts_of(b)]))), return_counts=True) if b.num_rows else ((), ())
            for p, c in zip(k, n):
                sums[int(p)] = sums.get(int(p), 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["pattern", "n"])

    counted = docs.select("text").mapInArrow(voted, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # at most 3 ** len(LABELLERS) rows
    v = unpattern(np.array([r["pattern"] for r in counted], np.int64))
    share, p = estimate(v, np.array([r["n"] for r in counted], np.float64))
    ids = sampled(docs, sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy("doc_id").select("text")  # at most ``sample`` rows are broadcast
    held, patterns = [], []
    for r in rows.toLocalIterator():  # a text is dropped once its features, of bounded number, are known
        text = (r["text"] or "").encode()
        held.append(compact(text))
        patterns.append(votes(np.array([measure(text)]))[0])
    soft = posterior(np.array(patterns, np.int8).reshape(-1, len(LABELLERS)), share, p)
    model = docs.sparkSession.sparkContext.broadcast((fit(held, soft), share, p))

    def run(batches):
        w, share, p = model.value
        for b in pieces(batches):
            texts = texts_of(b)
            v = votes(np.array([measure(t) for t in texts]).reshape(-1, len(LABELLERS)))
            row, at, weight = hashed_features(texts)
            z = np.bincount(row, w[at] * weight, minlength=len(texts))
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(posterior(v, share, p))], names=["doc_id", "score", "predicted", "posterior"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, posterior double")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, predicted, posterior, kept; true labels are not used."""
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("kept", F.col("predicted") == 1)
