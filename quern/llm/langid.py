"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter n-gram is bound from the permuted (rolled) vectors
of its letters by multiplication; a text is the bundle (sum) of its n-grams, a language the bundle of the
texts that are labelled with it.  A text gets the language whose prototype has the largest cosine.
Bundling is linear and exact in whole numbers, so every task bundles its own texts and the sums of the
SIZE dimensions of each language are added up in the JVM, whatever the order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.batches import pieces

SIZE = 512
CODES = 64  # letter classes: 0 for what separates words, 1-26 for a-z, the others by code point
FOLDS = 5
HELD = 16  # languages whose counts a task holds at once, 2 MB each
UNKNOWN = "und"

_letters = np.zeros(0, np.uint8)


def letter_codes() -> np.ndarray:
    """The class of every code point (0: not a letter)."""
    global _letters
    if not len(_letters):
        _letters = np.fromiter(((0 if not chr(i).isalpha() else i - 96 if 97 <= i <= 122 else 27 + i % 37) for i in range(0x110000)), np.uint8, 0x110000)
    return _letters


def letter_vectors() -> np.ndarray:
    return np.random.default_rng(77).choice(np.array([-1, 1], np.int8), (CODES, SIZE))


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of 3-grams, which are numbered by their letter classes."""
    v = letter_vectors() if not hasattr(gram_vectors, "rolled") else None
    if v is not None:
        gram_vectors.rolled = [np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v]
    a, b, c = gram_vectors.rolled
    return a[grams // CODES**2] * b[grams // CODES % CODES] * c[grams % CODES]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The letter 3-grams of a text, words set off by one blank, and their counts; none without a letter."""
    code = letter_codes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = np.concatenate([[0], code, [0]]).astype(np.int32)
    code = code[(code > 0) | np.concatenate([[True], code[:-1] > 0])]
    if not code.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(code[:-2] * CODES**2 + code[1:-1] * CODES + code[2:], return_counts=True)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def bundles(train: DataFrame) -> DataFrame:
    """lang and the bundled vector of some of its texts; a task holds the counts of HELD languages at most."""

    def bundled(lang: str, counts: np.ndarray):
        v = np.zeros(SIZE)
        g = np.flatnonzero(counts)
        for at in range(0, len(g), 2048):
            some = g[at : at + 2048]
            v += counts[some].astype(np.float64) @ gram_vectors(some).astype(np.float64)  # whole numbers below 2 ** 53
        return lang, v.astype(np.int64)

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def flush():
            rows = [bundled(*x) for x in sums.items()]
            sums.clear()
            vectors = np.concatenate([v for _, v in rows]) if rows else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * SIZE, pa.int32()), pa.array(vectors))], names=["lang", "vector"])

        for b in pieces(batches):
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                if lang not in sums and len(sums) >= HELD:
                    yield flush()
                g, n = gram_counts(t)
                sums.setdefault(lang, np.zeros(CODES**3, np.int64))[g] += n
        yield flush()

    return train.select("text", "lang").mapInArrow(run, "lang string, vector array<bigint>")


def prototypes(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the unit prototypes (SIZE by language) of rows with text and lang; the driver holds SIZE numbers a language."""
    added = bundles(train).select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    sums: dict[str, np.ndarray] = {}
    for r in added.toLocalIterator():
        sums.setdefault(r["lang"], np.zeros(SIZE))[r["at"]] = r["x"]
    names = sorted(sums)
    table = np.stack([sums[k] for k in names], axis=1) if names else np.zeros((SIZE, 0))
    return names, table / np.maximum(np.linalg.norm(table, axis=0), 1e-9)


def identify(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine, 0 if negative) of every row.

    A NULL text, one without a letter, or any text when nothing was learned is ``und`` with score 0.
    """
    known = docs.sparkSession.sparkContext.broadcast((names, table.astype(np.float32)))

    def run(batches):
        names, table = known.value
        for b in pieces(batches):
            langs, scores = [], []
            for t in b.column("text").to_pylist():
                g, n = gram_counts(t or "")
                if not len(g) or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                v = n.astype(np.float32) @ gram_vectors(g).astype(np.float32)
                cosines = v @ table / max(float(np.linalg.norm(v)), 1e-9)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out and have a text and a lang."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return identify(docs, *prototypes(train))
