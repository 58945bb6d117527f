"""Toxicity by noisy-channel restoration.

Text is taken as what a noisy channel made of clean words: letters become look-alike signs, signs or blanks
are put between letters, letters are repeated.  Each suspicious token or run of single letters becomes a
lattice with the possible sources of every character and their channel costs; Viterbi decoding under a
character trigram model of the whole corpus restores it.  The restored words, with their beginnings, are
scored by a logistic model that is learned from a bounded sample of labelled documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.batches import pieces
from quern.llm.langid import CODES, held_out, letter_codes
from quern.llm.text import md5_key

#: At most so many labelled documents are learned from, the smallest by a hash of doc_id.
SAMPLE = 8_000
FEATURES = 600
BEGINNINGS = range(4, 9)
REMEMBERED = 500_000
#: Tokens over LONG characters are decoded in pieces twice as long, which overlap by LONG.
LONG = 64

#: What a sign may stand for in disguised words; fixed values.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Channel costs; a digit is hardly ever put between letters, a sign often is.
SUBSTITUTED, DROPPED, DIGIT_DROPPED, REPEATED, BLANK_DROPPED = 2.0, 1.0, 5.0, 0.7, 1.2

SIGNS = "".join(map(re.escape, LOOKALIKES))
#: A token with a letter and, before its last letter, a sign or digit; or three equal letters in a row.
SUSPICIOUS = re.compile(rf"[^\W\d_].*(?:[{SIGNS}]|[\W\d_])+.*[^\W\d_]|^[{SIGNS}].*[^\W\d_]|[^\W\d_][{SIGNS}]+$|([^\W\d_])\1\1", re.S)
#: Equal letters in a row; of other tokens, these are decoded where the same with single letters may be a known word.
DOUBLED = re.compile(r"([^\W\d_])\1+")
STRETCHED = re.compile(r"(.)\1{3,}", re.S)
PARTS = re.compile(rf"[^\w{SIGNS}]+")
SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\W_][^\w\s]?\s+){2,}[^\W_](?=[^\w\s]?(?:\s|$))")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
WORDS = re.compile(r"[^\W\d_]+")


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter-class trigrams (blanks included) over all texts of all documents; of fixed size on the driver.

    A task gives a row for each trigram that it saw; they are added up in the JVM, spread over all tasks.
    """

    def count(batches):
        sums = np.zeros(CODES**3, np.int64)
        for b in pieces(batches):
            text = " ".join(["", *(t or "" for t in b.column("text").to_pylist()), ""]).lower()
            code = letter_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
            code = code[(code > 0) | np.concatenate([[True], code[:-1] > 0])]
            sums += np.bincount(code[:-2] * CODES**2 + code[1:-1] * CODES + code[2:], minlength=CODES**3)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(sums[seen])], names=["gram", "n"])

    added = docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(CODES**3, np.int64)
    rows = added.toArrow()  # at most CODES ** 3 rows
    out[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return out


class Restorer:
    """Viterbi decoding of character lattices under a trigram model."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(CODES, CODES, CODES).astype(np.float64)
        two = c.sum(axis=2, keepdims=True)
        one = c.sum(axis=(0, 2))[None, :, None] + 1.0  # times the middle letter was seen
        back = (c.sum(axis=0, keepdims=True) + 0.1) / (one + 0.1 * CODES)
        self.cost = -np.log((c + 5.0 * back) / (two + 5.0)).astype(np.float32)

    def code(self, ch: str) -> int:
        return int(letter_codes()[ord(ch)])

    def lattice(self, noisy: str) -> list[list[tuple[str, float]]]:
        """For every character what may stand behind it ('' for nothing), with costs."""
        out, before = [], ""
        for ch in noisy:
            if ch.isspace():
                out.append([("", BLANK_DROPPED), (" ", 0.0)])
            elif ch.isalpha():
                out.append([(ch, 0.0), ("", REPEATED)] if ch == before else [(ch, 0.0)])
            else:
                out.append([("", DIGIT_DROPPED if ch.isdigit() else DROPPED), *((x, SUBSTITUTED) for x in LOOKALIKES.get(ch, ""))])
            before = ch
        return out

    def restore(self, noisy: str) -> str:
        """The cheapest source of a noisy string."""
        beam: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        cost = self.cost
        for options in [*self.lattice(noisy.lower()), [(" ", 0.0)]]:
            ahead: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (spent, text) in beam.items():
                for ch, price in options:
                    if not ch or ch == " " and b == 0:
                        key, total, out = (a, b), spent + price, text
                    else:
                        k = 0 if ch == " " else self.code(ch)
                        key, total, out = (b, k), spent + price + float(cost[a, b, k]), text + ch
                    if key not in ahead or total < ahead[key][0]:
                        ahead[key] = (total, out)
            beam = ahead
        return min(beam.values())[1].strip()


class Reader:
    """From texts to the numbers of the restored words' features; without ``known`` names every one is numbered as it comes."""

    def __init__(self, counts: np.ndarray, known: dict[str, int] | None = None):
        self.restorer, self.known = Restorer(counts), known
        self.numbers: dict[str, int] = {} if known is None else known
        self.seen: dict[str, tuple] = {}
        self.single = {DOUBLED.sub(r"\1", n) for n in known or ()}
        self.whole = [n for n in known or () if len(n) >= 5 and n[-1] != "*"]

    def names(self, word: str) -> list[str]:
        """A word and its beginnings as names of features."""
        return [word, *(word[:k] + "*" for k in BEGINNINGS if k < len(word))]

    def forms(self, token: str, plain: str) -> set[str]:
        """What is decoded of a token."""
        doubled = DOUBLED.findall(plain)  # the letters
        if SUSPICIOUS.search(token):
            out = {token, plain}
        elif doubled and self.may_be_known(plain):
            out = {plain}
        else:
            return set()
        if len(doubled) > 1:
            out.add(DOUBLED.sub(r"\1", plain))
        return out

    def may_be_known(self, word: str) -> bool:
        """False only if no choice of single or doubled letters gives a known word or beginning.

        While words are learned none is known: ordinary words with doubled letters would only add copies of themselves.
        """
        word = DOUBLED.sub(r"\1", word)
        return word in self.single or any(word[:k] + "*" in self.single for k in range(1, min(len(word), BEGINNINGS[-1]) + 1))

    def decoded(self, token: str) -> set[str]:
        """Names of the words and restored words of a token of bounded length."""
        plain = EDGE.sub("", token).lower()
        found = {n for w in WORDS.findall(plain) for n in self.names(w)}
        for form in self.forms(token, plain):
            found.update(n for w in self.restorer.restore(form).split() for n in self.names(w))
        return found

    def decoded_long(self, token: str) -> set[str]:
        """The same in overlapping pieces, with the known words inside them; long runs of one character are cut to three."""
        token = STRETCHED.sub(r"\1\1\1", token.lower())
        found: set[str] = set()
        for at in range(0, max(1, len(token) - LONG), LONG):
            piece = token[at : at + 2 * LONG]
            for part in {piece, *PARTS.split(piece)}:
                found |= self.decoded(part)
            glued = {piece, DOUBLED.sub(r"\1", piece)}
            if SUSPICIOUS.search(piece) or DOUBLED.search(piece):
                glued |= {self.restorer.restore(x) for x in glued}
            found.update(n for n in self.whole if any(n in x for x in glued))
        return found

    def token(self, token: str) -> tuple:
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            found = self.decoded(token) if len(token) <= LONG else self.decoded_long(token)
            if len(token) > LONG:  # words as they stand, which pieces may cut
                found.update(n for w in WORDS.findall(token.lower()) for n in self.names(w))
            got = self.seen[token] = tuple(self.numbered(found))
        return got

    def numbered(self, names: Iterable[str]) -> list[int]:
        if self.known is None:
            return [self.numbers.setdefault(n, len(self.numbers)) for n in names]
        return [self.known[n] for n in names if n in self.known]

    def features(self, text: str) -> set[int]:
        out: set[int] = set()
        for got in map(self.token, set(text.split())):
            if got:
                out.update(got)
        for m in SPACED.finditer(text):
            run = m.group()
            if len({c for c in run.lower() if c.isalnum()}) < 2:  # one letter over and over
                continue
            for at in range(0, len(run), 120):  # overlapping pieces of long runs
                part = run[max(0, at - 40) : at + 120]
                joined = "".join(WORDS.findall(part)).lower()
                for w in [*self.restorer.restore(part).split(), *self.restorer.restore(joined).split()]:
                    out.update(self.numbered(self.names(w)))
                if self.known is not None:
                    out.update(self.known[n] for n in self.whole if n in joined)
        return out


def learn(rows: list[tuple[np.ndarray, int]], names: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Features by name and their weights (the last is the offset) from numbers of names and labels."""
    y = np.array([t for _, t in rows], np.float64)
    n_pos, n_neg = y.sum(), len(y) - y.sum()
    pos, neg = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for found, t in rows:
        (pos if t else neg)[found] += 1
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    gain = {names[f]: odds[f] * math.sqrt(pos[f]) for f in np.flatnonzero((pos >= 4) & (odds > 1.5)).tolist()}
    known = {f: i for i, f in enumerate(sorted(gain, key=lambda f: (-gain[f], f))[:FEATURES])}
    place = np.full(len(names), -1)
    for number, name in enumerate(names):
        place[number] = known.get(name, -1)
    x = np.zeros((len(rows), len(known) + 1))
    x[:, -1] = 1
    for r, (found, _) in enumerate(rows):
        at = place[found]
        x[r, at[at >= 0]] = 1
    w = np.zeros(x.shape[1])
    w[-1] = math.log((n_pos + 1) / (n_neg + 1))
    ridge = np.full(len(w), 0.3)
    ridge[-1] = 1e-3
    for _ in range(12):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return known, w


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Iterator[tuple[str, int]]:
    """At most ``limit`` (text, toxic) of labelled documents that are not held out, one text at a time."""
    picked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    picked = picked.orderBy(md5_key("toxic", F.col("doc_id")), "doc_id", "toxic").limit(limit)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.col("text").isNotNull())  # at most ``limit`` rows are broadcast
    for r in found.orderBy("doc_id").select("text", "toxic").toLocalIterator():
        yield r["text"], int(r["toxic"])


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A NULL or empty text gets the score of a text without any feature.  Without labels the score is the
    prior of one label of each kind, 0.5, lowered to 0.499.  Rows that repeat a doc_id are scored each; an
    empty table gives no rows.
    """
    counts = trigram_counts(docs)
    reader = Reader(counts)
    rows = [(np.fromiter(reader.features(t), np.int32), y) for t, y in labelled_sample(docs, labels, limit)]
    known, w = learn(rows, list(reader.numbers))
    del reader, rows
    w[-1] = min(w[-1], math.log(0.499 / 0.501))
    model = docs.sparkSession.sparkContext.broadcast((counts.astype(np.float32), known, w))

    def run(batches):
        counts, known, w = model.value
        reader = Reader(counts, known)
        for b in pieces(batches):
            z = np.array([w[-1] + w[list(reader.features(t))].sum() if t else w[-1] for t in b.column("text").to_pylist()], np.float64)
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
