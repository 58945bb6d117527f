"""Exact token counts at every prefix of a text, by dynamic programming.

A byte-level BPE text is cut into pieces that are encoded one by one.  For a piece, ``prefix_counts`` holds
the exact number of tokens of every byte prefix: the last token of a prefix is the one vocabulary entry
that ends there and whose pair with the last token of the prefix before it survives encoding, so
count[i] = count[i - length of that token] + 1.  A text's table has the sums at its piece starts; the
count at any character is one look-up and the few characters after the last but one piece start.  Hence
truncation to a budget and budget tests need no second encoding of the text.
"""

from __future__ import annotations

import json
from bisect import bisect_right

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quern.llm.batches import pieces as batch_pieces

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Piece pattern of the vocabulary's byte-level cutting; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE_PIECES = 1_000_000  # pieces, and pairs of tokens, that a worker remembers
END, STEP = -1, 1 << 32


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pieces(dict):
    """Number of tokens by piece, filled when asked."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, piece: str) -> int:
        if len(self) >= TABLE_PIECES:
            self.clear()
        n = self[piece] = self.count(piece.encode("utf-8"))[-1]
        return n


class PrefixTokens:
    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        back = byte_letters()
        raw = lambda t: bytes(back[c] for c in t)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        joined = {raw(a + b) for a, b in merges}
        single = [raw(t) for t in spec["model"]["vocab"] if t not in self.special]
        ranks = {t: i for i, t in enumerate(t for t in single if t not in joined)}
        for a, b in merges:
            ranks.setdefault(raw(a + b), len(ranks))
        self.pairs = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token = list(ranks)  # by rank
        #: byte -> node; under END the token (rank + 1) that ends at a node
        self.trie: dict = {}
        for t, i in ranks.items():
            node = self.trie
            for x in t:
                node = node.setdefault(x, {})
            node[END] = i + 1
        self.ends = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.stays: dict[int, bool] = {}
        self.table = Pieces(self.prefix_counts)

    def together(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (0: the start), that is, the two encode to themselves."""
        if len(self.stays) >= TABLE_PIECES:
            self.stays.clear()
        both = [a - 1, b - 1] if a else [b - 1]
        got = self.stays[a * STEP + b] = self.pairs._encode_single_piece(b"".join(self.token[t] for t in both)) == both
        return got

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for every i from 0."""
        n, stays = len(piece), self.stays
        counts, last = [0] * (n + 1), [0] * (n + 1)
        for start in range(n):
            node, base, count = self.trie, last[start] * STEP, counts[start] + 1
            for stop in range(start, n):
                node = node.get(piece[stop])
                if node is None:
                    break
                token = node.get(END)
                if token is not None and not counts[stop + 1]:  # one token fits at every end
                    fits = stays.get(base + token)
                    if fits is None:
                        fits = self.together(last[start], token)
                    if fits:
                        counts[stop + 1] = count
                        last[stop + 1] = token
        return counts

    def count(self, text: str) -> int:
        """Tokens of the whole text; strings of special tokens are one token each."""
        if self.cut and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        return sum(map(self.table.__getitem__, self.ends.findall(text)))

    def prefix_table(self, text: str) -> tuple[list[int], list[int]]:
        """Piece starts (and the text's end) in characters, and the tokens before each."""
        starts, counts = [0], [0]
        at = 0
        for part in self.cut.splititer(text) if self.cut else [text]:
            for m in self.ends.finditer(part):
                starts.append(at + m.end())
                counts.append(counts[-1] + self.table[m.group()])
            at += len(part)
            if at < len(text):
                at += len(self.cut.match(text, at).group())
                starts.append(at)
                counts.append(counts[-1] + 1)
        return starts, counts

    def count_at(self, text: str, table: tuple[list[int], list[int]], chars: int) -> int:
        """Tokens of text[:chars], from the table of the text."""
        starts, counts = table
        back = max(0, bisect_right(starts, min(chars, len(text))) - 3)
        return counts[back] + self.count(text[starts[back] : chars])

    def longest_prefix(self, text: str, budget: int) -> int:
        """The most characters whose prefix has at most ``budget`` tokens, among the piece starts and the characters after the last of them that fits."""
        table = starts, counts = self.prefix_table(text)
        at = starts[bisect_right(counts, budget) - 1]
        while at < len(text) and self.count_at(text, table, at + 1) <= budget:
            at += 1
        return at


_loaded: dict[str, PrefixTokens] = {}


def loaded(name: str) -> PrefixTokens:
    """The counter for a public vocabulary file, once for each worker."""
    if name not in _loaded:
        import public_tokenizers

        _loaded[name] = PrefixTokens(public_tokenizers.path(name))
    return _loaded[name]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; a NULL text counts as empty, with no tokens.

    One pass over the texts, without a shuffle; a worker remembers a bounded number of pieces.  Rows that
    repeat a doc_id are counted each; an empty table gives no rows.
    """

    def run(batches):
        counter = loaded(vocabulary)
        for b in batch_pieces(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
