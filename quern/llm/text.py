"""Text measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One word: a run of anything but space and the ASCII white space controls.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of ``text`` as a long; a NULL text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of ``text`` in order; a NULL text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def md5_key(*parts: Column | str) -> Column:
    """A 60-bit number from the MD5 of the parts joined by ':' (NULL: 'null'), the same in any SQL engine."""
    shown = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *shown)), 1, 15), 16, 10).cast("long")


def text_key(text: Column) -> list[Column]:
    """Two longs, ka and kb: 128 bits of a text, by which rows are known whose result depends on the text alone."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("ka"), F.xxhash64(F.lit(1), text).alias("kb")]
