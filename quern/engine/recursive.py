"""Fixpoints for recursive queries, with or without duplicate removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quern.sources.stage import stage

MAX_ROUNDS = 1_000
MAX_ROWS = 1_000_000


class RecursionLimit(RuntimeError):
    """More rounds or rows than a recursive query may take."""


def fixpoint(anchor: DataFrame, term: Callable[[DataFrame], DataFrame], distinct: bool, max_rounds: int = MAX_ROUNDS, max_rows: int = MAX_ROWS) -> DataFrame:
    """anchor UNION [ALL] term, where ``term`` maps the rows that the last round added to new rows.

    Every round is written to the shared folder, so lineage stays short and a lost executor re-reads
    files.  With ``distinct`` a round keeps only rows that no earlier round had.
    """
    new = stage(anchor.distinct() if distinct else anchor, "recursion")
    done, total = new, new.count()
    for _ in range(max_rounds):
        rows = term(new).toDF(*anchor.columns)
        if distinct:
            rows = rows.subtract(done)
        new = stage(rows.select([rows[c].cast(k) for c, k in anchor.dtypes]), "recursion")
        n = new.count()
        if not n:
            return done
        total += n
        if total > max_rows:
            raise RecursionLimit(f"a recursive query gave over {max_rows} rows")
        done = done.union(new)
    raise RecursionLimit(f"a recursive query took over {max_rounds} rounds")
