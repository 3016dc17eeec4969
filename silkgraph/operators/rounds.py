"""Fixed points of joins and aggregates, round by round."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkgraph.sources.shared import materialize, remove

#: Rounds whose changes are kept apart before they are merged into one table.
MERGE = 8


def least_values(start: DataFrame, expand: Callable[[DataFrame], DataFrame], keys: list[str], value: str, max_rounds: int) -> DataFrame:
    """Least ``value`` of each key, from the rows ``start`` and what ``expand`` makes of rows that got better.

    A round reads what is known of the keys that it proposes alone, and writes
    the rows that got better alone; every ``MERGE`` rounds those are merged.
    """
    base, recent = materialize(start, "base"), []
    front = base
    known = lambda: reduce(DataFrame.unionByName, [base, *recent])
    best = lambda df: df.groupBy(*keys).agg(F.min(value).alias(value))
    for _ in range(max_rounds):
        tried = best(expand(front)).withColumnRenamed(value, "__new")
        old = best(known().join(tried.select(*keys), keys, "left_semi"))
        better = materialize(tried.join(old, keys, "left").where(F.col(value).isNull() | (F.col("__new") < F.col(value))).select(*keys, F.col("__new").alias(value)), "front")
        if better.isEmpty():
            remove(better)
            return best(known())
        recent.append(better)
        front = better
        if len(recent) == MERGE:
            merged = materialize(best(known()), "base")
            for t in [base, *recent[:-1]]:
                remove(t)
            base, recent = merged, []
    raise RuntimeError(f"values still fall after {max_rounds} rounds")
