"""Global ranks and running sums without a one-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silkgraph.sources.shared import materialize


def _offsets(ranged: DataFrame, value) -> DataFrame:
    """``__part, __before``: what ``value`` sums to in the partitions before; a row per partition."""
    parts = sorted((r["p"], r["n"]) for r in ranged.groupBy(F.shiftright("__at", 33).alias("p")).agg(value.alias("n")).collect())
    rows, total = [], 0
    for p, n in parts:
        rows.append((p, total))
        total += n
    return ranged.sparkSession.createDataFrame(rows or [(0, 0)], "__part long, __before long")


def _ranged(df: DataFrame, *order) -> DataFrame:
    return materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranged")


def global_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the order given. Range-sorted; only counts per partition meet."""
    ranged = _ranged(df, *order)
    placed = ranged.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(_offsets(ranged, F.count("*"))), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__before", "__at")


def exclusive_sum(df: DataFrame, value: str, *order, name: str = "offset") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows before, in the order given."""
    ranged = _ranged(df, *order)
    own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__part", F.shiftright("__at", 33)).withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    joined = placed.join(F.broadcast(_offsets(ranged, F.sum(value))), "__part")
    return joined.withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__part", "__before", "__at", "__own")
