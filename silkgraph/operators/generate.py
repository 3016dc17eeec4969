"""Synthetic graphs and features. Equal parameters give equal rows, in any layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(n: int, *keys) -> Column:
    """A number from 0 to ``n - 1`` that depends on the keys only."""
    return F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys]), F.lit(n)).cast("long")


def planted_components(spark: SparkSession, vertices: int = 28_500, edges: int = 280_000, blocks: int = 2, bridges: int = 16, seed: int = 1) -> DataFrame:
    """Distinct random edges within blocks, and bridges between their first vertices; amounts 5 to 300."""
    size = vertices // blocks
    i = F.col("id")
    within = spark.range(edges).select((draw(size, seed, 1, i) + size * (i % blocks)).alias("u"), (draw(size, seed, 2, i) + size * (i % blocks)).alias("v"))
    across = spark.range(bridges).select((i % size).alias("u"), (size * (1 + i % max(1, blocks - 1)) + draw(size, seed, 3, i)).alias("v")) if blocks > 1 else within.limit(0)
    return within.unionByName(across).where("u <> v").distinct().withColumn("w", 5 + draw(296, seed, F.col("u"), F.col("v")))


def small_world(spark: SparkSession, n: int = 30_000, k: int = 10, rewire: float = 0.5, seed: int = 1) -> DataFrame:
    """A ring with ``k`` neighbours, ends rewired with the given chance, in both directions; amounts 5 to 300."""
    ring = spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("j"))
    move = draw(1_000_000, seed, 4, F.col("u"), F.col("j")) < int(rewire * 1_000_000)
    half = ring.select("u", F.when(move, draw(n, seed, 5, F.col("u"), F.col("j"))).otherwise((F.col("u") + F.col("j")) % n).alias("v")).where("u <> v")
    return half.unionByName(half.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().withColumn("w", 5 + draw(296, seed, F.col("u"), F.col("v")))


def tree_with_cliques(spark: SparkSession, edges: int = 280_000, cliques: tuple[int, ...] = (12, 13, 12), band: int = 1000, w: int = 123_123, seed: int = 1) -> DataFrame:
    """A random tree, dense cliques on its first vertices and random edges within a band of ids; one amount."""
    n = max(2, edges // 10)
    tree = spark.range(1, n).select(draw(1 << 40, seed, 6, F.col("id")).alias("r"), F.col("id").alias("v")).select((F.col("r") % F.col("v")).alias("u"), "v")
    parts, start = [tree], 0
    for size in cliques:
        ids = F.sequence(F.lit(start).cast("long"), F.lit(start + size - 1).cast("long"))
        parts.append(spark.range(start, start + size).select(F.col("id").alias("u"), F.explode(ids).alias("v")))
        start += size
    left = max(0, edges - n - sum(c * (c - 1) for c in cliques))
    parts.append(spark.range(left).select(draw(n, seed, 7, F.col("id")).alias("u"), draw(band, seed, 8, F.col("id")).alias("d")).select("u", (F.col("u") + F.col("d") + 1).alias("v")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("u <> v").distinct().withColumn("w", F.lit(w).cast("long"))


def labelled_features(spark: SparkSession, rows: int = 80_000, dims: int = 1000, share: float = 0.33, seed: int = 1) -> DataFrame:
    """``row_id, x, label``: thousandths from 0 to 0.999; label 1 above a threshold on a hidden linear score.

    The threshold is the score's approximate quantile under its normal limit.
    """
    x = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), j), F.lit(1000)) / 1000.0)
    w = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: F.pmod(F.xxhash64(F.lit(seed + 1), j), F.lit(2001)) / 1000.0 - 1)
    scored = spark.range(rows).select(F.col("id").alias("row_id"), x.alias("x"), w.alias("w")).withColumn("s", F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    cut = scored.approxQuantile("s", [share], 0.001)[0]
    return scored.select("row_id", "x", (F.col("s") > cut).cast("int").alias("label"))
