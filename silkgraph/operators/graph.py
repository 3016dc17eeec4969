"""Relational building blocks on an edge table ``u, v, w``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkgraph.functions.ranking import exclusive_sum, global_rank
from silkgraph.functions.scalar import ratio_ok
from silkgraph.sources.shared import materialize, remove


def vertex_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``id, out_deg, in_deg``; one shuffle, parallel edges count."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("o")), F.struct(F.col("v").alias("id"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("out_deg"), F.sum(1 - F.col("o")).alias("in_deg"))


def twohop_cardinality(edges: DataFrame) -> DataFrame:
    """``id, n_two``: two-hop walks that start at each source, counted from degrees alone."""
    out = edges.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("d"))
    return edges.join(out, "v").groupBy(F.col("u").alias("id")).agg(F.sum("d").alias("n_two"))


def graph_profile(edges: DataFrame) -> DataFrame:
    """One row of statistics for choosing a strategy."""
    n = vertex_set(edges).agg(F.count("*").alias("n_vertices"))
    stats = edges.agg(F.count("*").alias("n_edges"), F.max("w").alias("max_w"), F.sum("w").alias("sum_w"), F.count_distinct("u").alias("n_sources"), F.count_distinct("v").alias("n_targets"))
    return stats.crossJoin(n).withColumn("sparse", F.col("n_edges") <= 10 * F.col("n_vertices"))  # a row each


def vertex_dense_rank(edges: DataFrame) -> DataFrame:
    """``id, rank``: vertices numbered from 0 in order of their ids."""
    return global_rank(vertex_set(edges), F.col("id"))


def csr_offsets(edges: DataFrame) -> DataFrame:
    """``id, deg, offset``: where the out-edges of each vertex would start in an array sorted by source."""
    return exclusive_sum(degrees(edges).select("id", F.col("out_deg").alias("deg")), "deg", F.col("id"))


def topo_prune(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Edges that are left when vertices without incoming or outgoing edges are removed until none is left.

    Two semi-joins a round on key columns alone; every round is written, so
    plans stay short.
    """
    e = materialize(edges, "prune")
    n = e.count()
    for _ in range(max_rounds):
        last, e = e, materialize(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select(*edges.columns), "prune")
        remove(last)
        m = e.count()
        if m == n:
            return e
        n = m
    raise RuntimeError(f"edges still fall off after {max_rounds} rounds")


def two_hop_paths(edges: DataFrame, ratio: bool = False) -> DataFrame:
    """``u, m, v, w1, w2`` with ``u <> v``; with ``ratio`` both amounts must be able to follow one another."""
    a = edges.select("u", F.col("v").alias("m"), F.col("w").alias("w1"))
    b = edges.select(F.col("u").alias("m"), "v", F.col("w").alias("w2"))
    cond = (F.col("u") != F.col("v")) & (ratio_ok(F.col("w1"), F.col("w2")) if ratio else F.lit(True))
    return a.join(b, "m").where(cond).select("u", "m", "v", "w1", "w2")


def reverse_reach(edges: DataFrame, hops: int = 3) -> DataFrame:
    """``root, id, hops``: vertices larger than the root from which it is reached in so few hops."""
    step = edges.where("u <> v").select(F.col("u").alias("id"), F.col("v").alias("to")).distinct()
    level = step.where("id > to").select(F.col("to").alias("root"), "id")
    found = level.withColumn("hops", F.lit(1))
    for k in range(2, hops + 1):
        level = level.select("root", F.col("id").alias("to")).join(step, "to").where("id > root").select("root", "id").distinct()
        found = found.unionByName(level.withColumn("hops", F.lit(k)))
    return found.groupBy("root", "id").agg(F.min("hops").alias("hops"))


def contracted_sources(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``id, label``: sources of one out-edge in the acyclic prefix of the graph, and how many sources fold into each.

    Peels vertices without incoming edges; one of those with a single out-edge
    passes its label plus one on to its successor.
    """
    e = materialize(edges.select("u", "v"), "peel")
    labels: DataFrame | None = None
    carried = e.sparkSession.createDataFrame([], "id long, label long")
    for _ in range(max_rounds):
        heads = e.select(F.col("u").alias("id")).distinct().join(e.select(F.col("v").alias("id")).distinct(), "id", "left_anti")
        out = e.join(heads, e.u == heads.id, "left_semi").groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d"), F.max("v").alias("to"))
        own = out.join(carried, "id", "left").select("id", "d", "to", F.coalesce("label", F.lit(0)).cast("long").alias("label"))
        round_ = materialize(own, "heads")
        if round_.isEmpty():
            break
        single = round_.where("d = 1").select("id", "label")
        labels = single if labels is None else labels.unionByName(single)
        passed = round_.where("d = 1").groupBy(F.col("to").alias("id")).agg(F.sum(F.col("label") + 1).alias("label"))
        carried = materialize(carried.unionByName(passed).groupBy("id").agg(F.sum("label").alias("label")), "carried")
        e = materialize(e.join(round_.select(F.col("id").alias("u")), "u", "left_anti").select("u", "v"), "peel")
    return labels if labels is not None else carried
