"""Registry of the named queries; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkgraph.functions import scalar
from silkgraph.functions.ranking import global_rank
from silkgraph.operators import classify, components, cycles, generate, graph, shortest
from silkgraph.plans.oracle import ORACLES
from silkgraph.sources import leaderboard, sinks
from silkgraph.sources import transfers as src

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def on_edges(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(src.transfers(spark, sf))


def on_pruned(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(graph.topo_prune(src.transfers(spark, sf)))


def on_features(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(src.features(spark, sf))


def as_text(found: DataFrame) -> DataFrame:
    return found.select("len", F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"))


def cycle_query(lengths, ratio: bool, edges=src.transfers) -> Query:
    return lambda spark, sf: as_text(cycles.cycles(edges(spark, sf), lengths, ratio))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    lines = sinks.cycle_report(cycles.cycles(src.transfers(spark, sf), ratio=True))
    return global_rank(lines, F.col("len"), F.col("path"), name="row").select(F.col("row").cast("int").alias("row"), "line")


def _sp_counts(spark: SparkSession, sf: str) -> DataFrame:
    edges = src.transfers_whole(spark, sf).where("u <> v")
    return shortest.path_counts(edges, sources=edges.select(F.col("u").alias("id"))).select("s", "v", "dist", F.round("sigma", 3).alias("sigma"))


def _sp_counts_all(spark: SparkSession, sf: str) -> DataFrame:
    counts = shortest.path_counts(src.transfers_multi(spark, sf).where("u <> v"))
    return counts.select("s", "v", "dist", F.round("sigma", 3).alias("sigma"))


def _array_products(rows: DataFrame) -> DataFrame:
    """Matrix helpers on the first six features as two rows of three, and the scalar functions beside them."""
    x = F.transform(F.slice("x", 1, 6), lambda v: F.round(v * 100).cast("int").cast("double"))
    m = F.array(F.slice("a", 1, 3), F.slice("a", 4, 3))
    flat = lambda c: F.concat_ws(",", F.transform(F.flatten(c), lambda v: v.cast("long").cast("string")))
    a, first = F.col("a"), F.col("a")[0].cast("long")
    return rows.select("row_id", x.alias("a")).select(
        "row_id", F.concat_ws(",", F.transform(scalar.mat_vec(m, F.slice(a, 1, 3)), lambda v: v.cast("long").cast("string"))).alias("product"), flat(scalar.outer(F.slice(a, 1, 2), F.slice(a, 3, 2))).alias("outer"),
        flat(scalar.transpose(m)).alias("transposed"), flat(scalar.mat_mul(m, scalar.transpose(m))).alias("squared"), scalar.bit_length(first).cast("int").alias("bits"), F.round(scalar.root(first), 6).alias("root"),
    )


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    return leaderboard.flatten(leaderboard.sample_documents(spark, sf)).withColumn("users", F.array_join("users", " "))


QUERIES: dict[str, Query] = {
    "transfers_scan": src.transfers_multi,
    "transfers_filtered": src.transfers,
    "transfers_in_id_range": lambda spark, sf: src.in_id_range(src.transfers_multi(spark, sf), 1000),
    "transfers_without_zero": lambda spark, sf: src.clean_edges(src.transfers_raw(spark, sf), positive=True),
    "vertex_set": on_edges(graph.vertex_set),
    "degrees": on_edges(graph.degrees),
    "twohop_cardinality": on_edges(graph.twohop_cardinality),
    "graph_profile": on_edges(graph.graph_profile),
    "vertex_dense_rank": on_edges(graph.vertex_dense_rank),
    "csr_offsets": on_edges(graph.csr_offsets),
    "topo_prune": on_edges(graph.topo_prune),
    "two_hop_paths": on_pruned(graph.two_hop_paths),
    "two_hop_ratio": on_pruned(lambda e: graph.two_hop_paths(e, ratio=True)),
    "reverse_reach_3": on_pruned(graph.reverse_reach),
    **{f"cycles_len{n}": cycle_query([n], False) for n in range(3, 8)},
    **{f"ratio_cycles_len{n}": cycle_query([n], True) for n in range(3, 8)},
    "ratio_cycles_all": cycle_query(range(3, 8), True),
    "cycle_counts": on_edges(lambda e: cycles.cycle_counts(cycles.cycles(e))),
    "ratio_cycle_counts": on_edges(lambda e: cycles.cycle_counts(cycles.cycles(e, ratio=True))),
    "cycle_report": _report,
    "flow_cycles_len4": cycle_query([3, 4], True, src.transfers_flow),
    **{f"flow_cycles_len{n}": cycle_query([n], True, src.transfers_flow) for n in range(5, 8)},
    "flow_plain_cycles": cycle_query(range(3, 6), False, src.transfers_flow),
    "weak_components": on_edges(components.weak_components),
    "component_sizes": on_edges(components.component_sizes),
    "scc_labels": on_edges(components.strong_components),
    "scc_condensed_degree": on_edges(components.condensed_degrees),
    "sssp_from_1": lambda spark, sf: shortest.sssp(src.transfers_multi(spark, sf), 1),
    "reachable_counts": on_edges(shortest.reachable_counts),
    "sp_counts": _sp_counts,
    "sp_counts_all": _sp_counts_all,
    "betweenness_top100": lambda spark, sf: shortest.top_central(shortest.betweenness(src.transfers_whole(spark, sf).where("u <> v"))),
    "contracted_sources": on_edges(lambda e: graph.contracted_sources(e.select(F.col("v").alias("u"), F.col("u").alias("v")))),
    "centroids": on_features(classify.centroids),
    "centroid_predict": on_features(lambda f: classify.centroid_predict(f, f)),
    "centroid_shortcut_predict": on_features(lambda f: classify.centroid_predict(f, f, shortcut=True)),
    "centroid_l1_predict": on_features(lambda f: classify.centroid_l1_predict(f, f)),
    "linear_quantile_predict": on_features(lambda f: classify.linear_quantile_predict(f, f)),
    "signed_sum_predict": on_features(lambda f: classify.signed_sum_predict(f, f).select("row_id", "pred")),
    "nb_predict": on_features(lambda f: classify.nb_predict(f, f).select("row_id", "pred")),
    "predict_accuracy": on_features(lambda f: classify.accuracy(classify.centroid_predict(f, f), f)),
    "confusion": on_features(lambda f: classify.confusion(classify.centroid_predict(f, f), f)),
    "zscore_stats": on_features(classify.zscore_stats),
    "array_products": on_features(_array_products),
    "sgd_predict": on_features(lambda f: classify.sgd_predict(f, f)),
    "zscore_sgd_predict": on_features(lambda f: classify.zscore_sgd_predict(f, f)),
    "logreg_predict": on_features(lambda f: classify.logreg_predict(f, f)),
    "leaderboard_flatten": _flat,
    "gen_planted": lambda spark, sf: generate.planted_components(spark),
    "gen_small_world": lambda spark, sf: generate.small_world(spark),
    "gen_clique": lambda spark, sf: generate.tree_with_cliques(spark),
    "gen_features": lambda spark, sf: generate.labelled_features(spark),
}
