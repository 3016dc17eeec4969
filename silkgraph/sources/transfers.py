"""Readers of transfer tables and of the text formats around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkgraph.functions.ranking import global_rank
from silkgraph.sources.shared import materialize


def read_transfers(spark: SparkSession, path: str, columns: tuple[str, ...] = ("u", "v", "w")) -> DataFrame:
    """Transfers from text lines ``source,target,amount`` (LF or CRLF); ids up to 2**32 - 1.

    Only the named columns are parsed; malformed lines are dropped.
    """
    return spark.read.csv(path, schema="u LONG, v LONG, w LONG", mode="DROPMALFORMED").select(*columns)


def read_weighted_graph(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """Edges, number of vertices and source of a text with the header ``N M s`` and lines ``u v c``."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).select(*[F.try_element_at("f", F.lit(i + 1)).cast("long").alias(c) for i, c in enumerate("uvw")])
    head = spark.read.text(path).limit(1).first()[0].split()
    n, m, source = map(int, head)
    edges = lines.where("u is not null and v is not null and w is not null")
    first = F.monotonically_increasing_id()
    return edges.withColumn("__i", first).where("__i > 0").drop("__i"), n, source


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, value``: the lines of a text, or of several in order of their names, numbered from 0.

    Nothing is shuffled: lines carry their file, the start of their split and
    their place in it, and only the splits' numbers of lines meet.
    """
    at = F.monotonically_increasing_id()
    lines = materialize(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at")), "lines")
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("least"), F.count("*").alias("n")).orderBy("file", "block").collect()  # a row per split
    before, total = [], 0
    for r in splits:
        before.append((r["file"], r["block"], total - r["least"]))
        total += r["n"]
    shift = F.broadcast(spark.createDataFrame(before, "file string, block long, shift long"))
    return lines.join(shift, ["file", "block"]).select((F.col("at") + F.col("shift")).alias("row_id"), "value")


def read_features(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """``row_id, x`` (and ``label``): lines of comma-separated decimals, the label last; ``row_id`` is the line's number from 0."""
    cells = numbered_lines(spark, path).select("row_id", F.split(F.trim("value"), ",").alias("c"))
    values = lambda c: F.transform(c, lambda x: x.cast("decimal(6,3)").cast("double"))
    if not labelled:
        return cells.select("row_id", values(F.col("c")).alias("x"))
    return cells.select("row_id", values(F.slice("c", F.lit(1), F.size("c") - 1)).alias("x"), F.element_at("c", -1).cast("int").alias("label"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def transfers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel transfers from suppliers to parts; the amount is what the discount leaves of a tenth, so some are zero."""
    rows = lineitem(spark, sf_dir).where("l_quantity <= 8")
    return rows.select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.greatest(F.lit(0).cast("long"), F.floor(F.col("l_quantity") - 100 * F.col("l_discount")).cast("long")).alias("w"))


def transfers_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel transfers from suppliers to parts, zero amounts dropped."""
    rows = lineitem(spark, sf_dir).where("l_quantity <= 8")
    return rows.select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.floor("l_extendedprice").cast("long").alias("w")).where("w > 0")


def transfers_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`transfers_multi`, from the rows of all quantities."""
    rows = lineitem(spark, sf_dir)
    return rows.select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.floor("l_extendedprice").cast("long").alias("w")).where("w > 0")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transfer for each pair of accounts, the largest; no self-loops."""
    rows = lineitem(spark, sf_dir).where("l_quantity <= 8 and l_suppkey <> l_partkey")
    return rows.groupBy(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).agg(F.max(F.floor("l_extendedprice").cast("long")).alias("w"))


def transfers_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the customer of each order to that of the next one in time; the largest amount for a pair."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    ranked = global_rank(orders, F.col("o_orderdate"), F.col("o_orderkey"))
    after = ranked.select((F.col("rank") - 1).alias("rank"), F.col("o_custkey").alias("v"))
    pairs = ranked.join(after, "rank").where("o_custkey <> v")
    return pairs.groupBy(F.col("o_custkey").alias("u"), "v").agg(F.max(F.floor("o_totalprice").cast("long")).alias("w"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, x, label``: embeddings, label 1 for the upper half of the classes."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") >= 5).cast("int").alias("label"))


def clean_edges(edges: DataFrame, positive: bool = False) -> DataFrame:
    """Without self-loops; of parallel transfers the largest; with ``positive`` zero amounts go first."""
    rows = edges.where("w > 0") if positive else edges
    return rows.where("u <> v").groupBy("u", "v").agg(F.max("w").alias("w"))


def in_id_range(edges: DataFrame, cap: int) -> DataFrame:
    """Edges with both ends below ``cap``; null ends fall out."""
    return edges.where((F.col("u") < cap) & (F.col("v") < cap))
