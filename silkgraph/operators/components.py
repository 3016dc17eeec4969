"""Connected components of undirected and directed graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkgraph.sources.shared import materialize, remove

MAX_ROUNDS = 60


def _print(edges: DataFrame) -> tuple:
    """Fingerprint of an edge set, to see whether a round changed it."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first())


def star_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``id, component``: the smallest id that links reach, for every id in ``edges``.

    Alternates large-star and small-star steps until the edges are stars
    around the smallest ids. Steps are aggregates and equi-joins; a hub's rows
    are those of a join with one row per key, which Spark can split. Rows with
    a null end are ignored.
    """
    ids = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    ids = materialize(ids, "links")  # read twice, and dear to make again
    alone = ids.where("u = v").select(F.col("u").alias("id"))
    e = materialize(ids.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _print(e)
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, e = e, materialize(small.where("u <> v").distinct(), "edges")
        remove(last)
        now = _print(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")))
    return found.unionByName(alone.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def weak_components(edges: DataFrame) -> DataFrame:
    """``id, component`` ignoring directions; loops alone count as vertices."""
    return star_components(edges)


def component_sizes(edges: DataFrame) -> DataFrame:
    """``component, n_vertices, n_edges, sum_w`` of each weak component."""
    labels = materialize(weak_components(edges), "labels")
    v = labels.groupBy("component").agg(F.count("*").alias("n_vertices"))
    e = edges.join(labels, F.col("u") == F.col("id")).groupBy("component").agg(F.count("*").alias("n_edges"), F.sum("w").alias("sum_w"))
    return v.join(e, "component", "left").select("component", "n_vertices", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("sum_w", F.lit(0)).alias("sum_w"))


def _spread_max(e: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, color``: the largest id that reaches each vertex within ``e``.

    A round follows edges and then jumps: what reaches a vertex's colour
    reaches the vertex too. So colours travel twice as far with every round,
    and a long path takes a number of rounds that is logarithmic in its length
    where ids have no order along it.
    """
    color = materialize(ids.select("id", F.col("id").alias("color")), "color")
    while True:
        sent = color.join(e, color.id == e.u).groupBy(e.v.alias("id")).agg(F.max("color").alias("got"))
        step = color.join(sent, "id", "left").select("id", F.col("color").alias("was"), F.greatest("color", F.coalesce("got", "color")).alias("color"))
        jump = step.join(color.select(F.col("id").alias("color"), F.col("color").alias("far")), "color", "left")
        last, color = color, materialize(jump.select("id", F.greatest("color", F.coalesce("far", "color")).alias("color"), "was"), "color")
        remove(last)
        if color.where("color > was").isEmpty():
            return color.select("id", "color")


#: Rounds that take off vertices without incoming or outgoing edges before colours are spread.
TRIMS = 3


def strong_components(edges: DataFrame) -> DataFrame:
    """``id, scc``: the smallest id of each vertex's strongly connected component.

    Vertices get a scattered number (a one-to-one hash of their id). Every
    vertex takes the largest number that reaches it as its colour; those of a
    colour that also reach it are a component. Edges between colours lie in no
    component and go, and the rest of each colour goes on. Because numbers are
    scattered, paths fall apart like a random search tree: rounds are
    logarithmic in their length, not proportional to it.
    """
    all_ids = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    e = materialize(edges.where("u <> v").select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v")).distinct(), "scc")
    found: DataFrame | None = None
    n = e.count()
    while n:
        for _ in range(TRIMS):
            e = materialize(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"), "scc")
            m, n = n, e.count()
            if m == n:
                break
        if not n:
            break
        color = materialize(_spread_max(e, e.select(F.col("u").alias("id")).union(e.select("v")).distinct()), "colors")
        cu, cv = color.select(F.col("id").alias("u"), F.col("color").alias("cu")), color.select(F.col("id").alias("v"), F.col("color").alias("cv"))
        inside = materialize(e.join(cu, "u").join(cv, "v").where("cu = cv").select("u", "v"), "inside")
        back = _spread_max(inside.select(F.col("v").alias("u"), F.col("u").alias("v")), color.select("id"))
        done = materialize(color.join(back.withColumnRenamed("color", "back"), "id").where("color = back").select(F.col("id").alias("p"), "color"), "done")
        found = done if found is None else found.unionByName(done)
        gone = done.select(F.col("p").alias("id"))
        e = materialize(inside.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v"), "scc")
        n = e.count()
    if found is None:
        return all_ids.select("id", F.col("id").alias("scc"))
    own = all_ids.withColumn("p", F.xxhash64("id")).join(found, "p", "left")
    own = materialize(own.select("id", F.coalesce("color", "p").alias("color")), "scc-colors")
    return own.join(own.groupBy("color").agg(F.min("id").alias("scc")), "color").select("id", "scc")


def condensed_degrees(edges: DataFrame) -> DataFrame:
    """``scc, size, in_deg, out_deg``: components and the distinct edges between them."""
    labels = materialize(strong_components(edges), "scc-labels")
    between = edges.select("u", "v").join(labels.select(F.col("id").alias("u"), F.col("scc").alias("a")), "u").join(labels.select(F.col("id").alias("v"), F.col("scc").alias("b")), "v")
    links = materialize(between.where("a <> b").select("a", "b").distinct(), "condensed")
    size = labels.groupBy("scc").agg(F.count("*").alias("size"))
    i, o = links.groupBy(F.col("b").alias("scc")).agg(F.count("*").alias("in_deg")), links.groupBy(F.col("a").alias("scc")).agg(F.count("*").alias("out_deg"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return size.join(i, "scc", "left").join(o, "scc", "left").select("scc", "size", zero("in_deg"), zero("out_deg"))
