"""Simple directed cycles of length 3 to 7, met in the middle.

A cycle is found once, from its smallest vertex: a forward half that starts
there and a backward half that ends there meet on (root, middle). Halves have
at most four and three edges, all vertices beyond the root, and the ratio
check where it is asked for, so every join prunes as early as it can.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkgraph.functions.scalar import ratio_ok
from silkgraph.operators.cycle_kernel import cycles_kernel
from silkgraph.operators.graph import topo_prune
from silkgraph.sources.shared import materialize
from silkgraph.sources.transfers import clean_edges

LENGTHS = range(3, 8)
#: Edges that may be broadcast to the kernel.
KERNEL_EDGES = 10_000_000


def _forward(edges: DataFrame, k: int, ratio: bool) -> DataFrame:
    """``p0 .. pk, first, last``: paths of ``k`` edges whose first vertex is their smallest."""
    paths = edges.where("v > u").select(F.col("u").alias("p0"), F.col("v").alias("p1"), F.col("w").alias("first"), F.col("w").alias("last"))
    for i in range(1, k):
        step = edges.select(F.col("u").alias(f"p{i}"), F.col("v").alias(f"p{i + 1}"), F.col("w").alias("next"))
        new = F.col(f"p{i + 1}")
        cond = new > F.col("p0")
        for j in range(1, i):
            cond &= new != F.col(f"p{j}")
        if ratio:
            cond &= ratio_ok(F.col("last"), F.col("next"))
        paths = paths.join(step, f"p{i}").where(cond).select(*[f"p{j}" for j in range(i + 2)], "first", F.col("next").alias("last"))
    return paths


def _backward(edges: DataFrame, k: int, ratio: bool) -> DataFrame:
    """``q0 .. qk, b_first, b_last``: paths of ``k`` edges whose last vertex is their smallest."""
    paths = edges.where("u > v").select(F.col("u").alias(f"q{k - 1}"), F.col("v").alias(f"q{k}"), F.col("w").alias("b_first"), F.col("w").alias("b_last"))
    for i in range(k - 1, 0, -1):
        step = edges.select(F.col("u").alias(f"q{i - 1}"), F.col("v").alias(f"q{i}"), F.col("w").alias("prev"))
        new = F.col(f"q{i - 1}")
        cond = new > F.col(f"q{k}")
        for j in range(i + 1, k):
            cond &= new != F.col(f"q{j}")
        if ratio:
            cond &= ratio_ok(F.col("prev"), F.col("b_first"))
        paths = paths.join(step, f"q{i}").where(cond).select(*[f"q{j}" for j in range(i - 1, k + 1)], F.col("prev").alias("b_first"), "b_last")
    return paths


def _meet(forward: DataFrame, backward: DataFrame, a: int, b: int, ratio: bool) -> DataFrame:
    other = backward.select(F.col("q0").alias(f"p{a}"), F.col(f"q{b}").alias("p0"), *[F.col(f"q{j}").alias(f"p{a + j}") for j in range(1, b)], "b_first", "b_last")
    cond = F.lit(True)
    for j in range(1, b):
        for i in range(1, a):
            cond &= F.col(f"p{a + j}") != F.col(f"p{i}")
    if ratio:
        cond &= ratio_ok(F.col("last"), F.col("b_first")) & ratio_ok(F.col("b_last"), F.col("first"))
    return forward.join(other, ["p0", f"p{a}"]).where(cond).select(F.lit(a + b).alias("len"), F.array(*[f"p{i}" for i in range(a + b)]).alias("path"))


def prepared(edges: DataFrame, ratio: bool) -> DataFrame:
    """What cycles can consist of: no self-loops, one edge for a pair, no dead ends; with ``ratio`` no zero amounts."""
    return topo_prune(clean_edges(edges, positive=ratio))


def cycles(edges: DataFrame, lengths=LENGTHS, ratio: bool = False, pruned: bool = False, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """``len, path``: every simple cycle of the lengths, once, its smallest vertex first.

    With ``ratio`` each transfer's amount must be able to follow the one
    before, around the end as well. ``pruned`` says ``edges`` come from
    :func:`prepared`. With at most ``kernel_edges`` edges the kernel finds
    them; beyond that joins do, and halves that several lengths use are
    written once.
    """
    lengths = sorted(set(lengths))
    if not lengths or lengths[0] < 3 or lengths[-1] > 7:
        raise ValueError("cycles have 3 to 7 edges")
    e = edges if pruned else materialize(clean_edges(edges, positive=ratio), "cycle-edges")
    if e.count() <= kernel_edges:
        return cycles_kernel(e, lengths, ratio)
    e = e if pruned else topo_prune(e)
    shared = len(lengths) > 1
    keep = lambda df, tag: materialize(df, tag) if shared else df
    fore: dict[int, DataFrame] = {}
    back: dict[int, DataFrame] = {}
    out = []
    for n in lengths:
        b = n // 2
        a = n - b
        fore.setdefault(a, keep(_forward(e, a, ratio), "forward"))
        back.setdefault(b, keep(_backward(e, b, ratio), "backward"))
        out.append(_meet(fore[a], back[b], a, b, ratio))
    return reduce(DataFrame.unionByName, out)


def cycle_counts(found: DataFrame) -> DataFrame:
    """``len, n``: cycles by length, and in all (``len`` 0)."""
    return found.rollup("len").agg(F.count("*").alias("n")).select(F.coalesce("len", F.lit(0)).alias("len"), "n")
