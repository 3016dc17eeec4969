"""Shortest paths, path counts and betweenness centrality.

Two ways with one result. Where the graph passes a size check, its arrays are
broadcast and every task makes the runs of its own sources (``path_kernel``), so
work spreads over sources and a row per vertex and task is summed. Beyond it,
distances, path counts and dependencies are fixed points of joins and grouped
aggregates over (source, vertex) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkgraph.operators.graph import vertex_set
from silkgraph.operators.path_kernel import BLOCK_HEADS, Run, Shared, common, share
from silkgraph.operators.rounds import least_values
from silkgraph.sources.shared import materialize, remove

#: Edges between vertices with edges out that may be broadcast to the kernel; ten times as many in all.
KERNEL_EDGES = 10_000_000
MAX_ROUNDS = 10_000
MANY = 1 << 60
#: Rows that a kernel gathers before it hands them on.
BATCH_ROWS = 50_000


def _spread(sources: DataFrame) -> DataFrame:
    """``sources`` dealt out to several tasks for each core, as runs differ in length."""
    return sources.repartition(sources.sparkSession.sparkContext.defaultParallelism * 4)


def sssp(edges: DataFrame, source: int, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``v, dist`` of every vertex that ``source`` reaches; a round relaxes the edges of vertices that came nearer."""
    start = edges.sparkSession.createDataFrame([(source, 0)], "v long, dist long")
    return _relaxed(edges, start, ["v"], max_rounds)


def all_distances(edges: DataFrame, max_rounds: int = MAX_ROUNDS, sources: DataFrame | None = None) -> DataFrame:
    """``s, v, dist`` from all vertices, or from those of ``sources`` (``id``); a row per reached pair."""
    ids = vertex_set(edges) if sources is None else sources.select("id").distinct()
    start = ids.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).cast("long").alias("dist"))
    return _relaxed(edges, start, ["s", "v"], max_rounds)


def _relaxed(edges: DataFrame, start: DataFrame, keys: list[str], max_rounds: int) -> DataFrame:
    e = materialize(edges.groupBy("u", "v").agg(F.min("w").alias("w")), "sp-edges").withColumnRenamed("v", "to")
    others = [k for k in keys if k != "v"]
    expand = lambda front: front.join(e, front.v == e.u).select(*others, F.col("to").alias("v"), (F.col("dist") + F.col("w")).alias("dist"))
    return materialize(least_values(start, expand, keys, "dist", max_rounds), "dist")


def reachable_counts(edges: DataFrame, sources: DataFrame | None = None, max_rounds: int = MAX_ROUNDS, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """``id, n_reached``: other vertices that each vertex, or each of ``sources`` (``id``), reaches.

    The kernel counts and writes no pairs, and vertices that reach the same of
    the core are counted once a task; ``kernel_edges`` as in :func:`share`, beyond
    it joins.
    """
    hops = materialize(edges.select("u", "v", F.lit(1).cast("long").alias("w")), "hops")
    graph = share(hops, kernel_edges)
    if graph is None:
        return all_distances(hops.distinct(), max_rounds, sources).groupBy(F.col("s").alias("id")).agg((F.count("*") - 1).alias("n_reached"))
    remove(hops)
    ids = graph.vertices() if sources is None else sources.select(F.col("id").cast("long").alias("id")).distinct()
    tasks, shared_outer = graph.tasks(), edges.sparkSession.sparkContext.broadcast(graph.outer)

    def count(block: list[int]) -> dict[int, int]:
        """Of some heads, what each reaches, itself included."""
        heads, of, reached = tasks.heads, {}, {}
        for s in block:
            begin = np.array([s]) if heads.level[s] else heads.core_reached(s)
            of[s] = begin.tobytes()
            if of[s] not in reached:
                reached[of[s]] = heads.reach(begin)
        n = {k: len(r) for k, r in reached.items()}
        for chunk in tasks.chunks():
            for k, r in reached.items():
                n[k] += len(chunk.reached(common(r, chunk.heads)[1]))
        return {s: n[of[s]] for s in block}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, outer = tasks.heads, shared_outer.value
        plain = heads.inner == 0
        for batch in batches:
            ids_ = batch["id"].to_pylist()
            at = [-1 if x is None else heads.number(x) for x in ids_]
            n = {-1: 0} | {s: int(outer[s]) for s in at if s >= 0 and plain[s]}
            todo = [s for s in dict.fromkeys(at) if s not in n]
            while todo:
                block, size = [], 0
                while todo and size < BLOCK_HEADS:
                    block.append(s := todo.pop())
                    size += heads.n
                n |= {s: k - 1 for s, k in count(block).items()}
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([n[s] for s in at], pa.int64())], names=["id", "n_reached"])

    return _spread(ids).mapInArrow(run, "id long, n_reached long")


def _tight(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """``s, u, v, m``: edges on shortest paths; parallel ones count."""
    e = edges.groupBy("u", "v", "w").agg(F.count("*").alias("m"))
    a = dist.select("s", F.col("v").alias("u"), F.col("dist").alias("du"))
    b = dist.select("s", "v", F.col("dist").alias("dv"))
    return a.join(e, "u").join(b, ["s", "v"]).where("du + w = dv").groupBy("s", "u", "v").agg(F.sum("m").alias("m"))


def _accumulate(start: DataFrame, step, keys: list[str], max_rounds: int) -> DataFrame:
    """Sum of the rounds of a linear iteration that ends, over rows ``*keys, c``."""
    front = materialize(start, "round")
    parts = [front]
    for _ in range(max_rounds):
        front = materialize(step(front), "round")
        if front.isEmpty():
            break
        parts.append(front)
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return materialize(total.groupBy(*keys).agg(F.sum("c").alias("c")), "total")


def path_counts(edges: DataFrame, max_rounds: int = MAX_ROUNDS, sources: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """``s, v, dist, sigma``: distances and numbers of shortest paths (amounts are positive) from all vertices, or from ``sources`` (``id``).

    The kernel hands on the rows of a block of runs, those to the same vertices
    together; ``kernel_edges`` as in :func:`share`, beyond it joins.
    """
    edges = materialize(edges.select("u", "v", "w"), "sp-all")
    graph = share(edges, kernel_edges) if edges.where("w is null or w <= 0").isEmpty() else None
    if graph is None:
        return _path_counts_joins(edges, max_rounds, sources)
    remove(edges)
    ids = graph.vertices() if sources is None else sources.select(F.col("id").cast("long").alias("id")).distinct()
    tasks, names = graph.tasks(), ["s", "v", "dist", "sigma"]

    def rows(block: list[Run]) -> Iterator[list[np.ndarray]]:
        heads = tasks.heads
        source = lambda r, n: np.full(n, heads.ids[r.source])
        for r in block:
            yield [source(r, len(r.reached)), heads.ids[r.reached], r.dist, r.sigma]
        for chunk in tasks.chunks():
            parts, size = [], 0
            for r in block:
                mine, its = common(r.reached, chunk.heads)
                if not len(mine):
                    continue
                found, dist, paths, _ = chunk.relax(its, r.dist[mine], r.sigma[mine])
                parts.append([source(r, len(found)), found, dist, paths])
                size += len(found)
                if size >= 10 * BATCH_ROWS:
                    yield _together(parts, chunk.targets)
                    parts, size = [], 0
            if parts:
                yield _together(parts, chunk.targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _gathered(_blocks(batches, tasks, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return _spread(ids).mapInArrow(run, "s long, v long, dist long, sigma double")


def _together(parts: list[list[np.ndarray]], targets: np.ndarray) -> list[np.ndarray]:
    """Rows of several runs, those to the same target side by side, which files hold in less room."""
    s, v, dist, sigma = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(v, kind="stable") if len(parts) > 1 else slice(None)
    return [s[order], targets[v[order]], dist[order], sigma[order]]


def _blocks(batches: Iterator[pa.RecordBatch], tasks, rows) -> Iterator[list[np.ndarray]]:
    """``rows`` of blocks of runs from the ids of ``batches``; a vertex without edges out has its own row alone."""
    block, size = [], 0
    for batch in batches:
        alone = []
        for id_ in batch["id"].to_pylist():
            if id_ is None:
                continue
            if (s := tasks.heads.number(id_)) < 0:
                alone.append(id_)
                continue
            block.append(tasks.heads.run(s))
            size += len(block[-1].reached) + 100
            if size >= BLOCK_HEADS:
                yield from rows(block)
                block, size = [], 0
        if alone:
            yield [np.array(alone), np.array(alone), np.zeros(len(alone), np.int64), np.ones(len(alone))]
    if block:
        yield from rows(block)


def _gathered(parts: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """The same rows, at least ``BATCH_ROWS`` at a time."""
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p[0])
        if size >= BATCH_ROWS:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _path_counts_joins(edges: DataFrame, max_rounds: int, sources: DataFrame | None) -> DataFrame:
    dist = all_distances(edges, max_rounds, sources)
    dag = materialize(_tight(edges, dist), "dag")
    start = dist.where("s = v").select("s", "v", F.lit(1.0).alias("c"))
    step = lambda f: f.withColumnRenamed("v", "u").join(dag, ["s", "u"]).groupBy("s", "v").agg(F.sum(F.col("c") * F.col("m")).alias("c"))
    return dist.join(_accumulate(start, step, ["s", "v"], max_rounds), ["s", "v"]).select("s", "v", "dist", F.col("c").alias("sigma"))


def betweenness_joins(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``id, bc`` by joins and aggregates."""
    counts = materialize(_path_counts_joins(edges, max_rounds, None), "sigma")
    dag = _tight(edges, counts.select("s", "v", "dist"))
    a = counts.select("s", F.col("v").alias("u"), F.col("sigma").alias("su"))
    b = counts.select("s", "v", F.col("sigma").alias("sv"))
    x = materialize(dag.join(a, ["s", "u"]).join(b, ["s", "v"]).select("s", "u", "v", (F.col("m") * F.col("su") / F.col("sv")).alias("x")), "share")
    start = x.groupBy("s", F.col("u").alias("v")).agg(F.sum("x").alias("c"))
    step = lambda f: f.join(x, ["s", "v"]).groupBy("s", "u").agg(F.sum(F.col("c") * F.col("x")).alias("c")).withColumnRenamed("u", "v")
    delta = _accumulate(start, step, ["s", "v"], max_rounds)
    sums = delta.where("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum("c").alias("bc"))
    return vertex_set(edges).join(sums, "id", "left").select("id", F.coalesce("bc", F.lit(0.0)).alias("bc"))


def folded_sources(n: int, u: np.ndarray, v: np.ndarray, m: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``label, into``: sources folded into each of ``n`` vertices with edges out, and the one that it folds into itself (-1 for none), from the edges between them and the number of edges to others.

    Vertices that no cycle leads to are peeled in order; one of them with a
    single edge out has the shortest paths of its successor, so it needs no
    run of its own.
    """
    order = np.argsort(u, kind="stable")
    head, to, m = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n))]), v[order], m[order]
    waits, label, into = np.bincount(to, minlength=n), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    ready = np.flatnonzero(waits == 0).tolist()
    while ready:
        x = ready.pop()
        out = to[head[x] : head[x + 1]]
        if len(out) == 1 and not outer[x] and m[head[x]] == 1:
            into[x] = out[0]
            label[out[0]] += label[x] + 1
        for y in out.tolist():
            waits[y] -= 1
            if not waits[y]:
                ready.append(y)
    return label, into


def betweenness_kernel(edges: DataFrame, fold: bool = True) -> DataFrame:
    """``id, bc`` by single-source runs over broadcast arrays, from the vertices with edges to others that have edges out.

    With ``fold``, vertices of :func:`folded_sources` have no runs: those of
    the vertex they fold into count for them, and what the chain between adds
    is a product of counts.
    """
    return _betweenness_runs(share(edges, MANY), fold)


def _betweenness_runs(graph: Shared, fold: bool = True) -> DataFrame:
    spark, n = graph.packed.sparkSession, graph.heads.n
    label, into = folded_sources(n, *graph.between, graph.outer) if fold else (np.zeros(n, np.int64), np.full(n, -1, np.int64))
    chained = np.flatnonzero((into >= 0) & (label > 0))
    chained = chained[np.argsort(into[chained], kind="stable")]
    tasks, shared = graph.tasks(), spark.sparkContext.broadcast((label, chained, into[chained]))

    def follow(s: int, reached: int, total: np.ndarray) -> None:
        label, chained, chained_to = shared.value
        chain = [(s, reached)]
        while chain:
            x, reached = chain.pop()
            for i in range(np.searchsorted(chained_to, x), np.searchsorted(chained_to, x, side="right")):
                y = int(chained[i])
                total[y] += int(label[y]) * (reached + 1)
                chain.append((y, reached + 1))

    def add(block: list[Run], total: np.ndarray) -> None:
        heads, label = tasks.heads, shared.value[0]
        others = [len(r.reached) - 1 for r in block]
        for chunk in tasks.chunks():
            for i, r in enumerate(block):
                mine, its = common(r.reached, chunk.heads)
                if not len(mine):
                    continue
                found, _, paths, (begin, place, m) = chunk.relax(its, r.dist[mine], r.sigma[mine])
                others[i] += len(found)
                r.x[mine] += np.bincount(begin, m / paths[place], len(mine))  # a sink hands on 1 / its paths for each path
        for r, n_others in zip(block, others, strict=True):
            times = int(label[r.source])
            before = total[r.source]
            total[r.reached] += (1 + times) * heads.dependencies(r)
            total[r.source] = before + times * n_others
            follow(r.source, n_others, total)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads = tasks.heads
        total, block, size = np.zeros(heads.n), [], 0
        for pdf in batches:
            for s in pdf["id"].tolist():
                block.append(heads.run(s))
                size += len(block[-1].reached) + 100
                if size >= BLOCK_HEADS:
                    add(block, total)
                    block, size = [], 0
        add(block, total)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": heads.ids[some], "bc": total[some]})

    own = np.flatnonzero((into < 0) & ((graph.heads.inner > 0) | (label > 0)))
    sums = graph.vertices().select("id", F.lit(0.0).alias("bc"))
    if len(own):
        sums = sums.union(_spread(spark.createDataFrame(pd.DataFrame({"id": own}), "id long")).mapInPandas(run, "id long, bc double"))
    return sums.groupBy("id").agg(F.sum("bc").alias("bc"))


def betweenness(edges: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """``id, bc``: unnormalised directed betweenness; amounts are positive, parallel shortest edges count.

    The kernel within ``kernel_edges``, as in :func:`share`, else joins.
    """
    positive = materialize(edges.where("w > 0").select("u", "v", "w"), "bc-edges")
    graph = share(positive, kernel_edges)
    if graph is None:
        return betweenness_joins(positive)
    remove(positive)
    return _betweenness_runs(graph)


def top_central(scores: DataFrame, n: int = 100) -> DataFrame:
    """At most ``n`` rows by ``round(bc, 3)`` descending, then id."""
    return scores.select("id", F.round("bc", 3).alias("bc")).orderBy(F.desc("bc"), "id").limit(n)
