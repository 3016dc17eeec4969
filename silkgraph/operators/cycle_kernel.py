"""Simple cycles over broadcast arrays: tasks take roots, and no path is shuffled or written.

As in the joins of :mod:`silkgraph.operators.cycles`, a forward and a backward
half meet on (root, middle). The backward halves of some roots are held and
sorted; forward halves are walked in pieces, and their last step only goes to
vertices where a backward half of the root begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Roots that are walked together, candidates of a step or a meeting (one row's at least), and backward halves that are held.
ROOTS, PIECE, HELD = 256, 1 << 20, 1 << 21
#: Places of the table that says where backward halves begin.
PLACES = 1 << 20

Csr = tuple[np.ndarray, np.ndarray, np.ndarray]


class Halves(NamedTuple):
    """Paths from roots (``cols[0]``) to tips (``cols[-1]``), with the amounts at both ends."""

    cols: list[np.ndarray]
    root_w: np.ndarray
    tip_w: np.ndarray

    def take(self, at: np.ndarray | slice) -> Halves:
        return Halves([c[at] for c in self.cols], self.root_w[at], self.tip_w[at])


def can_follow(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x <= 5 * y) & (y <= 3 * x)


def by_first(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> Csr:
    order = np.argsort(u, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n))]), v[order], w[order]


class Graph:
    """Edges by their first vertex, and ``back`` by their last; vertices are numbered in order of their ids. Dead ends are removed."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        self.ids, n = np.unique(u), -1
        while len(self.ids) != n:
            n = len(self.ids)
            keep = np.isin(u, self.ids)
            keep &= np.isin(v, self.ids)
            if not keep.all():
                u, v, w = u[keep], v[keep], w[keep]
            self.ids = np.intersect1d(u, v)
        self.n = len(self.ids)
        small = np.int32 if not len(w) or int(w.max()) < 1 << 28 else np.int64
        self.ahead = by_first(np.searchsorted(self.ids, u).astype(np.int32), np.searchsorted(self.ids, v).astype(np.int32), w.astype(small), self.n)

    @classmethod
    def of(cls, edges: DataFrame) -> Graph:
        """Edges ``u, v, w`` whose ends are not null; columns that fit are sent with half their width."""
        ends = edges.select(F.min(F.least("u", "v", "w")).alias("least"), F.max(F.greatest("u", "v")).alias("id"), F.max("w").alias("w")).first()
        kind = lambda x: "int" if x is not None and x < 1 << 31 and ends["least"] > -(1 << 31) else "long"
        rows = edges.select(F.col("u").cast(kind(ends["id"])), F.col("v").cast(kind(ends["id"])), F.coalesce("w", F.lit(0)).cast(kind(ends["w"])).alias("w")).toArrow()
        columns = []
        for c in ("u", "v", "w"):  # a column at a time, as the driver's memory is small
            columns.append(rows[c].to_numpy())
            rows = rows.drop_columns(c)
        return cls(*columns)

    @cached_property
    def back(self) -> Csr:
        head, to, w = self.ahead
        return by_first(to, np.repeat(np.arange(self.n, dtype=np.int32), np.diff(head)), w, self.n)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "back"}


def pieces(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``PIECE`` candidates in all, or one row."""
    total, at = np.cumsum(counts), 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(total, PIECE + (total[at - 1] if at else 0), side="right")))
        yield at, end
        at = end


def spread(begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the place of each of ``counts`` places from ``begin`` on."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) + (begin - np.cumsum(counts) + counts)[row]


def starts(csr: Csr, roots: np.ndarray) -> Halves:
    head, to, w = csr
    row, at = spread(head[roots], head[roots + 1] - head[roots])
    keep = to[at] > roots[row]
    row, at = row[keep], at[keep]
    return Halves([roots[row], to[at]], w[at], w[at])


def walked(csr: Csr, halves: Halves, steps: int, ratio: bool, ahead: bool, table: np.ndarray | None) -> Iterator[Halves]:
    """``halves`` that go on for so many steps, in pieces; at the end only those whose place in ``table`` is marked."""
    if not len(halves.root_w):
        return
    if not steps:
        yield halves if table is None else halves.take(table[places(halves.cols[0], halves.cols[-1])])
        return
    head, to, w = csr
    tip = halves.cols[-1]
    begin, counts = head[tip], head[tip + 1] - head[tip]
    for i, j in pieces(counts):
        row, at = spread(begin[i:j], counts[i:j])
        part = halves.take(slice(i, j))
        new, root = to[at], part.cols[0][row]
        ok = new > root
        if table is not None and steps == 1:
            ok &= table[places(root, new)]
        row, at, new = row[ok], at[ok], new[ok]
        ok = np.ones(len(row), bool)
        if ratio:
            x, y = part.tip_w[row], w[at]
            ok = can_follow(x, y) if ahead else can_follow(y, x)
        for c in part.cols[1:-1]:
            ok &= new != c[row]
        row, at, new = row[ok], at[ok], new[ok]
        longer = Halves([*(c[row] for c in part.cols), new], part.root_w[row], w[at])
        yield from walked(csr, longer, steps - 1, ratio, ahead, None if steps == 1 else table)


def places(root: np.ndarray, tip: np.ndarray) -> np.ndarray:
    return (root.astype(np.int64) * 0x9E3779B1 + tip) & (PLACES - 1)


def blocks(found: Iterator[Halves]) -> Iterator[Halves]:
    """Halves together, up to ``HELD`` and a piece."""
    held, size = [], 0
    join = lambda: Halves([np.concatenate(c) for c in zip(*(h.cols for h in held), strict=True)], np.concatenate([h.root_w for h in held]), np.concatenate([h.tip_w for h in held]))
    for h in found:
        held.append(h)
        size += len(h.root_w)
        if size >= HELD:
            yield join()
            held, size = [], 0
    if size:
        yield join()


def met(graph: Graph, fore: Halves, back: Halves, keys: np.ndarray, ratio: bool) -> Iterator[list[np.ndarray]]:
    """Columns of the cycles that ``fore`` and ``back`` (in order of ``keys``) make."""
    own = fore.cols[0].astype(np.int64) * graph.n + fore.cols[-1]
    begin = np.searchsorted(keys, own)
    counts = np.searchsorted(keys, own, side="right") - begin
    for i, j in pieces(counts):
        row, at = spread(begin[i:j], counts[i:j])
        row += i
        if ratio:
            ok = can_follow(fore.tip_w[row], back.tip_w[at]) & can_follow(back.root_w[at], fore.root_w[row])
            row, at = row[ok], at[ok]
        ok = np.ones(len(row), bool)
        for q in back.cols[1:-1]:
            for p in fore.cols[1:-1]:
                ok &= q[at] != p[row]
        row, at = row[ok], at[ok]
        if len(row):
            yield [*(c[row] for c in fore.cols), *(c[at] for c in reversed(back.cols[1:-1]))]


def rooted(graph: Graph, roots: np.ndarray, n: int, ratio: bool) -> Iterator[list[np.ndarray]]:
    """Columns of the cycles of ``n`` edges whose smallest vertices are ``roots``."""
    b = n // 2
    for back in blocks(walked(graph.back, starts(graph.back, roots), b - 1, ratio, False, None)):
        keys = back.cols[0].astype(np.int64) * graph.n + back.cols[-1]
        order = np.argsort(keys)
        back, keys = back.take(order), keys[order]
        table = np.zeros(PLACES, bool)
        table[places(back.cols[0], back.cols[-1])] = True
        for fore in walked(graph.ahead, starts(graph.ahead, np.unique(back.cols[0])), n - b - 1, ratio, True, table):
            yield from met(graph, fore, back, keys, ratio)


def cycles_kernel(edges: DataFrame, lengths: list[int], ratio: bool) -> DataFrame:
    """``len, path`` as by :func:`silkgraph.operators.cycles.cycles`; ``edges`` have no self-loops and one row for a pair."""
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(Graph.of(edges))
    tasks = spark.sparkContext.defaultParallelism * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for batch in batches:
            for task in batch["id"].to_pylist():
                roots = np.arange(task, graph.n, tasks, dtype=np.int32)  # small roots have the most paths
                for i in range(0, len(roots), ROOTS):
                    for n in lengths:
                        for cols in rooted(graph, roots[i : i + ROOTS], n, ratio):
                            m = len(cols[0])
                            paths = pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, n), pa.int32()), pa.array(graph.ids[np.stack(cols, axis=1).ravel()].astype(np.int64)))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, n), pa.int32()), paths], names=["len", "path"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "len int, path array<long>")
