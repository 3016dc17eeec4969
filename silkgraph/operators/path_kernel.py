"""Single-source runs over broadcast arrays.

Vertices without edges out, the sinks, can be most of a graph. Their edges are
dealt by their ids into chunks, packed by tasks and broadcast one by one, so
neither the driver nor a task holds all of them. The other vertices, the heads,
are peeled from their end: vertices whose edges all go to peeled ones are a
level. A run is Dijkstra's algorithm in the core that is left, then a step of
arrays for each level and each chunk of sinks.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkgraph.sources.shared import materialize, remove

#: Edges of a chunk of sinks, about.
CHUNK_EDGES = 1_000_000
#: Levels that are peeled at most; the rest is core.
LEVELS = 64
#: Bytes of chunks up to which a task keeps them all.
KEPT_BYTES = 100_000_000
#: Different sets of reached core vertices that a task remembers.
KNOWN_SETS = 100
#: Sets of begins whose targets a chunk remembers.
SEEN = 4
#: Reached heads that a task holds of a block of runs.
BLOCK_HEADS = 1_000_000
FAR_INT = 1 << 62
FAR = np.int64(FAR_INT)


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if not len(x) or -(1 << 31) <= x.min() and x.max() < 1 << 31 else x


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``begin[0] .. begin[0] + n[0] - 1, begin[1] ..``"""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + n, n)


def least_edges(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``u, v, w, m``: of parallel edges the least, and their number."""
    order = np.lexsort((w, u, v))
    u, v, w = u[order], v[order], w[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(first)
    pair = np.cumsum(first) - 1
    m = np.bincount(pair[w == w[at][pair]], minlength=len(at)) if len(at) else np.zeros(0, np.int64)
    return u[at], v[at], w[at], m


class Chunk:
    """Edges into some vertices, ``targets``, none of which is among their begins, ``heads``.

    Targets are in order of their numbers of edges, most first; layer k has the
    k-th least edge of each target that has so many, so a layer's targets are
    the first ones.
    """

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, m: np.ndarray):
        ids, inverse, n = np.unique(v, return_inverse=True, return_counts=True)
        rank = np.argsort(-n, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[rank] = np.arange(len(ids))
        self.targets, n, target = ids[rank], n[rank], place[inverse]
        order = np.lexsort((w, target))
        k = np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)  # place among its target's edges
        order = order[np.argsort(k, kind="stable")]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(k))]) if len(u) else np.zeros(1, np.int64)
        self.heads, head = np.unique(u[order], return_inverse=True)
        self.head = head.astype(np.uint16 if len(self.heads) < 1 << 16 else np.int32)
        self.w, self.m = narrow(w[order]), None if (m == 1).all() else narrow(m[order])
        self.heads = narrow(self.heads)
        self.by_head, self.seen = None, {}

    def _by_head(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges in order of their begins, and where each begin's start."""
        if self.by_head is None:
            self.by_head = np.argsort(self.head, kind="stable").astype(np.int32), np.concatenate([[0], np.cumsum(self.degrees())])
        return self.by_head

    def _edges(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the (local) ``heads``, and the place in ``heads`` of each."""
        order, start = self._by_head()
        n = start[heads + 1] - start[heads]
        return order[ranges(start[heads], n)], np.repeat(np.arange(len(heads)), n)

    def few(self, heads: np.ndarray) -> bool:
        """Whether the (local) ``heads`` have a small part of the edges."""
        start = self._by_head()[1]
        return 8 * int((start[heads + 1] - start[heads]).sum()) < len(self.head)

    def target_of(self, edges: np.ndarray) -> np.ndarray:
        return edges - self.at[np.searchsorted(self.at, edges, side="right") - 1]

    def degrees(self) -> np.ndarray:
        return np.bincount(self.head, minlength=len(self.heads))

    def relax(self, heads: np.ndarray, dist: np.ndarray, sigma: np.ndarray) -> tuple:
        """From the (local) ``heads`` with their distances and numbers of paths: targets reached, their distances and numbers of paths, and the edges on shortest paths as (place in ``heads``, place in the targets reached, ``m``)."""
        if not len(heads):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(float), (none, none, none)
        if self.few(heads):
            edges, begin = self._edges(heads)
            far = dist[begin] + self.w[edges]
            found, place = np.unique(self.target_of(edges), return_inverse=True)
            best = np.full(len(found), FAR)
            np.minimum.at(best, place, far)
            tight = far == best[place]
            edges, begin, place = edges[tight], begin[tight], place[tight]
        else:
            where = np.zeros(len(self.heads), np.int64)
            where[heads] = np.arange(len(heads))
            local = np.full(len(self.heads), FAR)
            local[heads] = dist
            n, k = int(self.at[1]), min(len(heads) - 1, len(heads) // 64 + 1)
            near = np.argpartition(dist, k)  # the edges of the nearest begins come first, so that the others are bounded well
            edges, begin = self._edges(heads[near[:k]])
            place, far, near, nearest = self.target_of(edges), dist[near[:k]][begin] + self.w[edges], dist[near[k]], heads[near[:k]]
            best = np.full(n, FAR)
            np.minimum.at(best, place, far)
            local[nearest] = FAR
            kept, active = [(edges, place, far)], self.reached(heads)  # others would stay to the last layer
            for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True):
                active = active[: np.searchsorted(active, b - a)]
                w = self.w[a + active]
                may = w + near <= best[active]  # later edges are longer, and what is known gets no worse
                active, w = active[may], w[may]
                if not len(active):
                    break
                far = local[self.head[a + active]] + w
                better = far <= best[active]
                some, far = active[better], far[better]
                best[some] = far
                kept.append((a + some, some, far))
            edges, place, far = (np.concatenate(c) for c in zip(*kept, strict=True))
            tight = (far == best[place]) & (far < FAR)
            edges, place = edges[tight], place[tight]
            begin = where[self.head[edges]]
            found = np.flatnonzero(best < FAR)
            best = best[found]
            if len(found) < n:
                number = np.zeros(n, np.int64)
                number[found] = np.arange(len(found))
                place = number[place]
        m = np.ones(len(edges), np.int64) if self.m is None else self.m[edges]
        return found, best, np.bincount(place, sigma[begin] * m, len(found)), (begin, place, m)

    def reached(self, heads: np.ndarray) -> np.ndarray:
        """Targets that edges of the (local) ``heads`` lead to."""
        if len(heads) == len(self.heads):
            return np.arange(len(self.targets))
        if not len(heads):
            return np.zeros(0, np.int64)
        if self.few(heads):
            return np.unique(self.target_of(self._edges(heads)[0]))
        if (key := heads.tobytes()) not in self.seen:
            while len(self.seen) >= SEEN:
                self.seen.pop(next(iter(self.seen)))
            self.seen[key] = self._reached(heads)
        return self.seen[key]

    def _reached(self, heads: np.ndarray) -> np.ndarray:
        local = np.zeros(len(self.heads), bool)
        local[heads] = True
        seen = local[self.head[: self.at[1]]]
        waiting = np.flatnonzero(~seen)
        for a, b in zip(self.at[1:-1].tolist(), self.at[2:].tolist(), strict=True):
            waiting = waiting[: np.searchsorted(waiting, b - a)]
            hit = local[self.head[a + waiting]]
            seen[waiting[hit]] = True
            waiting = waiting[~hit]
            if not len(waiting):
                break
        return np.flatnonzero(seen)


def common(some: np.ndarray, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal values in two sorted arrays of different values."""
    if len(some) > len(all_):
        return common(all_, some)[::-1]
    at = np.searchsorted(all_, some)
    at[at == len(all_)] = 0
    hit = all_[at] == some if len(all_) else np.zeros(len(some), bool)
    return np.flatnonzero(hit), at[hit]


class Run:
    """What a run reached among the heads, in order of their numbers, and the edges on shortest paths between them: of the core in order of their ends' distances, then of each level, as places in ``reached``."""

    __slots__ = ("core", "dist", "levels", "reached", "sigma", "source", "x")


class Heads:
    """Vertices with edges out, numbered in order of their ids, and the edges between them."""

    def __init__(self, ids: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, m: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.inner = np.bincount(u, minlength=self.n)
        level, left = np.zeros(self.n, np.int32), np.ones(len(u), bool)
        rest = np.ones(self.n, bool)
        for k in range(1, LEVELS):
            peeled = rest & (np.bincount(u[left], minlength=self.n) == 0)
            if not peeled.any():
                break
            level[peeled] = k
            rest &= ~peeled
            left &= rest[v]
        self.level = level
        self.chunks = [Chunk(u[s], v[s], w[s], m[s]) for k in range(int(level.max(initial=0)), 0, -1) if (s := level[v] == k).any()]
        self.core = np.flatnonzero(level == 0)
        s = level[v] == 0
        a, b = np.searchsorted(self.core, u[s]), np.searchsorted(self.core, v[s])
        order = np.lexsort((w[s], a))
        self.to, self.w, self.m = narrow(b[order]), narrow(w[s][order]), narrow(m[s][order])
        self.start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(self.core)))])
        self.lists = None

    def number(self, id_: int) -> int:
        """Place of a vertex with edges out; -1 for others."""
        at = int(np.searchsorted(self.ids, id_))
        return at if at < self.n and self.ids[at] == id_ else -1

    def _adjacent(self) -> list:
        if self.lists is None:
            self.lists, self.known, self.sets = [None] * len(self.core), {}, {}
            self.dense = np.full(self.n, FAR), np.zeros(self.n)
        return self.lists

    def _core_run(self, s: int) -> tuple[list, list]:
        """Core vertices that ``s`` reaches in order, and their distances.

        Where a vertex on the way is in the strong component of ``s`` and had a
        run itself, nothing is farther than it and what it reaches.
        """
        lists, dist, order, far, most = self._adjacent(), {s: 0}, [], [], FAR_INT
        heap, done, get, push = [(0, s)], set(), dist.get, heapq.heappush
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            order.append(x)
            far.append(d)
            if x in self.known:
                reached, farthest = self.known[x]
                if d + farthest < most and s in reached:
                    most = d + farthest
            if (edges := lists[x]) is None:
                a, b = self.start[x], self.start[x + 1]
                edges = lists[x] = list(zip(self.to[a:b].tolist(), self.w[a:b].tolist(), strict=True))
            for y, w in edges:
                new = d + w
                if new > most:
                    break  # the next ones are longer
                if new < get(y, FAR_INT):
                    dist[y] = new
                    push(heap, (new, y))
        if len(self.sets) < KNOWN_SETS:
            done = frozenset(done)
            self.known[s] = self.sets.setdefault(done, done), far[-1]
        return order, far

    def run(self, source: int) -> Run:
        """Shortest paths from the head ``source`` to heads."""
        self._adjacent()
        dist, sigma = self.dense
        found, edges, core = [np.array([source])], [], []
        if self.level[source]:
            dist[source], sigma[source] = 0, 1
        else:
            order, far = self._core_run(int(np.searchsorted(self.core, source)))
            order = np.array(order)
            found = [self.core[order]]
            dist[found[0]] = far
            n = self.start[order + 1] - self.start[order]
            at = ranges(self.start[order], n)
            u, v = self.core[np.repeat(order, n)], self.core[self.to[at]]
            tight = np.flatnonzero(dist[u] + self.w[at] == dist[v])
            tight = tight[np.argsort(dist[v[tight]], kind="stable")]
            core = [u[tight], v[tight], self.m[at[tight]]]
            count = {source: 1.0}
            for x, y, m in zip(*(c.tolist() for c in core), strict=True):
                count[y] = count.get(y, 0.0) + count[x] * m
            sigma[found[0]] = [count[x] for x in found[0].tolist()]
        for chunk in self.chunks:
            at = np.flatnonzero(dist[chunk.heads] < FAR)
            heads = chunk.heads[at]
            new, far, paths, (begin, end, m) = chunk.relax(at, dist[heads], sigma[heads])
            new = chunk.targets[new]
            dist[new], sigma[new] = far, paths
            found.append(new)
            edges.append((heads[begin], new[end], m))
        run = Run()
        run.source, run.reached = source, np.sort(np.concatenate(found))
        run.dist, run.sigma = dist[run.reached], sigma[run.reached]
        place = lambda e: (np.searchsorted(run.reached, e[0]), np.searchsorted(run.reached, e[1]), e[2])
        run.core, run.levels = place(core) if core else None, [place(e) for e in edges if len(e[0])]
        run.x = np.zeros(len(run.reached))
        dist[run.reached], sigma[run.reached] = FAR, 0
        return run

    def dependencies(self, run: Run) -> np.ndarray:
        """Of ``source`` on each head reached, when ``run.x`` has the sums of ``m / paths`` over edges to sinks."""
        x, sigma = run.x, run.sigma
        for begin, end, m in reversed(run.levels):
            x += np.bincount(begin, m * (1 / sigma[end] + x[end]), len(x))
        if run.core:
            found, paths = x.tolist(), sigma.tolist()
            for u, v, m in zip(*(c[::-1].tolist() for c in run.core), strict=True):
                found[u] += m * (1 / paths[v] + found[v])
            x = np.array(found)
        return x * sigma

    def core_reached(self, source: int) -> np.ndarray:
        """Core vertices that the core vertex ``source`` reaches, as heads in order."""
        self._adjacent()
        s = int(np.searchsorted(self.core, source))
        seen = np.zeros(len(self.core), bool)
        seen[s] = True
        front = np.array([s])
        while len(front):
            n = self.start[front + 1] - self.start[front]
            front = np.unique(self.to[ranges(self.start[front], n)])
            front = front[~seen[front]]
            seen[front] = True
        return self.core[seen]

    def reach(self, begin: np.ndarray) -> np.ndarray:
        """Heads that the heads ``begin`` (all core, or one of a level) reach through levels, themselves included."""
        seen = np.zeros(self.n, bool)
        seen[begin] = True
        for chunk in self.chunks:
            seen[chunk.targets[chunk.reached(np.flatnonzero(seen[chunk.heads]))]] = True
        return np.flatnonzero(seen)


class Shared:
    """A graph for tasks: ``heads``, the edges ``between`` them (``u, v, m``), the number of sinks next to each (``outer``), ``chunks`` of sinks, and ``packed``, whose ``ids`` are all sinks."""

    def __init__(self, heads: Heads, between: tuple, chunks: list, keep: bool, outer: np.ndarray, packed: DataFrame):
        self.heads, self.between, self.outer, self.packed = heads, between, outer, packed
        self.shared = packed.sparkSession.sparkContext.broadcast(heads)
        self.chunks, self.keep = chunks, keep

    def tasks(self) -> Tasks:
        return Tasks(self.shared, self.chunks, self.keep)

    def vertices(self) -> DataFrame:
        """``id`` of every vertex."""
        spark = self.packed.sparkSession
        heads = spark.createDataFrame(pa.table({"id": self.heads.ids})) if self.heads.n else spark.range(0)
        return heads.union(self.packed.select(F.explode("ids").alias("id")))


class Tasks:
    """The part of :class:`Shared` that tasks read."""

    def __init__(self, shared, chunks: list, keep: bool):
        self.shared, self.shared_chunks, self.keep = shared, chunks, keep

    @property
    def heads(self) -> Heads:
        return self.shared.value

    def chunks(self) -> Iterator[Chunk]:
        for c in self.shared_chunks:
            yield c.value
            if not self.keep:
                c.__dict__.pop("_value", None)  # the file stays


def share(edges: DataFrame, kernel_edges: int) -> Shared | None:
    """The arrays of ``edges``, or None if there are more than ``kernel_edges`` between heads, or ten times as many in all."""
    n_edges = edges.count()
    if n_edges > 10 * kernel_edges:
        return None
    context = edges.sparkSession.sparkContext
    edges = edges.select(*[F.col(c).cast("long").alias(c) for c in ("u", "v", "w")]).where("u is not null and v is not null")
    ids = np.sort(edges.select("u").distinct().toArrow()["u"].to_numpy())
    known = context.broadcast(ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[b[c].to_numpy() for b in batches_] for batches_ in [list(batches)] for c in ("u", "v", "w")]
        if not sum(map(len, columns[0])):
            return
        u, v, w, m = least_edges(*(np.concatenate(c) for c in columns))
        del columns
        u = np.searchsorted(known.value, u)
        at = np.searchsorted(known.value, v)
        at[at == len(known.value)] = 0
        inner = known.value[at] == v
        chunk = Chunk(u[~inner], v[~inner], w[~inner], m[~inner])
        between = tuple(narrow(c[inner]) for c in (u, at, w, m))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(chunk.targets)], pa.int32()), pa.array(chunk.targets)), pa.array([pickle.dumps(chunk) if len(chunk.head) else None], pa.binary()), pa.array([int(inner.sum())], pa.int64()), pa.array([pickle.dumps(between)], pa.binary())], names=["ids", "chunk", "n", "edges"])

    dealt = edges.repartitionByRange(max(1, -(-n_edges // CHUNK_EDGES)), "v")
    packed = materialize(dealt.mapInArrow(pack, "ids array<long>, chunk binary, n long, edges binary"), "packed")
    if (packed.agg(F.sum("n")).first()[0] or 0) > kernel_edges:
        remove(packed)
        return None
    parts = [pickle.loads(r[0]) for r in packed.select("edges").toLocalIterator()]
    between = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
    del parts
    heads = Heads(ids, *between)
    outer, chunks, held = np.zeros(heads.n, np.int64), [], 0
    for r in packed.where("chunk is not null").select("chunk").toLocalIterator():  # one at a time
        chunk = pickle.loads(r[0])
        held += len(r[0])
        outer[chunk.heads] += chunk.degrees()
        chunks.append(context.broadcast(chunk))
        chunks[-1].__dict__.pop("_value", None)
    u, v, _, m = between
    return Shared(heads, (u, v, m), chunks, held <= KEPT_BYTES, outer, packed)
