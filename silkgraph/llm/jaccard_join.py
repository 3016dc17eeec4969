"""Grouped prefix join on the Jaccard similarity of word shingles.

1. Shingles are counted over all documents in a fixed number of counters; the
   counts order the shingles, rare ones first (equal counts by hash).
2. A document's prefix is the part of its set, in that order, of which linked
   documents share something. Documents with the same prefix and size are one
   group, and only groups are posted under the shingles of the prefix.
3. A task reads the postings of a shingle in order of size and filters pairs
   of groups by size and by a parity sketch, whose Hamming distance never
   exceeds the symmetric difference. Pairs aren't written: groups that have a
   partner left join the cell of the first that such pairs reach.
4. Cells are expanded to their members, which sketches as wide as their sets
   filter again in the same way; cells that still share members unite. The texts of those that
   are left are verified with exact sets: every pair of a cell is compared, as
   differences from what most of the cell has in common, and a cell returns a
   forest of its links and the number of links of each member. Of cells of
   several blocks each text is read once, and its differences from one text of
   the cell stand for it in the pairs of blocks.
5. Connected components of the forests.

A shingle or a cell with very many rows is dealt into blocks, and every pair
of blocks is a task of its own, so neither memory nor a task's rows grow with
it. Equal sets are compared once, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silkgraph.llm.common import broadcast_if_small, materialize, table, text_blocks, unused, word_codes
from silkgraph.operators.components import star_components

#: Counters for the order of shingles, and rows they are sent in.
COUNTERS, CHUNK = 1 << 19, 1 << 13
#: 64-bit words of a sketch.
SKETCH = 4
#: Rows of a shingle or a cell that are filtered in one block, and shingles of a cell that are verified in one.
RUN, BLOCK_SHINGLES = 512, 250_000
#: Documents in cells whose ids may be broadcast, so that only their texts are shuffled.
BROADCAST_ROWS = 1_000_000
#: Words that a worker process remembers.
CACHE = 100_000
#: Bytes of text that are split and hashed together, that sets are held of, and pairs of rows that are filtered together (one text, one run at least).
SPLIT_BYTES, SET_BYTES, PAIRS = 2 << 20, 8 << 20, 1 << 20

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingles of texts."""

    known: dict[str, int] = {}  # of this worker process: place of a word's hash in values
    values = np.zeros(1 << 16, np.uint64)

    def __init__(self, k: int):
        self.k = k

    def hashes(self, words: list[str]) -> np.ndarray:
        cls = Shingler
        if len(cls.known) > CACHE:
            cls.known.clear()
        at = np.fromiter(map(cls.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            n = len(cls.known)
            if n + len(new) > len(cls.values):
                cls.values = np.concatenate([cls.values, np.zeros(max(len(cls.values), len(new)), np.uint64)])
            own = [words[i] for i in new]
            cls.values[n : n + len(new)] = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in own), np.uint64, len(own))
            at[new] = np.arange(n, n + len(new))
            cls.known.update(zip(own, at[new].tolist(), strict=True))
        return cls.values[at]

    def shingles(self, v: np.ndarray, k: int) -> np.ndarray:
        h = np.full(max(0, len(v) - k + 1), k, np.uint64)
        for i in range(k):
            h = mix(h * M1 + v[i : i + len(h)])
        return h

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The set of each text; words are split and hashed for a block of texts at a time."""
        for a, b in text_blocks(texts, SPLIT_BYTES):
            words, codes, begin = word_codes(pc.ascii_lower(texts[a:b]))
            v = self.hashes(words.to_numpy(zero_copy_only=False).tolist())[codes]
            h = self.shingles(v, self.k)
            for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                if j - i >= self.k:
                    yield np.unique(h[i : j - self.k + 1])
                else:
                    yield self.shingles(v[i:j], j - i) if j > i else np.zeros(0, np.uint64)


def shingle_levels(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Level of each counter (0 up to twice the mean, one more with each doubling), and whether it counted more than ``RUN`` shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total, held, size = Shingler(k), np.zeros(COUNTERS, np.int64), [], 0
        for batch in batches:
            for s in shingler.of(batch["text"]):
                held.append(s)
                size += len(s)
                if size > 1_000_000:
                    total += np.bincount((np.concatenate(held) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
                    held, size = [], 0
        if held:
            total += np.bincount((np.concatenate(held) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        part = TaskContext.get().partitionId() % 64  # partial sums; equal when a task is repeated
        chunks = COUNTERS // CHUNK
        n = pa.ListArray.from_arrays(pa.array(np.arange(0, COUNTERS + 1, CHUNK), pa.int32()), pa.array(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(chunks), pa.int32()), pa.array(np.full(chunks, part), pa.int32()), n], names=["chunk", "part", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["chunk"][:1], "n": [np.sum(np.stack(pdf["n"]), axis=0)]})

    rows = docs.select("text").mapInArrow(count, "chunk int, part int, n array<long>")
    some = rows.groupBy("chunk", "part").applyInPandas(add, "chunk int, n array<long>")
    total = np.zeros(COUNTERS, np.int64)
    for r in some.groupBy("chunk").applyInPandas(add, "chunk int, n array<long>").toLocalIterator():
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = r["n"]
    share = np.maximum(1.0, total / max(1.0, float(total.mean())))
    return np.floor(np.log2(share)).astype(np.uint8), total > RUN


def in_order(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles ``s``, rare ones first."""
    key = (levels[(s % np.uint64(COUNTERS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (mix(s) >> np.uint64(6))
    return s[np.argsort(key, kind="stable")]


def sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the shingles at each of ``bits`` places, in words of 64 bits."""
    at = ((mix(s ^ M1) >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(at, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_bits(n: int) -> int:
    """Places of the second sketch of a set of ``n``: the next power of two, but a least."""
    return max(64 * SKETCH, 1 << (n - 1).bit_length())


SET_COLS = "doc_id long, n int, lead long, stands int, s1 long, s2 long, p1 long, p2 long, prefix array<long>, often array<long>, wide binary, " + ", ".join(f"k{i} long" for i in range(SKETCH))


def sets(docs: DataFrame, k: int, num: int, den: int, levels: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Size, set hash, prefix (and which of its shingles may be ``often``) and sketch per row; of equal sets in a batch the smallest id ``stands`` for so many rows, and the others name it (``lead``)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    names = [c.split()[0] for c in SET_COLS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (levels, often) = Shingler(k), shared.value
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in text_blocks(whole["text"], SET_BYTES)):
            ids = batch["doc_id"].to_pylist()
            rows: list[list] = []
            same: dict[tuple, list[int]] = {}
            found: dict[int, np.ndarray] = {}
            for i, (doc_id, s) in enumerate(zip(ids, shingler.of(batch["text"]), strict=True)):
                n = len(s)
                rows.append([doc_id, n, *[None] * (len(names) - 2)])
                if not n or doc_id is None:
                    continue
                m = mix(s ^ M2)
                key = n, int(m.sum().view(np.int64)), int(mix(m).sum().view(np.int64))
                if key not in same:
                    same[key], found[i] = [], s
                same[key].append(i)
            for (n, s1, s2), at in same.items():
                s = found[at[0]]
                least = min(at, key=ids.__getitem__)
                for i in at:
                    rows[i][2] = ids[least] if i != least else None
                prefix = in_order(s, levels)[: n - (num * n + den - 1) // den + 1]
                step = np.arange(1, len(prefix) + 1, dtype=np.uint64)
                p1, p2 = (int(mix(prefix + step * c).sum().view(np.int64)) for c in (M1, M3))
                rows[least] = [ids[least], n, None, len(at), s1, s2, p1, p2, prefix.view(np.int64), prefix[often[(prefix % np.uint64(COUNTERS)).astype(np.int64)]].view(np.int64), sketch(s, wide_bits(n)).tobytes(), *sketch(s, 64 * SKETCH).tolist()]
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ", 1) for c in SET_COLS.split(", "))])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SET_COLS)


def blocks_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with more than ``RUN`` rows, and the number of ``blocks`` that they are dealt into."""
    return materialize(rows.groupBy(*keys).agg(F.ceil(F.count("*") / RUN).cast("int").alias("blocks")).where("blocks > 1"), "hot")


def in_blocks(rows: DataFrame, keys: list[str], id_: str, big: DataFrame) -> DataFrame:
    """``rows`` with ``a`` and ``b``, so that any two rows of a key meet in one ``(key, a, b)`` of about ``2 * RUN`` rows at most.

    Only the keys in ``big`` are dealt into blocks, by a hash of ``id_``;
    their rows are repeated once for each block.
    """
    if big.isEmpty():
        return rows.withColumns({"a": F.lit(0), "b": F.lit(0)})
    dealt = rows.join(broadcast_if_small(big, BROADCAST_ROWS), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(id_), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"a": F.least("own", "o"), "b": F.greatest("own", "o")}).drop("blocks", "own", "o")


def whole_runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames sorted by ``key``, ``a`` and ``b``, cut anew so that none ends within a run of equal ones; ``run`` numbers the runs of a frame.

    A run is what :func:`in_blocks` lets meet, so it is bounded.
    """
    held: list[pd.DataFrame] = []
    last, number = None, 0
    for pdf in batches:
        if not len(pdf):
            continue
        parts = [pdf[c].to_numpy() for c in (key, "a", "b")]
        new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in parts])])
        new[0] = last != tuple(x[0] for x in parts)
        last = tuple(x[-1] for x in parts)
        k = number + np.cumsum(new)
        number = int(k[-1])
        pdf = pdf.assign(run=k)
        if held and held[-1]["run"].iloc[-1] == k[0] == k[-1]:
            held.append(pdf)
            continue
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if held or cut:
            yield pd.concat([*held, pdf[:cut]], ignore_index=True)
        held = [pdf[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def partnered(key: np.ndarray, n: np.ndarray, k: np.ndarray, judge: np.ndarray, num: int, den: int) -> np.ndarray:
    """For rows (sorted by ``key, n``) that sizes and sketches ``k`` allow to link with another of their key: the first row that such links reach; for others -1.

    ``judge`` 0 marks a row whose sketch says nothing; pairs of two rows with
    2 are left out. Keys are taken together up to ``PAIRS`` pairs.
    """
    out = np.full(len(key), -1)
    if not len(key):
        return out
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    pairs = np.cumsum(np.diff(np.append(begin, len(key))) ** 2)
    cuts = begin[1:][pairs[1:] // PAIRS != pairs[:-1] // PAIRS].tolist()
    for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
        first = _partnered(key[a:b], n[a:b], k[a:b], judge[a:b], num, den)
        out[a:b] = np.where(first >= 0, first + a, -1)
    return out


def _partnered(key: np.ndarray, n: np.ndarray, k: np.ndarray, judge: np.ndarray, num: int, den: int) -> np.ndarray:
    rows, gap = np.arange(max(0, len(key) - 1), dtype=np.int32), 1
    a, b = [rows[:0]], [rows[:0]]
    while len(rows):
        rows = rows[rows + gap < len(key)]
        near = (key[rows] == key[rows + gap]) & (den * n[rows] >= num * n[rows + gap])
        rows = rows[near]  # a larger gap only makes both worse
        other = rows + gap
        apart = np.bitwise_count(k[rows] ^ k[other]).sum(1).astype(np.int64)
        # |x ^ y| = |x| + |y| - 2 |x & y|, and a link needs (num + den) |x & y| >= num (|x| + |y|)
        fits = (num + den) * apart <= (den - num) * (n[rows] + n[other])
        both = judge[rows] * judge[other]
        fits = (fits | (both == 0)) & (both != 4)
        a.append(rows[fits])
        b.append(other[fits])
        gap += 1
    a, b, out = np.concatenate(a), np.concatenate(b), np.arange(len(key))
    while len(a):
        low = np.minimum(out[a], out[b])
        if (low == out[a]).all() and (low == out[b]).all():
            break
        np.minimum.at(out, a, low)
        np.minimum.at(out, b, low)
        out = out[out]
    alone = np.ones(len(key), bool)
    alone[a] = alone[b] = False
    out[alone] = -1
    return out


def cells_of(num: int, den: int):
    """Reader of postings sorted by ``token, n``: ``cell, gid`` of groups with a partner that passes the filters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_runs(batches, "token"):
            k = pdf[[f"k{i}" for i in range(SKETCH)]].to_numpy().view(np.uint64)
            first = partnered(pdf["run"].to_numpy(), pdf["n"].to_numpy().astype(np.int64), k, pdf["exact"].to_numpy().astype(np.int64), num, den)
            some, gid = first >= 0, pdf["gid"].to_numpy()
            if some.any():
                yield pd.DataFrame({"cell": gid[first[some]], "gid": gid[some]}).drop_duplicates()

    return run


def narrowed(num: int, den: int):
    """Reader of members sorted by ``cell, n``: those with a partner by their wide sketches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_runs(batches, "cell"):
            ids, parts = pdf["doc_id"].to_numpy(), []
            words = pdf["wide"].map(len).to_numpy() // 8
            for w in np.unique(words):
                # partners' widths differ by a factor of two at most; parities of the wider fold onto the narrower
                at = np.flatnonzero((words == w) | (words == 2 * w))
                k = np.zeros((len(at), w), np.uint64)
                for i, x in enumerate(pdf["wide"].iloc[at]):
                    k[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, w), axis=0)
                own = np.where(words[at] == w, 1, 2)
                first = partnered(pdf["run"].to_numpy()[at], pdf["n"].to_numpy().astype(np.int64)[at], k, own, num, den)
                some = first >= 0
                parts.append(pdf[["doc_id", "n", "copies"]].iloc[at[some]].assign(cell=ids[at[first[some]]]))
            yield pd.concat(parts)[["cell", "doc_id", "n", "copies"]].drop_duplicates()

    return run


def compared(bag: list[np.ndarray], n: np.ndarray, block: np.ndarray, weight: np.ndarray, num: int, den: int, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Component (its first row) and summed weight of the links of each set; with ``cross`` only links between the two blocks count.

    ``bag`` are the sets, or their differences from one and the same set, and
    ``n`` the sizes of the sets. What more than half of the bag has is taken as
    given: a set is then its differences from that, which near copies have few
    of, and the differences that two sets share give the size of their
    intersection.
    """
    m = len(bag)
    own_size = np.array([len(s) for s in bag], np.int64)
    tokens, inverse, df = np.unique(np.concatenate(bag), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(m), own_size)
    given = 2 * df > m
    rare = ~given[inverse]
    # differences: own tokens that are not given, and given ones that are missing (a table of twice the tokens at most)
    partly = np.flatnonzero(given & (df < m))
    row = np.full(len(tokens), -1)
    row[partly] = np.arange(len(partly))
    there = np.zeros((len(partly), m), bool)
    at = row[inverse] >= 0
    there[row[inverse[at]], doc[at]] = True
    missing = np.argwhere(~there)
    d_doc, d_token = np.concatenate([doc[rare], missing[:, 1]]), np.concatenate([inverse[rare], partly[missing[:, 0]]])
    size = np.bincount(d_doc, minlength=m)
    shared = np.bincount(d_token, minlength=len(tokens))[d_token] > 1
    d_doc, d_token = d_doc[shared], d_token[shared]
    by_token = np.argsort(d_token, kind="stable")
    post, edge = d_doc[by_token], np.concatenate([[0], np.cumsum(np.bincount(d_token, minlength=len(tokens)))])
    by_doc = np.argsort(d_doc, kind="stable")
    own, first = d_token[by_doc], np.concatenate([[0], np.cumsum(np.bincount(d_doc, minlength=m))])
    component, links = np.arange(m), np.zeros(m, np.int64)
    for i in range(m):
        lists = [post[edge[t] : edge[t + 1]] for t in own[first[i] : first[i + 1]].tolist()]
        common = np.bincount(np.concatenate(lists), minlength=m) if lists else np.zeros(m, np.int64)
        both = (n[i] + n - (size[i] + size - 2 * common)) // 2
        linked = den * both >= num * (n[i] + n - both)
        linked[i] = False
        if cross:
            linked &= block != block[i]
        links[i] = weight[linked].sum()
        near = np.unique(component[linked])
        if len(near) and (near != component[i]).any():
            low = min(int(near[0]), int(component[i]))
            component[np.isin(component, near) | (component == component[i])] = low
    return component, links


def told(ids: np.ndarray, component: np.ndarray, links: np.ndarray) -> pd.DataFrame:
    some = links > 0
    return pd.DataFrame({"u": ids[some], "v": ids[component[some]], "links": links[some]})


def one_text(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of rows of one id, which should have one text, the first by text; in order of ids."""
    return pdf.sort_values(["doc_id", "text"]).drop_duplicates("doc_id", ignore_index=True)


def verify(k: int, num: int, den: int):
    """``u, v, links`` of a cell of one block: ``v`` is the smallest id that ``u`` is connected with."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = one_text(pdf)
        bag = list(Shingler(k).of(pa.array(pdf["text"], pa.string())))
        n = np.array([len(s) for s in bag], np.int64)
        return told(pdf["doc_id"].to_numpy(np.int64), *compared(bag, n, np.zeros(len(bag), np.int64), pdf["copies"].to_numpy(np.int64), num, den, False))

    return run


def differences(k: int):
    """``cell, doc_id, copies, block, n, apart``: sizes of sets, and the shingles in which they differ from the pivot's, a row of each block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pivot = one_text(pdf[pdf["pivot"]])
        pdf = one_text(pdf[~pdf["pivot"]])
        shingler = Shingler(k)
        base = next(shingler.of(pa.array(pivot["text"][:1], pa.string())))
        bag = list(shingler.of(pa.array(pdf["text"], pa.string())))
        apart = [np.setxor1d(s, base, assume_unique=True).view(np.int64) for s in bag]
        return pdf[["cell", "doc_id", "copies", "block"]].assign(n=np.array([len(s) for s in bag], np.int64), apart=pd.Series(apart, dtype=object))

    return run


def compare_blocks(num: int, den: int):
    """As :func:`verify`, of a block or of two blocks of a cell, from :func:`differences`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        bag = [np.asarray(x, np.int64) for x in pdf["apart"]]
        cross = bool(pdf["a"].iloc[0] != pdf["b"].iloc[0])
        return told(pdf["doc_id"].to_numpy(np.int64), *compared(bag, pdf["n"].to_numpy(np.int64), pdf["block"].to_numpy(), pdf["copies"].to_numpy(np.int64), num, den, cross))

    return run


def links(docs: DataFrame, k: int, num: int, den: int, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``u, v`` with the same components as all links, and ``id, n_links`` of the rows that have links; ``found`` comes from :func:`sets`."""
    whole = found.where("lead is null and n > 0 and doc_id is not null")
    same_group = ["p1", "p2", "n"]
    same_set = [*same_group, "s1", "s2"]
    sketches = [F.min(f"k{i}").alias(f"k{i}") for i in range(SKETCH)]
    even = F.lit(True)
    for i in range(SKETCH):
        even &= F.min(f"k{i}") == F.max(f"k{i}")
    groups = whole.groupBy(*same_group).agg(F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix"), even.alias("exact"), *sketches)
    posts = groups.select(F.explode("prefix").alias("token"), "n", "gid", "exact", *[f"k{i}" for i in range(SKETCH)])
    common = blocks_of(whole.select(F.explode("often").alias("token")), ["token"])
    cells = in_blocks(posts, ["token"], "gid", common).repartition("token", "a", "b").sortWithinPartitions("token", "a", "b", "n").mapInPandas(cells_of(num, den), "cell long, gid long")

    slim = whole.select("doc_id", "stands", *same_set)
    named = materialize(slim.groupBy(*same_set).agg(F.min("doc_id").alias("rep"), F.count("*").alias("batches"), F.sum("stands").alias("copies")), "named")
    copies = materialize(slim.join(named.where("batches > 1").drop("copies"), same_set).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), "copies")
    in_batch = found.where("lead is not null").select(F.col("doc_id").alias("u"), F.col("lead").alias("v"))
    gids = named.groupBy(*same_group).agg(F.min("rep").alias("gid"), F.count("*").alias("members"))
    wide = named.join(gids.where("members > 1"), same_group).select("gid", "rep", "n")  # groups of several sets
    cells = materialize(cells.unionByName(wide.select(F.col("gid").alias("cell"), "gid")).distinct(), "cells")

    # expand groups to their members: those of one set are the group's id itself
    single = cells.join(wide.select("gid").distinct(), "gid", "left_anti").select("cell", F.col("gid").alias("doc_id"))
    others = cells.join(wide, "gid").select("cell", F.col("rep").alias("doc_id"))
    wides = whole.groupBy("doc_id", "n").agg(F.first("wide").alias("wide"))
    expanded = single.unionByName(others).join(wides, "doc_id").join(named.select(F.col("rep").alias("doc_id"), "copies"), "doc_id")
    expanded = materialize(expanded.select("cell", "doc_id", "n", "copies", "wide"), "expanded")
    dealt = in_blocks(expanded, ["cell"], "doc_id", blocks_of(expanded, ["cell"])).repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b", "n")
    members = materialize(dealt.mapInPandas(narrowed(num, den), "cell long, doc_id long, n int, copies long").distinct(), "members")
    # cells that share a member are one: every pair is then verified once
    whole_cells = star_components(members, "cell", "doc_id").select(F.col("id").alias("doc_id"), F.col("component").alias("cell"))
    members = members.select("doc_id", "n", "copies").distinct().join(whole_cells, "doc_id")
    blocks = F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("cell").agg(blocks.alias("blocks"), F.min("doc_id").alias("first"), F.count("*").alias("n_docs")).where("n_docs > 1")
    placed = members.select("cell", "doc_id", "copies").distinct().join(sizes.drop("n_docs"), "cell").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    placed = materialize(placed, "placed")
    few = broadcast_if_small(placed.select("doc_id").distinct(), BROADCAST_ROWS)  # beyond it the join below shuffles all texts
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id", "left_semi")
    read = texts.join(placed, "doc_id")
    forest = "u long, v long, links long"
    verified = read.where("blocks = 1").groupBy("cell").applyInPandas(verify(k, num, den), forest)
    if not placed.where("blocks > 1").isEmpty():
        several = materialize(read.where("blocks > 1").withColumn("pivot", F.lit(False)), "several")
        pivots = several.where("doc_id = first").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("pivot", F.lit(True))
        apart = several.unionByName(pivots).groupBy("cell", "block").applyInPandas(differences(k), "cell long, doc_id long, copies long, block int, n long, apart array<long>")
        apart = apart.join(placed.where("blocks > 1").select("cell", "blocks").distinct(), "cell").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = apart.withColumns({"a": F.least("block", "o"), "b": F.greatest("block", "o")})
        verified = verified.unionByName(pairs.groupBy("cell", "a", "b").applyInPandas(compare_blocks(num, den), forest))
    verified = materialize(verified, "verified")
    edges = verified.where("u <> v").select("u", "v").unionByName(copies).unionByName(in_batch)

    own_links = named.where("copies > 1").select(F.col("rep").alias("id"), (F.col("copies") - 1).alias("n_links")).unionByName(verified.select(F.col("u").alias("id"), F.col("links").alias("n_links")))
    reps = materialize(own_links.groupBy("id").agg(F.sum("n_links").alias("n_links")), "links")
    to_rep = in_batch.join(copies.withColumnRenamed("u", "lead").withColumnRenamed("v", "rep"), F.col("v") == F.col("lead"), "left").select("u", F.coalesce("rep", "v").alias("v")).unionByName(copies).distinct()
    return edges, reps.unionByName(to_rep.where("u <> v").join(reps, F.col("v") == F.col("id")).select(F.col("u").alias("id"), "n_links"))


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` per row of ``docs``.

    Two documents link when ``den * |A & B| >= num * |A | B|`` for their sets
    of distinct ``k``-word shingles (A-Z lower-cased, words between ASCII white
    space; fewer words are one shingle). ``component_id`` is the smallest id
    that links reach, ``n_links`` the number of other rows that a row links
    with. Null and empty texts have empty sets and link with nothing; rows of
    one id are one document to the components, and should have one text; rows
    without id have no component and no links. Other columns are ignored.
    """
    levels = shingle_levels(docs, k)
    found = materialize(sets(docs, k, num, den, levels), "sets")
    edges, counts = links(docs, k, num, den, found)
    components = star_components(edges).select(F.col("id").alias("__id"), "component")
    counts = counts.groupBy(F.col("id").alias("__l")).agg(F.max("n_links").alias("n_links"))
    joined = found.select("doc_id", "n").join(components, F.col("doc_id") == F.col("__id"), "left").join(counts, F.col("doc_id") == F.col("__l"), "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id.

    Rows without id stay. Of repeated rows of an id the one whose text has the
    smallest hash stays, and of those with that text any.
    """
    levels = shingle_levels(docs, k)
    found = materialize(sets(docs, k, num, den, levels), "sets")
    id_, n, rank = (unused(docs, x) for x in ("id", "n", "rank"))
    drop = star_components(links(docs, k, num, den, found)[0]).where("id <> component").select(F.col("id").alias(id_))
    kept = docs.join(drop, F.col("doc_id").cast("long") == F.col(id_), "left_anti")
    twice = materialize(found.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(id_), "twice")
    if twice.isEmpty():
        return kept
    same = F.col("doc_id").cast("long") == F.col(id_)
    first = kept.join(twice, same, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where(F.col(rank) == 1).drop(rank)
    return kept.join(twice, same, "left_anti").unionByName(first)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
p as (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) s from w where len(w) > 0),
g as (select distinct doc_id, array_to_string(list_slice(w, s, s + 2), ' ') g from p),
n as (select doc_id, count(*) n from g group by doc_id),
j as (select a.doc_id a, b.doc_id b, count(*) c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from j join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
c as (select a, count(*) n from e group by a),
r as (select doc_id a, doc_id b from documents union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, m.c component_id, cast(coalesce(c.n, 0) as bigint) n_links
from documents d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id join (select a, min(b) c from r group by a) m on m.a = d.doc_id
"""
