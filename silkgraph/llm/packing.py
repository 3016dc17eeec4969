"""Best-fit packing of tokenised documents into sequences of bounded length.

Bulk-synchronous. Documents are range-sorted by length, longest first, which
gives each its rank among those of its length; equal lengths are a run, and so
are sequences with equal gaps, so tables of runs are bounded by the capacity,
not by the data. Sizes fall into ranges, each the upper half of what is left.
In a superstep every range sweeps its own documents and gaps at once: runs of
documents, longest first, look up their successor, the smallest gap that holds
them; of documents that want the same sequences, rank decides; gaps are
updated. What gaps are left travels to the range of the documents that fit
next, and the superstep is repeated. The first range with documents that wait
gets no more gaps from above, and opens new sequences for them. After as many
supersteps as there are ranges every document has a run, and finds its place
in it from its rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkgraph.llm.common import materialize, table, text_blocks, unused, word_codes

CAPACITY = 4096
#: Id that ends a document.
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Words that a worker process remembers; parts of words that are encoded together.
CACHE, JOINED = 1_000_000, 500
#: Ranges of sizes: (C/2, C], (C/4, C/2], and so on; the last one has all that is left.
RANGES = 8
#: Bits of a rank in a key, and of a sequence's number among those that a superstep opens.
RANK_BITS = 40


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A word of ASCII and Latin-1 letters with ASCII punctuation after it: the tokenizer splits between the two.
PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[!-&(-/:-@\[-`{-~]*)$"


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` rows."""
    return a if n <= len(a) else np.concatenate([a, np.zeros((max(n, 2 * len(a)) - len(a), *a.shape[1:]), a.dtype)])


class WordIds:
    """Ids of texts under a lower-casing tokenizer that drops white space and never joins words across it.

    Words are then independent, and each distinct one is looked up once; of
    plain words the letters and the punctuation after them are independent
    too. Plain parts are encoded many at a time: each ends with its only token
    that has the tokenizer's mark of a word's end.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}  # row in pairs: the two parts of a word
        self.pairs = np.zeros((1 << 16, 2), np.int32)
        self.parts: dict[str, int] = {"": 0}
        self.begin, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, "<u4")  # part i: flat[begin[i]:begin[i + 1]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_plain(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts one after another, and the number of each part's ids."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        chunks = [parts[i : i + JOINED] for i in range(0, len(parts), JOINED)]
        for chunk, own in zip(chunks, self.encode([" ".join(c) for c in chunks]), strict=True):
            last = np.flatnonzero(self.ends[own])
            if len(last) != len(chunk) or last[-1] != len(own) - 1:  # not a tokenizer that marks the ends of words
                alone = self.encode(chunk)
                own, size = np.concatenate(alone), np.array([len(x) for x in alone], np.int64)
            else:
                size = np.diff(last, prepend=-1)
            ids.append(own)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def part_numbers(self, texts: pa.Array, plain: bool) -> np.ndarray:
        """Numbers of the parts ``texts``; those that are new are encoded."""
        coded = texts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [p for p in distinct if p not in self.parts]
        if new:
            if plain:
                ids, sizes = self.encode_plain(new)
            else:
                alone = self.encode(new)
                ids, sizes = np.concatenate(alone), np.array([len(x) for x in alone], np.int64)
            n, k = len(self.parts), len(new)
            self.parts.update(zip(new, range(n, n + k), strict=True))
            self.begin = grown(self.begin, n + k + 1)
            self.begin[n + 1 : n + 1 + k] = self.begin[n] + np.cumsum(sizes)
            self.flat = grown(self.flat, int(self.begin[n + k]))
            self.flat[self.begin[n] : self.begin[n + k]] = ids
        return np.fromiter(map(self.parts.__getitem__, distinct), np.int32, len(distinct))[coded.indices.to_numpy()]

    def learn(self, new: pa.Array) -> None:
        found = pc.extract_regex(new, PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        n, k = len(self.words), len(new)
        self.pairs = grown(self.pairs, n + k)
        own = self.pairs[n : n + k]
        split = found.filter(found.is_valid())
        own[plain, 0] = self.part_numbers(pc.utf8_lower(split.field("letters")), True)
        own[plain, 1] = self.part_numbers(split.field("rest"), True)
        own[~plain, 0] = self.part_numbers(new.filter(found.is_null()), False)
        own[~plain, 1] = 0
        self.words.update(zip(new.to_numpy(zero_copy_only=False).tolist(), range(n, n + k), strict=True))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (and the last one's end); nulls are empty."""
        words, at, begin = word_codes(texts)
        distinct = words.to_numpy(zero_copy_only=False).tolist()
        rows = np.fromiter(map(self.words.get, distinct, repeat(-1)), np.int64, len(distinct))
        if (rows < 0).any():
            if len(self.words) > CACHE:  # of what is known only words that this block repeats stay
                often = np.bincount(at, minlength=len(distinct)) > 1
                self.forget()
                self.learn(words.filter(pa.array(often)))
                rows = np.fromiter(map(self.words.get, distinct, repeat(-1)), np.int64, len(distinct))
            new = np.flatnonzero(rows < 0)
            rows[new] = np.arange(len(self.words), len(self.words) + len(new))
            self.learn(words.take(pa.array(new)))
        part = self.pairs[rows[at]].reshape(-1)
        start, size = self.begin[part], self.begin[part + 1] - self.begin[part]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(start - ends + size, size) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[2 * begin]


_KNOWN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The one of this worker process: what it has learnt serves all its tasks."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``).

    Null and empty texts are the end id alone. Only documents longer than
    ``capacity`` are cut. Repeated rows give pieces each; other columns are
    ignored. A document's words and ids are in memory at once.
    """
    path = path or tokenizer_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def pieces(doc_id: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ids, begin = word_ids(path).of(texts)
        n = np.diff(begin) + 1  # with the end id
        stop = np.cumsum(n)
        whole = np.full(int(stop[-1]), end_id, "<u4")
        inner = np.ones(len(whole), bool)
        inner[stop - 1] = False
        whole[inner] = ids
        count = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(capacity, n[row] - start)
        at = (stop - n)[row] + start
        raw = memoryview(whole).cast("B")
        crc = [crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
        cols = [doc_id.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        if with_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(whole)), pa.int32()), pa.array(whole.view("<i4"))))
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_blocks(batch["text"]):
                yield pieces(batch["doc_id"][a:b], batch["text"][a:b])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


Run = tuple[int, int, int]  # size, number, first


def sweep(documents: list[Run], gaps: list[Run], capacity: int, opened: int | None) -> tuple[list[Run], list[Run], list[Run]]:
    """Match runs of documents with runs of gaps by best fit, longest documents first.

    ``documents`` are ``(length, number, first rank)``, ``gaps`` ``(gap,
    number, first sequence)``. Returns places ``(key, first sequence,
    offset)``, and the documents and gaps that are left. A place's documents,
    in order of rank, go to consecutive sequences at one offset; its key is
    ``(capacity - length) << RANK_BITS | first rank``. With ``opened``,
    documents that no gap holds get new sequences, numbered from there.
    """
    held: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
    order: list[int] = []  # the gaps there are, ascending
    places: list[Run] = []
    waiting: list[Run] = []

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not held[gap]:
                insort(order, gap)
            held[gap].append((first, n))

    for gap, n, first in sorted(gaps, key=lambda x: x[2], reverse=True):
        leave(gap, first, n)
    for length, left, rank in sorted(documents, key=lambda x: (-x[0], x[2])):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit")
        key = (capacity - length) << RANK_BITS
        while left and (at := bisect_left(order, length)) < len(order):  # the successor of the length among the gaps
            gap = order[at]
            first, n = held[gap].pop()
            m = min(n, left)
            if m < n:
                held[gap].append((first + m, n - m))
            if not held[gap]:
                order.pop(at)
            places.append((key | rank, first, capacity - gap))
            leave(gap - length, first, m)
            rank, left = rank + m, left - m
        if left and opened is None:
            waiting.append((length, left, rank))
        elif left:  # new sequences, filled one after another
            each = capacity // length
            full, rest = divmod(left, each)
            for j in range(each if full else 0):
                places.append((key | rank, opened, j * length))
                rank += full
            leave(capacity - each * length, opened, full)
            opened += full
            for j in range(rest):
                places.append((key | rank, opened, j * length))
                rank += 1
            if rest:
                leave(capacity - rest * length, opened, 1)
                opened += 1
    return places, waiting, [(gap, n, first) for gap in order for first, n in held[gap]]


def range_of(size: int, capacity: int) -> int:
    return min(RANGES, (capacity // size).bit_length()) - 1


STATE = "kind int, range int, size long, n long, first long"
WAITING, GAP, PLACED = 0, 1, 2


def matched(spark: SparkSession, runs: list[Run], capacity: int) -> DataFrame:
    """Places of runs of documents: ``size, n, first`` hold the key, first sequence and offset of each.

    A table of runs goes through the supersteps; the driver sees none of its rows.
    """
    levels = sorted({range_of(x, capacity) for x, _, _ in runs})  # those with documents

    def place_of(gap: int, done: int) -> int:
        """The next range after ``done`` with documents that the gap may hold; beyond the last there is none."""
        return next((i for i, r in enumerate(levels) if i > done and r >= range_of(gap, capacity)), len(levels))

    def superstep(now: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            at = int(pdf["range"].iloc[0])
            of = lambda kind: list(pdf.loc[pdf["kind"] == kind, ["size", "n", "first"]].itertuples(index=False, name=None))
            places, waiting, gaps = sweep(of(WAITING), of(GAP), capacity, now << RANK_BITS if at == now else None)
            rows = [(PLACED, at, *x) for x in places] + [(WAITING, at, *x) for x in waiting] + [(GAP, place_of(x[0], at), *x) for x in gaps]
            return pd.DataFrame(rows, columns=["kind", "range", "size", "n", "first"])

        return run

    state = spark.createDataFrame([(WAITING, levels.index(range_of(x, capacity)), x, n, first) for x, n, first in runs], STATE)
    done = [state.where("kind = 2")]
    for now in range(len(levels)):
        live = state.where((F.col("kind") != PLACED) & (F.col("range") < len(levels)))
        state = materialize(live.groupBy("range").applyInPandas(superstep(now), STATE), "superstep")
        done.append(state.where(F.col("kind") == PLACED))
    return reduce(DataFrame.unionByName, done)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; pieces of a sequence are gapless from 0.

    Needs ``doc_id, piece, length``; the other columns of ``pieces`` stay, but
    for ``sequence_id`` and ``offset``, which are replaced. Ties are broken by
    ``doc_id`` and ``piece``; an empty table stays empty.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    order = [F.desc("length"), F.col("doc_id"), F.col("piece")]
    at = unused(pieces, "at")
    ranked = materialize(pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    cells = ranked.groupBy(F.shiftright(at, 33).cast("int").alias("part"), F.col("length").alias("of")).agg(F.count("*").alias("n")).collect()  # at most partitions + lengths rows
    counts: dict[int, int] = {}
    sizes: dict[int, int] = {}
    for r in cells:
        counts[r["of"]] = counts.get(r["of"], 0) + r["n"]
        sizes[r["part"]] = sizes.get(r["part"], 0) + r["n"]
    parts = max(sizes, default=-1) + 1
    before = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(parts)])]).astype(np.int64)
    longest = sorted(counts, reverse=True)
    first = dict(zip(longest, np.concatenate([[0], np.cumsum([counts[x] for x in longest])])[:-1], strict=True)) if longest else {}
    # runs of places are bounded by the capacity (tens of thousands for 4096), whatever the number of pieces
    runs = matched(spark, [(x, n, 0) for x, n in counts.items()], capacity).select("size", "n", "first").toPandas().sort_values("size")
    shared = spark.sparkContext.broadcast((before, first, *(runs[c].to_numpy(np.int64) for c in ("size", "n", "first"))))
    names = pieces.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, first, keys, sequences, offsets = shared.value
        start = np.zeros(capacity + 1, np.int64)
        for length, n in first.items():
            start[length] = n
        for pdf in batches:
            row, length = pdf[at].to_numpy(), pdf["length"].to_numpy()
            rank = before[row >> 33] + (row & ((1 << 33) - 1)) - start[length]
            key = ((capacity - length) << RANK_BITS) | rank
            run = np.searchsorted(keys, key, side="right") - 1
            out = pdf[names].copy()
            out["sequence_id"] = sequences[run] + (key - keys[run])
            out["offset"] = offsets[run]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInPandas(place, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token ids of each sequence, from pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(tokenize(docs, path, capacity), "pieces"), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
