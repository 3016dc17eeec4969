"""Substring deduplication: seeds from winnowing, extension to maximal repeats.

Of each window of ``W`` words winnowing picks one seed of ``K`` words; equal
windows pick equal seeds at equal places. A seed with the windows that picked
it is a segment, the seed extended both ways as far as they reach.

1. Seeds of all documents are joined on their hash. Of equal segments (equal
   extension both ways) only the one with the smallest document can keep its
   words; the others are repeats as a whole.
2. Seeds with different extensions are extended window by window: the text of
   each extension's first document is read again at all places where it has
   the extension, and a window is a repeat if a document with a smaller id
   has it.
3. Overlapping repeats unite to maximal ones, whose words are cut.

Neither step forms pairs. Both joins stream sorted rows and hold no more than
the places of one segment in one document, and rows that a batch can decide on
its own never travel, so a segment that very many documents share costs its
join one document's places per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkgraph.llm.common import broadcast_if_small, materialize, table, unused

#: Words of a window, the shortest repeat that counts, and of a seed.
W, K = 50, 16
#: Words that a worker remembers.
CACHE = 1_000_000
#: Windows per batch that are sent on together.
BATCH_ROWS = 400_000
#: Documents whose ids may be broadcast, so that only their texts are shuffled.
BROADCAST_ROWS = 1_000_000

REMOVE, CHECK = 0, 1
MASK32 = np.uint64(0xFFFFFFFF)


def powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Hasher:
    """128-bit hashes of word ranges, as differences of polynomial prefix sums modulo 2**64."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.values = np.zeros((2, 1 << 16), np.uint64)
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        self.up = [powers(b, n) for b in self.BASES]
        self.down = [powers(pow(b, -1, 1 << 64), n) for b in self.BASES]

    def prefix(self, words: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for w in [w for w in set(words) if w not in known]:
            i = known[w] = len(known)
            if i >= self.values.shape[1]:
                self.values = np.concatenate([self.values, np.zeros_like(self.values)], axis=1)
            h = xxhash.xxh3_128_intdigest(w)
            self.values[:, i] = h & (2**64 - 1), h >> 64
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if len(words) >= len(self.up[0]):
            self.grow(2 * len(words))
        return [np.concatenate([[np.uint64(0)], np.cumsum(v[ids] * up[: len(ids)], dtype=np.uint64)]) for v, up in zip(self.values, self.up, strict=True)]

    def ranges(self, prefix: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Hashes of words ``start`` to ``end`` (exclusive), for arrays of both."""
        return [(p[end] - p[start]) * down[start] for p, down in zip(prefix, self.down, strict=True)]


def segments(hasher: Hasher, words: list[bytes]) -> tuple[np.ndarray, ...] | None:
    """``seed, seg1, seg2, start, n`` of a text's segments; n windows from start picked the seed."""
    n = len(words)
    if n < W:
        return None
    prefix = hasher.prefix(words)
    at = np.arange(n - K + 1)
    grams = hasher.ranges(prefix, at, at + K)[0]
    # the upper half of a mixed hash orders seeds, of equal ones the leftmost is picked
    mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    low = (mixed & ~MASK32) | at.astype(np.uint64)
    span, width = 1, W - K + 1
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: n - W + 1], low[width - span : width - span + n - W + 1])
    seed = (low & MASK32).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
    count = np.diff(np.concatenate([start, [len(seed)]]))
    seed = seed[start]
    one, two = hasher.ranges(prefix, start, start + count + W - 1)
    place = ((seed - start) * 4099 + count).astype(np.uint64)
    return grams[seed], one + place * np.uint64(0x9E3779B97F4A7C15), two ^ place, start, count


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Mask of the rows whose keys differ from those of the row before."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    return np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def combine(cols: dict[str, np.ndarray], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys and document; mask (in that order) of rows that a smaller document of the batch beats."""
    order = np.lexsort((cols["doc_id"], *[cols[k] for k in reversed(keys)]))
    new = firsts(*[cols[k][order] for k in keys])
    doc = cols["doc_id"][order]
    lead = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))] if len(doc) else doc
    return order, doc > lead


KEYED = "route long, seed long, seg1 long, seg2 long, doc_id long, th long, start int, n int, kind int"
DECIDED = "doc_id long, th long, start int, n int, kind int"


def keyed(cols: dict[str, np.ndarray], keys: list[str], keep_all: bool) -> pd.DataFrame:
    """Rows for a join: those beaten within the batch are decided and routed at random."""
    order, beaten = combine(cols, keys)
    out = {k: v[order] for k, v in cols.items()}
    if not keep_all:  # of equal rows one is enough to stand for its document
        once = firsts(*[out[k] for k in keys]) | beaten
        out, beaten = {k: v[once] for k, v in out.items()}, beaten[once]
    spread = (out["th"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + out["start"].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)
    out["route"] = np.where(beaten, spread, out[keys[0]])
    out["kind"] = np.where(beaten, REMOVE, CHECK)
    return pd.DataFrame(out)


def stream(extend: bool):
    """Reader of sorted rows: repeats, and (if ``extend``) the leading documents' rows of seeds with several segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "th", "start", "n", "kind"]
        last = lead = None
        count, held = 0, []  # segments of the last seed; its leaders' rows for as long as it has but one
        for pdf in batches:
            decided = pdf[pdf["kind"] == REMOVE]
            yield decided[names]
            pdf = pdf[pdf["kind"] == CHECK]
            if not len(pdf):
                continue
            seed, one, two, doc = (pdf[c].to_numpy() for c in ("seed", "seg1", "seg2", "doc_id"))
            new = firsts(seed, one, two)
            if last is not None and last == (seed[0], one[0], two[0]):
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
            leader = np.where(at >= 0, doc[np.maximum(at, 0)], -1 if lead is None else lead)
            beaten = doc > leader
            yield pdf.loc[beaten, names].assign(kind=REMOVE)
            if extend:
                group = np.cumsum(firsts(seed)) - 1
                counts = np.bincount(group, new).astype(np.int64)
                if last is not None and last[0] == seed[0]:
                    counts[0] += count
                    if counts[0] > 1:
                        yield from held
                        held = []
                else:
                    held = []
                yield pdf.loc[~beaten & (counts[group] > 1), names].drop_duplicates()
                if group[-1] > 0:
                    held = []
                count = counts[-1]
                if count == 1:
                    held.append(pdf.loc[~beaten & (group == group[-1]), names].drop_duplicates())
            last, lead = (seed[-1], one[-1], two[-1]), leader[-1]

    return run


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, th, text``: rows of one id and text are one document; rows without id or text take no part."""
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def seeds(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, names = Hasher(), ["seed", "seg1", "seg2", "start", "n"]
        for pdf in batches:
            parts, docs_, ths = [], [], []
            for doc_id, th, text in zip(pdf["doc_id"], pdf["th"], pdf["text"], strict=True):
                if (found := segments(hasher, text.encode().split())) is not None:
                    parts.append(found)
                    docs_.append(np.full(len(found[0]), doc_id))
                    ths.append(np.full(len(found[0]), th))
            if parts:
                cols = {k: np.concatenate(x) for k, x in zip(names, zip(*parts, strict=True), strict=True)}
                cols = {k: v.view(np.int64) for k, v in cols.items()} | {"doc_id": np.concatenate(docs_), "th": np.concatenate(ths)}
                yield keyed(cols, ["seed", "seg1", "seg2"], True)

    return identified(docs).mapInPandas(run, KEYED)


def windows(texts: DataFrame) -> DataFrame:
    """Hashes of the windows of segments; ``texts`` has ``doc_id, th, text, segs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, held, size = Hasher(), [], 0

        def flush() -> pd.DataFrame:
            cols = {k: np.concatenate(x) for k, x in zip(("seed", "seg1", "doc_id", "th", "start"), zip(*held, strict=True), strict=True)}
            return keyed(cols | {"seg2": np.zeros_like(cols["seed"]), "n": np.ones_like(cols["seed"])}, ["seed", "seg1"], True)

        for pdf in batches:
            for doc_id, th, text, segs in zip(pdf["doc_id"], pdf["th"], pdf["text"], pdf["segs"], strict=True):
                at = np.unique(np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in segs]))
                one, two = hasher.ranges(hasher.prefix(text.encode().split()), at, at + W)
                held.append((one.view(np.int64), two.view(np.int64), np.full(len(at), doc_id), np.full(len(at), th), at))
                size += len(at)
                if size >= BATCH_ROWS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.mapInPandas(run, KEYED)


def join_sorted(rows: DataFrame, extend: bool) -> DataFrame:
    return rows.repartition("route").sortWithinPartitions("seed", "seg1", "seg2", "doc_id").mapInPandas(stream(extend), DECIDED)


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, th, start, n``: ``n`` windows from ``start`` on repeat those of smaller documents."""
    found = materialize(join_sorted(seeds(docs), True), "segments")
    checks = materialize(found.where(F.col("kind") == CHECK).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n")).alias("segs")), "checks")
    few = broadcast_if_small(checks.select("doc_id", "th"), BROADCAST_ROWS)  # beyond it the join below shuffles all texts
    texts = identified(docs).join(few, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"]).join(checks, ["doc_id", "th"])
    extended = join_sorted(windows(texts), False)
    return found.where(F.col("kind") == REMOVE).unionByName(extended).select("doc_id", "th", "start", "n")


def with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with an array of ``(start, n)`` windows to remove, or null, and the name of that column."""
    id_, th, name = (unused(docs, x) for x in ("id", "th", "spans"))
    spans = repeats(docs).groupBy(F.col("doc_id").alias(id_), F.col("th").alias(th)).agg(F.collect_list(F.struct("start", "n")).alias(name))
    return docs.join(spans, (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(th)), "left").drop(id_, th), name


def cut(text: str | None, spans) -> tuple[list[bytes], list[bytes]]:
    """Words of a text, and those that are kept."""
    words = (text or "").encode().split() if isinstance(text, str) else []
    if spans is None or not len(spans) or not words:
        return words, words
    edge = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        edge[s["start"]] += 1
        edge[s["start"] + s["n"] + W - 1] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return words, [w for w, k in zip(words, keep, strict=True) if k]


def dedup_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per row of ``docs``.

    A word goes if it is in a window of ``W`` words that also starts in a
    document with a smaller id, judged on the input. Null texts have no words;
    rows without id neither lose words nor take any; repeated rows are alike
    and don't remove each other. Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, spans in zip(pdf["text"], pdf[name], strict=True):
                words, kept = cut(text, spans)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out.astype({"doc_id": "Int64"})

    marked, name = with_spans(docs.select("doc_id", "text"))
    return marked.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeats cut out of ``text``; all columns stay.

    Texts without repeats stay as they are; others become their kept words,
    joined by one space, and rows of which nothing is left go.
    """

    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("text").type
            texts, spans = batch["text"].to_pylist(), batch[name].to_pylist()
            cuts = [b" ".join(cut(t, s)[1]).decode() if s else t for t, s in zip(texts, spans, strict=True)]
            keep = pa.array([not s or t != "" for t, s in zip(cuts, spans, strict=True)], pa.bool_())
            cols = [pa.array(cuts, kind) if name == "text" else batch[name] for name in schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names).filter(keep)

    marked, name = with_spans(docs)
    return marked.mapInArrow(run, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(table(spark, sf_dir, "documents"))


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, w, unnest(range(1, len(w) - 48)) s from w where len(w) >= 50),
h as (select doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) k from g),
m as (select k, min(doc_id) d from h group by k),
r as (select distinct h.doc_id, unnest(range(s, s + 50)) p from h join m on m.k = h.k and m.d < h.doc_id),
l as (select doc_id, list(p) p, count(*) n from r group by doc_id),
e as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) i from w),
t as (select e.doc_id, string_agg(x, ' ' order by i) x from e left join r on r.doc_id = e.doc_id and r.p = e.i where r.p is null group by e.doc_id)
select w.doc_id, cast(len(w.w) as bigint) n_words, cast(coalesce(l.n, 0) as bigint) n_removed, sha256(coalesce(t.x, '')) kept_sha256
from w left join l on l.doc_id = w.doc_id left join t on t.doc_id = w.doc_id
"""
