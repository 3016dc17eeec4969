"""Benchmark decontamination with a broadcast set of normalised n-grams.

Native: the scan is one narrow pass. Every word of a document becomes a row
that also holds the ``n - 1`` words after it; a hash join with the windows of
the benchmark finds hits, equality of the words verifies them, and only hits
and one row per document are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkgraph.llm.common import broadcast_if_small, materialize, norm_words, table, unused

NGRAM = 10
#: Rows of benchmark windows, or of flagged documents, that may be broadcast.
BROADCAST_ROWS = 1_000_000


def benchmark_windows(benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """Distinct windows of the items: ``b_len, b_key, b0 .. b{n-1}, b_items``.

    A window is ``n`` consecutive words; an item of fewer, but not none, is one
    window. Null texts have no windows. Items without id still give windows.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), norm_words(F.col("text")).alias("w"))
    size = F.size("w")
    starts = F.when(size == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1)))
    windows = items.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.lit(n)).alias("win"))
    grouped = windows.groupBy("win").agg(F.collect_set("item").alias("b_items"))
    cells = [F.get("win", F.lit(i)).alias(f"b{i}") for i in range(n)]
    return grouped.select(F.size("win").alias("b_len"), "b_items", *cells).withColumn("b_key", F.xxhash64("b_len", *[f"b{i}" for i in range(n)]))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: ``keys``, ``n_words, hits, items``.

    ``hits`` are the ``(pos, len)`` of windows in order of position, ``items``
    the distinct ids (as strings, sorted) whose windows occur. Null or empty
    texts have no words and no hits; repeated rows give a row each; an empty
    benchmark gives no hits. Other columns of ``docs`` are ignored.
    """
    windows = benchmark_windows(benchmark, n)
    lengths = sorted(r[0] for r in windows.select("b_len").distinct().collect()) or [n]
    words = docs.select(*keys, F.monotonically_increasing_id().alias("rid"), norm_words(F.col("text")).alias("w"))
    ahead = [F.col("w"), *[F.slice("w", F.lit(i + 1), F.size("w")) for i in range(1, n)]]
    rows = words.select(*keys, "rid", F.size("w").alias("n_words"), F.posexplode_outer(F.arrays_zip(*ahead)).alias("pos", "z"))
    zipped = rows.schema["z"].dataType.fieldNames()
    rows = rows.select(*keys, "rid", "n_words", "pos", *[F.col("z").getField(f).alias(f"w{i}") for i, f in enumerate(zipped)])

    def key(k: int):
        used = [F.col(f"w{i}") for i in range(k)] + [F.lit(None).cast("string")] * (n - k)
        return F.when(F.col(f"w{k - 1}").isNotNull(), F.xxhash64(F.lit(k), *used))

    if len(lengths) == 1:
        rows = rows.withColumn("len", F.lit(lengths[0])).withColumn("key", key(lengths[0]))
    else:
        tries = F.explode(F.array(*[F.struct(F.lit(k).alias("len"), key(k).alias("key")) for k in lengths])).alias("t")
        rows = rows.select("*", tries).select("*", "t.len", "t.key").drop("t")
    equal = F.lit(True)
    for i in range(n):
        equal &= F.col(f"b{i}").isNull() | (F.col(f"w{i}") == F.col(f"b{i}"))
    found = rows.join(broadcast_if_small(windows, BROADCAST_ROWS), (F.col("key") == F.col("b_key")) & (F.col("len") == F.col("b_len")) & equal, "left")
    kept = found.where(F.col("b_len").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    hit = F.when(F.col("b_len").isNotNull(), F.struct("pos", F.col("b_len").alias("len")))
    return kept.groupBy("rid", *keys).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("b_items")))).alias("items")
    )


def covered(hits: str = "hits"):
    """Number of words in the union of sorted ``(pos, len)`` spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))

    def step(acc, h):
        end = (h["pos"] + h["len"]).cast("long")
        begin = F.greatest(acc["reach"], h["pos"].cast("long"))
        return F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), end - begin)).alias("n"), F.greatest(acc["reach"], end).alias("reach"))

    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """Digest of :func:`find_hits` per document."""
    return find_hits(docs, benchmark, n).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, mode: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents or spans; all columns stay.

    ``mode="documents"`` drops the rows with a hit. ``mode="spans"`` cuts the
    words of hits, with what stands between them and the next word, out of
    ``text``. A row is known by its id and its text, so of rows with one id, or
    without any, only those go, or are cut, whose own text has a hit.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    id_, th, hits = (unused(docs, x) for x in ("id", "th", "hits"))
    found = find_hits(own, benchmark, n, ("doc_id", "th")).where(F.size("hits") > 0)
    flagged = materialize(found.groupBy(F.col("doc_id").alias(id_), F.col("th").alias(th)).agg(F.any_value("hits").alias(hits)), "flagged")  # rows of a group have one text
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(th))
    if mode == "documents":
        return docs.join(broadcast_if_small(flagged.drop(hits), BROADCAST_ROWS), same, "left_anti")
    joined = docs.join(broadcast_if_small(flagged, BROADCAST_ROWS // 100), same, "left")
    piece = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all("text", F.lit(piece), F.lit(0))
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.filter(pieces, lambda p, i: ~F.exists(hits, lambda h: (i >= h["pos"]) & (i < h["pos"] + h["len"])))
    return joined.withColumn("text", F.when(F.col(hits).isNotNull(), F.concat(lead, F.array_join(kept, ""))).otherwise(F.col("text"))).select(*docs.columns)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with recursive dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bi as (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) s from bw where len(w) > 0),
win as (select distinct item_id, array_to_string(list_slice(w, s, s + 9), ' ') g, least(10, len(w)) k from bi),
ks as (select distinct k from win),
dp as (select doc_id, k, w, unnest(range(1, len(w) - k + 2)) s from dw, ks where len(w) >= k),
dg as (select doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') g from dp),
hit as (select d.doc_id, d.s, d.k, b.item_id from dg d join win b on b.k = d.k and b.g = d.g),
cov as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(s, s + k)) p from hit) group by doc_id),
its as (select doc_id, count(distinct item_id) n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) l from hit group by doc_id)
select dw.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(cov.n, 0) as bigint) n_hit, cast(coalesce(its.n, 0) as bigint) n_items,
  sha256(coalesce(its.l, '')) items_sha256, coalesce(cov.n, 0) > 0 contaminated
from dw left join cov on cov.doc_id = dw.doc_id left join its on its.doc_id = dw.doc_id
"""
