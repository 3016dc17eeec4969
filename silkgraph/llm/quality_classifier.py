"""Document quality by hierarchical empirical Bayes.

A document's own evidence comes from two logistic models (low quality, toxic)
over shape features and a learnt lexicon. Sites add theirs: grouped sums of
the documents' probabilities give each host a posterior that is shrunk to the
global rate, and each path of a host one that is shrunk to its host's; how
strongly is estimated from the spread between sites, so sparse sites hardly
move. A document's log odds shift by what its site's posterior differs from
the global rate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silkgraph.llm.common import LOWER, UPPER, broadcast_if_small, materialize, norm_words, table, unused

#: Labelled documents that the models are fitted on: about this many, those with the smallest hashes of their id.
FIT_DOCS = 6000
#: A lexicon word occurs in so many of the sample's toxic documents (and this share of them), and its share of toxic words has such log odds over that of others, with such a z score; at most so many words.
LEXICON_DOCS, LEXICON_SHARE, LEXICON_ODDS, LEXICON_Z, LEXICON_WORDS = 5, 0.02, 2.5, 5.0, 2000
#: Bounds of the strength of a prior, in documents.
STRENGTH = (5.0, 10_000.0)
#: Sites that may be broadcast.
BROADCAST_SITES = 200_000

SYMBOLS = b"#*$%&|<>~^=+_{}[]@\\/!"
_WORDS = bytes(ord(LOWER[UPPER.index(chr(i))]) if chr(i) in UPPER else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Occurrences of a word in one document that the lexicon counts.
MOST_IN_A_DOC = 5
#: Words whose weights a worker remembers.
CACHE = 500_000
#: Lengths of word beginnings that the lexicon holds beside whole words; they end in an asterisk there.
PREFIXES = (7, 6, 5, 4)
FEATURES = ("log_words", "word_length", "upper", "symbols", "symbol_words", "distinct", "dup_lines", "digits", "short_lines", "top_word")


class Lexicon(dict):
    """Weights of words (UTF-8): of the word and its beginnings the entry with the largest z score counts; 0 without one."""

    def __init__(self, entries: dict[str, tuple[float, float]]):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHE:
            self.clear()
        text = word.decode()
        found = [self.entries.get(text), *[self.entries.get(text[:k] + "*") for k in PREFIXES if len(text) >= k]]
        self[word] = weight = max((e for e in found if e), default=(0.0, 0.0))[1]
        return weight


def features(text: str | None, lexicon: Lexicon) -> tuple[list[float], list[float], int]:
    """Shape features, lexicon features (summed weight, length, weight by length, root of hits, largest weight), number of words."""
    raw = text.encode() if isinstance(text, str) else b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES), [0.0] * 5, 0
    size = sum(map(len, words))
    plain = raw.translate(None, SYMBOLS)
    letters = len(raw) - len(raw.translate(None, (LOWER + UPPER).encode()))
    uppers = len(raw) - len(raw.translate(None, UPPER.encode()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    hits = list(filter(None, map(lexicon.__getitem__, raw.translate(_WORDS).split()))) if lexicon.entries else []
    counts = Counter(words)
    distinct, common = len(counts), max(counts.values())
    shape = [
        np.log(n), size / n / 10, uppers / max(1, letters), (len(raw) - len(plain)) / size, 1 - len(plain.split()) / n, distinct / n**0.8,
        1 - len(set(lines)) / max(1, len(lines)), (len(raw) - len(raw.translate(None, b"0123456789"))) / size, sum(len(x) < 20 for x in lines) / max(1, len(lines)), common / n,
    ]
    return shape, [sum(hits), n / 100, 100 * sum(hits) / (n + 20), np.sqrt(len(hits)), max(hits, default=0.0)], n


class Logistic:
    """Ridge logistic regression on standardised features, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._design(x)
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z**2], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.w, -20, 20)


class Constant:
    """Stands in where the labels are of one kind or missing."""

    def __init__(self, logit: float):
        self.value = logit

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fit_head(x: np.ndarray, y: np.ndarray) -> Logistic | Constant:
    if len(y) < 10 or y.min() == y.max():
        return Constant(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -3.0))
    return Logistic(x, y)


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS) -> tuple[dict[str, tuple[float, float]], Logistic | Constant, Logistic | Constant]:
    """Lexicon, model of low quality and model of toxicity from a bounded sample of labelled documents."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    place = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) / float(1 << 30)
    total = known.count()
    sample = F.broadcast(known.where(place < min(1.0, limit / max(1, total))))  # about `limit` rows
    labelled = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("__id"))
    # copies and near copies would lend their words too much weight: one document for each smallest shingle
    w = norm_words(F.col("text"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1)))
    least = F.array_min(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(4)), " "))))
    one = labelled.withColumn("w", w).groupBy(least.alias("k")).agg(F.min_by(F.struct("text", "quality", "toxic"), F.struct("doc_id", F.xxhash64("text"))).alias("d"))
    chosen = materialize(one.select("d.*"), "labelled")
    whole = norm_words(F.col("text"))

    def beginnings(k: int) -> Column:
        return F.transform(F.filter(whole, lambda x: F.length(x) >= k), lambda x: F.concat(F.substring(x, 1, k), F.lit("*")))

    judged = chosen.where("toxic in (0, 1)").withColumn("id", F.monotonically_increasing_id())
    sizes = {r["toxic"]: r for r in judged.groupBy("toxic").agg(F.count("*").alias("docs"), F.sum(F.size(whole)).alias("words")).collect()}
    entries: dict[str, tuple[float, float]] = {}
    if len(sizes) == 2:
        counts = judged.select("id", "toxic", F.explode(F.concat(whole, *map(beginnings, PREFIXES))).alias("w")).groupBy("w", "id", "toxic").agg(F.least(F.count("*"), F.lit(MOST_IN_A_DOC)).alias("n"))
        of = lambda kind, x: F.sum(F.when(F.col("toxic") == kind, x).otherwise(0))
        both = counts.groupBy("w").agg(of(1, F.lit(1)).alias("a"), of(1, F.col("n")).alias("x"), of(0, F.col("n")).alias("y"))
        bad, good = sizes[1], sizes[0]
        weight = F.log((F.col("x") + 0.5) / (bad["words"] + 1)) - F.log((F.col("y") + 0.5) / (good["words"] + 1))
        z = weight / F.sqrt(1 / (F.col("x") + 0.5) + 1 / (F.col("y") + 0.5))
        telling = both.where(F.col("a") >= max(LEXICON_DOCS, LEXICON_SHARE * bad["docs"])).select("w", z.alias("z"), weight.alias("weight")).where((F.col("weight") >= LEXICON_ODDS) & (F.col("z") >= LEXICON_Z))
        entries = {r["w"]: (r["z"], r["weight"]) for r in telling.orderBy(F.desc("z"), "w").limit(LEXICON_WORDS).collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(entries)
        for pdf in batches:
            rows = [features(t, lexicon) for t in pdf["text"]]
            yield pd.DataFrame({"x": [s + l for s, l, _ in rows], "n": [n for _, _, n in rows], "quality": pdf["quality"], "toxic": pdf["toxic"]})

    rows = chosen.mapInPandas(run, "x array<double>, n long, quality int, toxic int").where("n > 0").toPandas()
    k = len(FEATURES)
    x = np.array(rows["x"].tolist(), float).reshape(-1, k + 5)
    q, t = rows["quality"].notna().to_numpy(), rows["toxic"].notna().to_numpy()
    low = fit_head(x[q][:, :k], 1.0 - rows["quality"].to_numpy(float)[q])
    toxic = fit_head(x[t][:, k:], rows["toxic"].to_numpy(float)[t])
    return entries, low, toxic


def score(docs: DataFrame, model: tuple, host: str, path: str) -> DataFrame:
    """``doc_id, th, host, path, low, toxic``: log odds from each document's own text.

    Texts without words get the log odds 20 of low quality.
    """
    entries, low, toxic = model
    k = len(FEATURES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(entries)
        for pdf in batches:
            rows = [features(t, lexicon) for t in pdf["text"]]
            x = np.array([s + l for s, l, _ in rows], float).reshape(-1, k + 5)
            empty = np.array([n == 0 for _, _, n in rows], bool)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "th": pdf["th"], "host": pdf["host"], "path": pdf["path"],
                "low": np.where(empty, 20.0, low.logit(x[:, :k])), "toxic": np.where(empty, -20.0, toxic.logit(x[:, k:])),
            })

    site = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text", site(host).alias("host"), site(path).alias("path"))
    return rows.mapInPandas(run, "doc_id long, th long, host string, path string, low double, toxic double")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(rate: Column, n: Column, mean: Column) -> Column:
    """Documents that a prior counts for, from the spread of rates over the sites below it (moments)."""
    spread = F.sum(n * (rate - mean) ** 2) / F.sum(n)
    noise = F.sum(n * mean * (1 - mean) / F.greatest(n, F.lit(1.0))) / F.sum(n)
    between = F.greatest(spread - noise, F.lit(1e-9))
    return F.least(F.greatest(F.max(mean * (1 - mean)) / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def site_posteriors(scores: DataFrame, heads: tuple[str, ...] = ("low", "toxic")) -> DataFrame:
    """``host, path`` with, per head, the log odds of the path's posterior less those of the global rate (``shift_*``) and the posterior (``site_*``).

    Grouped sums only; the global figures are one row.
    """
    sums = [F.sum(sigmoid(F.col(h))).alias(f"s_{h}") for h in heads]
    paths = materialize(scores.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), *sums), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), *[F.sum(f"s_{h}").alias(f"h_{h}") for h in heads])
    means = hosts.agg(*[((F.sum(f"h_{h}") + 0.5) / (F.sum("n_host") + 1)).alias(f"m_{h}") for h in heads])
    global_ = F.broadcast(means)
    wide = hosts.crossJoin(global_)  # one row on the right
    k_host = wide.agg(*[strength(F.col(f"h_{h}") / F.col("n_host"), F.col("n_host"), F.col(f"m_{h}")).alias(f"k_{h}") for h in heads])
    posterior = lambda k, m, s, n: (k * m + s) / (k + n)
    shrunk = wide.crossJoin(F.broadcast(k_host))
    for h in heads:
        shrunk = shrunk.withColumn(f"p_{h}", posterior(F.col(f"k_{h}"), F.col(f"m_{h}"), F.col(f"h_{h}"), F.col("n_host")))
    shrunk = shrunk.select("host", *[f"{x}_{h}" for x in ("m", "p") for h in heads])
    below = paths.join(shrunk, "host")
    k_path = below.agg(*[strength(F.col(f"s_{h}") / F.col("n"), F.col("n"), F.col(f"p_{h}")).alias(f"c_{h}") for h in heads])
    out = below.crossJoin(F.broadcast(k_path))
    cols = []
    for h in heads:
        p = posterior(F.col(f"c_{h}"), F.col(f"p_{h}"), F.col(f"s_{h}"), F.col("n"))
        cols += [p.alias(f"site_{h}"), (logit(p) - logit(F.col(f"m_{h}"))).alias(f"shift_{h}")]
    return out.select("host", "path", *cols)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``doc_id, th, p_low, p_toxic, site_low, site_toxic, kept`` per row of ``docs``.

    ``host`` and ``path`` name the columns that place a document in a site and
    below it; where a column is missing or null, the site is the empty one.
    ``th`` is the text's xxhash64. A document is rejected if either posterior
    is at least one half; texts without words always are. Repeated rows give a
    row each.
    """
    scores = materialize(score(docs, fit(docs, labels), host, path), "scores")
    sites = materialize(site_posteriors(scores), "posteriors")
    rows = scores.join(broadcast_if_small(sites, BROADCAST_SITES), ["host", "path"])
    low = F.when(F.col("low") >= 20, 1.0).otherwise(sigmoid(F.col("low") + F.col("shift_low")))
    toxic = sigmoid(F.col("toxic") + F.col("shift_toxic"))
    out = rows.select("doc_id", "th", low.alias("p_low"), toxic.alias("p_toxic"), "site_low", "site_toxic")
    return out.withColumn("kept", (F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` without the rows that :func:`classify` rejects; all columns stay.

    A row stays if a row of its id and text is kept: equal texts of one id on
    different sites stay or go together. Texts without words always go.
    """
    id_, th = unused(docs, "id"), unused(docs, "th")
    good = classify(docs, labels, host, path).where("kept").select(F.col("doc_id").alias(id_), F.col("th").alias(th)).distinct()
    return docs.join(good, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(th)), "left_semi")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")
