"""Classifiers on labelled feature vectors ``row_id, x, label`` (label 0 or 1).

Training is a grouped sum over (label, dimension); a model is as long as a
vector, so prediction is a narrow pass with the model as literals.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkgraph.functions.ranking import global_rank
from silkgraph.functions.scalar import dot, gcd_all, quantise


def quantised(rows: DataFrame, digits: int = 2, dims: int | None = None) -> DataFrame:
    x = F.slice("x", F.lit(1), F.lit(dims)) if dims else F.col("x")
    return rows.withColumn("x", F.transform(x, lambda v: quantise(v, digits)))


def class_sums(rows: DataFrame) -> DataFrame:
    """``label, dim, s, n``."""
    return rows.select("label", F.posexplode("x").alias("dim", "v")).groupBy("label", "dim").agg(F.sum("v").alias("s"), F.count("*").alias("n"))


def centroids(rows: DataFrame, digits: int = 2, dims: int | None = None) -> DataFrame:
    """``dim, m0, m1``: whole means of the quantised features by class, cut toward zero."""
    mean = lambda k: F.expr(f"cast(sum(if(label = {k}, s, 0)) div nullif(sum(if(label = {k}, n, 0)), 0) as bigint)")
    return class_sums(quantised(rows, digits, dims)).groupBy("dim").agg(mean(0).alias("m0"), mean(1).alias("m1"))


def _model(means: DataFrame) -> tuple[list[int], list[int]]:
    got = means.orderBy("dim").collect()  # as long as a vector
    return [r["m0"] or 0 for r in got], [r["m1"] or 0 for r in got]


def _longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<bigint>") if values else F.array().cast("array<bigint>")


def centroid_predict(train: DataFrame, rows: DataFrame, shortcut: bool = False) -> DataFrame:
    """``row_id, score, pred``: 1 where the class-1 mean is strictly nearer (squared distance).

    ``shortcut`` also answers 1 where the first feature is 0.2 or more.
    """
    m0, m1 = _model(centroids(train))
    total, diff = _longs([a + b for a, b in zip(m0, m1, strict=True)]), _longs([a - b for a, b in zip(m0, m1, strict=True)])
    doubled = F.zip_with("x", total, lambda x, t: 2 * x - t)
    scored = quantised(rows).select("row_id", F.col("x")[0].alias("x0"), dot(doubled, diff).alias("score"))
    near = F.col("score") < 0
    return scored.select("row_id", "score", ((near | (F.col("x0") >= 200)) if shortcut else near).cast("int").alias("pred"))


def centroid_l1_predict(train: DataFrame, rows: DataFrame, dims: int = 48, margin: int = 300) -> DataFrame:
    """Nearest class mean by absolute distance on the first ``dims`` features, one decimal each; 1 within a margin."""
    m0, m1 = _model(centroids(train, 1, dims))
    away = lambda m: dot(F.col("x"), _longs(m), lambda x, y: F.abs(x - y))
    return quantised(rows, 1, dims).select("row_id", (away(m1) - away(m0)).alias("score")).select("row_id", "score", (F.col("score") < margin).cast("int").alias("pred"))


def below_quantile(scored: DataFrame, share: float, inclusive: bool = False) -> DataFrame:
    """``pred`` 0 for scores below the value at rank ``floor(share * n)`` (or equal to it), else 1."""
    ranked = global_rank(scored.select("score"), F.col("score"))
    cut = ranked.where(F.col("rank") == math.floor(share * scored.count())).first()
    bound = F.lit(cut["score"] if cut else 0)
    return scored.select("row_id", "score", F.when(F.col("score") <= bound if inclusive else F.col("score") < bound, 0).otherwise(1).alias("pred"))


def linear_quantile_predict(train: DataFrame, rows: DataFrame, share: float = 0.047) -> DataFrame:
    """Score by the difference of the class means; the lowest ``share`` of scores is class 0."""
    m0, m1 = _model(centroids(train, 1))
    w = _longs([b - a for a, b in zip(m0, m1, strict=True)])
    return below_quantile(quantised(rows, 1).select("row_id", dot(F.col("x"), w).alias("score")), share)


def signed_sum_predict(train: DataFrame, rows: DataFrame, share: float = 0.32) -> DataFrame:
    """Score by class-1 sums less class-0 sums, centred and reduced by their gcd; scores up to the quantile are class 0."""
    got = class_sums(quantised(train, 1)).groupBy("dim").agg(F.sum(F.when(F.col("label") == 1, F.col("s")).otherwise(-F.col("s"))).alias("c")).orderBy("dim").collect()
    c = [r["c"] for r in got]
    centred = [len(c) * x - sum(c) for x in c]
    w = [x // gcd_all(centred) for x in centred]
    return below_quantile(quantised(rows, 1).select("row_id", dot(F.col("x"), _longs(w)).alias("score")), share, inclusive=True)


def nb_predict(train: DataFrame, rows: DataFrame, dims: int | None = None) -> DataFrame:
    """Multinomial naive Bayes on non-negative quantised features, add-one smoothing."""
    positive = lambda df: df.withColumn("x", F.transform("x", lambda v: F.greatest(v, F.lit(0).cast("bigint"))))
    sums = {(r["label"], r["dim"]): r["s"] for r in class_sums(positive(quantised(train, 1, dims))).collect()}  # two rows a dimension
    sizes = dict(train.groupBy("label").count().collect())
    d = max((k for _, k in sums), default=-1) + 1
    total = [sum(sums.get((y, k), 0) for k in range(d)) for y in (0, 1)]
    w = [math.log(sums.get((1, k), 0) + 1) - math.log(total[1] + 1) - math.log(sums.get((0, k), 0) + 1) + math.log(total[0] + 1) for k in range(d)]
    bias = math.log(max(1, sizes.get(1, 0))) - math.log(max(1, sizes.get(0, 0)))
    score = dot(F.col("x"), F.lit(w).cast("array<double>"), zero=F.lit(0.0)) + bias
    return positive(quantised(rows, 1, dims)).select("row_id", score.alias("score")).select("row_id", F.round("score", 6).alias("score"), (F.col("score") > 0).cast("int").alias("pred"))


def zscore_stats(rows: DataFrame) -> DataFrame:
    """``dim, mean, var``: mean and sample variance of each feature."""
    return rows.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.var_samp("v"), 6).alias("var"))


def logreg_predict(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Logistic regression on standardised features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    vec = lambda df: df.withColumn("features", array_to_vector("x"))
    model = LogisticRegression(maxIter=50, regParam=1e-3, standardization=True).fit(vec(train).select("features", F.col("label").cast("double").alias("label")))
    return model.transform(vec(rows)).select("row_id", F.col("prediction").cast("int").alias("pred"))


#: Rows that a sequential fit may collect: it takes the first rows of a table, in order.
SGD_ROWS = 20_000


def sgd_weights(x: np.ndarray, y: np.ndarray, batch: int, rate: float, passes: int, start: float, keep_gradient: bool) -> np.ndarray:
    """Weights of a logistic model after batches taken in order; a last batch that is not full counts too.

    With ``keep_gradient`` the gradient of a batch (a mean) is added to those
    of all batches before, as momentum without decay; otherwise it is a sum.
    """
    w, g = np.full(x.shape[1], start), np.zeros(x.shape[1])
    for _ in range(passes):
        for at in range(0, len(x), batch):
            a, b = x[at : at + batch], y[at : at + batch]
            step = (1 / (1 + np.exp(-np.clip(a @ w, -500, 500))) - b) @ a
            g = g + step / batch if keep_gradient else step
            w = w - rate * g
    return w


def _prefix(train: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > SGD_ROWS:
        raise ValueError(f"a sequential fit takes at most {SGD_ROWS} rows")
    rows = first_rows(train, n).select("row_id", "x", "label").orderBy("row_id").collect()
    width = len(rows[0]["x"]) if rows else 0
    return np.array([r["x"] for r in rows], float).reshape(len(rows), width), np.array([r["label"] for r in rows], float)


def _doubles(values: np.ndarray) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>") if len(values) else F.array().cast("array<double>")


def sgd_predict(train: DataFrame, rows: DataFrame, n: int = 8000, batch: int = 8, rate: float = 0.00125, start: float = 0.25) -> DataFrame:
    """``row_id, score, pred``: logistic regression without a bias, one pass over the first ``n`` rows in small batches; 1 from score 0 on."""
    x, y = _prefix(train, n)
    if not len(x):
        return rows.select("row_id", F.lit(0.0).alias("score"), F.lit(1).alias("pred"))
    w = sgd_weights(x, y, batch, rate, 1, start, False)
    scored = rows.select("row_id", F.round(dot(F.col("x"), _doubles(w), zero=F.lit(0.0)), 9).alias("score"))
    return scored.withColumn("pred", (F.col("score") >= 0).cast("int"))


def zscore_sgd_predict(train: DataFrame, rows: DataFrame, n: int = 1900, batch: int = 32, rate: float = 0.4, passes: int = 2) -> DataFrame:
    """``row_id, score, pred``: logistic regression with a bias on standardised features of the first ``n`` rows; gradients add up from batch to batch."""
    x, y = _prefix(train, n)
    if not len(x):
        return rows.select("row_id", F.lit(0.0).alias("score"), F.lit(0).alias("pred"))
    mean, scale = x.mean(0), np.sqrt(x.var(0))
    scale[scale == 0] = 1.0
    w = sgd_weights(np.column_stack([(x - mean) / scale, np.ones(len(x))]), y, batch, rate, passes, 0.0, True)
    own = w[:-1] / scale
    score = dot(F.col("x"), _doubles(own), zero=F.lit(0.0)) + F.lit(float(w[-1] - own @ mean))
    return rows.select("row_id", F.round(score, 9).alias("score")).withColumn("pred", (F.col("score") > 0).cast("int"))


def accuracy(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """``n, n_right, accuracy``."""
    both = predictions.join(truth.select("row_id", "label"), "row_id")
    right = F.sum((F.col("pred") == F.col("label")).cast("long"))
    return both.agg(F.count("*").alias("n"), right.alias("n_right"), F.round(right / F.count("*"), 6).alias("accuracy"))


def confusion(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    return predictions.join(truth.select("row_id", "label"), "row_id").groupBy("label", "pred").agg(F.count("*").alias("n"))


def non_negative(rows: DataFrame) -> DataFrame:
    """Training rows without a negative feature."""
    return rows.where(F.forall("x", lambda v: v >= 0))


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The training sample of the first ``n`` rows; ids are row numbers, as the readers give them."""
    return rows.where(F.col("row_id") < n)
