"""Learners on Spark ML, positive-unlabelled calibration, importances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.numbers import logit, root, shift_logit
from ..sources.sinks import write_once
from .windows import exact_quantile, numbered


def _weights(df: DataFrame, label: str, weight: str | None, balanced: bool) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    if not balanced:
        return df.withColumn("__w", w)
    sums = {r[label]: r.s for r in df.groupBy(label).agg(F.sum(w).alias("s")).collect()}  # two rows
    total = sum(sums.values())
    factor = F.when(F.col(label) == 1, total / (2 * sums.get(1, total))).otherwise(total / (2 * sums.get(0, total)))
    return df.withColumn("__w", w * factor)


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, c: float = 1.0, balanced: bool = True, tolerance: float = 1e-10):
    """Scaled features, weights, L2 penalty 1 / C."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = _weights(df, label, weight, balanced)
    n = max(rows.count(), 1)
    steps = [VectorAssembler(inputCols=list(features), outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__features", withMean=True),
             LogisticRegression(featuresCol="__features", labelCol=label, weightCol="__w", regParam=1.0 / (c * n), standardization=False, maxIter=500, tol=tolerance)]
    return Pipeline(stages=steps).fit(rows)


def logistic_gradient(model, df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, c: float = 1.0, balanced: bool = True) -> DataFrame:
    """(feature, gradient) of the penalised mean log-likelihood at a fitted model, and of its intercept: all are 0 at the optimum, whatever
    found it."""
    scaler, regression = model.stages[1], model.stages[2]
    rows = _weights(df, label, weight, balanced)
    total = rows.agg(F.sum("__w").alias("w"), F.count("*").alias("n")).first()
    miss = (F.col(label) - F.col("__s")) * F.col("__w") / F.lit(float(total.w))
    scaled = [(f, (F.col(f) - float(m)) / max(float(s), 1e-300), float(b)) for f, m, s, b in zip(features, scaler.mean, scaler.std, regression.coefficients)]
    parts = [F.struct(F.lit("intercept").alias("feature"), F.sum(miss).alias("gradient"))]
    parts += [F.struct(F.lit(f).alias("feature"), (F.sum(miss * z) - F.lit(b / (c * total.n))).alias("gradient")) for f, z, b in scaled]
    return score(model, rows, "__s").agg(F.array(*parts).alias("g")).select(F.explode("g").alias("g")).select("g.*")


@dataclass(frozen=True)
class Boosted:
    """A boosted model and how it came about."""

    model: object
    rounds: int  # trees that are kept
    limit: int
    features: tuple

    def gains(self, spark, folder: str) -> DataFrame:
        """(feature, splits, gain, share): impurity that the splits on a feature took away, summed over the rows they saw."""
        self.model.stages[-1].write().overwrite().save(folder)
        nodes = spark.read.parquet(f"{folder}/data").select("nodeData.*").where("leftChild >= 0")
        by = nodes.groupBy(F.col("split.featureIndex").alias("__i")).agg(F.count("*").alias("splits"), F.sum(F.col("gain") * F.col("rawCount")).alias("gain"))
        names = spark.createDataFrame(list(enumerate(self.features)), "__i int, feature string")
        out = names.join(by, "__i", "left").select("feature", F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("gain", F.lit(0.0)).alias("gain"))
        whole = out.agg(F.sum("gain").alias("g")).first().g or 1.0
        return out.withColumn("share", F.col("gain") / F.lit(float(whole)))


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, depth: int = 4, rounds: int = 50, rate: float = 0.05, balanced: bool = True, seed: int = 0, validation: str | None = None, tolerance: float = 0.001):
    """Gradient-boosted trees over binned features.

    ``validation`` is a flag of rows that aren't learnt from; trees are added until the loss on them no longer falls by ``tolerance`` of itself.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = _weights(df, label, weight, balanced)
    boost = GBTClassifier(featuresCol="__features", labelCol=label, weightCol="__w", maxDepth=depth, maxIter=rounds, stepSize=rate, seed=seed)
    if validation:
        boost = boost.setValidationIndicatorCol(validation).setParams(validationTol=tolerance)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__features"), boost]).fit(rows)


def fit_stopped(df: DataFrame, features: Sequence[str], label: str, group: str, rounds: int = 200, held: float = 0.2, seed: int = 0, **options) -> Boosted:
    """Boosted trees that stop early; whole groups, a share ``held`` of them drawn by their id, tell when."""
    rows = df.withColumn("__held", draws.uniform(f"stop {seed}", group) < held)
    model = fit_boosted(rows, features, label, rounds=rounds, seed=seed, validation="__held", **options)
    return Boosted(model, model.stages[-1].getNumTrees, rounds, tuple(features))


def score(model, df: DataFrame, name: str = "score") -> DataFrame:
    """Probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    columns = df.columns
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).select(*columns, name)


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, fold: str, k: int, fit=fit_logistic, **options) -> DataFrame:
    """Each row's score by the model that didn't see its fold."""
    out = None
    for i in range(k):
        part = score(fit(df.where(F.col(fold) != i), features, label, **options), df.where(F.col(fold) == i))
        out = part if out is None else out.unionByName(part)
    return out


def calibrate_sigmoid(df: DataFrame, label: str, score_: str = "score"):
    """Logistic regression on the logit of out-of-fold scores; returns a function of columns."""
    rows = df.withColumn("__z", logit(F.col(score_)))
    model = fit_logistic(rows, ["__z"], label, c=1e6, balanced=False)
    scaler, regression = model.stages[1], model.stages[2]
    slope = float(regression.coefficients[0]) / max(float(scaler.std[0]), 1e-12)
    intercept = float(regression.intercept) - slope * float(scaler.mean[0])
    return lambda c: 1 / (1 + F.exp(-(intercept + slope * logit(c))))


def elkan_noto(df: DataFrame, positive: str, score_: str = "score", prior: float | None = None) -> DataFrame:
    """C is the mean score of positives; p = min(score / c, 1); if a base rate is given, the logits
    are shifted so that p has this mean."""
    c = df.where(F.col(positive) == 1).agg(F.avg(score_).alias("c")).first().c or 1.0
    out = df.withColumn("p", F.least(F.col(score_) / c, F.lit(1.0)))
    if prior is None:
        return out
    # the mean of shifted logits by a histogram of the logits, which lie within 14 of 0: 1,800 bins at most, one pass, whatever the number of rows
    bins = [(r.b / 64, r["count"]) for r in out.groupBy(F.round(logit(F.col("p")) * 64).alias("b")).count().collect()]
    n = sum(k for _, k in bins) or 1
    import math

    gamma = root(lambda g: sum(k / (1 + math.exp(-(x + g))) for x, k in bins) / n - prior)
    return out.withColumn("p", shift_logit(F.col("p"), gamma))


def permutation_importance(df: DataFrame, key: str, features: Sequence[str], label: str, scored, metric, repeats: int = 5, seed: int = 0) -> DataFrame:
    """(feature, loss, std, repeats): how much of a metric is lost if a feature's values are dealt anew.

    ``scored(rows)`` adds a column ``score``; ``metric(rows, by)`` gives (by, value) for each ``by``.  Rows are numbered once, in an
    order drawn by their key; in each repeat a row takes the feature of the row some places on (drawn anew for each
    repeat), so every value is dealt once.  All features and repeats are scored and measured in one pass: one exchange
    brings the other rows' features, and a row becomes one for each feature where it is.
    """
    placed = numbered(df.select(key, label, *features), [key], seed=seed, name="__i").withColumn("__i", F.col("__i") - 1)
    n = df.count()
    if not n:
        raise ValueError("no rows")
    shift = F.array(*[F.struct(F.lit(r).alias("r"), (1 + draws.number(f"shift {seed}", F.lit(r)) % F.lit(max(n - 1, 1))).alias("by")) for r in range(repeats)])
    donor = placed.select(F.col("__i").alias("__at"), F.struct(*features).alias("__new"))
    asked = placed.withColumn("__s", F.explode(shift)).withColumn("__at", (F.col("__i") + F.col("__s.by")) % n)
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.struct(*[F.col(f"__new.{f}" if f == g else g).alias(g) for g in features]).alias("x")) for k, f in enumerate(features)])
    dealt = asked.join(donor, "__at").select(label, F.col("__s.r").alias("r"), F.explode(each).alias("e")).select(label, (F.col("e.k") * repeats + F.col("r")).alias("__by"), "e.x.*")
    whole = placed.select(label, F.lit(-1).alias("__by"), *features)
    value = metric(scored(dealt.unionByName(whole)), "__by").where("value is not null")
    base = value.where("__by = -1").select(F.col("value").alias("__base"))
    loss = value.where("__by >= 0").join(F.broadcast(base), F.lit(True)).select(F.floor(F.col("__by") / repeats).cast("int").alias("__k"), (F.col("__base") - F.col("value")).alias("loss"))
    out = loss.groupBy("__k").agg(F.avg("loss").alias("loss"), F.stddev_pop("loss").alias("std"), F.count("*").alias("repeats"))
    return out.select(F.element_at(F.array(*[F.lit(f) for f in features]), F.col("__k") + 1).alias("feature"), "loss", "std", "repeats")


def accuracy(rows: DataFrame, by: str, label: str, threshold: float = 0.5) -> DataFrame:
    """A metric for ``permutation_importance``: share of rows on the right side."""
    return rows.groupBy(by).agg(F.avg(((F.col("score") >= threshold).cast("int") == F.col(label)).cast("double")).alias("value"))


def area(rows: DataFrame, by: str, label: str) -> DataFrame:
    """A metric for ``permutation_importance``: the ROC AUC."""
    from .audit import weighted_metrics

    return weighted_metrics(rows.withColumn("__one", F.lit(1)), by, label, "score", "__one").select(by, F.col("roc_auc").alias("value"))


def rate_matched_threshold(df: DataFrame, score_: str, rate: float) -> float:
    """The threshold that flags a given share."""
    return exact_quantile(df, score_, 1 - rate)


def surrogate_scores(labelled: DataFrame, population: DataFrame, key: str, features: Sequence[str], label: str, rate: float, fit=fit_logistic, **options) -> DataFrame:
    """A model of the labelled rows scores the others of a population, which then are flagged at a given rate."""
    others = population.join(labelled.select(key).distinct(), key, "left_anti")
    scored = score(fit(labelled, features, label, **options), others)
    threshold = rate_matched_threshold(scored, "score", rate)
    return scored.withColumn("flagged", (F.col("score") >= F.lit(threshold)).cast("int"))


def one_shot(spark, path: str, config: dict, digest: str, test) -> DataFrame:
    """A frozen configuration is tested once: an error if it isn't the one that was frozen, or was tested before;
    what ``test()`` gives is written and read from there."""
    if freeze(config) != digest:
        raise ValueError("the configuration isn't the frozen one")
    place = f"{path.rstrip('/')}/{digest}"
    write_once(test(), place)
    return spark.read.parquet(place)


def freeze(config: dict) -> str:
    """Digest of a configuration that a later test has to name."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, allow_nan=False).encode()).hexdigest()
