"""Evaluation statistics as aggregations."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from .windows import average_rank, running_sums, short


def confusion(df: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and what follows from them."""
    y, p = F.col(label), F.col(predicted)
    n = lambda a, b: F.count_if((y == a) & (p == b))
    counts = df.groupBy(*keys).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"))
    return derived(counts)


def derived(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    recall, specificity, precision = safe(tp, tp + fn), safe(tn, tn + fp), safe(tp, tp + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns({
        "precision": precision, "recall": recall, "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2,
        "f1": safe(2 * tp, 2 * tp + fp + fn), "mcc": safe(tp * tn - fp * fn, root), "accuracy": safe(tp + tn, tp + tn + fp + fn)})


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """By ranks, equal scores sharing theirs."""
    r = average_rank(df, score, "__r")
    p, n = F.count_if(F.col(label) == 1).cast("double"), F.count_if(F.col(label) == 0).cast("double")
    s = F.sum(F.when(F.col(label) == 1, F.col("__r")))
    return r.where(F.col(label).isNotNull()).agg(((s - p * (p + 1) / 2) / F.when(p * n > 0, p * n)).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of precision over the gains of recall, equal scores taken together."""
    by = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count("*").alias("n"))
    run = running_sums(by.withColumns({"tp": F.col("p"), "all": F.col("n")}), score, ["tp", "all"], descending=True)
    return run.agg((F.sum(F.col("p") * F.col("tp") / F.col("all")) / F.when(F.sum("p") > 0, F.sum("p"))).alias("average_precision"))


def brier(label: Column, score: Column) -> Column:
    return F.avg((label - score) * (label - score))


def sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Counts and metrics for each threshold, in one pass over the rows."""
    each = df.select(label, score, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    out = confusion(each.withColumn("__p", (F.col(score) >= F.col("threshold")).cast("int")), label, "__p", ["threshold"])
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return out.withColumn("flag_rate", (F.col("tp") + F.col("fp")) / n)


def choose_threshold(df: DataFrame, label: str, score: str, rule: str = "highest") -> DataFrame:
    """Of all scores as thresholds, and one above 1, the best by balanced accuracy, then F1, then the
    higher threshold (or the one nearest to a half)."""
    by = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    total = by.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    above = df.sparkSession.createDataFrame([(1.0000000000000002, 0, 0)], by.schema)
    run = running_sums(by.unionByName(above).toDF("threshold", "tp", "fp"), "threshold", ["tp", "fp"], descending=True)
    run = derived(run.withColumns({"fn": F.lit(total.p or 0) - F.col("tp"), "tn": F.lit(total.n or 0) - F.col("fp")}))
    last = F.col("threshold") if rule == "highest" else -F.abs(F.col("threshold") - 0.5)
    return run.agg(F.max_by(F.struct("threshold", "balanced_accuracy", "f1"), F.struct("balanced_accuracy", "f1", last)).alias("b")).select("b.*")


def youden(df: DataFrame, label: str, score: str) -> DataFrame:
    """The threshold with the greatest TPR - FPR."""
    by = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    total = by.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    run = running_sums(by, "threshold", ["p", "n"], descending=True)
    j = F.col("p") / F.lit(float(max(total.p or 0, 1))) - F.col("n") / F.lit(float(max(total.n or 0, 1)))
    return run.select("threshold", j.alias("j")).agg(F.max("j").alias("j"), F.max_by("threshold", F.struct("j", "threshold")).alias("threshold"))


def youden_out_of_fold(df: DataFrame, label: str, score: str, fold: str, k: int) -> DataFrame:
    """``threshold`` and ``predicted`` of each row, by the threshold that is best on the other folds."""
    out = None
    for i in range(k):
        t = youden(df.where(F.col(fold) != i), label, score).select(F.lit(i).alias(fold), "threshold")
        out = t if out is None else out.unionByName(t)
    rows = df.join(F.broadcast(out), fold)  # a row for each fold
    return rows.withColumn("predicted", (F.col(score) >= F.col("threshold")).cast("int"))


def cohens_d(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Difference of means over the pooled deviation, for each feature."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select(label, "x.*")
    of = lambda f, y: f(F.when(F.col(label) == y, F.col("v")))
    m = long.groupBy("feature").agg(*[of(f, y).alias(f"{n}{y}") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)) for y in (0, 1)])
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    return m.select("feature", F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled).alias("d"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's r of average ranks."""
    ok = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_rank(average_rank(ok, a, "__a"), b, "__b")
    return ranked.agg(F.corr("__a", "__b").alias("rho"), F.count("*").alias("n"))


def spearman_test(df: DataFrame, a: str, b: str, steps: int = 20_000) -> DataFrame:
    """One row: rho, number of pairs, and the two-sided p of Student's t with n - 2 degrees of freedom.

    p is a ratio of integrals of sin(t) ** (n - 3), whose middles of equal steps are summed: from 0 to the angle whose squared sine
    is 1 - rho ** 2, over that to a right angle.
    """
    row = spearman(df, a, b)
    power = F.col("n").cast("double") - 3
    upto = lambda end: F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda s, k: s + F.pow(F.sin((k + 0.5) * end / steps), power)) * end
    rest = F.greatest(F.lit(0.0), 1 - F.col("rho") * F.col("rho"))
    p = F.when(rest <= 0, 0.0).otherwise(F.least(F.lit(1.0), upto(F.asin(F.sqrt(rest))) / upto(F.lit(math.pi / 2))))
    return row.select("rho", "n", F.when(F.col("rho").isNotNull() & (F.col("n") >= 3), p).alias("p"))


def by_year(df: DataFrame, year: str, label: str, predicted: str, least: int = 5) -> DataFrame:
    """Metrics of years with enough of both classes."""
    out = confusion(df, label, predicted, [year])
    return out.where((F.col("tp") + F.col("fn") >= least) & (F.col("fp") + F.col("tn") >= least))


def bootstrap(df: DataFrame, metric: Callable[[DataFrame, str], DataFrame], resamples: int = 200, seed: int = 0, key: str = "sample_id") -> DataFrame:
    """2.5th and 97.5th percentile of a metric over resamples: ``metric(rows, weight column)`` aggregates
    by ``__b``, null if it has none (a resample of one class), which leaves that resample out.  Each row has a Poisson weight for each resample,
    drawn from a hash: no row is copied to the driver."""
    weight = draws.poisson(draws.uniform(seed, key, "__b"))
    rows = df.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("__w", weight).where("__w > 0")
    values = metric(rows, "__w").where("value is not null")
    return values.agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.count("*").alias("resamples"))


def paired_gain(df: DataFrame, label: str, a: str, b: str, resamples: int = 200, seed: int = 0, key: str = "sample_id") -> DataFrame:
    """Bootstrap of the gain in balanced accuracy of predictions ``b`` over ``a``."""

    def metric(rows: DataFrame, w: str) -> DataFrame:
        hit = lambda c, y: F.sum(F.when((F.col(label) == y) & (F.col(c) == y), F.col(w)).otherwise(0)) / F.sum(F.when(F.col(label) == y, F.col(w)))
        return rows.groupBy("__b").agg(((hit(b, 1) + hit(b, 0) - hit(a, 1) - hit(a, 0)) / 2).alias("value"))

    return bootstrap(df, metric, resamples, seed, key)


def pu_curve(df: DataFrame, positive: str, score: str, prior: float, points: int = 201) -> DataFrame:
    """At each threshold recall r over positives and flagged share f: precision ~ r * prior / f and
    false positive rate ~ (f - r * prior) / (1 - prior)."""
    grid = [k / (points - 1) for k in range(points)]
    each = df.select(positive, score, F.explode(F.array(*[F.lit(t) for t in grid])).alias("threshold"))
    hit = (F.col(score) >= F.col("threshold")).cast("double")
    c = each.groupBy("threshold").agg(F.avg(F.when(F.col(positive) == 1, hit)).alias("recall"), F.avg(hit).alias("flagged"))
    r, f = F.col("recall"), F.col("flagged")
    return c.withColumn("precision", F.when(f > 0, F.least(F.lit(1.0), r * prior / f))).withColumn("fpr", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (f - r * prior) / (1 - prior))))


def trapezoid(df: DataFrame, x: str, y: str) -> DataFrame:
    """Area below sorted points; a curve is short, which is checked."""
    df = short(df)
    w = Window.orderBy(x, y)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(part.alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("area"))


def wilcoxon(df: DataFrame, before: str, after: str) -> DataFrame:
    """Signed ranks of paired differences, ties averaged, with the normal approximation's z."""
    d = df.select((F.col(after) - F.col(before)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    r = average_rank(d, "m", "r")
    n = F.count("*").cast("double")
    plus = F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0))
    return r.agg(plus.alias("w_plus"), n.alias("n"), ((plus - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("z"))
