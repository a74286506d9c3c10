"""A detector held against households it has never seen, and against itself before and after an installation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.numbers import clip, shift_logit
from .windows import average_rank

THRESHOLD, RESAMPLES, LEAST_PAIRS = 0.5, 2000, 5
#: Pairs up to which the signed-rank test counts all signs.
EXACT_PAIRS = 50
METRICS = ("balanced_accuracy", "roc_auc", "average_precision")


def calibrated(score: Column, c: float, gamma: float) -> Column:
    """The final model's score as a probability: over the mean score of positives, then shifted on the logit scale."""
    return shift_logit(clip(score / c, 0.0, 1.0), gamma)


def weighted_metrics(rows: DataFrame, by: str, label: str, score: str, weight: str, threshold: float = THRESHOLD) -> DataFrame:
    """For each ``by``: balanced accuracy, ROC AUC and average precision of weighted rows.  Equal scores are taken
    together first; a group without one of the classes has no row."""
    w = F.col(weight).cast("double")
    of = lambda y: F.sum(F.when(F.col(label) == y, w).otherwise(0.0))
    each = rows.groupBy(by, F.col(score).alias("s")).agg(of(1).alias("p"), of(0).alias("n"))
    below, above = Window.partitionBy(by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = each.withColumns({"less": F.coalesce(F.sum("n").over(below), F.lit(0.0)), "tp": F.sum("p").over(above), "fp": F.sum("n").over(above)})
    hit, total = lambda x, up: F.sum(F.when(F.col("s") >= threshold if up else F.col("s") < threshold, F.col(x)).otherwise(0.0)), lambda x: F.sum(x)
    out = run.groupBy(by).agg(
        total("p").alias("__p"), total("n").alias("__n"), hit("p", True).alias("__tp"), hit("n", False).alias("__tn"),
        F.sum(F.col("p") * (F.col("less") + F.col("n") / 2)).alias("__auc"), F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)).alias("__ap"))
    p, n = F.col("__p"), F.col("__n")
    return out.where((p > 0) & (n > 0)).select(by, ((F.col("__tp") / p + F.col("__tn") / n) / 2).alias("balanced_accuracy"), (F.col("__auc") / (p * n)).alias("roc_auc"), (F.col("__ap") / p).alias("average_precision"))


def metric_intervals(rows: DataFrame, key: str, label: str, score: str, resamples: int = RESAMPLES, seed: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """One row: 2.5th and 97.5th percentile of each metric over resamples with Poisson weights; resamples with one class only are left out."""
    drawn = rows.select(key, label, score, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("__b"))
    weighted = drawn.withColumn("__w", draws.poisson(draws.uniform(seed, key, "__b"))).where("__w > 0")
    each = weighted_metrics(weighted, "__b", label, score, "__w", threshold)
    return each.agg(*[F.percentile(m, q).alias(f"{m}_{n}") for m in METRICS for n, q in (("low", 0.025), ("high", 0.975))], F.count("*").alias("resamples"))


def households(labels: DataFrame, key: str = "gp_nr") -> DataFrame:
    """A household is what any of its rows says."""
    flag = lambda c: F.max(F.coalesce(F.col(c), F.lit(False))).alias(c)
    return labels.groupBy(key).agg(*[flag(c) for c in ("battery_positive", "audit_negative", "has_pv_row", "has_meter")], F.min("battery_commissioning_date").alias("commissioned"))


def _latest(rows: DataFrame, key: str, year: str, first: bool = False) -> DataFrame:
    """The last (or first) year's row of each household."""
    pick = F.min_by if first else F.max_by
    return rows.groupBy(key).agg(pick(F.struct(*[F.col(c) for c in rows.columns if c != key]), year).alias("r")).select(key, "r.*")


def control_rows(oof: DataFrame, labels: DataFrame, years: DataFrame, score: Column, c: float = 1.0, gamma: float = 0.0, least_months: int = 6, key: str = "gp_nr") -> DataFrame:
    """Set A: (gp_nr, label, probability).  Positives have the out-of-fold probability of their last year that counts as positive;
    negatives, never trained on, the final model's calibrated ``score`` of their last year with enough months."""
    of = households(labels, key).where(F.col("has_pv_row") & F.col("has_meter"))
    positive = _latest(oof.where("pu_label = 'P'").join(of.where("battery_positive").select(key), key, "left_semi").select(key, "year", "probability"), key, "year")
    usable = years.where(F.col("n_months") >= least_months).join(of.where("audit_negative").select(key), key, "left_semi")
    negative = _latest(usable.select(key, "year", calibrated(score, c, gamma).alias("probability")), key, "year")
    return positive.select(key, F.lit(1).alias("label"), "probability").unionByName(negative.select(key, F.lit(0).alias("label"), "probability"))


def audit_set_a(rows: DataFrame, threshold: float = THRESHOLD, resamples: int = RESAMPLES, seed: int = 0, key: str = "gp_nr") -> DataFrame:
    """One row of what ``control_rows`` gives: counts, rates beside that of always saying the larger class, areas and their
    intervals; nulls, and ``error``, if there is one class only."""
    up = F.col("probability") >= threshold
    n = lambda y, hit: F.count_if((F.col("label") == y) & (up if hit else ~up))
    count = rows.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_positives"), F.count_if(F.col("label") == 0).alias("n_negatives"), n(1, True).alias("tp"), n(1, False).alias("fn"), n(0, True).alias("fp"), n(0, False).alias("tn"))
    f = lambda c: F.col(c).cast("double")
    share = lambda a, b: F.when(F.col(b) > 0, f(a) / f(b))
    both = (F.col("n_positives") > 0) & (F.col("n_negatives") > 0)
    right, most = (f("tp") + f("tn")) / f("n"), F.greatest(f("n_positives"), f("n_negatives")) / f("n")
    one = lambda c: F.when(both, c)
    percent = lambda c: F.format_string("%.1f%%", 100 * c)
    head = count.select(
        "*", F.lit(threshold).alias("threshold"), one(share("tp", "n_positives")).alias("sensitivity"), one(share("tn", "n_negatives")).alias("specificity"),
        one(right).alias("accuracy"), one(most).alias("no_skill"), one(F.concat(percent(right), F.lit(" vs "), percent(most), F.lit(" no-skill baseline"))).alias("accuracy_vs_baseline"),
        F.when(~both, "audit set A unavailable").alias("error"))
    whole = weighted_metrics(rows.select("label", "probability", F.lit(0).alias("__all"), F.lit(1).alias("__w")), "__all", "label", "probability", "__w", threshold).drop("__all")
    interval = metric_intervals(rows, key, "label", "probability", resamples, seed, threshold)
    # each side has one row
    return head.join(F.broadcast(whole), F.lit(True), "left").join(F.broadcast(interval), F.lit(True), "left")


def retrofit_pairs(oof: DataFrame, labels: DataFrame, begin: str, end: str, key: str = "gp_nr") -> DataFrame:
    """Set B: (gp_nr, before, after): the probability of the last year before that of commissioning, and of the first year after it, of
    households commissioned between two days."""
    of = households(labels, key).where(F.col("battery_positive") & F.col("commissioned").between(F.lit(begin).cast("date"), F.lit(end).cast("date")))
    rows = oof.join(of.select(key, F.year("commissioned").alias("__y")), key)
    side = lambda test, first, name: _latest(rows.where(test).select(key, "year", "probability"), key, "year", first).select(key, F.col("probability").alias(name))
    return side(F.col("year") < F.col("__y"), False, "before").join(side(F.col("year") > F.col("__y"), True, "after"), key)


def erf(x: Column, terms: int = 160) -> Column:
    """The error function of 0 <= x by a series of positive terms; beyond 6 it is 1 to a double's precision."""
    step = lambda a, k: F.struct((a["sum"] + a["term"] * 2 * x * x / (2 * k + 1)).alias("sum"), (a["term"] * 2 * x * x / (2 * k + 1)).alias("term"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("sum"), x.alias("term")), step, lambda a: a["sum"])
    return F.when(x >= 6, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * series))


def signed_rank_test(pairs: DataFrame, before: str, after: str, keys: Sequence[str] = (), exact: int = EXACT_PAIRS) -> DataFrame:
    """Wilcoxon's signed-rank test for each of ``keys``: (n, w_plus, method, p), two-sided.  Pairs without a difference are left out.
    With few pairs, no ties and none left out, all signs are counted: the number of ways to a rank sum is a sum over the
    ranks in turn.  Else the normal law is used, its variance less by that of ties."""
    d = pairs.select(*keys, (F.col(after) - F.col(before)).alias("d")).where("d is not null")
    zeros = d.groupBy(*keys).agg(F.count_if(F.col("d") == 0).alias("zeros"))
    ranked = average_rank(d.where("d <> 0").withColumn("m", F.abs("d")), "m", "r", list(keys))
    tied = ranked.groupBy(*keys, "m").agg(F.count("*").alias("t"), F.first("r").alias("r"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"))
    sums = tied.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("r") * F.col("up")).alias("w_plus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    out = zeros.join(sums, list(keys), "left") if keys else zeros.join(F.broadcast(sums), F.lit(True), "left")
    n, w = F.col("n").cast("double"), F.col("w_plus")
    z = F.abs(w - n * (n + 1) / 4) / F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    few = (F.col("n") <= exact) & (F.col("ties") == 0) & (F.col("zeros") == 0)
    # ways[s]: how many choices of signs give the positive ranks the sum s
    grow = lambda ways, k: F.zip_with(F.concat(ways, F.array_repeat(F.lit(0.0), k)), F.concat(F.array_repeat(F.lit(0.0), k), ways), lambda a, b: a + b)
    ways = F.when(few, F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(exact)).cast("int")), F.array(F.lit(1.0)), grow))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    at = w.cast("int")
    tail = F.least(add(F.slice("ways", 1, at + 1)), add(F.slice("ways", at + 1, F.size("ways")))) / F.pow(F.lit(2.0), n)
    p = F.when(few, F.least(F.lit(1.0), 2 * tail)).otherwise(1 - erf(z / F.lit(math.sqrt(2.0))))
    rows = out.withColumn("ways", ways)
    return rows.select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.when(few, "exact").otherwise("normal").alias("method"), F.when(F.col("n") > 0, p).alias("p"))


def audit_set_b(pairs: DataFrame, keys: Sequence[str] = (), least: int = LEAST_PAIRS) -> DataFrame:
    """For each of ``keys``: pairs, share of those that rose, median rise, means, and the signed-rank p; a note instead if the pairs are few."""
    d = F.col("after") - F.col("before")
    stats = pairs.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), F.avg((d > 0).cast("double")).alias("win_rate"), F.percentile(d, 0.5).alias("median_jump"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"))
    test = signed_rank_test(pairs, "before", "after", keys).select(*keys, "w_plus", "method", F.col("p").alias("wilcoxon_p"))
    out = stats.join(test, list(keys), "left") if keys else stats.join(F.broadcast(test), F.lit(True), "left")
    enough = F.col("n_pairs") >= least
    measures = ("win_rate", "median_jump", "mean_before", "mean_after", "w_plus", "method", "wilcoxon_p")
    return out.select(*keys, "n_pairs", *[F.when(enough, F.col(c)).alias(c) for c in measures], F.when(~enough, "too few paired households").alias("note"))


def positive_unlabelled_audit(oof: DataFrame, c: float, threshold: float = THRESHOLD) -> DataFrame:
    """One row: how the probabilities of positive and unlabelled years lie."""
    y = (F.col("pu_label") == "P").cast("int")
    rows = oof.select(y.alias("label"), "probability", F.lit(0).alias("__all"), F.lit(1).alias("__w"))
    hit = (F.col("probability") >= threshold).cast("double")
    head = rows.agg(F.count("*").alias("n_years"), F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("label") == 0).alias("n_unlabelled"), F.lit(float(c)).alias("c"),
        F.avg(F.when(F.col("label") == 1, hit)).alias("recall"), F.avg(F.when(F.col("label") == 0, hit)).alias("flag_rate"))
    areas = weighted_metrics(rows, "__all", "label", "probability", "__w", threshold).select("roc_auc", "average_precision")
    return head.join(F.broadcast(areas), F.lit(True), "left")
