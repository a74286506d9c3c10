"""Learners, held against what SQL can say of them: optima, invariants, and rules whose results are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws
from ..operators import audit as U
from ..operators import labels as L
from ..operators import models as M
from ..operators import stats as S
from ..session import scratch
from ..sources import exports
from . import proxies as P
from .registry import query

r6 = lambda c: F.round(c, 6)
_NUMBER = "CAST('0x' || md5(concat_ws(':', {0}))[1:13] AS BIGINT)"
_text = lambda c: f"CAST({c} AS VARCHAR)"


# -- permutation importance ---------------------------------------------------------
#: Order lines and a rule of two of their numbers; a tenth of the labels is wrong.
_LINES = """x0 AS (SELECT id, grp, quantity, discount, tax, CASE WHEN (quantity > 25 AND discount > 0.03) <> (grp % 10 = 0) THEN 1 ELSE 0 END AS label FROM (SELECT l_orderkey * 10 + l_linenumber AS id, any_value(l_orderkey) AS grp,
  min(CAST(l_quantity AS DOUBLE)) AS quantity, min(CAST(l_discount AS DOUBLE)) AS discount, min(CAST(l_tax AS DOUBLE)) AS tax FROM lineitem GROUP BY ALL))"""
_FEATURES = ("quantity", "discount", "tax")
_REPEATS = 3


def _lines(spark, sf, rule):
    l = P.load(spark, sf, "lineitem")
    id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    x = l.groupBy(id.alias("id")).agg(F.first("l_orderkey").alias("grp"), *[F.min(F.col(f"l_{c}").cast("double")).alias(c) for c in _FEATURES])
    return x.withColumn("label", (rule != (F.col("grp") % 10 == 0)).cast("int"))


def _rule(quantity="quantity", discount="discount"):
    return (F.col(quantity) > 25) & (F.col(discount) > 0.03)


@query(f"""WITH {_LINES}, x AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {_NUMBER.format("'0', " + _text("id"))}, id) - 1 AS i, count(*) OVER () AS n FROM x0),
s AS (SELECT r, 1 + {_NUMBER.format("'shift 0', " + _text("r"))} % (n - 1) AS step FROM range({_REPEATS}) t(r), (SELECT max(n) AS n FROM x)),
o AS (SELECT x.label, r, x.quantity, x.discount, x.tax, y.quantity AS q2, y.discount AS d2, y.tax AS t2 FROM x, s JOIN x y ON y.i = (x.i + step) % x.n),
e AS (SELECT 'quantity' AS feature, r, label, q2 > 25 AND discount > 0.03 AS p FROM o UNION ALL SELECT 'discount', r, label, quantity > 25 AND d2 > 0.03 FROM o UNION ALL SELECT 'tax', r, label, quantity > 25 AND discount > 0.03 FROM o),
b AS (SELECT avg(CASE WHEN (quantity > 25 AND discount > 0.03) = (label = 1) THEN 1.0 ELSE 0 END) AS base FROM x),
v AS (SELECT feature, r, base - avg(CASE WHEN p = (label = 1) THEN 1.0 ELSE 0 END) AS loss FROM e, b GROUP BY feature, r, base)
SELECT feature, round(avg(loss), 6) AS loss, round(stddev_pop(loss), 6) AS std, count(*) AS repeats FROM v GROUP BY feature""")  # fmt: skip
def permutation_importances(spark, sf):
    """Of a rule, so that what each feature is worth is known"""
    rows = _lines(spark, sf, _rule())
    out = M.permutation_importance(rows, "id", _FEATURES, "label", lambda d: d.withColumn("score", _rule().cast("double")), lambda d, by: M.accuracy(d, by, "label"), _REPEATS)
    return out.select("feature", r6("loss").alias("loss"), r6("std").alias("std"), "repeats")


# -- boosted trees ------------------------------------------------------------------------
_EITHER = "x1 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN ((quantity > 25) <> (discount > 0.05)) <> (grp % 10 = 0) THEN 1 ELSE 0 END AS label) FROM x0)"
_DRAW = draws.SQL_UNIFORM


@query(f"""WITH {_LINES}, {_EITHER}, u AS MATERIALIZED (SELECT *, {_DRAW.format("'test 0', " + _text("grp"))} < 0.3 AS test, {_DRAW.format("'stop 0', " + _text("grp"))} < 0.2 AS held FROM x1),
k AS (SELECT quantity AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM u WHERE test GROUP BY quantity), a AS (SELECT sum(p * (coalesce(less, 0) + n / 2)) / (sum(p) * sum(n)) AS auc FROM (SELECT *, sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS less FROM k))
SELECT count(*) FILTER (NOT test AND NOT held) AS learnt, count(*) FILTER (NOT test AND held) AS told_when, count(*) FILTER (test) AS tested, count(DISTINCT grp) FILTER (test) AS groups_tested, true AS within_limit, 1.0::DOUBLE AS shares, true AS tax_is_least,
  (SELECT round(auc, 6) FROM a) AS rule_auc, true AS better_than_rule FROM u""")  # fmt: skip
def boosted_trees(spark, sf):
    """Trees that stop when held-out groups say so; shares of the gain; better than any single rule on groups that weren't seen"""
    rows = _lines(spark, sf, (F.col("quantity") > 25) != (F.col("discount") > 0.05)).withColumn("test", draws.uniform("test 0", "grp") < 0.3)
    learnt, tested = rows.where(~F.col("test")).drop("test"), rows.where("test")
    fit = M.fit_stopped(learnt, list(_FEATURES), "label", "grp", rounds=24, depth=2, rate=0.4)
    gains = fit.gains(spark, f"{scratch(spark, 'boosted')}/trees")
    shares = gains.agg(F.round(F.sum("share"), 6).alias("shares"), (F.min_by("feature", "gain") == "tax").alias("tax_is_least"))
    scored = M.score(fit.model, tested).withColumns({"by": F.lit(0), "one": F.lit(1)})
    of = lambda score: U.weighted_metrics(scored, "by", "label", score, "one").select("roc_auc")
    areas = of("quantity").select(r6("roc_auc").alias("rule_auc")).join(of("score").select(F.col("roc_auc").alias("auc")), F.lit(True))
    held = draws.uniform("stop 0", "grp") < 0.2
    counts = rows.agg(F.count_if(~F.col("test") & ~held).alias("learnt"), F.count_if(~F.col("test") & held).alias("told_when"), F.count_if("test").alias("tested"), F.count_distinct(F.when(F.col("test"), F.col("grp"))).alias("groups_tested"))
    out = counts.join(F.broadcast(shares), F.lit(True)).join(F.broadcast(areas), F.lit(True))  # a row each
    return out.select("learnt", "told_when", "tested", "groups_tested", F.lit(0 < fit.rounds <= fit.limit).alias("within_limit"), "shares", "tax_is_least", "rule_auc", (F.col("auc") > F.col("rule_auc") + 0.2).alias("better_than_rule"))


# -- logistic regression -------------------------------------------------------------------
@query(P.sql("scored") + """, x AS (SELECT CASE WHEN (score > 1000) <> (doc_id % 5 = 0) THEN 1 ELSE 0 END AS label FROM scored)
SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS n_positive, 0.0::DOUBLE AS gradient, 0.5::DOUBLE AS balanced_mean, 0.5::DOUBLE AS prior_mean, round(avg(label), 4) AS calibrated_mean, 0.0::DOUBLE AS calibration_gradient FROM x""")
def logistic_certificate(spark, sf):
    """What holds at the optimum: no gradient; balanced classes share the mean; the calibrated out-of-fold scores have the labels' mean"""
    x = P.scored(spark, sf).withColumns({"log_chars": F.log1p("score"), "label": ((F.col("score") > 1000) != (F.col("doc_id") % 5 == 0)).cast("int")}).drop("score")
    features = ["log_chars", "quality"]
    model = M.fit_logistic(x, features, "label")
    gradient = M.logistic_gradient(model, x, features, "label").agg(F.round(F.max(F.abs("gradient")), 6).alias("gradient"))
    scored = M.score(model, x)
    weight = lambda y: F.avg(F.when(F.col("label") == y, F.col("score")))
    balanced = scored.agg(r6((weight(1) + weight(0)) / 2).alias("balanced_mean"))
    prior = M.elkan_noto(scored, "label", prior=0.5).agg(F.round(F.avg("p"), 2).alias("prior_mean"))
    folds = L.folds(x, "doc_id", "label", 3).select("doc_id", "fold")
    oof = M.out_of_fold(x.join(folds, "doc_id"), features, "label", "fold", 3)
    z = oof.withColumn("z", M.logit(F.col("score")))
    sigmoid = M.fit_logistic(z, ["z"], "label", c=1e6, balanced=False)
    slope = M.logistic_gradient(sigmoid, z, ["z"], "label", c=1e6, balanced=False).agg(F.round(F.max(F.abs("gradient")), 6).alias("calibration_gradient"))
    calibrated = z.select(M.calibrate_sigmoid(oof, "label")(F.col("score")).alias("p")).agg(F.round(F.avg("p"), 4).alias("calibrated_mean"))
    out = x.agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("n_positive"))
    for part in (gradient, balanced, prior, calibrated, slope):
        out = out.join(F.broadcast(part), F.lit(True))  # a row each
    return out


# -- protocols ------------------------------------------------------------------------------
@query(P.sql("scored") + """, v AS (SELECT score, label FROM scored WHERE doc_id % 2 = 0), o AS (SELECT score AS t, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM v GROUP BY score),
j AS (SELECT t, sum(p) OVER w / (SELECT greatest(sum(p), 1) FROM o) - sum(n) OVER w / (SELECT greatest(sum(n), 1) FROM o) AS j FROM o WINDOW w AS (ORDER BY t DESC)), b AS (SELECT arg_max(t, (j, t)) AS t FROM j), c AS (SELECT count(*) AS rows FROM v)
SELECT sha256('{"label": "toxic", "rows": ' || rows || ', "threshold": ' || t || '}') AS digest, true AS second_refused, true AS changed_refused, count(*) FILTER (label = 1 AND score >= t) AS tp, count(*) FILTER (label = 0 AND score >= t) AS fp, count(*) FILTER (label = 0 AND score < t) AS tn, count(*) FILTER (label = 1 AND score < t) AS fn
FROM scored, b, c WHERE doc_id % 2 = 1 GROUP BY ALL""")
def one_shot_test(spark, sf):
    """A threshold chosen on one half, frozen, and tested on the other half once; a second test and a changed configuration are refused"""
    path = scratch(spark, "one-shot")
    rows = P.scored(spark, sf).select("doc_id", "score", F.col("label").cast("int").alias("label"))
    chosen, tested = rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")
    config = {"threshold": S.youden(chosen, "label", "score").first().threshold, "rows": chosen.count(), "label": "toxic"}
    digest = M.freeze(config)

    def test():
        return S.confusion(tested.withColumn("p", (F.col("score") >= config["threshold"]).cast("int")), "label", "p").select("tp", "fp", "tn", "fn")

    def refused(config: dict, why: str) -> bool:
        try:
            M.one_shot(spark, path, config, digest, test)
        except Exception as error:
            return why in str(error)
        return False

    out = M.one_shot(spark, path, config, digest, test)
    return out.select(F.lit(digest).alias("digest"), F.lit(refused(config, "PATH_ALREADY_EXISTS")).alias("second_refused"), F.lit(refused(config | {"rows": 0}, "frozen")).alias("changed_refused"), "tp", "fp", "tn", "fn")


@query("""WITH d AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, CASE WHEN (o_totalprice > 150000) <> (o_orderkey % 7 = 0) THEN 1 ELSE 0 END AS label FROM orders), o AS (SELECT * FROM d WHERE o_orderkey % 3 <> 0)
SELECT o_orderkey, CASE WHEN price >= (SELECT quantile_cont(price, 0.8) FROM o) THEN 1 ELSE 0 END AS flagged FROM o""")
def surrogate_flags(spark, sf):
    """A model of the labelled third scores all others, and flags a fifth of them; its one feature rises with the label, so the fifth is known"""
    o = P.load(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    rows = o.withColumn("label", ((F.col("price") > 150000) != (F.col("o_orderkey") % 7 == 0)).cast("int"))
    out = M.surrogate_scores(rows.where("o_orderkey % 3 = 0"), rows.drop("label"), "o_orderkey", ["price"], "label", 0.2)
    return out.select("o_orderkey", "flagged")


@query("""WITH s AS (SELECT c_acctbal AS a, c_acctbal + 20000 * sin(c_custkey) AS b FROM customer), k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS b FROM s),
r AS (SELECT corr(a, b) AS rho, count(*) AS n FROM k), t AS (SELECT *, asin(sqrt(1 - rho * rho)) AS top FROM r)
SELECT round(rho, 6) AS rho, n, round(top * list_sum(list_transform(range(20000), lambda k: pow(sin((k + 0.5) * top / 20000), n - 3))) / (pi() / 2 * list_sum(list_transform(range(20000), lambda k: pow(sin((k + 0.5) * pi() / 2 / 20000), n - 3)))), 6) AS p FROM t""")
def spearman_p(spark, sf):
    """Rank correlation and its two-sided p"""
    c = P.load(spark, sf, "customer").select(F.col("c_acctbal").cast("double").alias("a"), (F.col("c_acctbal") + 20000 * F.sin("c_custkey")).alias("b"))
    return S.spearman_test(c, "a", "b").select(r6("rho").alias("rho"), "n", r6("p").alias("p"))


@query("SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS begins, count(*) AS n, round(sum(o_totalprice), 2) AS total, true AS in_order, 0 AS again FROM orders GROUP BY ALL")
def yearly_artifacts(spark, sf):
    """Years worked on side by side, stored, and not again in a second run"""
    path, made = scratch(spark, "years"), []
    rows = P.load(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice")

    def work(day, part):
        made.append(day)
        return part.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    first = exports.months_resumed(rows, work, path, unit="year")
    n = len(made)
    out = None
    for day, stored in exports.months_resumed(rows, work, path, unit="year"):
        one = stored.select(F.lit(day).alias("begins"), "n", "total")
        out = one if out is None else out.unionByName(one)
    days = [d for d, _ in first]
    return out.withColumns({"in_order": F.lit(days == sorted(days)), "again": F.lit(len(made) - n)})
