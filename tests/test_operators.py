"""Relational, aggregate, label, statistics and model operators on small cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import draws
from gridloom.operators import aggregates as A
from gridloom.operators import audit, battery
from gridloom.operators import labels as L
from gridloom.operators import models as M
from gridloom.operators import relational as R
from gridloom.operators import stats as S
from gridloom.operators import windows as W


def test_guards(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 2.0, "b")], "id int, x double, s string")
    with pytest.raises(ValueError, match="missing"):
        R.require_columns(df, ["id", "y"])
    with pytest.raises(ValueError, match="not allowed"):
        R.guard_features(["einsp_kwh"], [], ["bezug"])
    assert R.drop_constant(df, ["id", "x"]).columns == ["id", "s"]
    assert R.feature_columns(df, ["id"]) == ["x"]
    with pytest.raises(ValueError, match="repeat"):
        R.join_checked(df, df.unionByName(df), ["id"])


def test_pairs_and_alignment(spark):
    r = spark.createDataFrame([("m", 1, "import", 2.0), ("m", 1, "export", 0.5), ("m", 2, "import", 1.0)], "mp_id string, slot int, register string, kwh double")
    assert R.pair_registers(r, ["mp_id", "slot"]).collect()[0]["import"] == 2.0
    assert R.pair_registers(r, ["mp_id", "slot"], outer=True).count() == 2
    assert R.with_household(spark.createDataFrame([("m",)], "mp_id string"), spark.createDataFrame([], "gp_nr string, mp_id string")).first().gp_nr == "MP:m"


def test_weekly_named_slots(spark):
    out = R.named_slots(spark.createDataFrame([(1, [float(k) for k in range(672)])], "id int, q array<double>"), "q")
    row = out.first()
    assert len(out.columns) == 673 and row["net_load_mon_00_15_kwh"] == 0 and row["net_load_sun_00_00_kwh"] == 671


def test_mode_with_tie(spark):
    df = spark.createDataFrame([("a", "Bern"), ("a", "BERN "), ("a", "Thun"), ("b", "x"), ("b", "y"), ("c", " ")], "k string, v string")
    got = {r.k: (r.v, r.conflict) for r in A.mode_or_null(df, ["k"], "v").collect()}
    assert got["a"][0].lower() == "bern" and got["a"][1] and got["b"] == (None, True) and "c" not in got


def test_universe_gate(spark):
    m = spark.createDataFrame([("a", 40, False), ("b", 1, False)], "gp_nr string, d int, f boolean")
    assert A.universe(m, "gp_nr", "d", "f").count() == 1
    with pytest.raises(ValueError, match="labelled"):
        A.universe(m, "gp_nr", "d", "f", labelled=F.lit(True))


def test_profile_needs_support(spark):
    rows = [("m", "2025-07", dt.date(2025, 7, d), s, 0.1 * d) for d in range(1, 13) for s in range(80)]
    df = spark.createDataFrame(rows, "mp_id string, month string, date date, slot int, kwh double")
    assert A.slot_profile(df).count() == 80
    assert A.slot_profile(df.where("date < '2025-07-09'")).count() == 0


def battery_days(spark, *rows):
    """Rows of (date, imp, exp) with the sun between 5 and 20."""
    data = [("m", "8000", d, True, imp, exp, 5.0, 20.0) for d, imp, exp in rows]
    return battery.battery_day(spark.createDataFrame(data, "mp_id string, plz string, date date, is_clear boolean, imp array<double>, exp array<double>, sunrise double, sunset double"))


def test_battery_day_of_both_registers(spark):
    imp = [0.05] * 80 + [0.0] * 8 + [0.05] * 8
    row = battery_days(spark, (dt.date(2025, 7, 15), imp, [0.0] * 96)).first()
    assert row.day_kwh == pytest.approx(4.4) and row.zero_run_after_sunset == 2.0 and row.step_slot == 88 and row.step_magnitude == 0.05
    assert row.evening_zero_share == 0.5 and row.both_zero_share == pytest.approx(8 / 96) and row.both_zero_share_daylight == 0
    assert row.exp_start_slot is None and row.exp_peak_flatness is None and row.exp_peak_kw == 0
    assert row.night_flat_block_share == 1 and row.night_block_power == 0.25 and row.has_both and row.export_share_of_daylight_energy == 0


def test_battery_day_without_a_register_or_season(spark):
    imp = [0.1] * 96
    rows = {r.date.month * 100 + r.date.day: r for r in battery_days(spark, (dt.date(2025, 1, 5), imp, imp), (dt.date(2025, 5, 5), imp, None), (dt.date(2025, 5, 6), None, imp), (dt.date(2025, 5, 7), None, None)).collect()}
    assert rows[105].zero_run_after_sunset is None and rows[105].night_flat_block_share is None and rows[105].flat_interval_share is None and rows[105].evening_zero_share == 0
    assert rows[505].exp_day_kwh is None and rows[505].both_zero_share is None and rows[505].day_kwh == pytest.approx(9.6) and not rows[505].has_both
    assert rows[506].day_kwh is None and rows[506].exp_peak_flatness == 1
    assert all(rows[507][c] is None for c in battery.DAY_MEASURES)


def test_flat_blocks(spark):
    ramp = [i / 95 for i in range(96)]
    ramp[20:28] = [0.25] * 8
    jagged = [0.0, 1.0] * 48
    part = list(jagged)
    part[10:14] = [0.5] * 4
    part[30:33] = [0.5] * 3  # too short
    gap = [0.3] * 96
    gap[3] = None  # a block of three, one missing, the rest
    df = spark.createDataFrame([(0, ramp), (1, jagged), (2, part), (3, gap), (4, [None] * 96)], "i int, v array<double>")
    got = {r.i: r.b for r in df.select("i", battery.flat_block(F.col("v")).alias("b")).collect()}
    assert got[0].share >= 8 / 96 and got[0].power == 1.0
    assert tuple(got[1]) == (0.0, None) and tuple(got[2]) == (4 / 96, 2.0)
    assert got[3].share == 92 / 96 and got[3].power == 1.25 and tuple(got[4]) == (0.0, None)


def test_flat_block_over_slots_that_are_apart(spark):
    v = [9.0] * 96
    for s in battery.NIGHT_SLOTS:
        v[s] = 0.1
    df = spark.createDataFrame([(v,)], "v array<double>")
    assert tuple(df.select(battery.flat_block(battery.picked(F.col("v"), battery.NIGHT_SLOTS)).alias("b")).first().b) == (1.0, 0.5)


def test_battery_month(spark):
    rows = [(dt.date(2025, 5, d), [0.1 * d] * 96, [0.0] * 96) for d in (1, 2, 3)]
    row = battery.battery_month(battery_days(spark, *rows)).first()
    assert row.n_days == 3 and row.day_kwh_mean == pytest.approx(19.2) and row.day_kwh_std == pytest.approx(9.6) and row.evening_zero_share_clear == 0


def test_signed_ranks_are_exact_for_few_pairs(spark):
    """Against all signs, one by one."""
    import itertools

    for d in ([1.5, -0.5, 2.5, 3.5, 4.5], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], [-3.0, 1.0, -2.0, 4.0]):
        ranks = sorted(range(len(d)), key=lambda i: abs(d[i]))
        w = sum(r + 1 for r, i in enumerate(ranks) if d[i] > 0)
        sums = [sum(r + 1 for r, s in enumerate(signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
        p = min(1.0, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums))
        row = audit.signed_rank_test(spark.createDataFrame([(0.0, x) for x in d], "a double, b double"), "a", "b").first()
        assert (row.n, row.w_plus, row.method) == (len(d), w, "exact") and row.p == pytest.approx(p)


def test_signed_ranks_with_ties_and_zeros(spark):
    df = spark.createDataFrame([(1, 0.0, x) for x in (1.0, 1.0, -1.0, 2.0, 0.0)] + [(2, 0.0, 0.0), (3, None, 1.0)], "k int, a double, b double")
    got = {r.k: r for r in audit.signed_rank_test(df, "a", "b", ["k"]).collect()}
    # ranks 2, 2, -2, 4: W+ = 8, mean 5, variance (4 * 5 * 9 - 24 / 2) / 24 = 7
    assert got[1].method == "normal" and got[1].w_plus == 8 and got[1].p == pytest.approx(math.erfc(3 / math.sqrt(7) / math.sqrt(2)))
    assert got[2].n == 0 and got[2].p is None and 3 not in got


def test_error_function(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 2.0, 3.5, 5.9, 6.0, 40.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(audit.erf(F.col("x"))).collect()]
    assert got == pytest.approx([math.erf(x) for x in xs], abs=1e-14)


def test_audit_of_one_class_and_of_few_pairs(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("b", 1, 0.2)], "gp_nr string, label int, probability double")
    row = audit.audit_set_a(rows, resamples=5).first()
    assert row.error and row.tp == 1 and row.fn == 1 and row.roc_auc is None and row.accuracy is None and row.resamples == 0
    pairs = spark.createDataFrame([("a", 0.1, 0.9)] * 3, "gp_nr string, before double, after double")
    assert audit.audit_set_b(pairs).first().note == "too few paired households"
    row = audit.audit_set_b(spark.createDataFrame([(str(i), 0.1, 0.2 + i / 50) for i in range(8)], "gp_nr string, before double, after double")).first()
    assert row.win_rate == 1 and row.method == "exact" and row.wilcoxon_p == pytest.approx(2 / 256)


def test_controls_are_never_trained_on(spark):
    labels = spark.createDataFrame([("p", True, None, True, True, None), ("p", None, False, None, None, dt.date(2024, 1, 1)), ("n", False, True, True, True, None), ("m", True, False, False, True, None)],
        "gp_nr string, battery_positive boolean, audit_negative boolean, has_pv_row boolean, has_meter boolean, battery_commissioning_date date")
    oof = spark.createDataFrame([("p", 2023, "U", 0.1), ("p", 2024, "P", 0.6), ("p", 2025, "P", 0.8), ("m", 2025, "P", 0.7), ("n", 2025, "U", 0.4)], "gp_nr string, year int, pu_label string, probability double")
    years = spark.createDataFrame([("n", 2024, 12, 0.5), ("n", 2025, 3, 0.9)], "gp_nr string, year int, n_months int, raw double")
    got = sorted(tuple(r) for r in audit.control_rows(oof, labels, years, F.col("raw")).collect())
    assert got == [("n", 0, pytest.approx(0.5)), ("p", 1, 0.8)]


def test_draws_are_uniform_and_poisson(spark):
    d = spark.range(20_000).select(draws.uniform(3, "id").alias("u"))
    row = d.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg(draws.poisson(F.col("u"))), F.var_pop(draws.poisson(F.col("u"))), F.count_distinct("u")).first()
    assert abs(row[0] - 0.5) < 0.01 and 0 <= row[1] and row[2] < 1 and abs(row[3] - 1) < 0.03 and abs(row[4] - 1) < 0.05 and row[5] == 20_000


def test_ranks_and_change_point(spark):
    df = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate([1, 2, 1, 2, 9, 8, 9, 8])] + [("short", 0, 1.0)], "name string, t int, v double")
    got = {r.name: r for r in W.pettitt(df, ["name"], "t", "v").collect()}
    assert got["s"].at == 3 and got["s"].k == 16 and got["short"].at == -1 and got["short"].p == 1
    ranks = {(r.t): r["rank"] for r in W.average_rank(df.where("name = 's'"), "v").collect()}
    assert ranks[0] == 1.5 and ranks[4] == 7.5


def test_splits_are_disjoint_stratified_and_stable(spark):
    df = spark.createDataFrame([(f"c{i // 4}", int(i // 4 % 4 == 0)) for i in range(400)], "g string, y int")
    out = L.split_groups(df, "g", "y")
    rows = out.collect()
    assert len(rows) == 100 and {r.split for r in rows} == {"train", "validation", "test"}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, L.split_groups(df.repartition(7), "g", "y").collect()))
    share = lambda s: np.mean([r.y for r in rows if r.split == s])
    assert abs(share("train") - share("test")) < 0.03
    folds = L.folds(df, "g", "y").collect()
    assert {r.fold for r in folds} == set(range(5))


def test_metrics_against_definitions(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(200) < 0.3).astype(int)
    s = np.round(np.clip(y * 0.3 + rng.random(200) * 0.7, 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b), i) for i, (a, b) in enumerate(zip(y, s))], "y int, s double, sample_id int")
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert S.roc_auc(df, "y", "s").first()[0] == pytest.approx(auc)
    best = S.choose_threshold(df, "y", "s").first()
    ba = lambda t: (np.mean(s[y == 1] >= t) + np.mean(s[y == 0] < t)) / 2
    assert best.balanced_accuracy == pytest.approx(max(ba(t) for t in [*set(s), 2.0]))
    gain = S.paired_gain(df.withColumn("a", F.lit(0)).withColumn("b", (F.col("s") > 0.5).cast("int")), "y", "a", "b", 50).first()
    assert gain.low > 0 and gain.resamples == 50


def test_models_learn_and_calibrate(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0.8).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c), i % 2, i) for i, ((a, b), c) in enumerate(zip(x, y))], "a double, b double, y int, fold int, id int")
    oof = M.out_of_fold(df, ["a", "b"], "y", "fold", 2)
    assert S.roc_auc(oof, "y", "score").first()[0] > 0.9
    shifted = M.elkan_noto(oof, "y", prior=0.3)
    assert shifted.agg(F.avg("p")).first()[0] == pytest.approx(0.3, abs=0.01)
    calibrate = M.calibrate_sigmoid(oof, "y")
    assert oof.select(F.avg(calibrate(F.col("score")))).first()[0] == pytest.approx(y.mean(), abs=0.05)
    model = M.fit_logistic(df, ["a", "b"], "y")
    rows = M.permutation_importance(df.withColumn("key", F.monotonically_increasing_id()), "key", ["a", "b"], "y", lambda d: M.score(model, d), lambda d, by: M.area(d, by, "y"), 3)
    loss = {r.feature: r.loss for r in rows.collect()}
    assert loss["a"] > 0.2 > abs(loss["b"])
    assert M.score(M.fit_boosted(df, ["a", "b"], "y", rounds=3), df).count() == 400


def test_weights_and_reconciliation(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, g string")
    w = {r.id: r.weight for r in L.equal_weights(df, "g").collect()}
    assert w[3] == 2 * w[1] and sum(w.values()) == pytest.approx(3)
    assert L.reconcile(df.where("id < 2"), df.where("id >= 2"), df, "id")
    assert not L.reconcile(df, df.where("id = 1"), df, "id")


def test_customer_week_end_to_end(spark):
    """One customer, a week of import 2.0 and export 0.5, one blank reading: 672 values, one filled with 1.5."""
    from gridloom.operators.weeks import assemble_weeks

    days = []
    for d in range(7):
        q = [1.5] * 96
        if d == 2:
            q[48] = None
        days.append(("m", dt.date(2024, 1, 1) + dt.timedelta(days=d), q))
    df = spark.createDataFrame(days, "mp_id string, date date, q array<double>")
    links = spark.createDataFrame([("c", "m")], "gp_nr string, mp_id string")
    row = assemble_weeks(df, links).first()
    assert row.eligible and row.imputed == 1 and len(row.load) == 672 and row.load[2 * 96 + 48] == 1.5 and row.week_start == dt.date(2024, 1, 1)
    two = links.unionByName(spark.createDataFrame([("c", "other")], links.schema))
    assert assemble_weeks(df, two).first().exclusion_reason == "too_many_missing_timestamps"
    assert assemble_weeks(df.where("date < '2024-01-07'"), links).first().exclusion_reason == "too_many_missing_timestamps"
    shifted = df.withColumn("date", F.date_add("date", 84))
    assert assemble_weeks(shifted, links, zone="Europe/Zurich").first().exclusion_reason == "dst_transition_week"


def test_running_sums_over_buckets(spark):
    rng = np.random.default_rng(9)
    x = rng.permutation(500)
    df = spark.createDataFrame([(float(v), int(v % 7)) for v in x], "v double, n long")
    for down in (False, True):
        got = {r.v: r.n for r in W.running_sums(df, "v", ["n"], down, 16).collect()}
        order = sorted(x, reverse=down)
        want, total = {}, 0
        for v in order:
            total += v % 7
            want[float(v)] = total
        assert got == want
    assert W.running_sums(df.where("false"), "v", ["n"]).count() == 0


def test_numbers_without_one_partition(spark):
    df = spark.createDataFrame([(f"k{i}", i % 2) for i in range(300)], "k string, y int")
    rows = W.numbered(df, ["k"], ["y"]).collect()
    for y in (0, 1):
        assert sorted(r["__r"] for r in rows if r.y == y) == list(range(1, 151))
    again = {(r.k, r["__r"]) for r in W.numbered(df.repartition(7), ["k"], ["y"]).collect()}
    assert again == {(r.k, r["__r"]) for r in rows}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=777), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    for q in (0.0, 0.1, 0.5, 0.987, 1.0):
        assert W.exact_quantile(df, "v", q) == pytest.approx(np.quantile(x, q))
    assert W.exact_quantile(df.where("false"), "v", 0.5) is None


def test_spearman_p(spark):
    from gridloom.functions.numbers import incomplete_beta

    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-6)
    few = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double")
    assert S.spearman_test(few, "a", "b").first().p is None
    same = spark.createDataFrame([(float(i), float(i)) for i in range(5)], "a double, b double")
    assert S.spearman_test(same, "a", "b").first().p == 0
    df = spark.createDataFrame([(float(i), float(v)) for i, v in enumerate([2, 1, 4, 3, 6, 5, 8, 7, 10, 9])], "a double, b double")
    rho, n, p = S.spearman_test(df, "a", "b").first()
    assert p == pytest.approx(incomplete_beta((n - 2) / 2, 0.5, 1 - rho * rho), rel=1e-6)
    assert n == 10 and rho == pytest.approx(0.9393939) and p == pytest.approx(5.484e-05, rel=1e-3)


def test_surrogate_and_one_shot(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(i, float(x), int(x > 0.5)) for i, x in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "id int, x double, y int")
    out = M.surrogate_scores(df.where("id < 150"), df, "id", ["x"], "y", 0.2)
    assert out.count() == 150 and 25 <= out.where("flagged = 1").count() <= 35 and out.where("flagged = 1").agg(F.min("x")).first()[0] > out.where("flagged = 0").agg(F.max("x")).first()[0] - 1e-9
    config = {"c": 1.0}
    digest = M.freeze(config)
    assert M.one_shot(spark, f"file://{tmp_path}", config, digest, lambda: df).count() == 300
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        M.one_shot(spark, f"file://{tmp_path}", config, digest, lambda: df)
    with pytest.raises(ValueError, match="frozen"):
        M.one_shot(spark, f"file://{tmp_path}", {"c": 2.0}, digest, lambda: df)


def test_acceptance(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, True)], "k int, f boolean")
    assert A.acceptance(df, "k", {"marked": F.col("f")}, {"households": 2, "marked": 2}).first().marked == 2
    with pytest.raises(ValueError, match="marked"):
        A.acceptance(df, "k", {"marked": F.col("f")}, {"marked": 3})


def test_repetition_is_by_power(spark):
    """Three days of like power at different hours repeat; days of other power don't."""
    from gridloom.operators import events as E

    def week(starts, powers):
        x = np.zeros(672)
        for d, (s, p) in enumerate(zip(starts, powers)):
            x[96 * d + s : 96 * d + s + 8] = p / 4
        return x.tolist()

    df = spark.createDataFrame([("alike", week([10, 40, 70], [5, 5.2, 4.9])), ("other", week([10, 10, 10], [4, 6, 9])), ("none", [0.0] * 672)], "id string, q array<double>")
    e = E.load_events(df, ["id"])
    got = {r.id: r for r in E.event_features(df, e, ["id"], "repeat_block", repeat_days=3).collect()}
    assert got["alike"].event_repetition == 3 and got["other"].event_repetition == 1 and got["none"].event_count == 0
    assert got["alike"].score == pytest.approx(1 - np.exp(-1.5)) and got["other"].score == pytest.approx((1 - np.exp(-1.5)) / 3) and got["none"].score == 0


def test_boosted_trees_stop_and_tell_gains(spark, tmp_path):
    rng = np.random.default_rng(21)
    rows = [(i // 2, float(a), float(b), float(c), int((a > 0) != (b > 0))) for i, (a, b, c) in enumerate(rng.normal(size=(600, 3)))]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, y int")
    fit = M.fit_stopped(df, ["a", "b", "c"], "y", "g", rounds=40, depth=2, rate=0.5, tolerance=0.05)
    gains = {r.feature: r for r in fit.gains(spark, f"file://{tmp_path}/trees").collect()}
    assert 0 < fit.rounds < 40 and sum(r.share for r in gains.values()) == pytest.approx(1)
    assert gains["c"].gain < gains["a"].gain + gains["b"].gain and gains["a"].splits > 0
    lone = M.fit_stopped(df, ["a"], "y", "g", rounds=5, depth=1)
    assert lone.rounds <= 5


def test_gradient_is_none_at_the_optimum_only(spark):
    rng = np.random.default_rng(22)
    rows = [(float(a), float(b), int(a + 0.5 * b + rng.normal() > 0.4), float(w)) for a, b, w in zip(rng.normal(size=300), rng.normal(size=300) * 9, rng.integers(1, 4, 300))]
    df = spark.createDataFrame(rows, "a double, b double, y int, w double")
    model = M.fit_logistic(df, ["a", "b"], "y", "w", c=0.5)
    got = {r.feature: r.gradient for r in M.logistic_gradient(model, df, ["a", "b"], "y", "w", c=0.5).collect()}
    assert set(got) == {"intercept", "a", "b"} and max(abs(x) for x in got.values()) < 1e-6
    other = {r.feature: r.gradient for r in M.logistic_gradient(model, df, ["a", "b"], "y", None, c=0.5).collect()}
    assert max(abs(x) for x in other.values()) > 1e-3


def test_charger_classes_over_midnight(spark):
    from gridloom.operators.weeks import charger_scores

    flat = [0.2] * 96
    evening, morning = list(flat), list(flat)
    evening[88:] = [7.0] * 8  # runs on over midnight: 13 slots
    morning[:5] = [7.0] * 5
    noon = list(flat)
    noon[40:43] = [4.2] * 3  # too short for the small class
    gap = list(evening)
    gap[3] = None  # not a whole day
    rows = [("c", dt.date(2024, 1, 1), evening), ("c", dt.date(2024, 1, 2), morning), ("c", dt.date(2024, 1, 3), noon), ("c", dt.date(2024, 1, 4), flat), ("d", dt.date(2024, 1, 1), [-x for x in flat]), ("e", dt.date(2024, 1, 1), gap)]
    got = {r.sample_id: r for r in charger_scores(spark.createDataFrame(rows, "sample_id string, date date, net array<double>")).collect()}
    assert set(got) == {"c", "d"}
    c = got["c"]
    assert c.n_days == 4 and c.ev_ramp_max == pytest.approx(6.8) and c.ev_ramp_days100 == 0 and c.ev_ramp_spec_days100 == 25
    assert c.ev_L2_large_spec_rate100 == 25 and c.ev_L2_large_tuned_rate100 == 25 and c.ev_L2_small_spec_rate100 == 0 and c.ev_spec_rate100 == 25 and c.ev_tuned_rate100 == 25 and c.ev_spec_daysfrac == 0.25
    assert got["d"].ev_spec_rate100 == 0 and got["d"].ev_ramp_max == 0


def test_places_of_a_shuffled_order(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(100)], "k string")
    one = {r.k: r.place for r in R.shuffled(df, "k", 1).collect()}
    assert sorted(one.values()) == list(range(100)) and one == {r.k: r.place for r in R.shuffled(df.repartition(5), "k", 1).collect()}
    assert one != {r.k: r.place for r in R.shuffled(df, "k", 2).collect()}


def test_windows_without_a_partition_are_short(spark):
    df = spark.range(20).withColumn("y", F.lit(1.0))
    assert W.leaderboard(df, F.desc("id")).where("position = 1").first().id == 19
    assert W.short(df, 20).count() == 20
    with pytest.raises(ValueError, match="more than 19"):
        W.short(df, 19)
    assert S.trapezoid(df, "id", "y").first().area == 19


def test_clear_days_agree_with_their_own_limits(spark):
    """A mean that comes out another way each time it is worked out: the day that is the quartile itself is clear all the same."""
    noisy = F.udf(lambda x: x + random.random() * 1e-9, "double").asNondeterministic()
    days = spark.createDataFrame([(dt.date(2024, m, d), float(d)) for m in range(1, 13) for d in range(1, 6)], "date date, radiation double").withColumn("radiation", noisy("radiation"))
    clear = W.clear_days(days).where("is_clear").select(F.month("date").alias("m"), F.day("date").alias("d")).collect()
    assert sorted(map(tuple, clear)) == [(m, d) for m in range(1, 13) for d in (4, 5)]
