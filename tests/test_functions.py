"""Array, date, text and number functions against NumPy and hand-made cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import dates, numbers, text
from gridloom.functions import vectors as V
from gridloom.operators import events as E


def vec(spark, *rows):
    return spark.createDataFrame([(i, [None if x is None else float(x) for x in r]) for i, r in enumerate(rows)], "id int, q array<double>")


def one(df, c):
    return [r[0] for r in df.orderBy("id").select(c).collect()]


def test_statistics_match_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [rng.normal(size=n) for n in (1, 2, 5, 96)]
    df, q = vec(spark, *rows), F.col("q")
    for p in (0.05, 0.5, 0.9):
        assert one(df, V.quantile(q, p)) == pytest.approx([np.quantile(r, p) for r in rows])
    assert one(df, V.std(q)) == pytest.approx([np.std(r) for r in rows])
    assert one(df, V.mean(q)) == pytest.approx([np.mean(r) for r in rows])
    got = one(df, V.std(q, 1))
    assert got[0] is None and got[1:] == pytest.approx([np.std(r, ddof=1) for r in rows[1:]])
    assert one(df, V.fourier(q, 1))[3] == pytest.approx(abs(np.fft.rfft(rows[3])[1]) / 96)
    assert one(df, V.largest(q, 3))[3] == pytest.approx(np.sort(rows[3])[-3:].mean())


def test_missing_slots(spark):
    df, q = vec(spark, [1, None, 3], [None, None], []), F.col("q")
    assert one(df, V.total(q)) == [4, 0, 0]
    assert one(df, V.strict_total(q)) == [None, None, 0]
    assert one(df, V.mean(q)) == [2, None, None]
    assert one(df, V.quantile(q, 0.5)) == [2, None, None]
    assert one(df, V.share_below(q, 2.0)) == [pytest.approx(1 / 3), 0, None]


def test_interpolation_is_interior_and_bounded(spark):
    df = vec(spark, [None, 0, None, None, 3, None], [0, None, None, None, None, None, 6], [None])
    assert one(df, V.interpolate(F.col("q"))) == [[None, 0, 1, 2, 3, None], [0, None, None, None, None, None, 6], [None]]


def brute_runs(flags, ring):
    n = len(flags)
    if n and all(flags):
        return [(0, n)]
    out = []
    for i in range(n):
        if flags[i] and not (flags[i - 1] if ring or i else False):
            k = 0
            while k < n and (flags[(i + k) % n] if ring else i + k < n and flags[i + k]):
                k += 1
            out.append((i, k))
    return out


def test_runs_on_line_and_ring(spark):
    rng = np.random.default_rng(1)
    rows = [rng.random(n) < 0.6 for n in (1, 2, 7, 12, 30)] + [np.ones(4, bool), np.zeros(4, bool)]
    df = vec(spark, *rows)
    flags = F.transform("q", lambda x: x > 0)
    for ring in (False, True):
        got = one(df, V.runs(flags, 1, ring))
        assert [[tuple(r) for r in g] for g in got] == [brute_runs(list(r), ring) for r in rows]
    assert one(df, V.longest_run(flags)) == [max((k for _, k in brute_runs(list(r), False)), default=0) for r in rows]
    assert one(df, V.leading_run(flags)) == [next((i for i, x in enumerate(r) if not x), len(r)) for r in rows]


def test_gap_closing(spark):
    df = vec(spark, [1, 0, 1, 0, 0, 1], [0, 1, 0])
    closed = V.close_gaps(F.transform("q", lambda x: x > 0))
    assert one(df, closed) == [[True, True, True, False, False, True], [False, True, False]]
    wider = V.close_gaps(F.transform("q", lambda x: x > 0), 2)
    assert one(df, wider) == [[True] * 6, [False, True, False]]


def test_rank_filter_repeats_edges(spark):
    x = np.random.default_rng(2).normal(size=20)
    want = [np.sort(np.pad(x, 4, mode="edge")[i : i + 9])[1] for i in range(20)]
    assert one(vec(spark, x), V.rank_filter(F.col("q"), 9, 0.2))[0] == pytest.approx(want)


def test_resampling_keeps_energy_and_shape(spark):
    x = np.array([1.0, 3, 2, 5])
    got = np.array(one(vec(spark, x), V.resample(F.col("q"), 7))[0])
    raw = np.interp(np.linspace(0, 3, 7), np.arange(4), x)
    assert got == pytest.approx(raw * x.sum() / raw.sum())


def test_injection_keeps_energy_on_the_ring(spark):
    df = vec(spark, np.full(96, 0.1))
    event = F.array(*[F.lit(float(k)) for k in (1, 2, 1)])
    got = np.array(one(df, E.inject(F.col("q"), event, F.lit(95), F.lit(4.0)))[0])
    assert got.sum() == pytest.approx(9.6 + 4)
    assert got[95] == pytest.approx(1.1) and got[0] == pytest.approx(2.1) and got[1] == pytest.approx(1.1)


def test_sequential_events_skip_accepted_runs(spark):
    x = [0.0] * 5 + [1.0] * 6 + [0.0] * 3 + [1.0] * 2 + [0.0] * 4
    out = E.sequential_events(vec(spark, x), ["id"], "q", 0.8, 3.0, 4).collect()
    assert [(r.start, r.length, r.excess) for r in out] == [(5, 6, 1.0)]


def test_plateau_wraps_midnight(spark):
    q = [0.05] * 96
    for k in range(91, 107):
        q[k % 96] = 0.05 + 0.125
    p = E.plateaus(vec(spark, q), ["id"], "q", "q").collect()
    assert [(r.start, r.length, r.wraps) for r in p] == [(91, 16, True)]
    assert p[0].amplitude_kw == pytest.approx(0.5)
    classes = spark.range(1).select(E.plateau_class(F.lit(p[0].amplitude_kw), F.lit(p[0].hours)), E.plateau_class(F.lit(3.0), F.lit(1.5))).first()
    assert list(classes) == ["wpb_candidate", "resistance_boiler"]


def test_two_season_score(spark):
    n = F.lit(None).cast("double")
    row = spark.range(1).select(E.two_season_score(F.lit(0.5), F.lit(0.5), F.lit(95), F.lit(1)), E.two_season_score(F.lit(0.5), n, F.lit(1), F.lit(1)), E.two_season_score(n, n, F.lit(1), F.lit(1))).first()
    assert row[0] > 0.8 and row[1] < 0.5 and row[2] == 0


def test_dates(spark):
    d = lambda s: F.lit(s)
    row = spark.range(1).select(
        dates.strict_date(d("31.01.2024")), dates.strict_date(d("1.1.2024")), dates.strict_date(d("31.02.2024")), dates.strict_date(F.lit(None).cast("string")),
        dates.lenient_date(d("1.2.2024")), dates.lenient_date(d("2024-02-01")), dates.lenient_date(d("soon")), dates.stamp_date(d("05.03.2024 23:45")), dates.week_start(F.lit(dt.date(2024, 1, 7))))
    assert list(row.first()) == [dt.date(2024, 1, 31), None, None, None, dt.date(2024, 2, 1), dt.date(2024, 2, 1), None, dt.date(2024, 3, 5), dt.date(2024, 1, 1)]


def test_wrapping_window_and_kilowatts(spark):
    hours = [5.75, 6.0, 17.75, 18.0, 23.75]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hours)], "id int, h double")
    assert one(df, dates.in_window(F.col("h"), 18, 6)) == [True, False, False, True, True]
    assert spark.range(1).select(*[numbers.kilowatts(F.lit(x)) for x in (0.25, 1.0, -2.0)]).first()[:] == (1, 4, -8)


def test_rounding_keeps_the_sign_as_sql_does(spark):
    import duckdb

    values = [-0.00003, -0.0, 0.0, 0.00003, -0.00005, 0.00005, 1.00005, -1.00015, 2.5, 0.49999999999999994e-4, 1e300, -1e306, float("inf"), float("nan"), None, 0.12345, -7.77775]
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 4)", [x]).fetchone()[0] for x in values]
    df = spark.createDataFrame(list(enumerate(values)), "id int, x double")
    assert list(map(repr, one(df, numbers.rounded(F.col("x"), 4)))) == list(map(repr, want))


def test_temporal_label(spark):
    day = lambda s: F.lit(dt.date.fromisoformat(s))
    a, b = day("2024-02-01"), day("2024-03-01")
    nothing = F.lit(None).cast("date")
    row = spark.range(1).select(*[dates.temporal_label(F.lit(1), day(w), a, b) for w in ("2024-01-01", "2024-03-04", "2024-01-29")], dates.temporal_label(F.lit(0), day("2024-03-04"), a, b), dates.temporal_label(F.lit(1), day("2024-03-04"), nothing, b)).first()
    assert list(row) == [0, 1, None, 0, None]


def test_sun(spark):
    up, down = dates.solar(F.col("doy"))
    june, december = spark.createDataFrame([(172,), (355,)], "doy int").select(up, down).collect()
    assert june[0] < december[0] and june[1] > december[1]
    assert 4 < june[0] < 5 and 16 < december[1] < 17


def test_text(spark):
    row = spark.range(1).select(text.clean(F.lit("  A \n b ")), text.clean(F.lit("  ")), text.number(F.lit("1,5")), text.number(F.lit("x")), text.number(F.lit("NaN")), text.is_marked(F.lit(" X ")), text.is_marked(F.lit("-")), text.is_marked(F.lit(None).cast("string"))).first()
    assert list(row) == ["a b", None, 1.5, None, None, True, False, False]


def test_root_and_shift():
    assert numbers.root(lambda x: x - 2) == pytest.approx(2)
    assert numbers.root(lambda x: 1.0) == 0.0


def test_ramps_and_shapes_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [np.abs(rng.normal(size=192)) for _ in range(3)]
    got = E.timed_ramps(vec(spark, *rows), ["id"], "q", 2.0, 4).orderBy("id").collect()
    for r, x in zip(got, rows):
        kw = x * 4
        big = [i for i in range(1, 192) if kw[i] - kw[i - 1] >= 2 and kw[i : i + 4].mean() >= 2]
        assert r.ramps == len(big) and r.rise_max == pytest.approx(max(kw[i] - kw[i - 1] for i in big))
        assert r.rise_median == pytest.approx(np.median([kw[i] - kw[i - 1] for i in big])) and r.days == len({i // 96 for i in big})
    shapes = E.shape_features(vec(spark, *rows), ["id"], "q", (1, 2), 4).orderBy("id").collect()
    for r, x in zip(shapes, rows):
        z = (x - np.median(x)) / max(np.quantile(x, 0.95) - np.quantile(x, 0.05), 0.1)
        assert [r[f"shape_block{b}"] for b in range(4)] == pytest.approx(z.reshape(4, 48).mean(axis=1))
        assert [r.fourier_1, r.fourier_2] == pytest.approx(np.abs(np.fft.rfft(z))[1:3] / 192)
