"""Stages of the grid analysis on small inputs with known answers."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swelter.functions import stats
from swelter.operators import clustering, ellipses, events, heatwaves, power_law, regional
from swelter.plans import catalogue
from swelter.sources import grid


def series(bits, skip=()):
    """One cell whose days at 1 exceed; calendar days in skip are missing."""
    day, out = dt.date(2001, 6, 1), []
    for i, b in enumerate(bits):
        while (day - dt.date(2001, 6, 1)).days in skip:
            day += dt.timedelta(1)
        out.append((day, i, float(b)))
        day += dt.timedelta(1)
    return out


@pytest.mark.parametrize(
    ("bits", "skip", "spans"),
    [("1110110011010101", (), [(1, 6, 5), (9, 16, 5)]), ("01110", (), [(2, 4, 3)]), ("110011", (), []), ("1011", (), [(1, 4, 3)]), ("101", (), []), ("111111", (3,), [(1, 3, 3), (4, 6, 3)]), ("111111", (), [(1, 6, 6)])],
)
def test_islands(spark, bits, skip, spans):
    rows = series(map(int, bits), skip)
    df = spark.createDataFrame([(d, 1, 0.0, 0.0, v) for d, _, v in rows], "date date, cell_id int, lon double, lat double, tmax_c double")
    found, days = heatwaves.detect(df, 99.9 if "0" in bits else 0, 3, 3)
    place = {d: i + 1 for d, i, _ in rows}
    assert sorted((place[r.start_date], place[r.end_date], r.exceeding_days) for r in found.collect()) == spans
    inside = {place[r.date] for r in days.where("local_event_id is not null").collect()}
    assert inside == {k for a, b, _ in spans for k in range(a, b + 1)}


@pytest.mark.parametrize(("values", "q", "want"), [(range(1, 101), 0.975, 98), ((5, 1, 3), 0.5, 3), ((0,) * 10, 0.5, 0), ((1, 2, 3, 4), 0.5, 3)])
def test_quantile_higher(spark, values, q, want):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert df.agg(regional.quantile_higher(F.col("v"), q)).first()[0] == want


def test_dbscan_equals_a_set_definition():
    rng = random.Random(1)
    for _ in range(40):
        cells = sorted({(rng.randrange(7), rng.randrange(7)) for _ in range(rng.randrange(1, 30))})
        p = np.array(cells, dtype=float)
        d2 = (p[:, None, 0] - p[:, 0]) ** 2 + (p[:, None, 1] - p[:, 1]) ** 2
        eps, m = rng.choice([1.0, 1.5, 2.0]), rng.randrange(2, 6)
        labels, near = clustering.dbscan(len(p), clustering.neighbours(p[:, 0], p[:, 1], 1.0, rng.choice([2.0, 2.5, 4.0])), eps, m)
        assert near.tolist() == (d2 <= eps * eps).sum(axis=1).tolist()
        core = [i for i in range(len(p)) if (d2[i] <= eps * eps).sum() >= m]
        root = {i: i for i in core}
        for _ in core:
            for i in core:
                root[i] = min(root[j] for j in core if d2[i, j] <= eps * eps)
        ranks = {r: k for k, r in enumerate(sorted(set(root.values())))}
        for i in range(len(p)):
            close = [ranks[root[j]] for j in core if d2[i, j] <= eps * eps]
            assert labels[i] == (ranks[root[i]] if i in root else min(close, default=-1))


@pytest.mark.parametrize(("counts", "want"), [((1,), 1), ((3,), 2), ((1, 1, 1), 3), ((2, 3, 2), 3), ((1, 2, 1), 4), ((1, 0), 4), ((0, 2), 4)])
def test_event_types(spark, counts, want):
    got = spark.range(1).select(events.event_type(F.lit(len(counts)), F.lit(min(counts)), F.lit(max(counts)))).first()[0]
    assert got == want


def test_one_cell_has_a_round_ellipse(spark):
    df = spark.createDataFrame([(1, dt.date(2001, 1, 1), 5.0, 50.0, 30.0)], "cluster_id int, date date, lon double, lat double, tmax_c double")
    r = ellipses.fitted(df).first()
    assert (r.major_axis_km, r.axis_ratio, r.orientation_east_ccw_deg, r.azimuth_north_cw_deg) == (2.5, 1.0, 0.0, 90.0)


def test_seasons_and_trends(spark):
    assert (events.season_start((4, 5, 6)), events.season_start((11, 12, 1, 2, 3)), events.season_start(tuple(range(1, 13)))) == (4, 11, 1)
    with pytest.raises(ValueError):
        events.season_start((1, 3))
    z, p, verdict = stats.mann_kendall(45, 125)
    assert z == pytest.approx(44 / 125**0.5) and p < 0.05 and verdict == "increasing"
    assert stats.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    df = spark.createDataFrame([(3, y, 2.0 * y + 1) for y in range(1, 11)], "event_type int, year int, mean_duration_days double")
    r = events.trend_parts(df).first()
    assert (r.mann_kendall_s, r.sen_slope, r.mann_kendall_var) == (45, 2.0, 125.0) and r.ols_slope == pytest.approx(2)
    rows = [(3, y, 2.0 * y + y % 2) for y in range(1, 11)] + [(4, 1, 1.0), (4, 2, 2.0)]
    three, four = sorted(events.duration_trends(spark.createDataFrame(rows, "event_type int, year int, mean_duration_days double")).collect())
    assert three.mann_kendall_result == "increasing" and three.ols_slope_days_per_decade == pytest.approx(20, abs=0.5) and three.ols_p_value < 1e-6
    assert four.mann_kendall_result == "too few years" and four.n_years == 2 and four.ols_p_value is None and four.mann_kendall_s is None
    flat = spark.createDataFrame([(3, y, 5.0) for y in range(5)], "event_type int, year int, mean_duration_days double")
    r = sorted(events.duration_trends(flat).collect())[0]
    assert (r.ols_slope_days_per_decade, r.ols_p_value, r.ols_r_squared, r.mann_kendall_result) == (0.0, 1.0, 0.0, "no significant trend")


def test_input_helpers(spark):
    assert (grid.temperature_unit("degrees_Celsius"), grid.temperature_unit("K")) == ("degC", "K")
    with pytest.raises(ValueError):
        grid.temperature_unit("F")
    assert grid.decode_time([0, 24.0, 47.9999999999999999], "hours since 2000-01-01 00:00") == [dt.date(2000, 1, 1), dt.date(2000, 1, 2), dt.date(2000, 1, 3)]
    assert grid.decode_time([0], "hours since 2000-01-01 01:00 +02:00") == [dt.date(1999, 12, 31)]
    rows = spark.createDataFrame([(dt.date(2000, 1, d), x, y, None if (x, y) == (1.0, 0.0) else 300.0) for d in (1, 2) for x in (0.0, 1.0) for y in (0.0, 1.0)], "date date, lon double, lat double, value double")
    out = grid.complete(grid.from_rows(rows, "kelvin"))
    assert sorted({(r.cell_id, r.lon, r.lat) for r in out.collect()}) == [(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 1.0)]


def test_power_law_scan_equals_numpy_and_bootstrap_is_repeatable(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.round(1000 * (1 - rng.random(60)) ** (-1 / 1.5), 3)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)] * 3, "dataset string, area_km2 double")
    got = {r.dataset: r for r in power_law.fitted(df).collect()}
    xmin, alpha, d, n = power_law.fit(x)
    assert (got["a"].xmin_km2, got["a"].n_tail, got["a"].status) == (xmin, n, "ok") and got["b"].status == "no_candidates"
    assert got["a"].alpha == pytest.approx(alpha, rel=1e-12) and got["a"].ks_distance == pytest.approx(d, rel=1e-9)
    one = sorted(map(tuple, power_law.bootstrap(spark, x.tolist(), 20, 5).collect()))
    monkeypatch.setattr(power_law, "STATE_REPS", 7)  # other starts in the stream of numbers
    assert one == sorted(map(tuple, power_law.bootstrap(spark, x.tolist(), 20, 5).collect())) and len(one) == 20
    assert power_law.fit(np.ones(3)) is None


def test_power_law_bootstrap_covers_both_samples_and_is_summed_up(spark):
    assert catalogue.BOOTSTRAP_REPS == 5000
    got = {r.dataset: r for r in catalogue.QUERIES["power_law_summary"](spark, "/root/testdata/sf0.001", reps=20).collect()}
    assert set(got) == {"daily_maxima", "event_maxima"}
    for r in got.values():
        assert r.reps == 20 and r.status == "ok" and 0 <= r.p_lower <= r.p_upper <= 1
        assert r["alpha_boot_q2.5"] <= r.alpha_boot_q25 <= r.alpha_boot_median <= r.alpha_boot_q75 <= r["alpha_boot_q97.5"]


def test_a_threshold_of_no_cells_is_refused(spark):
    daily = spark.createDataFrame([(1, 0), (2, 0)], "k int, regional_threshold_cells int")
    with pytest.raises(ValueError, match="zero cells"):
        regional.checked(daily)
    good = daily.withColumn("regional_threshold_cells", F.lit(3))
    assert regional.checked(good) is good


def test_round_and_lone_clusters_point_by_convention(spark):
    k = 110.574 / (111.320 * math.cos(math.radians(1.0)))
    square = [(1, x * k, y) for x in (-1.0, 1.0) for y in (0.0, 2.0)]
    rows = spark.createDataFrame([(c, dt.date(2001, 6, 1), x, y, 30.0) for c, x, y in [*square, (2, 5.0, 5.0)]], "cluster_id int, date date, lon double, lat double, tmax_c double")
    # equal variances up to the last bits; made equal so that the tie itself is met
    got = {r.ellipse_id: r for r in ellipses.fitted(rows).collect()}
    assert got[1].axis_ratio == pytest.approx(1) and got[1].n_member_cells == 4
    assert (got[2].orientation_east_ccw_deg, got[2].azimuth_north_cw_deg, got[2].major_axis_km) == (0.0, 90.0, 2.5)
    even = spark.createDataFrame([(3, dt.date(2001, 6, 1), x, y, 30.0) for x, y in ((0.0, 0.0), (0.0, 0.0))], "cluster_id int, date date, lon double, lat double, tmax_c double")
    tie = ellipses.fitted(even).first()
    assert (tie.orientation_east_ccw_deg, tie.azimuth_north_cw_deg, tie.eigenvalue_major_km2, tie.major_axis_km) == (90.0, 0.0, 0.0, 2.5)
