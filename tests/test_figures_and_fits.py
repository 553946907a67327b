"""Figure data and pruned power-law fits against direct computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swelter.operators import figure_data as fd
from swelter.operators import power_law


def test_density_is_that_of_all_values(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(10, 25, 400), "b": np.r_[rng.uniform(-90, 90, 60), -140.0, 170.0], "one": np.array([3.0]), "same": np.full(5, 2.0)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    got = fd.density(df, "g", "v", -90.0, 90.0).toPandas()
    assert set(got["g"]) == {"a", "b"}
    for g, own in got.groupby("g"):
        own, v = own.sort_values("at"), values[g]
        h = v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-0.5 * ((np.linspace(-90, 90, 600)[:, None] - v) / h) ** 2).sum(axis=1) / (h * len(v) * math.sqrt(2 * math.pi))
        assert len(own) == 600 and np.allclose(own["at"], np.linspace(-90, 90, 600)) and np.abs(own["density"] - want).max() < 1e-3 * want.max()


def hinges(x):
    x, n = np.sort(x), len(x)
    d = math.floor((n + 3) / 2) / 2
    at = lambda k: (x[math.floor(k) - 1] + x[math.ceil(k) - 1]) / 2
    return at(d), at((n + 1) / 2), at(n + 1 - d)


def test_boxes_equal_tukeys(spark):
    rng = np.random.default_rng(6)
    groups = {k: np.round(np.r_[rng.normal(0, 1, n), rng.normal(0, 8, n // 5)], 1) for k, n in enumerate((1, 2, 3, 4, 7, 50, 333))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(0, None), (None, 1.0)], "g int, v double")
    got, out = {r.g: r for r in fd.boxes(df, "g", "v").collect()}, fd.outliers(df, "g", "v").collect()
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        low, mid, high = hinges(v)
        reach = 1.5 * (high - low)
        inside = v[(v >= low - reach) & (v <= high + reach)]
        assert tuple(got[k])[1:] == (len(v), inside.min(), pytest.approx(low), pytest.approx(mid), pytest.approx(high), inside.max(), len(v) - len(inside))
        assert sorted(r.v for r in out if r.g == k) == sorted(v[(v < low - reach) | (v > high + reach)])
    assert len(out) > 5


def test_classes_and_limits(spark):
    counts = [0] * 50 + [1] * 20 + [2] * 20 + [3] * 9 + [40]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(counts)] + [(200, None)], "id int, n int")
    breaks = fd.quantile_breaks(df, "n")
    want = list(dict.fromkeys([0.0, *np.quantile(counts, fd.CLASS_SHARES).tolist()]))
    assert breaks.first().breaks == pytest.approx(want)
    got = {r.id: r["class"] for r in fd.classed(df, "n", breaks).collect()}
    assert got[200] is None and all(got[i] == min(np.searchsorted(want, c, side="right") - 1, len(want) - 2) for i, c in enumerate(counts))
    assert tuple(fd.robust_limits(df, "n").first()) == pytest.approx(tuple(np.quantile(counts, [0.02, 0.98])))
    assert tuple(fd.robust_limits(df.where("n = 1"), "n").first()) == (1.0, 2.0)
    ranks = spark.createDataFrame([(k / 20,) for k in range(1, 21)], "concentration_rank double")
    assert [r.rank_class for r in fd.rank_classes(ranks).orderBy("concentration_rank").collect()] == [min(k // 2, 9) for k in range(1, 21)]


def test_outlines_lie_on_their_ellipses(spark):
    e = (7, 600.0, 200.0, math.cos(0.7), math.sin(0.7), 12.0, 48.0)
    df = spark.createDataFrame([e], "ellipse_id int, major_axis_km double, minor_axis_km double, major_axis_east double, major_axis_north double, centroid_lon_weighted double, centroid_lat_weighted double")
    rows = fd.outlines(df).orderBy("point").collect()
    assert len(rows) == 240 and (rows[0].lon, rows[0].lat) == pytest.approx((rows[-1].lon, rows[-1].lat))
    for r in rows:
        x, y = (r.lon - 12) * 111.320 * math.cos(math.radians(48)), (r.lat - 48) * 110.574
        assert ((x * e[3] + y * e[4]) / 300) ** 2 + ((y * e[3] - x * e[4]) / 100) ** 2 == pytest.approx(1)
    ends = {r.axis: r for r in fd.axes(df).collect()}
    assert (ends["major"].lon_to, ends["major"].lat_to) == pytest.approx((rows[0].lon, rows[0].lat))
    assert (ends["minor"].lon_from + ends["minor"].lon_to) / 2 == pytest.approx(12)


def test_pruned_fits_equal_the_scan_of_all_cutoffs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    body = rng.uniform(1, 50, 300)
    samples = {"tail": np.r_[body, 50 * rng.pareto(2.5, 200) + 50], "ties": np.round(50 * rng.pareto(1.5, 400) + 10, 0), "two": np.array([3.0, 9.0]), "same": np.full(4, 2.0)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in samples.items() for v in vs], "dataset string, area_km2 double")
    got = {r.dataset: r for r in power_law.fitted(df).collect()}
    for k, v in samples.items():
        want = power_law.fit(v)
        if want is None:
            assert got[k].status == "no_candidates" and got[k].n_candidates == 0
            continue
        assert (got[k].xmin_km2, got[k].alpha, got[k].ks_distance, got[k].n_tail) == (want[0], pytest.approx(want[1], rel=1e-10), pytest.approx(want[2], abs=1e-10), want[3])
        assert got[k].n_candidates == len(set(v)) - 1 and got[k].status == "ok"
    left = power_law._sorted_out(df.where("dataset = 'tail'"), "dataset", "area_km2").count()
    assert left < 0.25 * len(samples["tail"])  # of 500 cutoffs few are set against their tails


def test_tail_curves(spark):
    fits = spark.createDataFrame([("d", 100, 40, 10.0, 2.5, "ok"), ("e", 3, 0, 1.0, 1.0, "no_candidates")], "dataset string, n long, n_tail long, xmin_km2 double, alpha double, status string")
    sample = spark.createDataFrame([("d", 1000.0), ("d", 10.0), ("e", 1.0)], "dataset string, area_km2 double")
    rows = fd.tail_curves(fits, sample, 3).orderBy("point").collect()
    assert [(r.area_km2, r.ccdf) for r in rows] == [(pytest.approx(x), pytest.approx(0.4 * (x / 10) ** -1.5)) for x in (10.0, 100.0, 1000.0)]
