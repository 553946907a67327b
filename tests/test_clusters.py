"""Clusters of days that are dealt to tiles equal those of whole days."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from swelter.operators import clustering

DAY = dt.date(2001, 6, 1)


def days(rng, n_days, side, share):
    """Random blobs on a grid of quarter degrees, some days dense, some sparse."""
    out = []
    for d in range(n_days):
        field = rng.random((side, side))
        for _ in range(2):
            field = (field + np.roll(field, 1, 0) + np.roll(field, 1, 1) + np.roll(field, -1, 0)) / 4
        x, y = np.nonzero(field <= np.quantile(field, share[d % len(share)]))
        out += [(DAY + dt.timedelta(d), int(a * side + b), 40 + b * 0.25, 10 + a * 0.25, 1, 30.0) for a, b in zip(x.tolist(), y.tolist())]
    return out


SCHEMA = "date date, cell_id int, lat double, lon double, local_event_id int, tmax_c double"


def whole_days(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for d, own in by.items():
        own.sort(key=lambda r: (r[3], r[2]))
        lon, lat = np.array([r[3] for r in own]), np.array([r[2] for r in own])
        yield d, own, clustering.neighbours(lon, lat, 0.25, 4.0)


@pytest.mark.parametrize("tile", [4, 9, 256])
def test_labels_of_tiles_equal_those_of_whole_days(spark, tile):
    rng = np.random.default_rng(11)
    rows = days(rng, 6, 30, (0.15, 0.3, 0.45))
    cells = spark.createDataFrame(rows, SCHEMA)
    pick = [(1.0, 3), (1.5, 5), (2.0, 6), (2.5, 9), (4.0, 12), (3.4, 4)]
    settings = spark.createDataFrame([(DAY + dt.timedelta(d), float(e), m) for d, (e, m) in enumerate(pick)], "date date, sequence_eps double, sequence_min_samples int")
    got = {(r.date, r.cell_id): (r.dbscan_label, r.is_core_cell, r.n_cells_within_eps) for r in clustering.labelled(cells, settings, 0.25, tile=tile).collect()}
    assert len(got) == len(rows)
    seen = set()
    for d, own, near in whole_days(rows):
        e, m = pick[(d - DAY).days]
        labels, n_near = clustering.dbscan(len(own), near, e, m)
        for r, label, n in zip(own, labels.tolist(), n_near.tolist()):
            assert got[d, r[1]] == (label, int(n >= m), n)
            seen.add(label)
    assert len(seen) > 5 and -1 in seen


@pytest.mark.parametrize("tile", [4, 11])
def test_counts_of_tiles_equal_those_of_whole_days(spark, tile):
    rng = np.random.default_rng(12)
    rows = days(rng, 4, 26, (0.1, 0.2, 0.4))
    eps, sizes = (1.0, 2.0, 3.5, 4.0), (4, 7, 12)
    got = {(r.date, r.eps, r.min_samples): r.n_clusters for r in clustering.cluster_counts(spark.createDataFrame(rows, SCHEMA), 0.25, eps, sizes, tile).collect()}
    want = {(d, e, m): int(clustering.dbscan(len(own), near, e, m)[0].max(initial=-1)) + 1 for d, own, near in whole_days(rows) for e in eps for m in sizes}
    assert got == want and max(want.values()) > 4 and 0 in want.values()


def test_a_large_day_in_tiles(spark):
    """A ring and a snake that run through many tiles are one cluster each; no task gets more than a tile and its border."""
    side, at = 400, {}
    for k in range(side):
        for w in range(2):
            for x, y in ((k, w), (k, side - 1 - w), (w, k), (side - 1 - w, k)):
                at[x, y] = 1
    for row in range(20, 380, 24):
        for k in range(20, 380):
            at[k, row] = at[k, row + 1] = 2
        end = 379 if (row - 20) // 24 % 2 == 0 else 20
        if row + 24 < 380:
            for y in range(row, row + 24):
                at[end, y] = at[end - 1 if end > 20 else 21, y] = 2
    rows = [(DAY, x * side + y, y * 0.25, x * 0.25, 1, 30.0) for x, y in at]
    cells = spark.createDataFrame(rows, SCHEMA)
    settings = spark.createDataFrame([(DAY, 1.5, 4)], "date date, sequence_eps double, sequence_min_samples int")
    out = clustering.labelled(cells, settings, 0.25, tile=32)
    got = {(r.cell_id // side, r.cell_id % side): r.dbscan_label for r in out.collect()}
    assert got == {k: v - 1 for k, v in at.items()}
    most = clustering.tiled(cells, 0.25, 4, 32).groupBy("ti", "tj").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert most <= (32 + 16) ** 2 and clustering.cluster_counts(cells, 0.25, (1.5,), (4,), 32).first().n_clusters == 2


def test_no_cells(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert clustering.cluster_counts(none).count() == 0
    assert clustering.labelled(none, spark.createDataFrame([], "date date, sequence_eps double, sequence_min_samples int")).count() == 0
