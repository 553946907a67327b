"""Running totals and ranks over buckets equal those over the whole table."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from swelter.functions import ordered
from swelter.operators import point_process


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("n", [1, 7, 40])
def test_running_totals(spark, n, down):
    rng = random.Random(n)
    # a third of all rows share one value, some rows agree in everything
    rows = [(rng.choice([5.0, rng.random() * 10, rng.random() * 10]), rng.randrange(400), rng.randrange(1, 5) / 4) for _ in range(1500)]
    df = spark.createDataFrame(rows, "v double, id int, w double")
    got = sorted((r.v, r.id, r.w, r.before) for r in ordered.running(df, "v", "id", F.col("w"), down, n=n).collect())
    key = lambda r: (-r[0] if down else r[0], r[1])
    want, total = [], Decimal(0)
    ranked = sorted(rows, key=key)
    for k, r in enumerate(ranked):
        if k and key(ranked[k - 1]) != key(r):
            total = sum((Decimal(x[2]) for x in ranked[:k]), Decimal(0))
        want.append((*r, total))
    assert got == sorted(want)


def test_totals_by_value_and_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(50) / 2) for _ in range(600)] + [("a", None)]
    got = ordered.totals_by_value(spark.createDataFrame(rows, "g string, v double"), "v", F.lit(1), keys=("g",), n=6).collect()
    assert len(got) == len({r for r in rows if r[1] is not None})
    for r in got:
        assert r.of == rows.count((r.g, r.v)) and r.before == sum(1 for g, v in rows if v is not None and g == r.g and v < r.v)


def test_ranks_have_no_window_over_the_whole_table(spark):
    cells = spark.createDataFrame([(i, float(i % 30), 1e-7 * (i % 9 + 1) * (1 + 1e-15 * (i % 2))) for i in range(90)], "cell_id int, lat double, mean_intensity_per_km2 double")
    ranks = point_process.concentration_ranks(cells)
    assert {(r.cell_id % 9, round(r.concentration_rank, 9)) for r in ranks.collect()} == {(k, round((10 * k + 5.5) / 90, 9)) for k in range(9)}
    points = cells.select(F.col("cell_id").alias("nearest_cell_id"), F.lit(True).alias("is_daily_largest"), F.lit(False).alias("is_event_largest"))
    for df in (ranks, point_process.zones(cells, points, 1.0, 1.0)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("_bucket" in line for line in windows)  # rows of a bucket, or one row for each bucket
    assert point_process.concentration_ranks(cells.limit(0)).count() == 0
