"""Windows, nearest cells and the K function against brute force; the contrast finds what made its K."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swelter.operators import point_process as pp


@pytest.mark.parametrize(("first", "last", "size", "want"), [(0.0, 10.0, 4.0, [2.0, 6.0]), (0.0, 10.0, 5.0, [2.5, 7.5]), (0.0, 1.0, 5.0, []), (0.0, 11.0, 4.0, [2.0, 6.0, 10.0])])
def test_pixel_centres(spark, first, last, size, want):
    assert spark.range(1).select(pp.axis_centres(F.lit(first), F.lit(last), size)).first()[0] == want


def test_nearest_cells_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    c, p = rng.uniform(-300, 300, (80, 2)), rng.uniform(-350, 350, (200, 2))
    cells = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(c)], "cell_id int, x_km double, y_km double")
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id int, x_km double, y_km double")
    d = np.sqrt(((p[:, None] - c) ** 2).sum(axis=2))
    for r in pp.nearest_cell(points, cells, 60.0, "id").collect():
        if d[r.id].min() > 60:
            assert r.nearest_cell_id is None
        else:
            assert (r.nearest_cell_id, r.nearest_cell_distance_km) == (d[r.id].argmin(), pytest.approx(d[r.id].min()))


def test_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    pixels = spark.range(20).select((F.col("id") * 10.0 + 5).alias("x_km")).crossJoin(spark.range(15).select((F.col("id") * 10.0 + 5).alias("y_km")))
    shifts = pp.overlaps(pixels, 10.0, 40.0)
    assert {(r.i, r.j): r.area for r in shifts.collect()}[(3, -2)] == 17 * 13 * 100.0
    p = np.column_stack([rng.uniform(0, 200, 60), rng.uniform(0, 150, 60)])
    w = rng.uniform(0.001, 0.004, 60)
    points = spark.createDataFrame([(i, float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(p, w))], "ellipse_id int, x_km double, y_km double, intensity double")
    got = pp.inhomogeneous_k(points, shifts, 10.0, 40.0, 8).orderBy("r").collect()
    half = lambda v: np.sign(v) * np.floor(abs(v) + 0.5)
    for r in got:
        want = sum(1 / (w[a] * w[b] * (20 - abs(half((p[b] - p[a])[0] / 10))) * (15 - abs(half((p[b] - p[a])[1] / 10))) * 100) for a in range(60) for b in range(60) if a != b and np.hypot(*(p[b] - p[a])) <= r.r)
        assert r.k == pytest.approx(want, rel=1e-9)


def test_overlaps_of_a_window_with_holes(spark):
    rng = np.random.default_rng(8)
    held = {(x, y) for x in range(14) for y in range(11) if rng.random() < 0.6}
    pixels = spark.createDataFrame([(x * 10.0 + 5, y * 10.0 - 40) for x, y in held], "x_km double, y_km double")
    got = {(r.i, r.j): r.area for r in pp.overlaps(pixels, 10.0, 30.0).collect()}
    x0, y0 = min(x for x, _ in held), min(y for _, y in held)
    assert x0 == y0 == 0
    want = {(i, j): 100.0 * n for i in range(-4, 5) for j in range(-4, 5) if (n := sum((x + i, y + j) in held for x, y in held))}
    assert got == want


def test_contrast_finds_the_model():
    r = np.linspace(5, 400, 64)
    variance, scale, contrast, converged = pp.minimum_contrast(r, pp.model_k(r, 1.3, 70.0))
    assert converged and variance == pytest.approx(1.3, rel=1e-3) and scale == pytest.approx(70.0, rel=1e-3) and contrast < 1e-8
    assert pp.model_k(r, 1e-9, 50.0) == pytest.approx(np.pi * r * r, rel=1e-4)
