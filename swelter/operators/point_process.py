"""The point process of centroids: raster, window, nearest cells, trend and zones.

Places are points of the equal-area plane (projection), in km. Nearest cells are found by
an equi-join on tiles of the plane, not by comparing all pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from swelter.functions.ordered import TOTAL, running, significant, totals_by_value
from swelter.functions.projection import forward, inverse
from swelter.operators.ellipses import KM_LAT, KM_LON


def projected(places: DataFrame, lon0: float, lat0: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    x, y = forward(F.col(lon), F.col(lat), lon0, lat0)
    return places.withColumns({"x_km": x, "y_km": y})


def centre(cells: DataFrame) -> tuple[float, float]:
    """The middle of the cells' extent, (lon, lat)."""
    r = cells.agg(((F.min("lon") + F.max("lon")) / 2).alias("lon"), ((F.min("lat") + F.max("lat")) / 2).alias("lat")).first()
    return r["lon"], r["lat"]


def nearest_cell(points: DataFrame, cells: DataFrame, reach: float, key: str) -> DataFrame:
    """points with nearest_cell_id and nearest_cell_distance_km, null where no cell is within reach.

    points, cells: with x_km, y_km; cells with cell_id. Cells are dealt to square tiles of
    side reach; a point looks at its own tile and the eight around it. Of cells equally
    near the smallest id is taken.
    """
    tile = lambda c: F.floor(F.col(c) / reach).cast("long")
    held = cells.select("cell_id", F.col("x_km").alias("_cx"), F.col("y_km").alias("_cy"), tile("x_km").alias("_i"), tile("y_km").alias("_j"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asked = points.select(key, "x_km", "y_km", F.explode(near).alias("_a")).withColumn("_b", F.explode(near))
    asked = asked.select(key, "x_km", "y_km", (tile("x_km") + F.col("_a")).alias("_i"), (tile("y_km") + F.col("_b")).alias("_j"))
    d = F.sqrt((F.col("x_km") - F.col("_cx")) ** 2 + (F.col("y_km") - F.col("_cy")) ** 2)
    best = asked.join(held, ["_i", "_j"]).withColumn("_d", d).where(F.col("_d") <= reach).groupBy(key).agg(F.min(F.struct("_d", "cell_id")).alias("_best"))
    return points.join(best, key, "left").withColumns({"nearest_cell_id": F.col("_best.cell_id"), "nearest_cell_distance_km": F.col("_best._d")}).drop("_best")


def axis_centres(first: Column, last: Column, size: float) -> Column:
    """Centres of the pixels of an axis: first + size / 2, and on by size while below last."""
    n = F.ceil((last - first - size / 2) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: first + size / 2 + k * size)).otherwise(F.array().cast("array<double>"))


def pixels(cells: DataFrame, size: float) -> DataFrame:
    """(pixel_id, x_km, y_km) of the raster over the cells' extent, a pixel's size more on each side, x fastest."""
    box = cells.agg(*[f(c).alias(f"{n}_{c}") for c in ("x_km", "y_km") for f, n in ((F.min, "min"), (F.max, "max"))])
    rows = box.select(
        axis_centres(F.col("min_x_km") - size, F.col("max_x_km") + size, size).alias("xs"), axis_centres(F.col("min_y_km") - size, F.col("max_y_km") + size, size).alias("ys"),
    )
    rows = rows.select(F.size("xs").alias("nx"), "xs", F.posexplode("ys").alias("iy", "y_km"))
    # the rows are dealt out before the pixels of each are made
    rows = rows.repartition("iy").select("nx", "iy", "y_km", F.posexplode("xs").alias("ix", "x_km"))
    return rows.select((F.col("iy").cast("long") * F.col("nx") + F.col("ix")).alias("pixel_id"), "x_km", "y_km")


def window(cells: DataFrame, points: DataFrame, lon0: float, lat0: float, size: float, margin: float) -> DataFrame:
    """Pixels of the observation window: those with a cell within size + margin, and each point's own.

    points: with x_km, y_km. Returns pixel_id, x_km, y_km, lon, lat, nearest_cell_id and
    nearest_cell_distance_km.
    """
    raster = pixels(cells, size)
    near = nearest_cell(raster, cells, size + margin, "pixel_id").where("nearest_cell_id is not null")
    corner = raster.agg(F.min("x_km").alias("x0"), F.min("y_km").alias("y0"), F.max("x_km").alias("x1"))
    k = lambda c, o: F.round((F.col(c) - F.col(o)) / size)
    nx = F.round((F.col("x1") - F.col("x0")) / size) + 1
    own = points.join(F.broadcast(corner)).select((k("y_km", "y0") * nx + k("x_km", "x0")).cast("long").alias("pixel_id")).distinct()
    forced = raster.join(own, "pixel_id", "left_semi").join(near.select("pixel_id"), "pixel_id", "left_anti")
    forced = nearest_cell(forced, cells, 4 * (size + margin), "pixel_id")
    lon, lat = inverse(F.col("x_km"), F.col("y_km"), lon0, lat0)
    return near.unionByName(forced).withColumns({"lon": lon, "lat": lat})


#: Points that a fit takes at least.
LEAST_POINTS = 5


def trend(quadrature: DataFrame, covariates: tuple[str, ...], max_iter: int = 50) -> dict[str, float]:
    """Coefficients of the log-linear intensity, by a weighted Poisson regression.

    quadrature: (n, w, covariates): points of the process and of the raster with their
    weights w; y = n / w is regressed on the covariates with weights w (Berman and Turner).
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = VectorAssembler(inputCols=list(covariates), outputCol="features").transform(quadrature.withColumn("y", F.col("n") / F.col("w")))
    model = GeneralizedLinearRegression(family="poisson", link="log", labelCol="y", weightCol="w", maxIter=max_iter, tol=1e-10).fit(rows)
    return {"(Intercept)": float(model.intercept)} | {c: float(v) for c, v in zip(covariates, model.coefficients)}


def quadrature(window_pixels: DataFrame, points: DataFrame, covariates: tuple[str, ...], size: float) -> DataFrame:
    """(n, w, covariates): a pixel's area is shared by its centre and the points in it."""
    at = lambda c: F.floor(F.col(c) / size)
    held = points.groupBy(at("x_km").alias("_i"), at("y_km").alias("_j")).agg(F.count("*").alias("_n"))
    area = size * size
    dummy = window_pixels.withColumns({"_i": at("x_km"), "_j": at("y_km")}).join(held, ["_i", "_j"], "left").select(F.lit(0.0).alias("n"), (area / (1 + F.coalesce("_n", F.lit(0)))).alias("w"), *covariates)
    data = points.withColumns({"_i": at("x_km"), "_j": at("y_km")}).join(held, ["_i", "_j"]).select(F.lit(1.0).alias("n"), (area / (1 + F.col("_n"))).alias("w"), *covariates)
    return dummy.unionByName(data)


def intensities(cells: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """cells with mean_intensity_per_km2 and concentration_rank, the share of cells no more intense (ties averaged)."""
    linear = F.lit(coefficients["(Intercept)"])
    for name, value in coefficients.items():
        if name != "(Intercept)":
            linear = linear + value * F.col(name)
    return concentration_ranks(cells.withColumn("mean_intensity_per_km2", F.exp(linear)))


#: Digits of an intensity that count in its rank; further ones depend on the order of sums.
DIGITS = 12


def concentration_ranks(cells: DataFrame, digits: int = DIGITS) -> DataFrame:
    """cells with concentration_rank: average rank of mean_intensity_per_km2 over the number of cells, ties averaged."""
    valued = cells.withColumn("_v", significant(F.col("mean_intensity_per_km2"), digits))
    ranks = totals_by_value(valued, "_v", F.lit(1)).select(F.col("_v").alias("_w"), ((F.col("before") + (F.col("of") + 1) / 2) / cells.agg(F.count("*")).scalar()).cast("double").alias("concentration_rank"))
    return valued.join(ranks, F.col("_v") == F.col("_w"), "left").drop("_v", "_w")


#: Shares of the area whose most intense part is a zone.
ZONES = (0.2, 0.5)


def zones(cells: DataFrame, points: DataFrame, step_lon: float, step_lat: float, fractions: tuple[float, ...] = ZONES) -> DataFrame:
    """(zone_area_fraction, group, n_centroids_in_group, n_in_zone, percent_in_zone).

    cells: (cell_id, lat, mean_intensity_per_km2); points: (nearest_cell_id,
    is_daily_largest, is_event_largest). The zone of a fraction holds the most intense
    cells until their share of the area reaches it, the cell that does included.
    """
    area = KM_LON * F.cos(F.radians("lat")) * step_lon * KM_LAT * step_lat
    valued = cells.withColumns({"_v": significant(F.col("mean_intensity_per_km2"), DIGITS), "_area": area.cast(TOTAL)})
    ranked = running(valued, "_v", "cell_id", F.col("_area"), down=True, name="_upto")
    ranked = ranked.withColumn("_before", F.col("_upto").cast("double") / valued.agg(F.sum("_area").cast("double")).scalar())
    at = points.join(ranked.select(F.col("cell_id").alias("nearest_cell_id"), "_before"), "nearest_cell_id")
    groups = {"all_centroids": F.lit(True), "daily_largest": F.col("is_daily_largest"), "event_largest": F.col("is_event_largest")}
    each = at.select("_before", F.explode(F.array(*[F.struct(F.lit(g).alias("group"), c.alias("own")) for g, c in groups.items()])).alias("g"))
    each = each.select("_before", "g.*", F.explode(F.array(*map(F.lit, fractions))).alias("zone_area_fraction"))
    inside = F.count_if(F.col("own") & (F.col("_before") < F.col("zone_area_fraction")))
    counts = each.groupBy("zone_area_fraction", "group").agg(F.count_if("own").alias("n_centroids_in_group"), inside.alias("n_in_zone"))
    return counts.withColumn("percent_in_zone", 100 * F.col("n_in_zone") / F.nullif(F.col("n_centroids_in_group"), F.lit(0)))


#: Contrast of fourth roots, and distances at which K is compared.
ROOT, DISTANCES = 0.25, 64


def overlaps(window_pixels: DataFrame, size: float, reach: float) -> DataFrame:
    """(i, j, area): how much of the window falls on itself when shifted by i, j pixels, within reach.

    Rows of the window are runs of pixels; two runs, one shifted along the other, overlap
    by what their ends tell, so runs are set against runs of the rows within reach, not
    pixels against pixels.
    """
    most = math.ceil(reach / size) + 1
    corner = window_pixels.agg(F.min("x_km").alias("x0"), F.min("y_km").alias("y0"))
    at = window_pixels.join(F.broadcast(corner)).select(F.round((F.col("x_km") - F.col("x0")) / size).cast("long").alias("px"), F.round((F.col("y_km") - F.col("y0")) / size).cast("long").alias("py"))
    # pixels that follow each other keep their distance from their place in the row
    runs = at.withColumn("_r", F.col("px") - F.row_number().over(W.partitionBy("py").orderBy("px"))).groupBy("py", "_r").agg(F.min("px").alias("a"), F.max("px").alias("b"))
    moved = runs.withColumn("j", F.explode(F.sequence(F.lit(-most), F.lit(most)))).select((F.col("py") + F.col("j")).alias("py"), "a", "b", "j")
    there = runs.select("py", F.col("a").alias("c"), F.col("b").alias("d"))
    shifts = F.sequence(F.greatest(F.col("c") - F.col("b"), F.lit(-most).cast("long")), F.least(F.col("d") - F.col("a"), F.lit(most).cast("long")))
    pairs = moved.join(there, "py").where((F.col("c") - F.col("b") <= most) & (F.col("d") - F.col("a") >= -most)).withColumn("i", F.explode(shifts))
    shared = F.least(F.col("b") + F.col("i"), F.col("d")) - F.greatest(F.col("a") + F.col("i"), F.col("c")) + 1
    return pairs.groupBy("i", "j").agg((F.sum(shared) * (size * size)).alias("area"))


def inhomogeneous_k(points: DataFrame, shifts: DataFrame, size: float, reach: float, n: int = DISTANCES, key: str = "ellipse_id") -> DataFrame:
    """(r, k): the inhomogeneous K function at n distances up to reach, translation corrected.

    points: (key, x_km, y_km, intensity). Pairs are found by tiles of side reach; each
    counts by the intensities of both and the window's overlap at its shift, interpolated
    to the nearest pixel.
    """
    tile = lambda c: F.floor(F.col(c) / reach).cast("long")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    held = points.select(F.col(key).alias("b"), F.col("x_km").alias("bx"), F.col("y_km").alias("by"), F.col("intensity").alias("lb"), tile("x_km").alias("i0"), tile("y_km").alias("j0"))
    asked = points.select(F.col(key).alias("a"), "x_km", "y_km", F.col("intensity").alias("la"), tile("x_km").alias("ti"), tile("y_km").alias("tj"))
    asked = asked.withColumn("di", F.explode(near)).withColumn("dj", F.explode(near)).withColumns({"i0": F.col("ti") + F.col("di"), "j0": F.col("tj") + F.col("dj")})
    dx, dy = F.col("bx") - F.col("x_km"), F.col("by") - F.col("y_km")
    pairs = asked.join(held, ["i0", "j0"]).where("a <> b").select("la", "lb", F.sqrt(dx * dx + dy * dy).alias("d"), F.round(dx / size).cast("long").alias("i"), F.round(dy / size).cast("long").alias("j")).where(F.col("d") <= reach)
    weighed = pairs.join(shifts, ["i", "j"]).select(F.ceil(F.col("d") * n / reach).cast("int").alias("bin"), (1 / (F.col("la") * F.col("lb") * F.col("area"))).alias("w"))
    sums = weighed.groupBy("bin").agg(F.sum("w").alias("w"))
    bins = points.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("bin"))
    whole = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # one row a distance
    return bins.join(sums, "bin", "left").select((F.col("bin") * reach / n).alias("r"), F.sum(F.coalesce("w", F.lit(0.0))).over(whole).alias("k"))


def model_k(r: np.ndarray, variance: float, scale: float) -> np.ndarray:
    """K of a log-Gaussian Cox process of exponential covariance, by the trapezoid rule from 0."""
    s = np.linspace(0.0, r[-1], 64 * len(r) + 1)
    f = 2 * np.pi * s * np.exp(variance * np.exp(-s / scale))
    whole = np.concatenate([[0.0], np.cumsum((f[1:] + f[:-1]) / 2) * (s[1] - s[0])])
    return np.interp(r, s, whole)


def minimum_contrast(r: np.ndarray, k: np.ndarray, start: tuple[float, float] | None = None) -> tuple[float, float, float, bool]:
    """(variance, scale, contrast, converged): the model whose K is nearest, in fourth roots (Diggle).

    A simplex search (Nelder and Mead) over the logarithms of both.
    """
    value = lambda p: float(np.mean((model_k(r, math.exp(min(p[0], 3.0)), math.exp(p[1])) ** ROOT - k**ROOT) ** 2))
    first = np.log(start or (1.0, r[-1] / 4))
    simplex = [first, first + [0.5, 0.0], first + [0.0, 0.5]]
    at = [value(p) for p in simplex]
    for _ in range(500):
        order = np.argsort(at, kind="stable")
        simplex, at = [simplex[i] for i in order], [at[i] for i in order]
        if at[2] - at[0] <= 1e-12 * (abs(at[0]) + 1e-12) or max(np.abs(simplex[2] - simplex[0]).max(), np.abs(simplex[1] - simplex[0]).max()) < 1e-9:
            return math.exp(simplex[0][0]), math.exp(simplex[0][1]), at[0], True
        middle = (simplex[0] + simplex[1]) / 2
        step = middle - simplex[2]
        tried = [(value(middle + f * step), f) for f in (1.0,)]
        if tried[0][0] < at[0]:
            tried.append((value(middle + 2 * step), 2.0))
        elif tried[0][0] >= at[1]:
            tried.append((value(middle + (0.5 if tried[0][0] < at[2] else -0.5) * step), 0.5 if tried[0][0] < at[2] else -0.5))
        best, f = min(tried)
        if best < at[2]:
            simplex[2], at[2] = middle + f * step, best
        else:
            simplex = [simplex[0], *[simplex[0] + (p - simplex[0]) / 2 for p in simplex[1:]]]
            at = [at[0], *map(value, simplex[1:])]
    return math.exp(simplex[0][0]), math.exp(simplex[0][1]), at[0], False
