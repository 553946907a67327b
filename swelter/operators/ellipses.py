"""Stage 4: principal-axis ellipses and temperature-weighted centroids of clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Km per degree of latitude, and of longitude at the equator; least variance in km2.
KM_LAT, KM_LON, FLOOR_KM2 = 110.574, 111.320, 1.0


def azimuth(degrees: Column) -> Column:
    """Degrees clockwise from north of an axis given counter-clockwise from east, in (-90, 90]."""
    turned = F.pmod(90 - degrees, F.lit(180.0))
    return F.when(turned > 90, turned - 180).otherwise(turned)


def fitted(cells: DataFrame, scale: float = 1.25) -> DataFrame:
    """One row per cluster of cells (cluster_id, date, lon, lat, tmax_c); noise has no id and is left out.

    Cells become km around the cluster's mean place; the covariance (n - 1) has closed-form
    axes. Axes of less than 1 km2 variance are drawn as 1, the variances stay as they are.
    A cluster of one cell, or of equal variances, points east or north by convention.
    """
    members = cells.where("cluster_id is not null")
    mean = members.groupBy("cluster_id").agg(F.avg("lon").alias("mx"), F.avg("lat").alias("my"))
    km = members.join(mean, "cluster_id").withColumns({
        "x": (F.col("lon") - F.col("mx")) * KM_LON * F.cos(F.radians("my")), "y": (F.col("lat") - F.col("my")) * KM_LAT, "w": F.col("tmax_c").cast("float").cast("double"),
    })
    sums = km.groupBy("cluster_id").agg(
        F.first("date").alias("date"), F.count("*").alias("n_member_cells"), F.first("mx").alias("centroid_lon_unweighted"), F.first("my").alias("centroid_lat_unweighted"),
        F.covar_samp("x", "x").alias("sxx"), F.covar_samp("y", "y").alias("syy"), F.covar_samp("x", "y").alias("sxy"),
        (F.sum(F.col("lon") * F.col("w")) / F.sum("w")).alias("centroid_lon_weighted"), (F.sum(F.col("lat") * F.col("w")) / F.sum("w")).alias("centroid_lat_weighted"),
        F.sum("w").alias("tmax_weight_sum_c"), F.min("w").alias("tmax_min_c"), F.max("w").alias("tmax_max_c"),
    )
    one = F.col("n_member_cells") == 1
    sums = sums.withColumns({"sxx": F.when(one, 1.0).otherwise(F.col("sxx")), "syy": F.when(one, 1.0).otherwise(F.col("syy")), "sxy": F.when(one, 0.0).otherwise(F.col("sxy"))})
    half, spread = (F.col("sxx") + F.col("syy")) / 2, F.sqrt(((F.col("sxx") - F.col("syy")) / 2) ** 2 + F.col("sxy") ** 2)
    out = sums.withColumns({"eigenvalue_major_km2": F.greatest(half + spread, F.lit(0.0)), "eigenvalue_minor_km2": F.greatest(half - spread, F.lit(0.0))})
    axis = lambda c: 2 * scale * F.sqrt(F.greatest(F.col(c), F.lit(FLOOR_KM2)))
    even = (F.col("sxy") == 0) & (F.col("sxx") == F.col("syy"))
    angle = F.pmod(F.degrees(0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy"))), F.lit(180.0))
    out = out.withColumns({"major_axis_km": axis("eigenvalue_major_km2"), "minor_axis_km": axis("eigenvalue_minor_km2"), "orientation_east_ccw_deg": F.when(one, 0.0).when(even, 90.0).otherwise(angle)})
    return out.withColumns({
        "ellipse_id": F.col("cluster_id"), "area_km2": math.pi * F.col("major_axis_km") / 2 * F.col("minor_axis_km") / 2, "axis_ratio": F.col("minor_axis_km") / F.col("major_axis_km"),
        "azimuth_north_cw_deg": azimuth(F.col("orientation_east_ccw_deg")), "major_axis_east": F.cos(F.radians("orientation_east_ccw_deg")), "major_axis_north": F.sin(F.radians("orientation_east_ccw_deg")),
    }).drop("sxx", "syy", "sxy")


def checked(cells: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """cells, or an error if a weight is not above zero, or a cell is none of the grid's at its place and date.

    grid: (date, cell_id, lon, lat), what the clusters were derived from.
    """
    members = cells.where("cluster_id is not null")
    if grid is not None:
        own = grid.select("date", "cell_id", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
        there = members.select("date", "cell_id", "lon", "lat").join(own, ["date", "cell_id"], "left")
        near = (F.abs(F.col("lon") - F.col("_lon")) < 1e-8) & (F.abs(F.col("lat") - F.col("_lat")) < 1e-8)
        if there.where(~F.coalesce(near, F.lit(False))).limit(1).count():
            raise ValueError("the clusters come from another grid than these temperatures")
    if members.where("not tmax_c > 0").limit(1).count():
        raise ValueError("centroid weights must be above zero; shift the temperatures")
    return cells
