"""Stage 2: days on which heatwaves cover unusually many cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_higher(values: Column, q: float) -> Column:
    """The element at rank ceil((n - 1) q) + 1 of an aggregate's values."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, (F.ceil((F.count(values) - 1) * F.lit(q)) + 1).cast("int"))


def daily_extent(days: DataFrame, percentile: float = 97.5) -> DataFrame:
    """One row per date, those without heatwaves too; `selected` is 1 at or above the threshold.

    The threshold is one number over one count per date, a scalar subquery.
    """
    inside = F.col("local_event_id").isNotNull()
    daily = days.groupBy("date").agg(
        F.count("*").alias("n_domain_cells"), F.count_if("exceeds").alias("n_exceeding_cells"),
        F.count_if(inside).alias("n_heatwave_cells"), F.count_if(inside & F.col("exceeds")).alias("n_heatwave_and_exceeding_cells"),
    )
    least = daily.agg(quantile_higher(F.col("n_heatwave_cells"), percentile / 100).alias("t"))
    out = daily.withColumn("regional_threshold_cells", least.scalar())
    return out.withColumns({
        "heatwave_fraction_of_domain": F.col("n_heatwave_cells") / F.col("n_domain_cells"),
        "heatwave_share_of_exceeding_cells": F.when(F.col("n_exceeding_cells") > 0, F.col("n_heatwave_and_exceeding_cells") / F.col("n_exceeding_cells")),
        "selected": (F.col("n_heatwave_cells") >= F.col("regional_threshold_cells")).cast("int"),
    })


def checked(daily: DataFrame) -> DataFrame:
    """daily, or an error if the threshold is zero (every day would be selected)."""
    if daily.where("regional_threshold_cells = 0").limit(1).count():
        raise ValueError("the regional threshold is zero cells; raise the percentile")
    return daily


def selected_cells(days: DataFrame, daily: DataFrame) -> DataFrame:
    """(date, cell_id, lat, lon, local_event_id, tmax_c) of heatwave cells on selected days."""
    return days.where("local_event_id is not null").join(daily.where("selected = 1").select("date"), "date", "left_semi").select("date", "cell_id", "lat", "lon", "local_event_id", "tmax_c")
