"""Stage 5: compound events of consecutive selected days, their types, summaries and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from swelter.functions.stats import mann_kendall, t_two_sided
from swelter.operators.clustering import with_runs

#: The names of the four types.
TYPES = {1: "Widespread (Isolated)", 2: "Spatially Clustered", 3: "Temporally Clustered", 4: "Compound Clustering (Multi-Type)"}
#: Areas equal to so many places are ties, which the earliest wins.
TIE_DP = 6


def event_type(days: Column, least: Column, most: Column) -> Column:
    """One day: 1 of one cluster, 2 of more; several days: 3 if all have one or all more, else 4."""
    even = ((least == 1) & (most == 1)) | (least > 1)
    return F.when(days == 1, F.when(most == 1, 1).otherwise(2)).when(even, 3).otherwise(4)


def season_start(months: tuple[int, ...]) -> int:
    """The first month of a season that may run over the year's end; 1 for a whole year."""
    own = set(months)
    starts = [m for m in own if (m - 2) % 12 + 1 not in own]
    if len(own) == 12:
        return 1
    if len(starts) != 1:
        raise ValueError("season months must follow one another")
    return starts[0]


def season_year(date: Column, start: int) -> Column:
    return F.year(date) - (F.month(date) < start).cast("int")


def event_days(daily_clusters: DataFrame, ellipses: DataFrame) -> DataFrame:
    """Selected days with their event: (date, compound_event_id, day_in_event, n_clusters, largest ...).

    daily_clusters: (date, n_clusters), days without a cluster too. Runs without any
    ellipse are no events; ids count the others.
    """
    largest = ellipses.groupBy("date").agg(F.max(F.struct(F.round("area_km2", TIE_DP).alias("tie"), (-F.col("ellipse_id")).alias("back"), "area_km2")).alias("top"))
    days = with_runs(daily_clusters).withColumn("_all", F.sum("n_clusters").over(W.partitionBy("run"))).where("_all > 0").drop("_all")
    days = days.withColumn("compound_event_id", F.dense_rank().over(W.orderBy("run")).cast("int"))
    days = days.withColumn("day_in_event", F.row_number().over(W.partitionBy("run").orderBy("date")).cast("int")).join(largest, "date", "left")
    return days.select("date", "compound_event_id", "day_in_event", "n_clusters", (-F.col("top.back")).alias("largest_ellipse_id"), F.col("top.area_km2").alias("largest_ellipse_area_km2"))


def classified(days: DataFrame, ellipses: DataFrame, settings: DataFrame) -> DataFrame:
    """One row per compound event, with its type, its settings and the shape of its ellipses."""
    runs = days.groupBy("compound_event_id").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").cast("int").alias("duration_days"),
        F.concat_ws("-", F.transform(F.array_sort(F.collect_list(F.struct("date", "n_clusters"))), lambda d: d["n_clusters"].cast("string"))).alias("daily_cluster_counts"),
        F.sum("n_clusters").alias("total_clusters"), F.min("n_clusters").alias("min_daily_clusters"), F.max("n_clusters").alias("max_daily_clusters"),
        F.count_if(F.col("n_clusters") == 1).alias("n_single_cluster_days"), F.count_if(F.col("n_clusters") > 1).alias("n_multi_cluster_days"),
        F.max(F.struct(F.round("largest_ellipse_area_km2", TIE_DP).alias("tie"), (-F.unix_date("date")).alias("back"), "date", "largest_ellipse_id", "largest_ellipse_area_km2")).alias("top"),
    )
    twice = F.radians(2 * F.col("azimuth_north_cw_deg"))
    shape = ellipses.join(days.select("date", "compound_event_id"), "date").groupBy("compound_event_id").agg(
        F.avg("area_km2").alias("mean_area_km2"), F.avg("axis_ratio").alias("mean_axis_ratio"), F.avg(F.cos(twice)).alias("c"), F.avg(F.sin(twice)).alias("s"))
    length = F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)
    angle = F.degrees(F.atan2("s", "c")) / 2
    mean = F.when(length > 1e-12, F.when(angle <= -90, angle + 180).otherwise(angle))
    kind = event_type(F.col("duration_days"), F.col("min_daily_clusters"), F.col("max_daily_clusters"))
    names = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v))])
    used = days.select("date", "compound_event_id").join(settings, "date").groupBy("compound_event_id").agg(F.max("sequence_eps").alias("event_eps"), F.max("sequence_min_samples").alias("event_min_samples"))
    return runs.join(shape, "compound_event_id").join(used, "compound_event_id").withColumn("event_type", kind).select(
        "compound_event_id", "start_date", "end_date", "duration_days", F.col("duration_days").alias("n_selected_days"), "event_type", names[F.col("event_type")].alias("event_type_name"), "daily_cluster_counts", "total_clusters",
        "min_daily_clusters", "max_daily_clusters", "n_single_cluster_days", "n_multi_cluster_days", "event_eps", "event_min_samples", "mean_area_km2", "mean_axis_ratio", mean.alias("axial_mean_azimuth_deg"), length.alias("axial_resultant_length"),
        F.col("top.largest_ellipse_id").alias("largest_ellipse_id"), F.col("top.date").alias("largest_ellipse_date"), F.col("top.largest_ellipse_area_km2").alias("largest_ellipse_area_km2"),
    )


def type_summary(events: DataFrame) -> DataFrame:
    """Always four rows; the statistics of a type without events are null."""
    types = events.sparkSession.range(1, 5).select(F.col("id").cast("int").alias("event_type"))
    per_event = F.avg("total_clusters")
    stats = events.groupBy("event_type").agg(
        F.sum("duration_days").alias("days"), F.count("*").alias("n"), F.max("duration_days").alias("longest_event_days"), F.round(F.avg("duration_days"), 2).alias("mean_duration_days_per_event"),
        F.round(per_event, 2).alias("mean_ellipses_per_event"), F.min("total_clusters").alias("minimum_ellipses_per_event"), F.max("total_clusters").alias("maximum_ellipses_per_event"),
    )
    names = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.lit(f"Type {k}: {v}"))])
    return types.join(stats, "event_type", "left").select(
        names[F.col("event_type")].alias("compound_heatwave_type"), F.coalesce("days", F.lit(0)).alias("selected_event_days"), F.coalesce("n", F.lit(0)).alias("number_of_compound_events"),
        "longest_event_days", "mean_duration_days_per_event", "mean_ellipses_per_event", "minimum_ellipses_per_event", "maximum_ellipses_per_event",
    )


def annual_counts(events: DataFrame, dates: DataFrame, start: int) -> DataFrame:
    """Events of each type by season year; every year that the dates hold is there."""
    years = dates.select(season_year(F.col("date"), start).alias("year")).distinct()
    of = events.groupBy(season_year(F.col("start_date"), start).alias("year")).agg(*[F.count_if(F.col("event_type") == k).alias(f"type_{k}_events") for k in TYPES], F.count("*").alias("all_events"))
    return years.join(of, "year", "left").fillna(0)


def annual_duration(events: DataFrame, start: int) -> DataFrame:
    """Mean duration of multi-day events by type and season year."""
    return events.where("event_type in (3, 4)").groupBy("event_type", season_year(F.col("start_date"), start).alias("year")).agg(F.avg("duration_days").alias("mean_duration_days"))


def trend_parts(series: DataFrame, group: str = "event_type", x: str = "year", y: str = "mean_duration_days") -> DataFrame:
    """Per group: n, least-squares slope and r2, the Mann-Kendall S with its variance, and Sen's slope.

    Pairs of years are a theta self-join within the group; a series has a row per year.
    """
    a, b = series.select(group, F.col(x).alias("x1"), F.col(y).alias("y1")), series.select(group, F.col(x).alias("x2"), F.col(y).alias("y2"))
    pairs = a.join(b, group).where("x1 < x2").groupBy(group).agg(F.sum(F.signum(F.col("y2") - F.col("y1"))).alias("mann_kendall_s"), F.median((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("sen_slope"))
    ties = series.groupBy(group, y).agg(F.count("*").alias("t")).groupBy(group).agg(F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("ties"), F.count("*").alias("values"))
    fit = series.groupBy(group).agg(F.count("*").alias("n_years"), F.regr_slope(y, x).alias("ols_slope"), F.regr_r2(y, x).alias("ols_r_squared"))
    n = F.col("n_years")
    return fit.join(ties, group).join(pairs, group, "left").withColumn("mann_kendall_var", (n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18).drop("ties")


#: Years that a trend takes at least.
LEAST_YEARS = 3


def duration_trends(series: DataFrame) -> DataFrame:
    """One row for each of types 3 and 4: slopes a decade, p values and verdicts.

    A type of fewer than LEAST_YEARS years has none and says so. A constant series has
    slope 0, p 1 and explains nothing.
    """
    parts = trend_parts(series)
    types = series.sparkSession.range(3, 5).select(F.col("id").cast("int").alias("event_type"))
    names = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v))])
    enough = F.coalesce(F.col("n_years") >= LEAST_YEARS, F.lit(False))
    rows = types.join(parts, "event_type", "left")
    n, r2 = F.col("n_years"), F.col("ols_r_squared")
    constant = F.col("values") == 1
    t = F.sqrt((n - 2) * r2 / (1 - r2))
    p_of_t = F.udf(lambda t, df: None if t is None or df is None else t_two_sided(t, df), "double")
    test = F.udf(lambda s, v: None if s is None else mann_kendall(s, v), "struct<z double, p double, verdict string>")
    rows = rows.withColumns({"_p": p_of_t(F.when(enough & ~constant & (r2 < 1), t), n - 2), "_mk": test(F.when(enough, F.col("mann_kendall_s")), F.col("mann_kendall_var"))})
    ols_p = F.when(constant, 1.0).when(r2 >= 1, 0.0).otherwise(F.col("_p"))
    only = lambda c: F.when(enough, c)
    return rows.select(
        "event_type", names[F.col("event_type")].alias("event_type_name"), F.coalesce(n, F.lit(0)).alias("n_years"),
        only(F.when(constant, 0.0).otherwise(10 * F.col("ols_slope"))).alias("ols_slope_days_per_decade"), only(ols_p).alias("ols_p_value"), only(F.when(constant, 0.0).otherwise(r2)).alias("ols_r_squared"),
        only(10 * F.col("sen_slope")).alias("sen_slope_days_per_decade"), only(F.col("mann_kendall_s")).alias("mann_kendall_s"), F.col("_mk.z").alias("mann_kendall_z"),
        F.col("_mk.p").alias("mann_kendall_p_value"), F.coalesce(F.col("_mk.verdict"), F.lit("too few years")).alias("mann_kendall_result"),
    )
