"""The data behind the figures: representative days, footprints, histograms, distributions."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from swelter.functions.ordered import totals_by_value
from swelter.operators.ellipses import KM_LAT, KM_LON

#: Events and days that represent each type.
SHOWN_EVENTS, SHOWN_DAYS = {1: 1, 2: 1, 3: 2, 4: 1}, {1: 1, 2: 1, 3: 2, 4: 6}


def _by_type(values: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("event_type")]


def representative_days(events: DataFrame, days: DataFrame) -> DataFrame:
    """(event_type, place, compound_event_id, date): the days that show each type.

    A type's longest events come first, then those with the larger largest ellipse, then
    the earlier. An event shows its first days; one of type 4 the six consecutive days
    with the most ellipses, the earliest of several.
    """
    best = W.partitionBy("event_type").orderBy(F.desc("duration_days"), F.desc("largest_ellipse_area_km2"), "start_date")
    shown = events.withColumn("place", F.row_number().over(best)).where(F.col("place") <= _by_type(SHOWN_EVENTS))
    rows = days.join(shown.select("compound_event_id", "event_type", "place", "duration_days"), "compound_event_id")
    n = _by_type(SHOWN_DAYS)
    event = W.partitionBy("compound_event_id")
    last = SHOWN_DAYS[4] - 1
    rows = rows.withColumn("held", F.sum("n_clusters").over(event.orderBy("day_in_event").rowsBetween(0, last)))
    whole = (F.col("event_type") == 4) & (F.col("duration_days") > n) & (F.col("day_in_event") <= F.col("duration_days") - last)
    rows = rows.withColumn("start", F.max(F.when(whole, F.struct("held", -F.col("day_in_event")))).over(event))
    first = F.coalesce(-F.col("start.col2"), F.lit(1))
    return rows.where((F.col("day_in_event") >= first) & (F.col("day_in_event") < first + n)).select("event_type", "place", "compound_event_id", "date")


def chosen_days(events: DataFrame, days: DataFrame, chosen: dict[int, list[dt.date]]) -> DataFrame:
    """representative_days() with the given first days in place of those found, for the types that have any.

    A date must lie in an event of its type, two dates in two events, and a type 3 event
    must have a day after it; else it is an error.
    """
    rows = [(k, i, d) for k, dates in chosen.items() for i, d in enumerate(dates, 1)]
    found = representative_days(events, days)
    if not rows:
        return found
    asked = events.sparkSession.createDataFrame(rows, "asked_type int, place int, first date")
    inside = (F.col("first") >= F.col("start_date")) & (F.col("first") <= F.col("end_date"))
    # as many rows as dates were given
    held = {(r.asked_type, r.place): r for r in asked.join(events.select("compound_event_id", "event_type", "start_date", "end_date"), inside, "left").collect()}
    for k, i, d in rows:
        r = held[k, i]
        if r.event_type != k:
            raise ValueError(f"{d} is no day of a type {k} event, so it can't represent one")
        if any(held[x].compound_event_id == r.compound_event_id for x in held if x[0] == k and x[1] < i):
            raise ValueError(f"the days that represent type {k} must come from several events")
        if k == 3 and d == r.end_date:
            raise ValueError(f"{d} is the last day of its type 3 event; two days are shown")
    own = asked.join(events.select("compound_event_id", "event_type"), F.col("asked_type") == F.col("event_type")).join(days.select("compound_event_id", "date"), "compound_event_id")
    named = own.join(events.sparkSession.createDataFrame([(*x, r.compound_event_id) for x, r in held.items()], "asked_type int, place int, compound_event_id int"), ["asked_type", "place", "compound_event_id"]).where("date >= first")
    nth = F.row_number().over(W.partitionBy("event_type", "place").orderBy("date"))
    shown = named.withColumn("_nth", nth).where(F.col("_nth") <= _by_type(SHOWN_DAYS)).select("event_type", "place", "compound_event_id", "date")
    return found.where(~F.col("event_type").isin(list(chosen))).unionByName(shown)


def footprints(ellipses: DataFrame, points: DataFrame, step: float) -> DataFrame:
    """points (lon, lat) with n_ellipses, the ellipses that cover them; points on a grid of that step.

    An ellipse is dealt to the grid's rows and columns that its longest axis reaches, so
    points meet only ellipses that may cover them, in an equi-join.
    """
    half = F.col("major_axis_km") / 2
    k = lambda v: F.floor(v / step + 1e-9).cast("long")
    reach_lat, reach_lon = half / KM_LAT, half / (KM_LON * F.cos(F.radians("centroid_lat_weighted")))
    span = lambda at, reach: F.sequence(k(F.col(at) - reach) - 1, k(F.col(at) + reach) + 1)
    dealt = ellipses.withColumn("_j", F.explode(span("centroid_lat_weighted", reach_lat))).withColumn("_i", F.explode(span("centroid_lon_weighted", reach_lon)))
    placed = points.withColumns({"_i": k(F.col("lon")), "_j": k(F.col("lat"))})
    dx = (F.col("lon") - F.col("centroid_lon_weighted")) * KM_LON * F.cos(F.radians("centroid_lat_weighted"))
    dy = (F.col("lat") - F.col("centroid_lat_weighted")) * KM_LAT
    along = (dx * F.col("major_axis_east") + dy * F.col("major_axis_north")) / half
    across = (dy * F.col("major_axis_east") - dx * F.col("major_axis_north")) / (F.col("minor_axis_km") / 2)
    near = ["lon", "lat", "centroid_lon_weighted", "centroid_lat_weighted", "major_axis_km", "minor_axis_km", "major_axis_east", "major_axis_north"]
    counts = placed.join(dealt.select(*near[2:], "_i", "_j"), ["_i", "_j"]).where(along**2 + across**2 <= 1 + 1e-12).groupBy("lon", "lat").agg(F.count("*").alias("n_ellipses"))
    return points.join(counts, ["lon", "lat"], "left").withColumn("n_ellipses", F.coalesce("n_ellipses", F.lit(0)))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, group: str) -> DataFrame:
    """(group, bin, n) of equal bins from 0, closed on the left, the last one on both sides."""
    width = (high - low) / bins
    at = F.when(F.col(value) == high, bins - 1).otherwise(F.floor((F.col(value) - low) / width)).cast("int")
    return rows.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(group, at.alias("bin")).agg(F.count("*").alias("n"))


def ccdf(sample: DataFrame, group: str = "dataset", value: str = "area_km2") -> DataFrame:
    """(group, value, ccdf): the share of values at or above each, ties in order of place."""
    counts = totals_by_value(sample, value, F.lit(1), keys=(group,)).withColumnsRenamed({"of": "_of", "before": "_before"})
    sizes = sample.groupBy(group).agg(F.count("*").alias("_n"))
    # equal values stand one after the other; a value's places are made from how many there are
    each = counts.join(sizes, group).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_of").cast("int") - 1)))
    return each.select(group, value, (1 - (F.col("_before") + F.col("_k")).cast("double") / F.col("_n")).alias("ccdf"))


def ecdf(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, ecdf): the share of values at or below each distinct one; null is no value."""
    counts = totals_by_value(rows, value, F.lit(1), keys=(group,))
    sizes = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"))
    return counts.join(sizes, group).select(group, value, ((F.col("before") + F.col("of")).cast("double") / F.col("_n")).alias("ecdf"))


def snapshots(shown: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells of the days that are shown, each in its cluster or noise.

    shown: (event_type, place, compound_event_id, date); cells: (date, cell_id, lon, lat, cluster_id, is_noise).
    """
    return shown.join(cells.select("date", "cell_id", "lon", "lat", "cluster_id", "is_noise"), "date")


def density(rows: DataFrame, group: str, value: str, low: float, high: float, n: int = 600) -> DataFrame:
    """(group, at, density): Gaussian kernels of width sd n^(-1/5), at n even places.

    A value is shared by the two places around it, in proportion, so only places are set
    against places, however many values there are; kernels as wide as a few steps hide
    that. Places go on beyond low and high as far as a kernel reaches. Groups of one value,
    or of equal ones, have no width and no rows.
    """
    step = (high - low) / (n - 1)
    own = rows.where(F.col(value).isNotNull()).groupBy(group).agg((F.stddev_samp(value) * F.pow(F.count("*"), F.lit(-0.2))).alias("_h"), F.count("*").alias("_n")).where("_h > 0")
    at = (F.col(value) - low) / step
    k, part = F.floor(at), at - F.floor(at)
    shares = F.array(F.struct(k.alias("k"), (1 - part).alias("w")), F.struct((k + 1).alias("k"), part.alias("w")))
    bins = rows.where(F.col(value).isNotNull()).select(group, F.explode(shares).alias("s")).groupBy(group, F.col("s.k").alias("_k")).agg(F.sum("s.w").alias("_w"))
    # exp() of what lies further away than 39 widths is 0
    reach = F.ceil(39 * F.col("_h") / step)
    near = bins.join(own, group).where((F.col("_k") >= -reach) & (F.col("_k") <= n - 1 + reach))
    places = near.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    kernel = F.exp(-0.5 * ((F.col("_p") - F.col("_k")) * step / F.col("_h")) ** 2) / (F.col("_h") * F.col("_n") * 2.5066282746310002)
    return places.groupBy(group, "_p").agg(F.sum(F.col("_w") * kernel).alias("density")).select(group, (low + F.col("_p") * step).alias("at"), "density")


def place_at(lon: Column, lat: Column, east_km: Column, north_km: Column) -> tuple[Column, Column]:
    """(lon, lat) so many km east and north of a place, on the plane around it."""
    return lon + east_km / (KM_LON * F.cos(F.radians(lat))), lat + north_km / KM_LAT


def outlines(ellipses: DataFrame, n: int = 240) -> DataFrame:
    """(ellipse_id, point, lon, lat): n points around each ellipse, the last on the first."""
    turn = 2 * math.pi * F.col("point") / (n - 1)
    along, across = F.col("major_axis_km") / 2 * F.cos(turn), F.col("minor_axis_km") / 2 * F.sin(turn)
    east, north = F.col("major_axis_east"), F.col("major_axis_north")
    lon, lat = place_at(F.col("centroid_lon_weighted"), F.col("centroid_lat_weighted"), along * east - across * north, along * north + across * east)
    return ellipses.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("ellipse_id", "point", lon.alias("lon"), lat.alias("lat"))


def axes(ellipses: DataFrame) -> DataFrame:
    """(ellipse_id, axis, lon_from, lat_from, lon_to, lat_to): where the major and the minor axis end."""
    a, b, east, north = F.col("major_axis_km") / 2, F.col("minor_axis_km") / 2, F.col("major_axis_east"), F.col("major_axis_north")
    at = lambda x, y: place_at(F.col("centroid_lon_weighted"), F.col("centroid_lat_weighted"), x, y)
    ends = {"major": (at(-a * east, -a * north), at(a * east, a * north)), "minor": (at(b * north, -b * east), at(-b * north, b * east))}
    each = [F.struct(F.lit(k).alias("axis"), *[c.alias(f"{name}_{side}") for side, (x, y) in zip(("from", "to"), v) for name, c in (("lon", x), ("lat", y))]) for k, v in ends.items()]
    return ellipses.select("ellipse_id", F.explode(F.array(*each)).alias("e")).select("ellipse_id", "e.*")


#: Shares of points at which classes of footprints end, and of values that colours reach to.
CLASS_SHARES, LIMIT_SHARES = (0.2, 0.4, 0.6, 0.8, 0.9, 0.95, 0.98, 1.0), (0.02, 0.98)


def quantile_breaks(rows: DataFrame, value: str, shares: tuple[float, ...] = CLASS_SHARES, first: float | None = 0.0) -> DataFrame:
    """One row (breaks): `first` and the quantiles (type 7) of value, each once. Equal values are counted first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    found = F.percentile("v", F.array(*map(F.lit, shares)), F.col("n"))
    start = F.array(*([F.lit(first)] if first is not None else [])).cast("array<double>")
    return counts.agg(F.array_distinct(F.concat(start, found)).alias("breaks"))


def classed(rows: DataFrame, value: str, breaks: DataFrame, name: str = "class") -> DataFrame:
    """rows with the class (from 0) of value between breaks: closed on the left, the last one on both sides.

    Values beyond the breaks are in the first or the last class; null has none.
    """
    joined = rows.withColumn("_breaks", breaks.scalar())
    inside = F.size(F.filter("_breaks", lambda b: b <= F.col(value))) - 1
    last = F.greatest(F.size("_breaks") - 2, F.lit(0))
    return joined.withColumn(name, F.when(F.col(value).isNotNull(), F.least(F.greatest(inside, F.lit(0)), last))).drop("_breaks")


def rank_classes(cells: DataFrame, rank: str = "concentration_rank", n: int = 10) -> DataFrame:
    """cells with rank_class, the tenth (from 0) that a rank from 0 to 1 lies in."""
    breaks = F.array(*[F.lit(k / n) for k in range(n + 1)])
    return classed(cells, rank, cells.sparkSession.range(1).select(breaks.alias("breaks")), "rank_class")


def robust_limits(rows: DataFrame, value: str) -> DataFrame:
    """One row (low, high): the 2nd and 98th percentile (type 7), one apart at least where they are equal."""
    found = quantile_breaks(rows, value, LIMIT_SHARES, None).select(F.element_at("breaks", 1).alias("low"), F.element_at("breaks", -1).alias("high"))
    return found.select("low", F.when(F.col("high") - F.col("low") < 1e-12, F.col("low") + 1).otherwise(F.col("high")).alias("high"))


#: Fixed value: how many times the hinges' distance whiskers reach beyond them at most.
WHISKER = 1.5


def boxes(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, low_whisker, lower_hinge, median, upper_hinge, high_whisker, n_outliers) after Tukey.

    Hinges lie at depth (floor((n + 1) / 2) + 1) / 2 from both ends; whiskers end at the
    last values within WHISKER times the hinges' distance. Values are found by their
    ranks among distinct ones, so no group is gathered.
    """
    counts = totals_by_value(rows.where(F.col(group).isNotNull()), value, F.lit(1), keys=(group,)).withColumns({"_to": (F.col("before") + F.col("of")).cast("long"), "_from": F.col("before").cast("long")})
    sizes = counts.groupBy(group).agg(F.max("_to").alias("n"))
    depth, n = (F.floor((F.col("n") + 1) / 2) + 1) / 2, F.col("n")
    wanted = {"lower_hinge": depth, "median": (n + 1) / 2, "upper_hinge": n + 1 - depth}
    ranks = [F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, d in wanted.items() for r in (F.floor(d), F.ceil(d))]
    asked = sizes.select(group, F.explode(F.array(*ranks)).alias("r")).select(F.col(group).alias("_g"), "r.*")
    held = counts.join(asked, (F.col(group) == F.col("_g")) & (F.col("rank") > F.col("_from")) & (F.col("rank") <= F.col("_to")))
    mid = held.groupBy(group).agg(*[F.avg(F.when(F.col("name") == k, F.col(value))).alias(k) for k in wanted])
    reach = WHISKER * (F.col("upper_hinge") - F.col("lower_hinge"))
    inside = (F.col(value) >= F.col("lower_hinge") - reach) & (F.col(value) <= F.col("upper_hinge") + reach)
    ends = counts.join(mid, group).groupBy(group).agg(F.min(F.when(inside, F.col(value))).alias("low_whisker"), F.max(F.when(inside, F.col(value))).alias("high_whisker"), F.sum(F.when(inside, 0).otherwise(F.col("of"))).cast("long").alias("n_outliers"))
    return sizes.join(mid, group).join(ends, group).select(group, "n", "low_whisker", "lower_hinge", "median", "upper_hinge", "high_whisker", "n_outliers")


def outliers(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value) of rows beyond their group's whiskers."""
    box = boxes(rows, group, value).select(F.col(group).alias("_g"), "low_whisker", "high_whisker")
    return rows.join(box, F.col(group) == F.col("_g")).where((F.col(value) < F.col("low_whisker")) | (F.col(value) > F.col("high_whisker"))).select(group, value)


def tail_curves(fits: DataFrame, sample: DataFrame, n: int = 200, group: str = "dataset", value: str = "area_km2") -> DataFrame:
    """(group, point, area_km2, ccdf): the fitted tail at n places, even in logarithms, from its cutoff to the largest value."""
    top = sample.groupBy(group).agg(F.max(value).alias("_top"))
    rows = fits.where("status = 'ok'").join(top, group).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    low = F.log("xmin_km2")
    x = F.exp(low + (F.log("_top") - low) * F.col("point") / (n - 1))
    return rows.select(group, "point", x.alias("area_km2"), (F.col("n_tail") / F.col("n") * F.pow(x / F.col("xmin_km2"), 1 - F.col("alpha"))).alias("ccdf"))
