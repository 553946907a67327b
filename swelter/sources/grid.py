"""Daily grids in long form: date, cell_id, lon, lat, tmax_c.

Every grid function returns complete series (each cell has the same dates), which the
stages rely on. All is lazy; complete() is the one that checks, with one action.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

GRID = ("date", "cell_id", "lon", "lat", "tmax_c")


def temperature_unit(units: str) -> str:
    """degC or K, from the spellings that files use; anything else is an error."""
    name = re.sub(r"[^a-z]", "", units.lower())
    if "celsius" in name or name in ("degc", "c", "degreec", "degreesc"):
        return "degC"
    if "kelvin" in name or name in ("degk", "k", "degreek", "degreesk"):
        return "K"
    raise ValueError(f"unknown temperature unit {units!r}")


def grid_step(values: list[float], name: str) -> float:
    """The signed step of an evenly spaced axis."""
    if len(values) < 2:
        raise ValueError(f"{name}: at least two values are needed")
    steps = [b - a for a, b in zip(values, values[1:])]
    if not steps[0] or any(abs(s - steps[0]) > 1e-4 * abs(steps[0]) for s in steps):
        raise ValueError(f"{name}: values are not evenly spaced")
    return steps[0]


#: Units of time that can be decoded, in seconds.
SECONDS = {"day": 86400, "hour": 3600, "hr": 3600, "minute": 60, "min": 60, "second": 1, "sec": 1, "s": 1}
_SINCE = re.compile(r"^\s*([a-z]+?)s?\s+since\s+(-?\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T\s]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?\s*(Z|UTC|[+-]\d{1,2}(?::?\d{2})?)?\s*$", re.I)
_EPOCH = dt.date(1970, 1, 1)


def time_seconds(values: list[float], units: str, calendar: str = "standard") -> list[float]:
    """UTC seconds since 1970 of "<unit> since <moment>" numbers."""
    if calendar.lower() not in ("standard", "gregorian", "proleptic_gregorian"):
        raise ValueError(f"calendar {calendar!r} is not supported")
    m = _SINCE.match(units)
    if not m or m[1].lower() not in SECONDS:
        raise ValueError(f"time units {units!r} are not supported")
    hour, minute, second = int(m[5] or 0), int(m[6] or 0), float(m[7] or 0)
    zone = 0
    if m[8] and m[8].upper() not in ("Z", "UTC"):
        digits = m[8][1:].replace(":", "").zfill(2)
        hours, minutes = int(digits[:2]), int(digits[2:] or 0)
        if hours > 14 or minutes > 59:
            raise ValueError(f"time units {units!r} have no such zone")
        zone = (-1 if m[8][0] == "-" else 1) * (hours * 3600 + minutes * 60)
    if hour > 23 or minute > 59 or second >= 60:
        raise ValueError(f"time units {units!r} have no such time of day")
    start = (dt.date(int(m[2]), int(m[3]), int(m[4])) - _EPOCH).days * 86400 + hour * 3600 + minute * 60 + second - zone
    return [start + v * SECONDS[m[1].lower()] for v in values]


def decode_time(values: list[float], units: str, calendar: str = "standard") -> list[dt.date]:
    """UTC days of "<unit> since <moment>" numbers; rounding noise below a day's end is undone."""
    out = []
    for s in time_seconds(values, units, calendar):
        days = s / 86400
        near = round(days)
        snapped = near if abs(days - near) <= 16 * 2**-52 * max(1.0, abs(days)) else math.floor(days)
        out.append(_EPOCH + dt.timedelta(days=snapped))
    return out


def wrapped_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def daily_maxima(readings: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("lon", "lat"), value: str = "value", per_day: int | None = None) -> DataFrame:
    """(date, keys, tmax): the largest reading of each UTC day; nulls count as missing.

    per_day: days that have not exactly so many distinct times at a place are left out.
    """
    out = readings.groupBy(F.to_date(ts).alias("date"), *keys).agg(F.max(value).alias("tmax"), F.count_distinct(ts).alias("n_times"))
    return (out.where(F.col("n_times") == per_day) if per_day else out).drop("n_times")


def first_version(readings: DataFrame, keys: tuple[str, ...], version: str = "expver", value: str = "value") -> DataFrame:
    """Of several versions of a reading the first that is not null."""
    return readings.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(version))).alias(value))


def cell_averages(points: DataFrame, size: float, step: float, value: str = "tmax") -> DataFrame:
    """(date, lon, lat, tmax): means over cells of size degrees that have all their points.

    points: (date, lon, lat, value) on a grid of that step. Cells that lack a row or a
    column of points anywhere go; missing readings (null) just don't count.
    """
    per = round(size / step)
    if per < 1 or abs(per * step - size) > 1e-6:
        raise ValueError("the cell size must be a whole multiple of the grid's step")
    k = lambda c: F.floor(F.col(c) / size + 1e-6)
    rows = points.withColumns({"_i": k("lon"), "_j": k("lat")})
    # a row for each place and not for each reading tells which cells are whole
    places = rows.select("_i", "_j", "lon", "lat").distinct()
    whole = places.groupBy("_i", "_j").agg(F.count_distinct("lon").alias("x"), F.count_distinct("lat").alias("y")).where((F.col("x") == per) & (F.col("y") == per)).select("_i", "_j")
    out = rows.join(whole, ["_i", "_j"], "left_semi").groupBy("date", "_i", "_j").agg(F.avg(value).alias("tmax"))
    centre = lambda c: (F.col(c) + 0.5) * size
    return out.select("date", centre("_i").alias("lon"), centre("_j").alias("lat"), "tmax")


def from_array(spark: SparkSession, values: Sequence, dates: Sequence[dt.date], lons: Sequence[float], lats: Sequence[float], units: str = "degC", **period) -> DataFrame:
    """A grid out of an array in memory, [date][lon][lat]; NaN and None are missing. For small inputs: it goes through the driver."""
    if len(values) != len(dates) or any(len(day) != len(lons) or any(len(row) != len(lats) for row in day) for day in values):
        raise ValueError(f"the array must be {len(dates)} dates by {len(lons)} longitudes by {len(lats)} latitudes")
    if len(set(dates)) != len(dates):
        raise ValueError("dates must not repeat")
    grid_step(sorted(lons), "longitude")
    grid_step(sorted(lats), "latitude")
    rows = [(d, float(x), float(y), None if v is None or v != v else float(v)) for d, day in zip(dates, values) for x, row in zip(lons, day) for y, v in zip(lats, row)]
    return complete(from_rows(spark.createDataFrame(rows, "date date, lon double, lat double, value double"), units, **period))


def from_rows(rows: DataFrame, units: str = "degC", months: tuple[int, ...] = tuple(range(1, 13)), start: str | None = None, end: str | None = None) -> DataFrame:
    """A grid from (date, lon, lat, value): period first, then places without any value go.

    Cells are numbered from 1, west to east within a row of latitude, rows south to north.
    """
    value = F.col("value") - 273.15 if temperature_unit(units) == "K" else F.col("value")
    kept = in_period(rows, months, start, end).select("date", F.col("lon").cast("double"), F.col("lat").cast("double"), value.cast("double").alias("tmax_c"))
    places = kept.groupBy("lon", "lat").agg(F.count("tmax_c").alias("n")).where("n > 0")
    # rows of latitude are counted first; the one ordered pass has a row for each of them
    rows = places.groupBy("lat").agg(F.count("*").alias("_n"))
    rows = rows.select("lat", (F.sum("_n").over(W.orderBy("lat")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("lat").orderBy("lon"))
    numbered = places.select("lon", "lat", own.alias("_nth")).join(rows, "lat").select("lon", "lat", (F.col("_before") + F.col("_nth")).cast("int").alias("cell_id"))
    return kept.join(numbered, ["lon", "lat"]).select(*GRID)


def in_period(grid: DataFrame, months: tuple[int, ...] = tuple(range(1, 13)), start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the months and dates; cell numbers stay."""
    out = grid.where(F.month("date").isin(*months))
    out = out.where(F.col("date") >= F.lit(start).cast("date")) if start else out
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


def complete(grid: DataFrame) -> DataFrame:
    """The grid itself, or an error that names a place with missing or infinite values.

    One aggregate over the cells and one action: all cells must have the same dates, told
    by their number and the sum of their hashes, and a value for each.
    """
    usable = F.abs("tmax_c") < float("inf")
    dates = F.sum(F.when(usable, F.xxhash64("date").cast("decimal(38,0)")))
    cells = grid.groupBy("cell_id").agg(F.count_if(F.coalesce(usable, F.lit(False))).alias("n"), F.count_distinct("date").alias("d"), dates.alias("h"))
    most = F.max(F.struct("d", "h"))
    whole = cells.agg(most.alias("top"), F.min(F.struct("d", "h")).alias("least"), F.count("*").alias("cells"), F.min(F.struct((F.col("n") == F.col("d")).alias("whole"), "cell_id", "n", "d")).alias("first")).first()
    if not whole.cells or whole.cells < 2:
        raise ValueError("a grid needs two cells at least")
    if not whole.first.whole:
        raise ValueError(f"cell {whole.first.cell_id} has {whole.first.n} values for {whole.first.d} dates")
    if whole.top != whole.least:
        n_dates = grid.agg(F.count_distinct("date")).first()[0]
        bad = cells.where((F.col("n") != n_dates) | (F.col("h") != F.lit(str(whole.top.h)).cast("decimal(38,0)"))).orderBy("cell_id").first()
        raise ValueError(f"cell {bad.cell_id} has {bad.n} values for {n_dates} dates")
    return grid


def lattice(lineitem: DataFrame) -> DataFrame:
    """A 10 x 10 grid out of order lines: 10 + the trailing 7-day mean of quantities, April to September.

    Days without lines count 0, so every cell has every day. The months are taken after
    the window, so April looks back into March.
    """
    rows = lineitem.select((F.col("l_partkey") % 100).cast("int").alias("cell_id"), F.to_date("l_shipdate").alias("date"), "l_quantity")
    sums = rows.groupBy("cell_id", "date").agg(F.sum("l_quantity").alias("s"))
    span = rows.agg(F.sequence(F.min("date"), F.max("date")).alias("days")).select(F.explode("days").alias("date"))
    days = span.select("date", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("cell_id"))
    week = W.partitionBy("cell_id").orderBy("date").rowsBetween(-6, 0)
    out = days.join(sums, ["cell_id", "date"], "left").withColumn("tmax_c", 10 + F.avg(F.coalesce("s", F.lit(0.0))).over(week))
    lon, lat = (F.col("cell_id") % 10).cast("double"), F.floor(F.col("cell_id") / 10).cast("double")
    return in_period(out.select("date", "cell_id", lon.alias("lon"), lat.alias("lat"), "tmax_c"), (4, 5, 6, 7, 8, 9))
