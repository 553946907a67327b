"""Stage 1: local heatwaves of each cell by percentile and gap-aware islands.

One shuffle by cell carries thresholds, islands, events and memberships: percentile,
lag/lead, running sums and the sums over an island all are windows within a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def marked_days(grid: DataFrame, percentile: float = 95, min_duration: int = 3, min_exceeding: int = 3) -> DataFrame:
    """grid with threshold, exceeds and event_number_in_cell (null outside local heatwaves).

    A day exceeds at or above the cell's type-7 percentile. Missing calendar days stand
    for two virtual days that don't exceed. One lone day below the threshold between two
    exceeding ones is bridged; two end the island. Islands that span min_duration days,
    min_exceeding of them exceeding, are numbered by time within the cell.
    """
    cell, by_day = W.partitionBy("cell_id"), W.partitionBy("cell_id").orderBy("date")
    upto = by_day.rowsBetween(W.unboundedPreceding, 0)
    rows = grid.withColumn("threshold", F.percentile("tmax_c", F.lit(percentile / 100)).over(cell))
    rows = rows.withColumn("exceeds", F.col("tmax_c") >= F.col("threshold"))
    rows = rows.withColumn("gap", F.coalesce(F.datediff("date", F.lag("date").over(by_day)) > 1, F.lit(False)).cast("int"))
    rows = rows.withColumn("pos", F.row_number().over(by_day) + 2 * F.sum("gap").over(upto))
    hit = F.when(F.col("exceeds"), F.col("pos"))
    near = {"last_hit": F.last(hit, ignorenulls=True).over(by_day.rowsBetween(W.unboundedPreceding, -1)), "before": F.lag(hit).over(by_day), "behind": F.lead(hit).over(by_day)}
    rows = rows.withColumns(near)
    starts = F.col("exceeds") & (F.col("last_hit").isNull() | (F.col("pos") - F.col("last_hit") > 2))
    bridged = F.coalesce(F.col("behind") - F.col("before") == 2, F.lit(False))
    rows = rows.withColumns({"island": F.sum(starts.cast("int")).over(upto), "member": F.col("exceeds") | bridged})
    own = W.partitionBy("cell_id", "island")
    inside = F.when(F.col("member"), F.col("pos"))
    rows = rows.withColumns({"span": F.max(inside).over(own) - F.min(inside).over(own) + 1, "ones": F.count_if("exceeds").over(own)})
    counts = (F.col("span") >= min_duration) & (F.col("ones") >= min_exceeding)
    rows = rows.withColumns({"kept": counts, "first": counts & starts})
    number = F.sum(F.col("first").cast("int")).over(upto).cast("int")
    rows = rows.withColumn("event_number_in_cell", F.when(F.col("kept") & F.col("member"), number))
    return rows.drop("gap", "pos", "last_hit", "before", "behind", "island", "member", "span", "ones", "kept", "first")


#: Keys that the first pass of running_totals() sums at a time.
TOTAL_BLOCK = 4096


def running_totals(counts: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """counts (key, n) with name: the sum of n over all smaller keys, which are whole numbers.

    Blocks of keys are summed first, so the one task that passes over all of them has a
    row for each TOTAL_BLOCK keys.
    """
    rows = counts.withColumn("_block", F.floor(F.col(key) / TOTAL_BLOCK))
    blocks = rows.groupBy("_block").agg(F.sum(n).alias("_sum"))
    blocks = blocks.select("_block", (F.sum("_sum").over(W.orderBy("_block")) - F.col("_sum")).alias("_before"))
    within = F.sum(n).over(W.partitionBy("_block").orderBy(key)) - F.col(n)
    return rows.withColumn("_within", within).join(blocks, "_block").withColumn(name, F.col("_before") + F.col("_within")).drop("_block", "_before", "_within")


def with_ids(days: DataFrame) -> DataFrame:
    """days with local_event_id; ids run by cell, then start: a cell's offset plus the event's number in it."""
    per_cell = days.groupBy("cell_id").agg(F.coalesce(F.max("event_number_in_cell"), F.lit(0)).alias("n"))
    before = running_totals(per_cell, "cell_id", "n", "before").select("cell_id", "before")
    return days.join(before, "cell_id").withColumn("local_event_id", (F.col("before") + F.col("event_number_in_cell")).cast("int")).drop("before")


def detect(grid: DataFrame, percentile: float = 95, min_duration: int = 3, min_exceeding: int = 3) -> tuple[DataFrame, DataFrame]:
    """(events, days): the catalogue of local heatwaves, and marked days with local_event_id or null."""
    days = with_ids(marked_days(grid, percentile, min_duration, min_exceeding))
    return catalogue(days), days.drop("event_number_in_cell")


def catalogue(days: DataFrame) -> DataFrame:
    """One row per local heatwave, from days with local_event_id and event_number_in_cell."""
    events = days.where("local_event_id is not null").groupBy("cell_id", "event_number_in_cell").agg(
        F.first("local_event_id").alias("local_event_id"), F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        F.count("*").cast("int").alias("duration_days"), F.count_if("exceeds").cast("int").alias("exceeding_days"), F.max(F.struct("tmax_c", (-F.unix_date("date")).alias("back"))).alias("peak"),
    )
    return events.select(
        "local_event_id", "cell_id", "lat", "lon", "event_number_in_cell", "start_date", "end_date", "duration_days", "exceeding_days",
        (F.col("duration_days") - F.col("exceeding_days")).alias("bridged_days"), F.date_from_unix_date(-F.col("peak.back")).alias("peak_date"), F.col("peak.tmax_c").alias("peak_tmax_c"),
    )


def cell_summary(days: DataFrame) -> DataFrame:
    """Per cell its threshold and counts, zeros kept."""
    return days.groupBy("cell_id").agg(
        F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("threshold").alias("threshold_tmax_c"), F.count_if("exceeds").alias("n_exceeding_days"),
        F.count("local_event_id").alias("n_heatwave_days"), F.count_distinct("local_event_id").alias("n_local_events"),
    )
