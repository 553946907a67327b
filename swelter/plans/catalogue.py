"""One query per operator, over the driver's tables, each with SQL that must give the same rows.

Doubles are rounded to DP places on both sides. The stages run at the 80th and 90th
percentiles, at which all kinds of event occur in the order-line grid.
"""

from __future__ import annotations

import atexit
import functools
import threading
import weakref
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swelter.functions import projection
from swelter.functions.projection import E1, E2, forward
from swelter.operators import clustering, ellipses, events, figure_data, heatwaves, point_process, power_law, regional
from swelter.shared import delete, exists, owned, owning, written
from swelter.sources import grid, requests

LOCAL, REGIONAL, DP = 80.0, 90.0, 6
SEASON = (4, 5, 6, 7, 8, 9)


def r(name: str) -> Column:
    return F.round(F.col(name), DP).alias(name)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class Run:
    """The chain of stages over one folder's order lines.

    What several later stages read is written in the shared folder where a stage ends, once
    a run and when first asked for: each stage starts from a scan, its plan stays small, and
    a lost executor costs no more than a stage. The tables are the run's own and stay till
    close(), or till Python ends.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, local: float = LOCAL, percentile: float = REGIONAL):
        self.grid = grid.lattice(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
        self.local, self.percentile = local, percentile
        self.tables: list[str] = []
        self.input = _state_of(spark, f"{sf_dir}/lineitem.parquet")
        atexit.register(delete, spark, self.tables)

    def written(self, df: DataFrame, label: str) -> DataFrame:
        with owned() as mine:
            out = written(df, label)
        self.tables += mine
        return out

    def close(self) -> None:
        delete(self.grid.sparkSession, self.tables)

    @cached_property
    def days(self) -> DataFrame:
        """Marked days, written, with ids that a row per cell gives them."""
        return heatwaves.with_ids(self.written(heatwaves.marked_days(self.grid, self.local), "days"))

    @cached_property
    def daily(self) -> DataFrame:
        return self.written(regional.daily_extent(self.days, self.percentile), "daily")

    @cached_property
    def cells(self) -> DataFrame:
        return self.written(regional.selected_cells(self.days, self.daily), "cells")

    @cached_property
    def counts(self) -> DataFrame:
        return self.written(clustering.cluster_counts(self.cells), "counts")

    @cached_property
    def settings(self) -> DataFrame:
        return self.written(clustering.pooled(clustering.daily_settings(self.counts, self.cells)), "settings")

    @cached_property
    def labels(self) -> DataFrame:
        return self.written(clustering.labelled(self.cells, self.settings), "labels")

    @cached_property
    def daily_clusters(self) -> DataFrame:
        """(date, n_clusters) of each selected day."""
        return self.labels.groupBy("date").agg((F.max("dbscan_label") + 1).alias("n_clusters"))

    @cached_property
    def ellipses(self) -> DataFrame:
        return self.written(ellipses.fitted(clustering.clustered(self.labels)[1]), "ellipses")

    @cached_property
    def event_days(self) -> DataFrame:
        return self.written(events.event_days(self.daily_clusters, self.ellipses), "event-days")

    @cached_property
    def compound(self) -> DataFrame:
        return self.written(events.classified(self.event_days, self.ellipses, self.settings), "events")


QUERIES, SQL = {}, {}
#: Runs that a result still holds, by session and folder, and those that the query under way has asked for.
_live: weakref.WeakValueDictionary[tuple, Run] = weakref.WeakValueDictionary()
_asked = threading.local()


def _state_of(spark: SparkSession, path: str) -> tuple:
    """What changes when a table is written anew: its time, size and number of files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = fs.getContentSummary(at)
    return fs.getFileStatus(at).getModificationTime(), whole.getLength(), whole.getFileCount()


def run_over(spark: SparkSession, sf_dir: str) -> Run:
    """The run over a folder that the result of another query holds, if its input and tables are as they were; else a new one."""
    key = (spark._jsparkSession.sessionUUID(), sf_dir)
    run = _live.get(key)
    if run is None or run.input != _state_of(spark, f"{sf_dir}/lineitem.parquet") or not all(exists(spark, p) for p in run.tables):
        run = _live[key] = Run(spark, sf_dir)
    if hasattr(_asked, "runs"):
        _asked.runs.append(run)
    return run


def query(sql: str | None = None):
    """Registers a query. Its result holds the runs it reads, so that queries after it need not repeat their stages."""

    def register(f):
        made = owning(f)

        @functools.wraps(f)
        def holding(*args, **kwargs) -> DataFrame:
            _asked.runs = []
            try:
                out = made(*args, **kwargs)
                out._runs = _asked.runs
            finally:
                del _asked.runs
            return out

        QUERIES[f.__name__] = holding
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# CTEs, each resting on those before it
_GRID = """
rows_ AS (SELECT CAST(l_partkey % 100 AS INTEGER) AS cell_id, CAST(l_shipdate AS DATE) AS date, l_quantity FROM lineitem),
sums AS (SELECT cell_id, date, sum(l_quantity) AS s FROM rows_ GROUP BY ALL),
span AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM rows_),
dense AS (SELECT k.date, k.cell_id, coalesce(s, 0) AS s FROM (SELECT date, CAST(unnest(range(100)) AS INTEGER) AS cell_id FROM span) k LEFT JOIN sums USING (date, cell_id)),
week_ AS (SELECT *, 10 + avg(s) OVER (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS tmax_c FROM dense),
grid AS (SELECT date, cell_id, CAST(cell_id % 10 AS DOUBLE) AS lon, CAST(cell_id // 10 AS DOUBLE) AS lat, tmax_c FROM week_ WHERE month(date) BETWEEN 4 AND 9)"""
_MARKED = _GRID + """,
thr AS (SELECT cell_id, quantile_cont(tmax_c, {local}) AS threshold FROM grid GROUP BY cell_id),
cal AS (SELECT date, row_number() OVER (ORDER BY date) + 2 * sum(gap) OVER (ORDER BY date) AS pos FROM (SELECT date, CASE WHEN date - lag(date) OVER (ORDER BY date) > 1 THEN 1 ELSE 0 END AS gap FROM (SELECT DISTINCT date FROM grid))),
marked AS (SELECT g.*, threshold, tmax_c >= threshold AS exceeds, CAST(pos AS BIGINT) AS pos FROM grid g JOIN thr USING (cell_id) JOIN cal USING (date)),
hits AS (SELECT cell_id, date, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY cell_id ORDER BY date) <= 2 THEN 0 ELSE 1 END AS flag FROM marked WHERE exceeds),
isl AS (SELECT *, sum(flag) OVER (PARTITION BY cell_id ORDER BY date) AS island FROM hits),
spans AS (SELECT cell_id, min(date) AS start_date, max(date) AS end_date, max(pos) - min(pos) + 1 AS span, count(*) AS ones FROM isl GROUP BY cell_id, island HAVING span >= 3 AND ones >= 3),
ids AS (SELECT *, row_number() OVER (ORDER BY cell_id, start_date) AS local_event_id, row_number() OVER (PARTITION BY cell_id ORDER BY start_date) AS nth FROM spans),
hw AS (SELECT m.*, CASE WHEN m.date <= i.end_date THEN i.local_event_id END AS local_event_id FROM marked m ASOF LEFT JOIN ids i ON m.cell_id = i.cell_id AND m.date >= i.start_date)""".replace("{local}", str(LOCAL / 100))
_EVENTS = _MARKED + """,
peaks AS (SELECT local_event_id, max(tmax_c) AS peak_tmax_c, arg_min(date, struct_pack(a := -tmax_c, b := date)) AS peak_date FROM hw WHERE local_event_id IS NOT NULL GROUP BY 1),
catalog1 AS (SELECT CAST(i.local_event_id AS INTEGER) AS local_event_id, i.cell_id, CAST(i.cell_id // 10 AS DOUBLE) AS lat, CAST(i.cell_id % 10 AS DOUBLE) AS lon, CAST(nth AS INTEGER) AS event_number_in_cell, start_date, end_date,
  CAST(span AS INTEGER) AS duration_days, CAST(ones AS INTEGER) AS exceeding_days, CAST(span - ones AS INTEGER) AS bridged_days, peak_date, round(peak_tmax_c, 6) AS peak_tmax_c FROM ids i JOIN peaks USING (local_event_id))"""
_DAILY = _MARKED + """,
extent0 AS (SELECT date, count(*) AS n_domain_cells, count(*) FILTER (exceeds) AS n_exceeding_cells, count(local_event_id) AS n_heatwave_cells, count(local_event_id) FILTER (exceeds) AS n_heatwave_and_exceeding_cells FROM hw GROUP BY date),
regional AS (SELECT list_sort(list(n_heatwave_cells))[CAST(ceil((count(*) - 1) * {q}) AS INTEGER) + 1] AS t FROM extent0),
daily AS (SELECT extent0.*, n_heatwave_cells / n_domain_cells AS heatwave_fraction_of_domain, CASE WHEN n_exceeding_cells > 0 THEN n_heatwave_and_exceeding_cells / n_exceeding_cells END AS heatwave_share_of_exceeding_cells, t AS regional_threshold_cells, CAST(n_heatwave_cells >= t AS INTEGER) AS selected FROM extent0, regional),
sc AS (SELECT date, cell_id, lat, lon, CAST(local_event_id AS INTEGER) AS local_event_id, tmax_c, row_number() OVER (PARTITION BY date ORDER BY lon, lat) AS j FROM hw WHERE local_event_id IS NOT NULL AND date IN (SELECT date FROM daily WHERE selected = 1))""".replace("{q}", str(REGIONAL / 100))
_COUNTS = _DAILY + """,
pairs AS MATERIALIZED (SELECT a.date, a.j, b.j AS k, (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) AS d2 FROM sc a JOIN sc b USING (date) WHERE d2 <= 16),
eps_ AS (SELECT unnest([1, 1.5, 2, 2.5, 3, 3.5, 4])::DOUBLE AS eps), ms_ AS (SELECT CAST(unnest(range(4, 13)) AS INTEGER) AS ms),
nn AS (SELECT date, eps, j, count(*) AS n FROM pairs, eps_ WHERE d2 <= eps * eps GROUP BY ALL),
core AS MATERIALIZED (SELECT date, eps, ms, j FROM nn, ms_ WHERE n >= ms),
links AS MATERIALIZED (SELECT a.date, a.eps, a.ms, a.j, b.j AS k FROM core a JOIN pairs p ON p.date = a.date AND p.j = a.j AND p.d2 <= a.eps * a.eps JOIN core b ON b.date = a.date AND b.eps = a.eps AND b.ms = a.ms AND b.j = p.k),
reach AS (SELECT date, eps, ms, j, j AS root FROM core UNION SELECT l.date, l.eps, l.ms, l.k, r.root FROM reach r JOIN links l ON l.date = r.date AND l.eps = r.eps AND l.ms = r.ms AND l.j = r.j WHERE l.k > r.root),
roots AS (SELECT date, eps, ms, j, min(root) AS root FROM reach GROUP BY ALL),
counts AS MATERIALIZED (SELECT d.date, eps_.eps, ms_.ms AS min_samples, CAST(coalesce(n, 0) AS INTEGER) AS n_clusters FROM (SELECT DISTINCT date FROM sc) d CROSS JOIN eps_ CROSS JOIN ms_
  LEFT JOIN (SELECT date, eps, ms, count(DISTINCT root) AS n FROM roots GROUP BY ALL) x ON x.date = d.date AND x.eps = eps_.eps AND x.ms = ms_.ms)"""
_SETTINGS = _COUNTS + """,
usable AS (SELECT * FROM (SELECT *, max(n_clusters) OVER (PARTITION BY date) AS top FROM counts) WHERE n_clusters > 0 OR top = 0),
freqs AS (SELECT *, count(*) OVER (PARTITION BY date, n_clusters) AS freq FROM usable),
modal AS (SELECT * FROM (SELECT *, max(freq) OVER (PARTITION BY date) AS most FROM freqs) WHERE freq = most),
set0 AS (SELECT date, array_to_string(list_sort(list(DISTINCT n_clusters)), '|') AS modal_cluster_counts, max(most) AS modal_frequency, count(*) AS n_pairs_retained, avg(eps) AS daily_eps, avg(min_samples) AS daily_min_samples_mean,
  CAST(greatest(1, floor(avg(min_samples) + 0.5)) AS INTEGER) AS daily_min_samples FROM modal GROUP BY date),
runs AS (SELECT *, sum(new) OVER (ORDER BY date) AS run FROM (SELECT *, CASE WHEN date - lag(date) OVER (ORDER BY date) = 1 THEN 0 ELSE 1 END AS new FROM set0)),
settings AS MATERIALIZED (SELECT * EXCLUDE (new, run), min(date) OVER w AS sequence_start_date, max(daily_eps) OVER w AS sequence_eps, max(daily_min_samples) OVER w AS sequence_min_samples, max(date) OVER w AS sequence_end_date, CAST(count(*) OVER w AS INTEGER) AS sequence_days FROM runs WINDOW w AS (PARTITION BY run))"""
_LABELS = _SETTINGS + """,
near2 AS (SELECT p.date, p.j, count(*) AS n FROM pairs p JOIN settings s USING (date) WHERE d2 <= sequence_eps * sequence_eps GROUP BY ALL),
core2 AS MATERIALIZED (SELECT n.date, n.j FROM near2 n JOIN settings s USING (date) WHERE n.n >= sequence_min_samples),
link2 AS MATERIALIZED (SELECT p.date, p.j, p.k FROM pairs p JOIN settings s USING (date) JOIN core2 b ON b.date = p.date AND b.j = p.k WHERE p.d2 <= sequence_eps * sequence_eps),
reach2 AS (SELECT date, j, j AS root FROM core2 UNION SELECT l.date, l.k, r.root FROM reach2 r JOIN link2 l ON l.date = r.date AND l.j = r.j),
root2 AS (SELECT date, j, min(root) AS root FROM reach2 GROUP BY ALL),
core3 AS MATERIALIZED (SELECT date, j, dense_rank() OVER (PARTITION BY date ORDER BY root) - 1 AS label FROM root2),
border AS (SELECT l.date, l.j, min(c.label) AS label FROM link2 l JOIN core3 c ON c.date = l.date AND c.j = l.k WHERE NOT EXISTS (SELECT 1 FROM core2 x WHERE x.date = l.date AND x.j = l.j) GROUP BY ALL),
labels AS MATERIALIZED (SELECT sc.date, sc.cell_id, sc.lat, sc.lon, sc.local_event_id, sc.tmax_c, CAST(coalesce(core3.label, border.label, -1) AS INTEGER) AS dbscan_label, CAST(core3.label IS NOT NULL AS INTEGER) AS is_core_cell, CAST(near2.n AS INTEGER) AS n_cells_within_eps, sequence_eps AS eps_applied, sequence_min_samples AS min_samples_applied
  FROM sc JOIN near2 USING (date, j) JOIN settings USING (date) LEFT JOIN core3 USING (date, j) LEFT JOIN border USING (date, j)),
per_day AS (SELECT date, max(dbscan_label) + 1 AS n_clusters, count(*) FILTER (dbscan_label < 0) AS noise FROM labels GROUP BY date),
offs AS (SELECT *, sum(n_clusters) OVER (ORDER BY date) - n_clusters AS before FROM per_day),
members AS MATERIALIZED (SELECT labels.*, CASE WHEN dbscan_label >= 0 THEN CAST(before + dbscan_label + 1 AS INTEGER) END AS cluster_id, CAST(dbscan_label < 0 AS INTEGER) AS is_noise FROM labels JOIN offs USING (date))"""
_ELLIPSES = _LABELS + """,
mean_ AS (SELECT cluster_id, avg(lon) AS mx, avg(lat) AS my FROM members WHERE cluster_id IS NOT NULL GROUP BY 1),
km AS (SELECT m.*, mx, my, (lon - mx) * 111.320 * cos(radians(my)) AS x, (lat - my) * 110.574 AS y, CAST(CAST(tmax_c AS FLOAT) AS DOUBLE) AS w FROM members m JOIN mean_ USING (cluster_id)),
cov AS (SELECT cluster_id, min(date) AS date, count(*) AS n, min(mx) AS mx, min(my) AS my, CASE WHEN count(*) = 1 THEN 1 ELSE var_samp(x) END AS sxx, CASE WHEN count(*) = 1 THEN 1 ELSE var_samp(y) END AS syy, CASE WHEN count(*) = 1 THEN 0 ELSE covar_samp(x, y) END AS sxy, sum(lon * w) / sum(w) AS wx, sum(lat * w) / sum(w) AS wy, sum(w) AS ws, min(w) AS wmin, max(w) AS wmax FROM km GROUP BY 1),
eig AS (SELECT *, greatest(0, (sxx + syy) / 2 + sqrt(((sxx - syy) / 2) * ((sxx - syy) / 2) + sxy * sxy)) AS l1, greatest(0, (sxx + syy) / 2 - sqrt(((sxx - syy) / 2) * ((sxx - syy) / 2) + sxy * sxy)) AS l2 FROM cov),
ang AS (SELECT *, 2.5 * sqrt(greatest(l1, 1)) AS major, 2.5 * sqrt(greatest(l2, 1)) AS minor, CASE WHEN n = 1 THEN 0 WHEN sxy = 0 AND sxx = syy THEN 90 ELSE degrees(0.5 * atan2(2 * sxy, sxx - syy)) END AS o FROM eig),
ell AS MATERIALIZED (SELECT cluster_id, date, n AS n_member_cells, mx, my, l1, l2, major, minor, pi() * major / 2 * minor / 2 AS area_km2, minor / major AS axis_ratio, CASE WHEN o < 0 THEN o + 180 ELSE o END AS o, CASE WHEN 90 - o > 90 THEN 90 - o - 180 ELSE 90 - o END AS az, wx, wy, ws, wmin, wmax FROM ang)"""
_COMPOUND = _ELLIPSES + """,
rd AS (SELECT *, sum(new) OVER (ORDER BY date) AS run FROM (SELECT date, n_clusters, CASE WHEN date - lag(date) OVER (ORDER BY date) = 1 THEN 0 ELSE 1 END AS new FROM per_day)),
kept AS (SELECT * FROM (SELECT *, sum(n_clusters) OVER (PARTITION BY run) AS total FROM rd) WHERE total > 0),
top AS (SELECT date, arg_min(cluster_id, struct_pack(a := -round(area_km2, 6), b := cluster_id)) AS top_id, max(area_km2) AS top_area FROM ell GROUP BY date),
evd AS MATERIALIZED (SELECT date, CAST(dense_rank() OVER (ORDER BY run) AS INTEGER) AS compound_event_id, CAST(row_number() OVER (PARTITION BY run ORDER BY date) AS INTEGER) AS day_in_event, n_clusters, top_id AS largest_ellipse_id, top_area AS largest_ellipse_area_km2 FROM kept LEFT JOIN top USING (date)),
ce0 AS (SELECT compound_event_id, min(date) AS start_date, max(date) AS end_date, CAST(count(*) AS INTEGER) AS duration_days, string_agg(CAST(n_clusters AS VARCHAR), '-' ORDER BY date) AS daily_cluster_counts, CAST(sum(n_clusters) AS BIGINT) AS total_clusters, min(n_clusters) AS min_daily_clusters, max(n_clusters) AS max_daily_clusters,
  count(*) FILTER (n_clusters = 1) AS n_single_cluster_days, count(*) FILTER (n_clusters > 1) AS n_multi_cluster_days, arg_min(largest_ellipse_id, struct_pack(a := -round(largest_ellipse_area_km2, 6), b := date)) AS largest_ellipse_id, arg_min(date, struct_pack(a := -round(largest_ellipse_area_km2, 6), b := date)) AS largest_ellipse_date, max(largest_ellipse_area_km2) AS largest_ellipse_area_km2 FROM evd GROUP BY 1),
shape AS (SELECT compound_event_id, avg(area_km2) AS mean_area_km2, avg(axis_ratio) AS mean_axis_ratio, avg(cos(radians(2 * az))) AS c, avg(sin(radians(2 * az))) AS s FROM ell JOIN evd USING (date) GROUP BY 1),
used AS (SELECT compound_event_id, max(sequence_eps) AS event_eps, max(sequence_min_samples) AS event_min_samples FROM evd JOIN settings USING (date) GROUP BY 1),
ce AS MATERIALIZED (SELECT ce0.*, event_eps, event_min_samples, mean_area_km2, mean_axis_ratio, c, s, CASE WHEN sqrt(c * c + s * s) > 1e-12 THEN degrees(atan2(s, c)) / 2 END AS axial, CASE WHEN duration_days = 1 THEN CASE WHEN max_daily_clusters = 1 THEN 1 ELSE 2 END WHEN (min_daily_clusters = 1 AND max_daily_clusters = 1) OR min_daily_clusters > 1 THEN 3 ELSE 4 END AS event_type FROM ce0 JOIN shape USING (compound_event_id) JOIN used USING (compound_event_id))"""


def sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


@query(sql(_GRID, "SELECT date, cell_id, lon, lat, round(tmax_c, 6) AS tmax_c FROM grid"))
def tmax_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.lattice(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


@query("SELECT CAST(ts AS DATE) AS date, user_id, max(value) AS tmax FROM events GROUP BY ALL")
def daily_max_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.daily_maxima(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ("user_id",), "value")


@query(sql(_GRID, """, k AS (SELECT *, floor(lon / 2 + 1e-6) AS i, floor(lat / 2 + 1e-6) AS j2 FROM grid),
whole AS (SELECT i, j2 FROM k GROUP BY ALL HAVING count(DISTINCT lon) = 2 AND count(DISTINCT lat) = 2)
SELECT date, (i + 0.5) * 2 AS lon, (j2 + 0.5) * 2 AS lat, round(avg(tmax_c), 6) AS tmax FROM k SEMI JOIN whole USING (i, j2) GROUP BY date, i, j2""".lstrip()))
def cell_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.cell_averages(grid.lattice(spark.read.parquet(f"{sf_dir}/lineitem.parquet")), 2.0, 1.0, "tmax_c"))


@query(sql(_EVENTS, "SELECT * FROM catalog1"))
def local_heatwaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(heatwaves.catalogue(run_over(spark, sf_dir).days))


@query(sql(_MARKED, "SELECT cell_id, date, CAST(local_event_id AS INTEGER) AS local_event_id, exceeds FROM hw WHERE local_event_id IS NOT NULL"))
def heatwave_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_over(spark, sf_dir).days.where("local_event_id is not null").select("cell_id", "date", "local_event_id", "exceeds")


@query(sql(_MARKED, "SELECT cell_id, any_value(lat) AS lat, any_value(lon) AS lon, round(any_value(threshold), 6) AS threshold_tmax_c, count(*) FILTER (exceeds) AS n_exceeding_days, count(local_event_id) AS n_heatwave_days, count(DISTINCT local_event_id) AS n_local_events FROM hw GROUP BY cell_id"))
def cell_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(heatwaves.cell_summary(run_over(spark, sf_dir).days))


@query(sql(_DAILY, "SELECT * REPLACE (round(heatwave_fraction_of_domain, 6) AS heatwave_fraction_of_domain, round(heatwave_share_of_exceeding_cells, 6) AS heatwave_share_of_exceeding_cells) FROM daily"))
def daily_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(run_over(spark, sf_dir).daily)


@query(sql(_DAILY, "SELECT date, n_heatwave_cells, round(heatwave_fraction_of_domain, 6) AS heatwave_fraction_of_domain, n_exceeding_cells, n_heatwave_and_exceeding_cells, round(heatwave_share_of_exceeding_cells, 6) AS heatwave_share_of_exceeding_cells FROM daily WHERE selected = 1"))
def regional_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = regional.checked(run_over(spark, sf_dir).daily).where("selected = 1")
    return _rounded(daily.select("date", "n_heatwave_cells", "heatwave_fraction_of_domain", "n_exceeding_cells", "n_heatwave_and_exceeding_cells", "heatwave_share_of_exceeding_cells"))


@query(sql(_DAILY, "SELECT date, cell_id, lat, lon, local_event_id FROM sc"))
def regional_day_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_over(spark, sf_dir).cells.drop("tmax_c")


@query(sql(_COUNTS, "SELECT * FROM counts"))
def dbscan_cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_over(spark, sf_dir).counts


@query(sql(_SETTINGS, "SELECT settings.* REPLACE (round(daily_eps, 6) AS daily_eps, round(daily_min_samples_mean, 6) AS daily_min_samples_mean, round(sequence_eps, 6) AS sequence_eps), n AS n_heatwave_cells FROM settings JOIN (SELECT date, count(*) AS n FROM sc GROUP BY 1) USING (date)"))
def daily_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(run_over(spark, sf_dir).settings)


@query(sql(_SETTINGS, "SELECT DISTINCT sequence_start_date, sequence_end_date AS end_date, sequence_days AS n_days, round(sequence_eps, 6) AS sequence_eps, sequence_min_samples FROM settings"))
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_over(spark, sf_dir).settings
    return _rounded(out.select("sequence_start_date", F.col("sequence_end_date").alias("end_date"), F.col("sequence_days").alias("n_days"), "sequence_eps", "sequence_min_samples").distinct())


_CELLS = "date, cell_id, lat, lon, local_event_id, dbscan_label, cluster_id, is_noise, is_core_cell, n_cells_within_eps"


@query(sql(_LABELS, f"SELECT {_CELLS} FROM members"))
def cluster_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(run_over(spark, sf_dir).labels)[1].select(*_CELLS.split(", "))


@query(sql(_LABELS, "SELECT cluster_id, m.date, dbscan_label AS cluster_number_in_day, dbscan_label, count(*) AS n_member_cells, CAST(sum(is_core_cell) AS BIGINT) AS n_core_cells, round(max(eps_applied), 6) AS eps_applied, max(min_samples_applied) AS min_samples_applied, max(n_clusters) AS n_clusters_on_day, max(noise) AS n_noise_cells_on_day FROM members m JOIN per_day p ON p.date = m.date WHERE cluster_id IS NOT NULL GROUP BY ALL"))
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustering.clustered(run_over(spark, sf_dir).labels)[0]
    return _rounded(out)


@query(sql(_ELLIPSES, """SELECT cluster_id, date, n_member_cells, round(mx, 6) AS centroid_lon_unweighted, round(my, 6) AS centroid_lat_unweighted, round(l1, 6) AS eigenvalue_major_km2, round(l2, 6) AS eigenvalue_minor_km2, round(major, 6) AS major_axis_km, round(minor, 6) AS minor_axis_km,
round(area_km2, 4) AS area_km2, round(axis_ratio, 6) AS axis_ratio, round(o, 6) AS orientation_east_ccw_deg, round(az, 6) AS azimuth_north_cw_deg, cluster_id AS ellipse_id, round(cos(radians(o)), 6) AS major_axis_east, round(sin(radians(o)), 6) AS major_axis_north, round(wx, 6) AS centroid_lon_weighted, round(wy, 6) AS centroid_lat_weighted, round(ws, 6) AS tmax_weight_sum_c, round(wmin, 6) AS tmax_min_c, round(wmax, 6) AS tmax_max_c FROM ell"""))
def fitted_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_over(spark, sf_dir).ellipses
    return _rounded(out.withColumn("area_km2", F.round("area_km2", 4)))


@query(sql(_COMPOUND, "SELECT * REPLACE (round(largest_ellipse_area_km2, 4) AS largest_ellipse_area_km2) FROM evd"))
def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_over(spark, sf_dir).event_days.withColumn("largest_ellipse_area_km2", F.round("largest_ellipse_area_km2", 4))


@query(sql(_COMPOUND, """SELECT compound_event_id, start_date, end_date, duration_days, duration_days AS n_selected_days, round(event_eps, 6) AS event_eps, event_min_samples, round(CASE WHEN axial <= -90 THEN axial + 180 ELSE axial END, 5) AS axial_mean_azimuth_deg, event_type, ['Widespread (Isolated)', 'Spatially Clustered', 'Temporally Clustered', 'Compound Clustering (Multi-Type)'][event_type] AS event_type_name, daily_cluster_counts, total_clusters, min_daily_clusters, max_daily_clusters, n_single_cluster_days, n_multi_cluster_days,
round(mean_area_km2, 4) AS mean_area_km2, round(mean_axis_ratio, 6) AS mean_axis_ratio, round(sqrt(c * c + s * s), 6) AS axial_resultant_length, largest_ellipse_id, largest_ellipse_date, round(largest_ellipse_area_km2, 4) AS largest_ellipse_area_km2 FROM ce"""))
def compound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_over(spark, sf_dir).compound
    return _rounded(out.withColumns({c: F.round(c, 4) for c in ("mean_area_km2", "largest_ellipse_area_km2")} | {"axial_mean_azimuth_deg": F.round("axial_mean_azimuth_deg", 5)}))


@query(sql(_COMPOUND, """SELECT ['Type 1: Widespread (Isolated)', 'Type 2: Spatially Clustered', 'Type 3: Temporally Clustered', 'Type 4: Compound Clustering (Multi-Type)'][t] AS compound_heatwave_type, coalesce(CAST(sum(duration_days) AS BIGINT), 0) AS selected_event_days, count(compound_event_id) AS number_of_compound_events, max(duration_days) AS longest_event_days, round(avg(duration_days), 2) AS mean_duration_days_per_event, round(avg(total_clusters), 2) AS mean_ellipses_per_event,
min(total_clusters) AS minimum_ellipses_per_event, max(total_clusters) AS maximum_ellipses_per_event FROM range(1, 5) x(t) LEFT JOIN ce ON event_type = t GROUP BY t"""))
def event_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.type_summary(run_over(spark, sf_dir).compound)


@query(sql(_COMPOUND, """, ys AS (SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM grid)
SELECT ys.year, count(*) FILTER (event_type = 1) AS type_1_events, count(*) FILTER (event_type = 2) AS type_2_events, count(*) FILTER (event_type = 3) AS type_3_events, count(*) FILTER (event_type = 4) AS type_4_events, count(event_type) AS all_events FROM ys LEFT JOIN ce ON year(start_date) = ys.year GROUP BY ys.year""".lstrip()))
def annual_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_over(spark, sf_dir)
    return events.annual_counts(run.compound, run.grid.select("date").distinct(), events.season_start(SEASON))


_SERIES = _COMPOUND + """,
series AS (SELECT event_type, CAST(year(start_date) AS INTEGER) AS year, avg(duration_days) AS y FROM ce WHERE event_type IN (3, 4) GROUP BY ALL)"""


@query(sql(_SERIES, "SELECT event_type, year, round(y, 6) AS mean_duration_days FROM series"))
def annual_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(events.annual_duration(run_over(spark, sf_dir).compound, events.season_start(SEASON)))


# two-sided p of a normal z and of a t with n - 2 degrees, by Simpson's rule on the density
_P_NORMAL = "greatest(0, 1 - 2 * list_sum(list_transform(range(0, 2001), lambda k: (CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * (abs(z) * k / 2000) * (abs(z) * k / 2000)))) * abs(z) / 6000 / sqrt(2 * pi()))"
_P_T = "1 - 2 * list_sum(list_transform(range(0, 2001), lambda k: (CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + (t * k / 2000) * (t * k / 2000) / (n - 2), -(n - 1) / 2.0))) * t / 6000 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi())"


@query(sql(_SERIES, f""", prs AS (SELECT a.event_type, CAST(sum(sign(b.y - a.y)) AS DOUBLE) AS s, median((b.y - a.y) / (b.year - a.year)) AS sen FROM series a JOIN series b ON a.event_type = b.event_type AND a.year < b.year GROUP BY 1),
tie AS (SELECT event_type, sum(t * (t - 1) * (2 * t + 5)) AS ties, count(*) AS vals FROM (SELECT event_type, y, count(*) AS t FROM series GROUP BY ALL) GROUP BY 1),
ols AS (SELECT event_type, count(*) AS n, regr_slope(y, year) AS b, regr_r2(y, year) AS r2 FROM series GROUP BY 1),
parts AS (SELECT *, (n * (n - 1) * (2 * n + 5) - ties) / 18 AS var FROM ols JOIN tie USING (event_type) LEFT JOIN prs USING (event_type) WHERE n >= 3),
stat AS (SELECT *, CASE WHEN s = 0 OR var <= 0 THEN 0 ELSE (s - sign(s)) / sqrt(var) END AS z, CASE WHEN vals > 1 AND r2 < 1 THEN sqrt((n - 2) * r2 / (1 - r2)) END AS t FROM parts),
tested AS (SELECT *, {_P_NORMAL} AS mk_p, CASE WHEN vals = 1 THEN 1 WHEN r2 >= 1 THEN 0 ELSE {_P_T} END AS p FROM stat)
SELECT CAST(x.k AS INTEGER) AS event_type, ['Widespread (Isolated)', 'Spatially Clustered', 'Temporally Clustered', 'Compound Clustering (Multi-Type)'][x.k] AS event_type_name, coalesce(o.n, 0) AS n_years,
round(CASE WHEN vals = 1 THEN 0 ELSE 10 * t.b END, 6) AS ols_slope_days_per_decade, round(p, 6) AS ols_p_value, round(CASE WHEN vals = 1 THEN 0 ELSE t.r2 END, 6) AS ols_r_squared, round(10 * sen, 6) AS sen_slope_days_per_decade,
s AS mann_kendall_s, round(z, 6) AS mann_kendall_z, round(mk_p, 6) AS mann_kendall_p_value, CASE WHEN t.n IS NULL THEN 'too few years' WHEN mk_p < 0.05 AND z > 0 THEN 'increasing' WHEN mk_p < 0.05 AND z < 0 THEN 'decreasing' ELSE 'no significant trend' END AS mann_kendall_result
FROM range(3, 5) x(k) LEFT JOIN ols o ON o.event_type = x.k LEFT JOIN tested t ON t.event_type = x.k""".lstrip()))
def duration_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = written(events.annual_duration(run_over(spark, sf_dir).compound, events.season_start(SEASON)), "series")
    return _rounded(events.duration_trends(series))


def _samples(run: Run) -> DataFrame:
    daily = run.event_days.where("largest_ellipse_id is not null").select(F.lit("daily_maxima").alias("dataset"), F.col("largest_ellipse_area_km2").alias("area_km2"))
    return daily.unionByName(run.compound.select(F.lit("event_maxima").alias("dataset"), F.col("largest_ellipse_area_km2").alias("area_km2")))


_AREAS = _COMPOUND + """,
areas AS MATERIALIZED (SELECT 'daily_maxima' AS dataset, largest_ellipse_area_km2 AS v FROM evd WHERE largest_ellipse_id IS NOT NULL UNION ALL SELECT 'event_maxima', largest_ellipse_area_km2 FROM ce)"""


_SCAN = _AREAS + """, cuts AS (SELECT DISTINCT dataset, round(v, 6) AS xmin FROM areas), open_ AS (SELECT * FROM (SELECT *, max(xmin) OVER (PARTITION BY dataset) AS top FROM cuts) WHERE xmin < top),
tails AS (SELECT o.dataset, xmin, round(v, 6) AS v, count(*) OVER w AS n, sum(ln(round(v, 6) / xmin)) OVER w AS logs, row_number() OVER (PARTITION BY o.dataset, xmin ORDER BY v) AS i FROM open_ o JOIN areas a ON a.dataset = o.dataset AND round(v, 6) >= xmin WINDOW w AS (PARTITION BY o.dataset, xmin)),
gaps AS (SELECT *, greatest(i / n - (1 - pow(v / xmin, -n / logs)), (1 - pow(v / xmin, -n / logs)) - (i - 1) / n) AS g FROM tails),
scan AS (SELECT dataset, xmin, max(n) AS n_tail, 1 + max(n / logs) AS alpha, max(g) AS d FROM gaps GROUP BY ALL)"""


@query(sql(_SCAN, "SELECT dataset, xmin, n_tail, round(alpha, 6) AS alpha, round(d, 6) AS ks_distance FROM scan"))
def power_law_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = written(_samples(run_over(spark, sf_dir)).withColumn("area_km2", F.round("area_km2", 6)), "areas")
    return _rounded(power_law.cutoff_scan(areas))


@query(sql(_SCAN, """, best AS (SELECT dataset, arg_min(struct_pack(x := xmin, n := n_tail, a := alpha, d := d), struct_pack(d := d, x := xmin)) AS b, count(*) AS n_candidates FROM scan GROUP BY 1)
SELECT dataset, count(*) AS n, n_candidates, b.n AS n_tail, b.x AS xmin_km2, round(b.a, 6) AS alpha, round(b.d, 6) AS ks_distance, round(b.n * ln((b.a - 1) / b.x) - b.a * b.n / (b.a - 1), 4) AS loglik, 'ok' AS status FROM areas JOIN best USING (dataset) GROUP BY ALL""".lstrip()))
def power_law_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = written(_samples(run_over(spark, sf_dir)).withColumn("area_km2", F.round("area_km2", 6)), "areas")
    return _rounded(power_law.fitted(areas).withColumn("loglik", F.round("loglik", 4)))


@query(sql(_GRID, "SELECT cell_id, any_value(lon) AS lon, any_value(lat) AS lat, round(avg(tmax_c), 6) AS mean_tmax, round(sqrt(greatest(0, avg(tmax_c * tmax_c) - avg(tmax_c) * avg(tmax_c))), 6) AS std_tmax FROM grid GROUP BY cell_id"))
def cell_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.lattice(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).groupBy("cell_id").agg(
        F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.avg("tmax_c").alias("mean_tmax"), F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("tmax_c") * F.col("tmax_c")) - F.avg("tmax_c") * F.avg("tmax_c"))).alias("std_tmax"))
    return _rounded(rows)


def _laea(lon: str, lat: str, lon0: float, lat0: float) -> tuple[str, str]:
    """forward() as SQL, with the same constants."""
    k = projection.constants(lon0, lat0)
    s_, dl = f"sin(radians({lat}))", f"radians({lon} - {lon0!r})"
    q = f"({1 - E2!r} * ({s_} / (1 - {E2!r} * {s_} * {s_}) - ln((1 - {E1!r} * {s_}) / (1 + {E1!r} * {s_})) / {2 * E1!r}))"
    b_ = f"asin(greatest(-1, least(1, {q} / {k.qp!r})))"
    f = f"sqrt(2 / (1 + {k.sin_b0!r} * sin({b_}) + {k.cos_b0!r} * cos({b_}) * cos({dl}))) * {k.rq!r}"
    return f"{f} * {k.d!r} * cos({b_}) * sin({dl})", f"{f} / {k.d!r} * ({k.cos_b0!r} * sin({b_}) - {k.sin_b0!r} * cos({b_}) * cos({dl}))"


_X, _Y = _laea("wx", "wy", 4.5, 4.5)
_CX, _CY = _laea("lon", "lat", 4.5, 4.5)
_POINTS = _COMPOUND + f""",
pts AS MATERIALIZED (SELECT cluster_id AS ellipse_id, {_X} AS x_km, {_Y} AS y_km FROM ell),
cls AS MATERIALIZED (SELECT cell_id, any_value(lon) AS lon, any_value(lat) AS lat, avg(tmax_c) AS mean_tmax, sqrt(greatest(0, avg(tmax_c * tmax_c) - avg(tmax_c) * avg(tmax_c))) AS std_tmax, {_CX.replace("lon -", "any_value(lon) -").replace("radians(lat)", "radians(any_value(lat))")} AS x_km, {_CY.replace("lon -", "any_value(lon) -").replace("radians(lat)", "radians(any_value(lat))")} AS y_km FROM grid GROUP BY cell_id),
near1 AS MATERIALIZED (SELECT p.ellipse_id, arg_min(c.cell_id, struct_pack(d := round(sqrt((p.x_km - c.x_km) ** 2 + (p.y_km - c.y_km) ** 2), 9), i := c.cell_id)) AS nearest_cell_id, min(sqrt((p.x_km - c.x_km) ** 2 + (p.y_km - c.y_km) ** 2)) AS d FROM pts p CROSS JOIN cls c GROUP BY 1)"""
#: The raster's pixel and the window's margin, in km.
PIXEL, MARGIN = 25.0, 80.0


def _cells(run: Run) -> DataFrame:
    """One row per cell: place in degrees and in the plane, mean and deviation of tmax."""
    rows = run.grid.groupBy("cell_id").agg(
        F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.avg("tmax_c").alias("mean_tmax"), F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("tmax_c") * F.col("tmax_c")) - F.avg("tmax_c") * F.avg("tmax_c"))).alias("std_tmax"))
    return written(point_process.projected(rows, 4.5, 4.5), "cells")


def _centroids(run: Run) -> DataFrame:
    """One row per ellipse: its centroid in the plane, and whether it is its day's or event's largest."""
    at = point_process.projected(run.ellipses, 4.5, 4.5, "centroid_lon_weighted", "centroid_lat_weighted")
    largest = lambda df, name: df.select(F.col("largest_ellipse_id").cast("int").alias("ellipse_id"), F.lit(True).alias(name)).where("ellipse_id is not null").distinct()
    out = at.select("ellipse_id", F.col("centroid_lon_weighted").alias("lon"), F.col("centroid_lat_weighted").alias("lat"), "x_km", "y_km")
    out = out.join(largest(run.event_days, "is_daily_largest"), "ellipse_id", "left").join(largest(run.compound, "is_event_largest"), "ellipse_id", "left")
    return written(out.fillna(False, ["is_daily_largest", "is_event_largest"]), "centroids")


@query(sql(_POINTS, "SELECT ellipse_id, round(x_km, 6) AS x_km, round(y_km, 6) AS y_km FROM pts"))
def laea_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster centroids on the equal-area plane around the lattice's middle."""
    found = run_over(spark, sf_dir).ellipses
    x, y = forward(F.col("centroid_lon_weighted"), F.col("centroid_lat_weighted"), 4.5, 4.5)
    return _rounded(found.select("ellipse_id", x.alias("x_km"), y.alias("y_km")))


@query(sql(_ELLIPSES, "SELECT cluster_id AS ellipse_id, round(wx, 6) AS lon, round(wy, 6) AS lat FROM ell"))
def laea_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids to the plane and back: the SQL has the places they came from."""
    found = run_over(spark, sf_dir).ellipses
    x, y = forward(F.col("centroid_lon_weighted"), F.col("centroid_lat_weighted"), 4.5, 4.5)
    lon, lat = projection.inverse(F.col("x_km"), F.col("y_km"), 4.5, 4.5)
    return _rounded(found.select("ellipse_id", x.alias("x_km"), y.alias("y_km")).select("ellipse_id", lon.alias("lon"), lat.alias("lat")))


@query(sql(_POINTS, "SELECT ellipse_id, nearest_cell_id, round(d, 6) AS nearest_cell_distance_km FROM near1"))
def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell nearest to each centroid."""
    run = run_over(spark, sf_dir)
    out = point_process.nearest_cell(_centroids(run), _cells(run), PIXEL + MARGIN, "ellipse_id")
    return _rounded(out.select("ellipse_id", "nearest_cell_id", "nearest_cell_distance_km"))


@query(sql(_POINTS, f""", box AS (SELECT min(x_km) - {PIXEL} AS x0, max(x_km) + {PIXEL} AS x1, min(y_km) - {PIXEL} AS y0, max(y_km) + {PIXEL} AS y1 FROM cls),
px AS (SELECT x0 + {PIXEL / 2} + {PIXEL} * unnest(range(CAST(ceil((x1 - x0 - {PIXEL / 2}) / {PIXEL}) AS BIGINT))) AS x_km FROM box),
py AS (SELECT y0 + {PIXEL / 2} + {PIXEL} * unnest(range(CAST(ceil((y1 - y0 - {PIXEL / 2}) / {PIXEL}) AS BIGINT))) AS y_km FROM box),
near2p AS (SELECT px.x_km, py.y_km, min(sqrt((px.x_km - c.x_km) ** 2 + (py.y_km - c.y_km) ** 2)) AS d FROM px CROSS JOIN py CROSS JOIN cls c GROUP BY ALL)
SELECT round(x_km, 6) AS x_km, round(y_km, 6) AS y_km, round(d, 6) AS nearest_cell_distance_km FROM near2p WHERE d <= {PIXEL + MARGIN}
  OR EXISTS (SELECT 1 FROM pts WHERE abs(pts.x_km - near2p.x_km) < {PIXEL / 2} AND abs(pts.y_km - near2p.y_km) < {PIXEL / 2})""".lstrip()))
def pixel_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation window of the point process."""
    run = run_over(spark, sf_dir)
    out = point_process.window(_cells(run), _centroids(run), 4.5, 4.5, PIXEL, MARGIN)
    return _rounded(out.select("x_km", "y_km", "nearest_cell_distance_km"))


@query(sql(_POINTS, """, cum AS (SELECT cell_id, (sum(cos(radians(lat))) OVER (ORDER BY round(mean_tmax, 10) DESC, cell_id) - cos(radians(lat))) / sum(cos(radians(lat))) OVER () AS before FROM cls),
own AS (SELECT before, ellipse_id IN (SELECT largest_ellipse_id FROM evd) AS daily, ellipse_id IN (SELECT largest_ellipse_id FROM ce) AS event FROM near1 JOIN cum ON cell_id = nearest_cell_id),
grp AS (SELECT before, unnest(['all_centroids', 'daily_largest', 'event_largest']) AS "group", unnest([true, daily, event]) AS mine FROM own)
SELECT f AS zone_area_fraction, "group", count(*) FILTER (mine) AS n_centroids_in_group, count(*) FILTER (mine AND before < f) AS n_in_zone, round(100 * count(*) FILTER (mine AND before < f) / nullif(count(*) FILTER (mine), 0), 6) AS percent_in_zone FROM grp CROSS JOIN (SELECT unnest([0.2, 0.5])::DOUBLE AS f) GROUP BY ALL""".lstrip()))
def concentration_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How centroids gather in the most intense cells; mean tmax stands for the intensity here."""
    run = run_over(spark, sf_dir)
    cells = _cells(run).withColumn("mean_intensity_per_km2", F.col("mean_tmax"))
    points = point_process.nearest_cell(_centroids(run), cells, PIXEL + MARGIN, "ellipse_id")
    return _rounded(point_process.zones(cells, points, 1.0, 1.0))


@query(sql(_POINTS, "SELECT cell_id, round((rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2) / count(*) OVER (), 6) AS concentration_rank FROM (SELECT cell_id, round(mean_tmax, 10) AS v FROM cls)"))
def concentration_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the cells by intensity, ties averaged; mean tmax stands for it here."""
    cells = _cells(run_over(spark, sf_dir)).withColumn("mean_intensity_per_km2", F.col("mean_tmax"))
    return _rounded(point_process.concentration_ranks(cells).select("cell_id", "concentration_rank"))


@query()
def intensity_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of the log-linear intensity of centroids over the window."""
    run = run_over(spark, sf_dir)
    covariates = ("lon", "lat", "mean_tmax", "std_tmax")
    cells, points = _cells(run), _centroids(run)
    values = cells.select(F.col("cell_id").alias("nearest_cell_id"), "mean_tmax", "std_tmax")
    pixels = point_process.window(cells, points, 4.5, 4.5, PIXEL, MARGIN).join(values, "nearest_cell_id")
    held = point_process.nearest_cell(points, cells, PIXEL + MARGIN, "ellipse_id").join(values, "nearest_cell_id")
    got = point_process.trend(written(point_process.quadrature(pixels, held, covariates, PIXEL), "quadrature"), covariates)
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', {v!r}D)" for k, v in got.items()) + " AS t(parameter, value)")


#: The window with each pixel's nearest cell, and what a pixel's area is shared by.
_QUADRATURE = _POINTS + f""",
box AS (SELECT min(x_km) - {PIXEL} AS x0, max(x_km) + {PIXEL} AS x1, min(y_km) - {PIXEL} AS y0, max(y_km) + {PIXEL} AS y1 FROM cls),
px AS (SELECT x0 + {PIXEL / 2} + {PIXEL} * unnest(range(CAST(ceil((x1 - x0 - {PIXEL / 2}) / {PIXEL}) AS BIGINT))) AS x_km FROM box),
py AS (SELECT y0 + {PIXEL / 2} + {PIXEL} * unnest(range(CAST(ceil((y1 - y0 - {PIXEL / 2}) / {PIXEL}) AS BIGINT))) AS y_km FROM box),
pixels_ AS (SELECT px.x_km, py.y_km, arg_min(c.cell_id, struct_pack(d := round(sqrt((px.x_km - c.x_km) ** 2 + (py.y_km - c.y_km) ** 2), 9), i := c.cell_id)) AS cell_id, min(sqrt((px.x_km - c.x_km) ** 2 + (py.y_km - c.y_km) ** 2)) AS d FROM px CROSS JOIN py CROSS JOIN cls c GROUP BY ALL),
win AS MATERIALIZED (SELECT * FROM pixels_ p WHERE d <= {PIXEL + MARGIN} OR EXISTS (SELECT 1 FROM pts WHERE abs(pts.x_km - p.x_km) < {PIXEL / 2} AND abs(pts.y_km - p.y_km) < {PIXEL / 2})),
tiles AS (SELECT floor(x_km / {PIXEL}) AS i, floor(y_km / {PIXEL}) AS j, count(*) AS m FROM pts GROUP BY ALL),
quad AS MATERIALIZED (SELECT 0 AS n, {PIXEL * PIXEL} / (1 + coalesce(m, 0)) AS w, mean_tmax AS x, std_tmax AS y FROM win JOIN cls USING (cell_id) LEFT JOIN tiles ON i = floor(win.x_km / {PIXEL}) AND j = floor(win.y_km / {PIXEL})
  UNION ALL SELECT 1, {PIXEL * PIXEL} / (1 + m), mean_tmax, std_tmax FROM pts JOIN near1 USING (ellipse_id) JOIN cls ON cls.cell_id = nearest_cell_id JOIN tiles ON i = floor(pts.x_km / {PIXEL}) AND j = floor(pts.y_km / {PIXEL}))"""


def _newton(turns: int = 16) -> str:
    """CTEs of Newton's steps for the weighted Poisson regression on two covariates, centred; fit_ has the coefficients."""
    out = ["mid AS (SELECT avg(x) AS mx, avg(y) AS my FROM quad)", "z AS MATERIALIZED (SELECT n, w, x - mx AS x, y - my AS y FROM quad CROSS JOIN mid)", "b0 AS MATERIALIZED (SELECT ln(sum(n) / sum(w)) AS p, 0.0::DOUBLE AS q, 0.0::DOUBLE AS r FROM z)"]
    for k in range(turns):
        out += [
            f"s{k} AS (SELECT any_value(p) AS p, any_value(q) AS q, any_value(r) AS r, sum(v) AS a, sum(v * x) AS b, sum(v * y) AS c, sum(v * x * x) AS d, sum(v * x * y) AS e, sum(v * y * y) AS f, sum(n - v) AS g, sum((n - v) * x) AS h, sum((n - v) * y) AS i FROM (SELECT z.*, p, q, r, w * exp(p + q * x + r * y) AS v FROM z CROSS JOIN b{k}))",
            f"b{k + 1} AS MATERIALIZED (SELECT p + (g * (d * f - e * e) - b * (h * f - e * i) + c * (h * e - d * i)) / det AS p, q + (a * (h * f - e * i) - g * (b * f - e * c) + c * (b * i - h * c)) / det AS q, r + (a * (d * i - h * e) - b * (b * i - h * c) + g * (b * e - d * c)) / det AS r FROM (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s{k}))",
        ]
    return ", ".join([*out, f"fit_ AS MATERIALIZED (SELECT p - q * mx - r * my AS p, q, r FROM b{turns} CROSS JOIN mid)"])


_TREND = f"{_QUADRATURE}, {_newton()}"
CLIMATE = ("mean_tmax", "std_tmax")


class Process:
    """The point process of one run's centroids on two covariates of their cells, up to its fitted trend."""

    def __init__(self, run: Run, covariates: tuple[str, ...] = CLIMATE):
        self.cells, self.points = _cells(run), _centroids(run)
        values = self.cells.select(F.col("cell_id").alias("nearest_cell_id"), "mean_tmax", "std_tmax")
        self.pixels = written(point_process.window(self.cells, self.points, 4.5, 4.5, PIXEL, MARGIN).join(values, "nearest_cell_id"), "pixels")
        self.held = written(point_process.nearest_cell(self.points, self.cells, PIXEL + MARGIN, "ellipse_id").join(values, "nearest_cell_id"), "held")
        self.covariates = covariates

    @cached_property
    def trend(self) -> dict[str, float]:
        return point_process.trend(written(point_process.quadrature(self.pixels, self.held, self.covariates, PIXEL), "quadrature"), self.covariates)

    @cached_property
    def intensity(self) -> DataFrame:
        return written(point_process.intensities(self.cells, self.trend), "intensity")

    def k(self, intensity: Column, reach: float, n: int) -> DataFrame:
        rows = self.held.withColumn("intensity", intensity)
        return point_process.inhomogeneous_k(rows, point_process.overlaps(self.pixels, PIXEL, reach), PIXEL, reach, n)


@query(sql(_TREND, "SELECT unnest(['(Intercept)', 'mean_tmax', 'std_tmax']) AS parameter, unnest([round(p, 4), round(q, 5), round(r, 5)]) AS value FROM fit_"))
def climate_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-linear intensity on the cells' mean and deviation of tmax; the SQL makes Newton's steps."""
    got = Process(run_over(spark, sf_dir)).trend
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', {round(v, 4 if k == '(Intercept)' else 5)!r}D)" for k, v in got.items()) + " AS t(parameter, value)")


@query(sql(_TREND, "SELECT cell_id, round(ln(lam), 4) AS log_intensity, round(rank() OVER (ORDER BY lam) / count(*) OVER (), 6) AS concentration_rank FROM (SELECT cell_id, exp(p + q * mean_tmax + r * std_tmax) AS lam FROM cls CROSS JOIN fit_)"))
def intensity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted intensity at the cells, and the share of cells that are no more intense."""
    found = Process(run_over(spark, sf_dir)).intensity
    return found.select("cell_id", F.round(F.log("mean_intensity_per_km2"), 4).alias("log_intensity"), r("concentration_rank"))


@query(sql(_TREND, """, cum AS (SELECT cell_id, (sum(cos(radians(lat))) OVER (ORDER BY lam DESC, cell_id) - cos(radians(lat))) / sum(cos(radians(lat))) OVER () AS before FROM (SELECT *, p + q * mean_tmax + r * std_tmax AS lam FROM cls CROSS JOIN fit_)),
own AS (SELECT before, ellipse_id IN (SELECT largest_ellipse_id FROM evd) AS daily, ellipse_id IN (SELECT largest_ellipse_id FROM ce) AS event FROM near1 JOIN cum ON cell_id = nearest_cell_id),
grp AS (SELECT before, unnest(['all_centroids', 'daily_largest', 'event_largest']) AS "group", unnest([true, daily, event]) AS mine FROM own)
SELECT f AS zone_area_fraction, "group", count(*) FILTER (mine) AS n_centroids_in_group, count(*) FILTER (mine AND before < f) AS n_in_zone, round(100 * count(*) FILTER (mine AND before < f) / nullif(count(*) FILTER (mine), 0), 6) AS percent_in_zone FROM grp CROSS JOIN (SELECT unnest([0.2, 0.5])::DOUBLE AS f) GROUP BY ALL""".lstrip()))
def intensity_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How centroids gather where the fitted intensity is largest."""
    process = Process(run_over(spark, sf_dir))
    return _rounded(point_process.zones(process.intensity, process.held, 1.0, 1.0))


#: Distance and number of steps of the K function's query, and the intensity that weighs its pairs.
K_REACH, K_STEPS, K_WEIGHTS = 200.0, 16, (-9.0, 0.05)


@query(sql(_QUADRATURE, f""", idx AS (SELECT CAST(round((x_km - min(x_km) OVER ()) / {PIXEL}) AS BIGINT) AS px, CAST(round((y_km - min(y_km) OVER ()) / {PIXEL}) AS BIGINT) AS py FROM win),
shift AS MATERIALIZED (SELECT b.px - a.px AS i, b.py - a.py AS j, count(*) * {PIXEL * PIXEL} AS area FROM idx a JOIN idx b ON abs(b.px - a.px) <= {int(K_REACH / PIXEL) + 1} AND abs(b.py - a.py) <= {int(K_REACH / PIXEL) + 1} GROUP BY ALL),
weighed AS (SELECT ellipse_id, p.x_km, p.y_km, exp({K_WEIGHTS[0]} + {K_WEIGHTS[1]} * mean_tmax) AS lam FROM pts p JOIN near1 USING (ellipse_id) JOIN cls ON cls.cell_id = nearest_cell_id),
both_ AS (SELECT sqrt((b.x_km - a.x_km) ** 2 + (b.y_km - a.y_km) ** 2) AS d, CAST(round((b.x_km - a.x_km) / {PIXEL}) AS BIGINT) AS i, CAST(round((b.y_km - a.y_km) / {PIXEL}) AS BIGINT) AS j, a.lam * b.lam AS ll FROM weighed a JOIN weighed b ON a.ellipse_id <> b.ellipse_id),
parts_ AS (SELECT d, 1 / (ll * area) AS w FROM both_ JOIN shift USING (i, j) WHERE d <= {K_REACH})
SELECT CAST(k * {K_REACH / K_STEPS} AS DOUBLE) AS r, round((SELECT coalesce(sum(w), 0) FROM parts_ WHERE d <= k * {K_REACH / K_STEPS}), 2) AS k FROM (SELECT unnest(range(1, {K_STEPS + 1})) AS k)""".lstrip()))
def inhomogeneous_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K function of the centroids, pairs weighed by an intensity that is given."""
    found = Process(run_over(spark, sf_dir)).k(F.exp(K_WEIGHTS[0] + K_WEIGHTS[1] * F.col("mean_tmax")), K_REACH, K_STEPS)
    return found.select("r", F.round("k", 2).alias("k"))


@query()
def intensity_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend and covariance of the centroids' process: variance and scale by minimum contrast of K."""
    process = Process(run_over(spark, sf_dir))
    near = process.held.join(process.intensity.select(F.col("cell_id").alias("nearest_cell_id"), F.col("mean_intensity_per_km2").alias("intensity")), "nearest_cell_id")
    extent = process.pixels.agg((F.max("x_km") - F.min("x_km")).alias("x"), (F.max("y_km") - F.min("y_km")).alias("y")).first()
    reach = max(4 * PIXEL, min(extent.x, extent.y) / 4)
    # one row a distance
    k = point_process.inhomogeneous_k(near, point_process.overlaps(process.pixels, PIXEL, reach), PIXEL, reach).orderBy("r").collect()
    variance, scale, contrast, converged = point_process.minimum_contrast(np.array([x.r for x in k]), np.array([x.k for x in k]))
    found = process.trend | {"var_sigma2": variance, "scale_km": scale, "mincon_objective": contrast, "mincon_converged": float(converged)}
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', {v!r}D)" for k, v in found.items()) + " AS t(parameter, value)")


@query(sql(_COMPOUND, """, best AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY duration_days DESC, largest_ellipse_area_km2 DESC, start_date) AS place FROM ce),
shown AS (SELECT evd.*, event_type, place, duration_days, [1, 1, 2, 6][event_type] AS n, sum(evd.n_clusters) OVER (PARTITION BY compound_event_id ORDER BY day_in_event ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS held FROM evd JOIN best USING (compound_event_id) WHERE place <= [1, 1, 2, 1][event_type]),
start_ AS (SELECT compound_event_id, arg_min(day_in_event, struct_pack(a := -held, b := day_in_event)) AS s FROM shown WHERE event_type = 4 AND duration_days > 6 AND day_in_event <= duration_days - 5 GROUP BY 1)
SELECT event_type, CAST(place AS INTEGER) AS place, compound_event_id, date FROM shown LEFT JOIN start_ USING (compound_event_id) WHERE day_in_event BETWEEN coalesce(s, 1) AND coalesce(s, 1) + n - 1""".lstrip()))
def representative_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_over(spark, sf_dir)
    return figure_data.representative_days(run.compound, run.event_days)


@query(SQL["representative_days"].replace("SELECT event_type, CAST(place AS INTEGER) AS place, compound_event_id, date FROM shown LEFT JOIN start_ USING (compound_event_id) WHERE",
    "SELECT event_type, CAST(place AS INTEGER) AS place, compound_event_id, m.date, cell_id, lon, lat, cluster_id, CAST(dbscan_label < 0 AS INTEGER) AS is_noise FROM shown LEFT JOIN start_ USING (compound_event_id) JOIN members m ON m.date = shown.date WHERE"))
def snapshot_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells in a heatwave on the days that represent each type, by cluster."""
    run = run_over(spark, sf_dir)
    return figure_data.snapshots(figure_data.representative_days(run.compound, run.event_days), clustering.clustered(run.labels)[1])


@query(sql(_COMPOUND, """, each AS (SELECT event_type, unnest(['mean_area_km2', 'mean_axis_ratio']) AS measure, unnest([round(mean_area_km2, 6), round(mean_axis_ratio, 6)]) AS v FROM ce)
SELECT event_type, measure, v, round(cume_dist() OVER (PARTITION BY event_type, measure ORDER BY v), 6) AS ecdf FROM each QUALIFY row_number() OVER (PARTITION BY event_type, measure, v) = 1""".lstrip()))
def event_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributions of events' mean areas and axis ratios, by type."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.round(c, 6).alias("v")) for c in ("mean_area_km2", "mean_axis_ratio")]))
    rows = run_over(spark, sf_dir).compound.select("event_type", each.alias("m")).select(F.concat_ws("|", "event_type", "m.measure").alias("key"), "m.v")
    return _by_measure(figure_data.ecdf(written(rows, "measured"), "key", "v"))


@query(sql(_ELLIPSES, """, fine AS (SELECT x / 4.0 AS lon, y / 4.0 AS lat FROM range(0, 37) a(x) CROSS JOIN range(0, 37) b(y)),
hit AS (SELECT lon, lat, (lon - wx) * 111.320 * cos(radians(wy)) AS dx, (lat - wy) * 110.574 AS dy, cos(radians(o)) AS e, sin(radians(o)) AS n, major / 2 AS a, minor / 2 AS b FROM fine CROSS JOIN ell)
SELECT lon::DOUBLE AS lon, lat::DOUBLE AS lat, count(*) FILTER (pow((dx * e + dy * n) / a, 2) + pow((dy * e - dx * n) / b, 2) <= 1 + 1e-12) AS n_ellipses FROM hit GROUP BY ALL""".lstrip()))
def ellipse_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ellipses cover each point of a grid four times as fine as the lattice."""
    quarter = lambda c: (F.col(c) / 4.0).cast("double")
    points = spark.range(37).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(36)))).select(quarter("id").alias("lon"), quarter("j").alias("lat"))
    return figure_data.footprints(run_over(spark, sf_dir).ellipses, points, 0.25)


_TYPED = _COMPOUND + """,
typed AS (SELECT event_type, az, axis_ratio, area_km2 FROM ell JOIN evd USING (date) JOIN ce USING (compound_event_id))"""


def _typed(run: Run) -> DataFrame:
    return run.ellipses.join(run.event_days.select("date", "compound_event_id"), "date").join(run.compound.select("compound_event_id", "event_type"), "compound_event_id")


@query(sql(_TYPED, "SELECT event_type, CAST(CASE WHEN axis_ratio = 1 THEN 19 ELSE floor(axis_ratio / 0.05) END AS INTEGER) AS bin, count(*) AS n FROM typed GROUP BY ALL"))
def geometry_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis ratios of ellipses in 20 bins, by type."""
    return figure_data.histogram(_typed(run_over(spark, sf_dir)), "axis_ratio", 0.0, 1.0, 20, "event_type")


@query(sql(_TYPED, "SELECT event_type, az AS azimuth, cume_dist() OVER (PARTITION BY event_type ORDER BY az) AS ecdf FROM (SELECT event_type, round(az, 6) AS az FROM typed) QUALIFY row_number() OVER (PARTITION BY event_type, az) = 1"))
def geometry_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution of azimuths, by type."""
    rows = _typed(run_over(spark, sf_dir)).withColumn("azimuth", F.round("azimuth_north_cw_deg", 6))
    return figure_data.ecdf(rows, "event_type", "azimuth")


@query(sql(_AREAS, "SELECT dataset, round(v, 6) AS area_km2, round(1 - (row_number() OVER (PARTITION BY dataset ORDER BY round(v, 6)) - 1) / count(*) OVER (PARTITION BY dataset), 6) AS ccdf FROM areas"))
def area_ccdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(figure_data.ccdf(_samples(run_over(spark, sf_dir)).withColumn("area_km2", F.round("area_km2", 6))))


_BOXED = _TYPED + """,
measured AS (SELECT event_type, unnest(['area_million_km2', 'axis_ratio', 'azimuth']) AS measure, unnest([round(area_km2 / 1e6, 9), round(axis_ratio, 9), round(az, 9)]) AS v FROM typed),
listed AS (SELECT event_type, measure, list_sort(list(v)) AS x, count(*) AS n, (floor((count(*) + 1) / 2) + 1) / 2 AS d FROM measured GROUP BY ALL),
hinged AS (SELECT *, (x[CAST(floor(d) AS INTEGER)] + x[CAST(ceil(d) AS INTEGER)]) / 2 AS lo, (x[CAST(floor((n + 1) / 2) AS INTEGER)] + x[CAST(ceil((n + 1) / 2) AS INTEGER)]) / 2 AS mid, (x[CAST(floor(n + 1 - d) AS INTEGER)] + x[CAST(ceil(n + 1 - d) AS INTEGER)]) / 2 AS hi FROM listed),
boxed AS (SELECT *, list_filter(x, lambda v: v >= lo - 1.5 * (hi - lo) AND v <= hi + 1.5 * (hi - lo)) AS inside FROM hinged)"""


def _measured(run: Run) -> DataFrame:
    """(key, v): the three measures of each ellipse, keyed by type and measure."""
    values = {"area_million_km2": F.col("area_km2") / 1e6, "axis_ratio": F.col("axis_ratio"), "azimuth": F.col("azimuth_north_cw_deg")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.round(v, 9).alias("v")) for k, v in values.items()]))
    return written(_typed(run).select("event_type", each.alias("m")).select(F.concat_ws("|", "event_type", "m.measure").alias("key"), "m.v"), "measured")


def _by_measure(df: DataFrame) -> DataFrame:
    parts = F.split("key", r"\|")
    return _rounded(df.select(parts[0].cast("int").alias("event_type"), parts[1].alias("measure"), *[c for c in df.columns if c != "key"]))


@query(sql(_BOXED, "SELECT event_type, measure, n, round(list_min(inside), 6) AS low_whisker, round(lo, 6) AS lower_hinge, round(mid, 6) AS median, round(hi, 6) AS upper_hinge, round(list_max(inside), 6) AS high_whisker, n - len(inside) AS n_outliers FROM boxed"))
def geometry_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tukey's boxes of areas, axis ratios and azimuths, by type."""
    return _by_measure(figure_data.boxes(_measured(run_over(spark, sf_dir)), "key", "v"))


@query(sql(_BOXED, "SELECT event_type, measure, round(v, 6) AS v FROM (SELECT event_type, measure, unnest(x) AS v, lo, hi FROM boxed) WHERE v < lo - 1.5 * (hi - lo) OR v > hi + 1.5 * (hi - lo)"))
def geometry_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values beyond the boxes' whiskers."""
    return _by_measure(figure_data.outliers(_measured(run_over(spark, sf_dir)), "key", "v"))


@query(sql(_TYPED, """, limits AS (SELECT min(round(area_km2, 6)) AS a, max(round(area_km2, 6)) AS b FROM typed)
SELECT event_type, CAST(CASE WHEN round(area_km2, 6) = b THEN 11 ELSE floor((round(area_km2, 6) - a) / ((b - a) / 12)) END AS INTEGER) AS bin, count(*) AS n FROM typed CROSS JOIN limits GROUP BY ALL""".lstrip()))
def area_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of ellipses in 12 bins from the least to the largest, by type."""
    rows = written(_typed(run_over(spark, sf_dir)).select("event_type", F.round("area_km2", 6).alias("area_km2")), "areas")
    span = rows.agg(F.min("area_km2").alias("a"), F.max("area_km2").alias("b")).first()
    if span.a is None:
        return figure_data.histogram(rows, "area_km2", 0.0, 1.0, 12, "event_type")
    low, high = (span.a, span.b) if span.b > span.a else (span.a - 1e5, span.b + 1e5)
    return figure_data.histogram(rows, "area_km2", low, high, 12, "event_type")


@query(sql(_TYPED, "SELECT event_type, CAST(CASE WHEN round(az, 6) = 90 THEN 11 ELSE floor((round(az, 6) + 90) / 15) END AS INTEGER) AS bin, count(*) AS n FROM typed GROUP BY ALL"))
def azimuth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Azimuths of ellipses in 12 bins, by type."""
    rows = _typed(run_over(spark, sf_dir)).withColumn("azimuth", F.round("azimuth_north_cw_deg", 6))
    return figure_data.histogram(rows, "azimuth", -90.0, 90.0, 12, "event_type")


@query(sql(_COMPOUND, f""", places AS (SELECT event_type, (axial + 90) / (180 / 599.0) AS u FROM ce WHERE axial IS NOT NULL),
wide AS (SELECT event_type, stddev_samp(axial) * pow(count(*), -0.2) AS h, count(*) AS n FROM ce WHERE axial IS NOT NULL GROUP BY 1),
bins AS (SELECT event_type, k, sum(w) AS w FROM (SELECT event_type, floor(u) AS k, 1 - (u - floor(u)) AS w FROM places UNION ALL SELECT event_type, floor(u) + 1, u - floor(u) FROM places) GROUP BY ALL)
SELECT event_type, round(-90 + p * (180 / 599.0), 6) AS "at", round(sum(w * exp(-0.5 * pow((p - k) * (180 / 599.0) / h, 2)) / (h * n * sqrt(2 * pi()))), 6) AS density FROM bins JOIN wide USING (event_type) CROSS JOIN range(600) r(p) WHERE h > 0 GROUP BY event_type, p""".lstrip()))
def orientation_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel densities of events' mean azimuths, by type."""
    return _rounded(figure_data.density(run_over(spark, sf_dir).compound, "event_type", "axial_mean_azimuth_deg", -90.0, 90.0))


@query(sql(_ELLIPSES, """, turned AS (SELECT cluster_id, CAST(k AS INTEGER) AS point, major / 2 * cos(2 * pi() * k / 239) AS u, minor / 2 * sin(2 * pi() * k / 239) AS v, cos(radians(o)) AS e, sin(radians(o)) AS n, wx, wy FROM ell CROSS JOIN range(240) r(k))
SELECT cluster_id AS ellipse_id, point, round(wx + (u * e - v * n) / (111.320 * cos(radians(wy))), 6) AS lon, round(wy + (u * n + v * e) / 110.574, 6) AS lat FROM turned""".lstrip()))
def ellipse_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """240 points around each ellipse, in degrees."""
    return _rounded(figure_data.outlines(run_over(spark, sf_dir).ellipses))


@query(sql(_ELLIPSES, """, half AS (SELECT cluster_id, unnest(['major', 'minor']) AS axis, unnest([major / 2 * cos(radians(o)), -minor / 2 * sin(radians(o))]) AS x, unnest([major / 2 * sin(radians(o)), minor / 2 * cos(radians(o))]) AS y, wx, wy FROM ell)
SELECT cluster_id AS ellipse_id, axis, round(wx - x / (111.320 * cos(radians(wy))), 6) AS lon_from, round(wy - y / 110.574, 6) AS lat_from, round(wx + x / (111.320 * cos(radians(wy))), 6) AS lon_to, round(wy + y / 110.574, 6) AS lat_to FROM half""".lstrip()))
def ellipse_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each ellipse's axes end, in degrees."""
    return _rounded(figure_data.axes(run_over(spark, sf_dir).ellipses))


@query(sql(_ELLIPSES, """, fine AS (SELECT x / 4.0 AS lon, y / 4.0 AS lat FROM range(0, 37) a(x) CROSS JOIN range(0, 37) b(y)),
hit AS (SELECT lon, lat, (lon - wx) * 111.320 * cos(radians(wy)) AS dx, (lat - wy) * 110.574 AS dy, cos(radians(o)) AS e, sin(radians(o)) AS n, major / 2 AS a, minor / 2 AS b FROM fine CROSS JOIN ell),
counted AS MATERIALIZED (SELECT lon::DOUBLE AS lon, lat::DOUBLE AS lat, count(*) FILTER (pow((dx * e + dy * n) / a, 2) + pow((dy * e - dx * n) / b, 2) <= 1 + 1e-12) AS n_ellipses FROM hit GROUP BY ALL),
ends AS (SELECT list_sort(list_distinct(list_concat([0.0::DOUBLE], quantile_cont(n_ellipses::DOUBLE, [0.2, 0.4, 0.6, 0.8, 0.9, 0.95, 0.98, 1.0])))) AS b FROM counted)
SELECT lon, lat, n_ellipses, CAST(greatest(0, least(len(b) - 2, len(list_filter(b, lambda x: x <= n_ellipses)) - 1)) AS INTEGER) AS class FROM counted CROSS JOIN ends""".lstrip()))
def footprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The footprints in classes that end at their quantiles."""
    quarter = lambda c: (F.col(c) / 4.0).cast("double")
    points = spark.range(37).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(36)))).select(quarter("id").alias("lon"), quarter("j").alias("lat"))
    counts = written(figure_data.footprints(run_over(spark, sf_dir).ellipses, points, 0.25), "footprints")
    return figure_data.classed(counts, "n_ellipses", figure_data.quantile_breaks(counts, "n_ellipses"))


@query(sql(_POINTS, "SELECT cell_id, CAST(least(9, len(list_filter(range(1, 10), lambda k: k / 10 <= x))) AS INTEGER) AS rank_class FROM (SELECT cell_id, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2) / count(*) OVER () AS x FROM (SELECT cell_id, round(mean_tmax, 10) AS v FROM cls))"))
def rank_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenths of the cells' ranks by mean tmax."""
    cells = _cells(run_over(spark, sf_dir)).withColumn("mean_intensity_per_km2", F.col("mean_tmax"))
    return figure_data.rank_classes(point_process.concentration_ranks(cells)).select("cell_id", "rank_class")


@query(sql(_SCAN, """, best AS (SELECT dataset, arg_min(struct_pack(x := xmin, n := n_tail, a := alpha), struct_pack(d := d, x := xmin)) AS b FROM scan GROUP BY 1),
tops AS (SELECT dataset, count(*) AS n, max(round(v, 6)) AS top FROM areas GROUP BY 1),
curve AS (SELECT dataset, CAST(k AS INTEGER) AS point, exp(ln(b.x) + (ln(top) - ln(b.x)) * k / 199) AS x, b, n FROM best JOIN tops USING (dataset) CROSS JOIN range(200) r(k))
SELECT dataset, point, round(x, 3) AS area_km2, round(b.n / n * pow(x / b.x, 1 - b.a), 6) AS ccdf FROM curve""".lstrip()))
def power_law_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted tails as curves of 200 points."""
    areas = written(_samples(run_over(spark, sf_dir)).withColumn("area_km2", F.round("area_km2", 6)), "areas")
    curves = figure_data.tail_curves(written(power_law.fitted(areas), "fits"), areas)
    return curves.select("dataset", "point", F.round("area_km2", 3).alias("area_km2"), r("ccdf"))


@query(sql(_COMPOUND, """, top_member AS (SELECT cluster_id, arg_min(struct_pack(cell_id := cell_id, local_event_id := local_event_id), struct_pack(a := -tmax_c, b := cell_id)) AS m, max(tmax_c) AS hottest FROM members WHERE cluster_id IS NOT NULL GROUP BY 1)
SELECT ce.compound_event_id, ce.start_date, ce.end_date, event_type, daily_cluster_counts, largest_ellipse_id, largest_ellipse_date, d.n_heatwave_cells, d.n_exceeding_cells, CAST(ell.n_member_cells AS BIGINT) AS n_member_cells, m.cell_id AS hottest_cell_id, round(hottest, 6) AS hottest_tmax_c, round(threshold, 6) AS threshold_tmax_c, m.local_event_id, i.start_date AS local_start_date, i.end_date AS local_end_date
FROM ce JOIN daily d ON d.date = largest_ellipse_date JOIN ell ON ell.cluster_id = largest_ellipse_id JOIN top_member t ON t.cluster_id = largest_ellipse_id JOIN thr ON thr.cell_id = m.cell_id JOIN ids i ON i.local_event_id = m.local_event_id""".lstrip()))
def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each compound event back through the stages: its day, its largest ellipse, that one's hottest cell, the local heatwave there."""
    run = run_over(spark, sf_dir)
    members = clustering.clustered(run.labels)[1].where("cluster_id is not null")
    top = members.groupBy("cluster_id").agg(F.max(F.struct("tmax_c", (-F.col("cell_id")).alias("back"), "cell_id", "local_event_id")).alias("m"))
    local = run.days.where("local_event_id is not null").groupBy("local_event_id").agg(F.min("date").alias("local_start_date"), F.max("date").alias("local_end_date"), F.first("threshold").alias("threshold_tmax_c"))
    daily = run.daily.select(F.col("date").alias("largest_ellipse_date"), "n_heatwave_cells", "n_exceeding_cells")
    out = run.compound.join(daily, "largest_ellipse_date").join(run.ellipses.select(F.col("ellipse_id").alias("largest_ellipse_id"), "n_member_cells"), "largest_ellipse_id")
    out = out.join(top.select(F.col("cluster_id").alias("largest_ellipse_id"), "m.cell_id", "m.tmax_c", "m.local_event_id"), "largest_ellipse_id").join(local, "local_event_id")
    return _rounded(out.select(
        "compound_event_id", "start_date", "end_date", "event_type", "daily_cluster_counts", "largest_ellipse_id", "largest_ellipse_date", "n_heatwave_cells", "n_exceeding_cells", "n_member_cells",
        F.col("cell_id").alias("hottest_cell_id"), F.col("tmax_c").alias("hottest_tmax_c"), "threshold_tmax_c", "local_event_id", "local_start_date", "local_end_date",
    ))


#: Repetitions and seeds of the study's configuration.
BOOTSTRAP_REPS, BOOTSTRAP_SEEDS = 5000, {"daily_maxima": 20261020, "event_maxima": 20261120}


def _bootstraps(spark: SparkSession, sf_dir: str, reps: int) -> tuple[DataFrame, DataFrame]:
    """(samples, refits) of the daily and the event maxima, in order of time.

    A sample has one number per selected day or event; it goes to every task that refits.
    """
    run = run_over(spark, sf_dir)
    areas = _samples(run)
    ordered = {"daily_maxima": run.event_days.where("largest_ellipse_id is not null").orderBy("date"), "event_maxima": run.compound.orderBy("compound_event_id")}
    values = {k: [x.largest_ellipse_area_km2 for x in df.select("largest_ellipse_area_km2").collect()] for k, df in ordered.items()}
    one, two = (power_law.bootstrap(spark, v, reps, BOOTSTRAP_SEEDS[k]).select(F.lit(k).alias("dataset"), "*") for k, v in values.items())
    return areas, one.unionByName(two)


@query()
def power_law_bootstrap(spark: SparkSession, sf_dir: str, reps: int = BOOTSTRAP_REPS) -> DataFrame:
    """Seeded refits of the daily and the event maxima."""
    return _bootstraps(spark, sf_dir, reps)[1]


@query()
def power_law_summary(spark: SparkSession, sf_dir: str, reps: int = BOOTSTRAP_REPS) -> DataFrame:
    """The fits with p, its bounds and error, and the quantiles of alpha by the refits."""
    areas, draws = _bootstraps(spark, sf_dir, reps)
    seeds = F.create_map(*[F.lit(x) for kv in BOOTSTRAP_SEEDS.items() for x in kv])
    return power_law.summary(written(draws, "refits"), power_law.fitted(written(areas, "areas"))).withColumn("seed", seeds[F.col("dataset")])


#: North, west, south and east of the area that the planned requests are for.
AREA = (50, -130, 25, -58)


@query("""WITH RECURSIVE p AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders),
m AS (SELECT CAST(unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS DATE) AS m, a, b FROM p),
r AS (SELECT CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, greatest(m, a) AS first, least(last_day(m), b) AS last FROM m WHERE month(m) BETWEEN 4 AND 9),
d AS (SELECT *, printf('%02d', month) AS mm, array_to_string(list_transform(generate_series(day(first), day(last)), lambda k: printf('%02d', k)), ',') AS days FROM r)
SELECT year, month, first, last, mm AS months, days, 'era5_daily_tmax_N50_W-130_S25_E-58_' || first || '_' || last || '.nc' AS file_name,
'derived-era5-single-levels-daily-statistics|reanalysis|2m_temperature|daily_maximum|utc+00:00|1_hourly|area=50,-130,25,-58|year=' || year || '|month=' || mm || '|day=' || days AS key FROM d""")
def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that would fetch the warm seasons of the orders' period, month by month."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    period = orders.agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    out = requests.named(requests.plan(period, SEASON), AREA)
    return out.select("year", "month", "first", "last", F.array_join("months", ",").alias("months"), F.array_join("days", ",").alias("days"), "file_name", "key")


@query("""WITH RECURSIVE p AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders),
m AS (SELECT CAST(unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS DATE) AS m, a, b FROM p),
r AS (SELECT CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, greatest(m, a) AS first, least(last_day(m), b) AS last FROM m WHERE month(m) BETWEEN 4 AND 9),
y AS (SELECT year, min(first) AS first, max(last) AS last, string_agg(printf('%02d', month), '-' ORDER BY month) AS mm, CAST(sum(day(last_day(first))) AS INTEGER) AS n_dates FROM r GROUP BY 1)
SELECT year, first, last, replace(mm, '-', ',') AS months, n_dates, 'era5_daily_tmax_N50_W-130_S25_E-58_' || year || '_months' || mm || '.nc' AS file_name FROM y""")
def request_plan_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by year: whole months, and how many days those have."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    period = orders.agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    out = requests.named(requests.plan(period, SEASON, "year"), AREA)
    whole = F.when(F.size("months") > 1, F.col("file_name")).otherwise(F.concat(F.lit("era5_daily_tmax_N50_W-130_S25_E-58_"), "year", F.lit("_months"), F.array_join("months", "-"), F.lit(".nc")))
    return out.select("year", "first", "last", F.array_join("months", ",").alias("months"), F.size("dates").alias("n_dates"), whole.alias("file_name"))
