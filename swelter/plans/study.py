"""A whole study: grid, five stages, models, and the tables they are published as."""

from __future__ import annotations

import datetime as dt
import glob
import os
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swelter.operators import clustering, ellipses, events, figure_data, heatwaves, point_process, power_law, regional
from swelter.plans.config import as_date, as_yaml, read_config
from swelter.shared import delete, owned, written
from swelter.sinks.publish import publish
from swelter.sources import grid, netcdf, requests

#: All tables and texts that a study may publish.
PARTIAL = ("heatwave_events", "cell_thresholds", "daily_extent", "regional_days", "regional_day_cells", "clusters", "cluster_cells", "daily_settings", "sequences")
WHOLE = (*PARTIAL, "ellipses", "compound_events", "event_days", "event_type_summary", "annual_counts", "annual_duration", "duration_trends", "power_law_fits", "representative_days")
MODELS = ("intensity_parameters", "intensity", "centroids", "centroid_concentration")
REPORT = "README.txt"
#: What the tables hold, for the report.
DESCRIPTIONS = {
    "heatwave_events": "every local heatwave: cell, first and last day, exceeding and bridged days, peak",
    "cell_thresholds": "every cell: threshold, number of heatwaves and their days",
    "daily_extent": "every date: cells that exceed and cells in a heatwave",
    "regional_days": "the dates that were selected, with their shares",
    "regional_day_cells": "the cells in a heatwave on selected dates",
    "clusters": "every cluster: date, number within the day, members, core cells, settings",
    "cluster_cells": "every cell of a selected date: its cluster, or noise",
    "daily_settings": "the settings found for each selected date and those of its sequence",
    "sequences": "runs of consecutive selected dates and their pooled settings",
    "ellipses": "every cluster's ellipse: axes, area, orientation, centroids",
    "compound_events": "every compound event: span, type, counts, mean geometry, largest ellipse",
    "event_days": "every day of the compound events and its largest ellipse",
    "event_type_summary": "events, days and ellipses of each type",
    "annual_counts": "events of each type by season year",
    "annual_duration": "mean durations of multi-day events by type and season year",
    "duration_trends": "slopes, tests and verdicts of those",
    "power_law_fits": "cutoffs, exponents and p values of the largest areas of days and of events",
    "representative_days": "the days that show each type",
    "intensity_parameters": "trend and covariance of the centroids' point process",
    "intensity": "every cell: fitted intensity and rank",
    "centroids": "every centroid on the equal-area plane and its nearest cell",
    "centroid_concentration": "how many centroids lie in the most intense parts of the area",
}


@dataclass
class Study:
    """The stages over a grid (date, cell_id, lon, lat, tmax_c), each written once when first asked for."""

    grid: DataFrame
    config: dict
    step: float = 1.0
    notes: list[str] = field(default_factory=list)

    @cached_property
    def days(self) -> DataFrame:
        h = self.config["heatwaves"]
        marked = heatwaves.marked_days(self.grid, h["threshold_percentile"], h["min_duration_days"], h["min_exceeding_days"])
        return heatwaves.with_ids(written(marked, "days"))

    @cached_property
    def daily(self) -> DataFrame:
        return regional.checked(written(regional.daily_extent(self.days, self.config["regional_days"]["percentile"]), "daily"))

    @cached_property
    def cells(self) -> DataFrame:
        return written(regional.selected_cells(self.days, self.daily), "cells")

    @cached_property
    def settings(self) -> DataFrame:
        c = self.config["clustering"]
        counts = clustering.cluster_counts(self.cells, self.step, tuple(map(float, c["eps_values"])), tuple(c["min_samples_values"]))
        return written(clustering.pooled(clustering.daily_settings(counts, self.cells)), "settings")

    @cached_property
    def labels(self) -> DataFrame:
        return written(clustering.labelled(self.cells, self.settings, self.step, int(max(self.config["clustering"]["eps_values"]))), "labels")

    @cached_property
    def daily_clusters(self) -> DataFrame:
        return self.labels.groupBy("date").agg((F.max("dbscan_label") + 1).alias("n_clusters"))

    @cached_property
    def ellipses(self) -> DataFrame:
        members = ellipses.checked(clustering.clustered(self.labels)[1], self.grid)
        return written(ellipses.fitted(members, self.config["ellipses"]["scale_factor"]), "ellipses")

    @cached_property
    def event_days(self) -> DataFrame:
        return written(events.event_days(self.daily_clusters, self.ellipses), "event-days")

    @cached_property
    def compound(self) -> DataFrame:
        return written(events.classified(self.event_days, self.ellipses, self.settings), "events")

    @cached_property
    def chosen(self) -> dict[int, list[dt.date]]:
        """The days that the settings name to represent a type."""
        named = {int(k[-1]): v if isinstance(v, list) else [v] for k, v in self.config["figures"]["representative_events"].items() if v is not None}
        return {k: [as_date(d) for d in v] for k, v in named.items()}

    def partial_tables(self) -> dict[str, DataFrame]:
        clusters, members = clustering.clustered(self.labels)
        daily = self.settings.join(self.daily_clusters, "date")
        out = (
            heatwaves.catalogue(self.days), heatwaves.cell_summary(self.days), self.daily, self.daily.where("selected = 1"), self.cells.drop("tmax_c"), clusters, members, daily,
            self.settings.groupBy("sequence_start_date", "sequence_end_date", "sequence_days", "sequence_eps", "sequence_min_samples").agg(F.sum("n_heatwave_cells").alias("n_heatwave_cells")),
        )
        return dict(zip(PARTIAL, out))

    def tables(self) -> dict[str, DataFrame]:
        start = events.season_start(tuple(self.config["period"]["warm_season_months"]))
        shown = figure_data.chosen_days(self.compound, self.event_days, self.chosen)  # refused before models are fitted
        series = written(events.annual_duration(self.compound, start), "series")
        named = self.event_days.select("date", "compound_event_id").join(self.compound.select("compound_event_id", "event_type"), "compound_event_id")
        out = (
            self.ellipses.join(named, "date"), self.compound, self.event_days, events.type_summary(self.compound), events.annual_counts(self.compound, self.grid.select("date").distinct(), start),
            series, events.duration_trends(series), self.power_law(), shown,
        )
        return self.partial_tables() | dict(zip(WHOLE[len(PARTIAL) :], out))

    def power_law(self) -> DataFrame:
        p, spark = self.config["power_law"], self.grid.sparkSession
        area = F.col("largest_ellipse_area_km2").alias("area_km2")
        parts = {"daily_maxima": (self.event_days.where("largest_ellipse_id is not null").orderBy("date"), p["seed_daily_maxima"]), "event_maxima": (self.compound.orderBy("compound_event_id"), p["seed_event_maxima"])}
        draws, areas = [], []
        for name, (df, seed) in parts.items():
            # one number per selected day or event, in order of time
            values = [r.area_km2 for r in df.select(area).collect()]
            draws.append(power_law.bootstrap(spark, values, p["bootstrap_repetitions"], seed).select(F.lit(name).alias("dataset"), "*"))
            areas.append(df.select(F.lit(name).alias("dataset"), area))
        fits = power_law.fitted(written(areas[0].unionByName(areas[1]), "areas"))
        return written(power_law.summary(written(draws[0].unionByName(draws[1]), "refits"), fits), "power-law")

    def intensity(self) -> dict[str, DataFrame]:
        """The trend of the centroids' intensity over the window, at the cells, and its zones."""
        c, spark = self.config["lgcp"], self.grid.sparkSession
        size, reach = c["raster_km"], c["raster_km"] + c["window_margin_km"]
        square = F.avg(F.col("tmax_c") * F.col("tmax_c")) - F.avg("tmax_c") * F.avg("tmax_c")
        cells = self.grid.groupBy("cell_id").agg(F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.avg("tmax_c").alias("mean_tmax"), F.sqrt(F.greatest(F.lit(0.0), square)).alias("std_tmax"))
        lon0, lat0 = point_process.centre(cells)
        cells = written(point_process.projected(cells, lon0, lat0), "cells")
        own = lambda df, name: df.select(F.col("largest_ellipse_id").cast("int").alias("ellipse_id"), F.lit(True).alias(name)).where("ellipse_id is not null").distinct()
        at = self.ellipses.select("ellipse_id", "date", F.col("centroid_lon_weighted").alias("lon"), F.col("centroid_lat_weighted").alias("lat"))
        at = at.join(own(self.event_days, "is_daily_largest"), "ellipse_id", "left").join(own(self.compound, "is_event_largest"), "ellipse_id", "left").fillna(False, ["is_daily_largest", "is_event_largest"])
        at = written(point_process.nearest_cell(point_process.projected(at, lon0, lat0), cells, reach, "ellipse_id"), "centroids")
        if at.count() < point_process.LEAST_POINTS:
            raise ValueError(f"the intensity needs {point_process.LEAST_POINTS} ellipses at least")
        if at.where("nearest_cell_id is null").limit(1).count():
            raise ValueError("a centroid lies outside the study window; raise window_margin_km")
        values = cells.select(F.col("cell_id").alias("nearest_cell_id"), "mean_tmax", "std_tmax")
        pixels = point_process.window(cells, at, lon0, lat0, size, c["window_margin_km"]).join(values, "nearest_cell_id")
        points = written(point_process.quadrature(pixels, at.join(values, "nearest_cell_id"), tuple(c["covariates"]), size), "quadrature")
        found = point_process.trend(points, tuple(c["covariates"]))
        ranked = written(point_process.intensities(cells, found), "intensity")
        extent = pixels.agg((F.max("x_km") - F.min("x_km")).alias("x"), (F.max("y_km") - F.min("y_km")).alias("y")).first()
        near = max(4 * size, min(extent.x, extent.y) / 4)
        dense = at.join(ranked.select(F.col("cell_id").alias("nearest_cell_id"), F.col("mean_intensity_per_km2").alias("intensity")), "nearest_cell_id")
        # one row a distance
        k = point_process.inhomogeneous_k(dense, point_process.overlaps(pixels, size, near), size, near).orderBy("r").collect()
        variance, scale, contrast, converged = point_process.minimum_contrast(np.array([x.r for x in k]), np.array([x.k for x in k]))
        found |= {"var_sigma2": variance, "scale_km": scale, "mincon_objective": contrast, "mincon_converged": float(converged)}
        made = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', {v!r}D)" for k, v in found.items()) + " AS t(parameter, value)")
        return dict(zip(MODELS, (made, ranked, at, point_process.zones(ranked, at, self.step, self.step))))


def read_input(spark: SparkSession, config: dict, backend: requests.Backend | None = None) -> DataFrame:
    """The grid that the settings name; a folder stands for its .nc files in order of name.

    source: cds asks the backend for what its cache lacks, and keeps the grid in processed_file.
    """
    i, p = config["input"], config["period"]
    if i["source"] == "cds":
        if backend is None:
            raise ValueError("downloads need a backend that talks to the data service")
        own, months, days = i["cds"], p["warm_season_months"], (p["start_date"], p["end_date"])
        wanted = requests.listed(requests.plan(spark.createDataFrame([days], "start date, end date"), months, own["request_period"]), own["area"])
        if not wanted:
            raise ValueError("no day of the warm season lies in the period")
        files = requests.Cache(own["cache_directory"]).complete(wanted, backend)
        out = netcdf.read_era5(spark, files, months=months, start=days[0].isoformat(), end=days[1].isoformat(), cell_size=i["era5_cell_size_deg"])
        netcdf.write_tmax(out, own["processed_file"], overwrite=True)
        return out
    files = [i["file"]] if isinstance(i["file"], str) else i["file"]
    paths = [f for x in files for f in (sorted(glob.glob(os.path.join(x, "*.[nN][cC]"))) if os.path.isdir(x) else [x])]
    if not paths:
        raise ValueError(f"there are no .nc files in {files[0]}")
    kind = i["format"]
    if kind == "auto":
        kind = "era5" if {"t2m", "2m_temperature"} & set(netcdf.header(paths[0]).variables) else "daily_tmax"
    months, start, end = p["warm_season_months"], *(d and d.isoformat() for d in (p["start_date"], p["end_date"]))
    if kind == "era5":
        return netcdf.read_era5(spark, paths, i["variable"], i["longitude"], i["latitude"], i["time"], i["units"], months, start, end, i["era5_cell_size_deg"])
    if len(paths) > 1:
        raise ValueError("daily maxima come in one file")
    return netcdf.read_tmax(spark, paths[0], i["variable"], i["longitude"], i["latitude"], i["time"], i["units"], months, start, end)


def report(study: Study, tables: dict[str, DataFrame], notes: list[str], started: dt.datetime) -> str:
    """The text beside the tables: input, settings, counts, models, tables, warnings and every setting."""
    c, degrees = study.config, lambda x, signs: f"{abs(x):g} {signs[x < 0]}"
    g = study.grid.agg(F.count_distinct("cell_id").alias("cells"), F.count_distinct("date").alias("dates"), *[f(x).alias(f"{n}_{x}") for x in ("lon", "lat", "date") for f, n in ((F.min, "first"), (F.max, "last"))]).first()
    h, area = c["heatwaves"], f"{degrees(g.first_lon, 'EW')} to {degrees(g.last_lon, 'EW')}, {degrees(g.first_lat, 'NS')} to {degrees(g.last_lat, 'NS')}"
    lines = ["Compound heatwave study", f"Started {started:%Y-%m-%d %H:%M:%S}, took {(dt.datetime.now() - started).total_seconds():.0f} seconds."]
    lines += ["", "INPUT", f"  {g.cells:,} cells, a step of {study.step:g} degrees, {area}", f"  {g.dates:,} dates from {g.first_date} to {g.last_date}, months {' '.join(map(str, c['period']['warm_season_months']))}"]
    lines += [
        "", "MAIN SETTINGS",
        f"  Local heatwaves: {h['min_duration_days']} days or more on end, {h['min_exceeding_days']} of them at or above the cell's percentile {h['threshold_percentile']:g}",
        f"  Regional days: more cells than percentile {c['regional_days']['percentile']:g} of the daily counts",
        f"  Clusters: radius {', '.join(map(str, c['clustering']['eps_values']))}; members {', '.join(map(str, c['clustering']['min_samples_values']))}",
        f"  Ellipses: scale {c['ellipses']['scale_factor']:g}; refits of the power law: {c['power_law']['bootstrap_repetitions']:,}",
    ]
    if study.chosen:
        lines.append("  Days that were chosen: " + "; ".join(f"type {k}: {', '.join(map(str, v))}" for k, v in sorted(study.chosen.items())))
    counts = {name: df.count() for name, df in tables.items()}
    lines += ["", "RESULTS", f"  Local heatwaves: {counts['heatwave_events']:,}", f"  Selected days: {counts['regional_days']:,}", f"  Clusters: {counts['clusters']:,}"]
    if "compound_events" in tables:
        kinds = {r.event_type: r["count"] for r in tables["compound_events"].groupBy("event_type").count().collect()}
        lines.append(f"  Compound events: {counts['compound_events']:,}; " + ", ".join(f"{kinds.get(k, 0)} of type {k}" for k in events.TYPES))
        lines += ["", "MODELS"]
        for r in sorted(tables["power_law_fits"].collect(), key=lambda r: r.dataset):
            p = "undefined" if r.p_value is None else f"{r.p_value:.3f}"
            lines.append(f"  {r.dataset}: alpha {r.alpha:.3f} above {r.xmin_km2:,.0f} km2, {r.n_tail} of {r.n}, p {p}" if r.status == "ok" else f"  {r.dataset}: no fit ({r.status})")
        if "intensity_parameters" in tables:
            lines += [f"  Intensity, {r.parameter}: {r.value:.6g}" for r in tables["intensity_parameters"].collect()]
    lines += ["", "TABLES", *[f"  {name}: {n:,} rows; {DESCRIPTIONS[name]}" for name, n in counts.items()], "", "WARNINGS", *(f"  {n}" for n in notes or ["none"])]
    return "\n".join([*lines, "", "SETTINGS (YAML)", *("  " + x for x in as_yaml({k: v for k, v in c.items() if k != "output"}).splitlines())]) + "\n"


def run(spark: SparkSession, config: str | dict | None = None, cells: DataFrame | None = None, backend: requests.Backend | None = None) -> dict[str, DataFrame]:
    """Runs a study and publishes its tables as Parquet in output: directory.

    cells: a grid to use in place of the input file; its period is cut to the settings'.
    backend: what source: cds asks for files.
    If no selected day forms a cluster, the tables up to there are published and an error
    is raised. A model that can't be fitted leaves its tables out and a note in the report.
    """
    started, settings = dt.datetime.now(), read_config(config, cells is None)
    p, out = settings["period"], settings["output"]["directory"]
    folder = out if "://" in out else os.path.abspath(out)
    with owned() as mine:
        try:
            if cells is None:
                cells = read_input(spark, settings, backend)
            else:
                cells = grid.in_period(cells, tuple(p["warm_season_months"]), *(d and d.isoformat() for d in (p["start_date"], p["end_date"])))
            study = Study(written(cells, "grid"), settings)
            lons = sorted(r.lon for r in study.grid.select("lon").distinct().collect())
            study.step = min((b - a for a, b in zip(lons, lons[1:])), default=1.0)
            managed = (*WHOLE, *MODELS, REPORT)
            if not study.daily_clusters.where("n_clusters > 0").limit(1).count():
                tables = study.partial_tables()
                publish(spark, tables, {REPORT: report(study, tables, ["Incomplete: no selected day formed a cluster."], started)}, folder, managed)
                raise ValueError(f"no selected day formed a cluster; the tables up to there are in {out}")
            tables = study.tables()
            try:
                tables |= study.intensity()
            except ValueError as e:
                study.notes.append(f"The intensity could not be fitted: {e}")
            publish(spark, tables, {REPORT: report(study, tables, study.notes, started)}, folder, managed)
        finally:
            delete(spark, mine)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in tables}
