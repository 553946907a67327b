"""Stage 3: density-based clusters of each selected day's cells.

A day's cells are dealt to square tiles of its grid, each with the cells around it that
its own may depend on (twice the radius), so no task gets more than a tile, however large
a day is. As cells stand on a grid and the radius is a few steps, neighbours are looked up
by offsets, once for all settings. A tile's components of core cells that hold cells of
other tiles too are merged with the components that these have there. Numbers go by
clusters' first cells, and search, pooling and numbering are DataFrame operations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from swelter.shared import written

EPS = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0)
MIN_SAMPLES = (4, 5, 6, 7, 8, 9, 10, 11, 12)


def neighbours(lon: np.ndarray, lat: np.ndarray, step: float, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, squared distance) of cells within radius of each other, each with itself too.

    On whole grid steps from the day's least lon and lat, so ties are exact.
    """
    x, y = np.rint((lon - lon.min()) / step).astype(np.int64), np.rint((lat - lat.min()) / step).astype(np.int64)
    reach = int(radius)
    # a number for each place, with room for the offsets at the rows' ends
    wide = int(y.max()) + 2 * reach + 1
    place = (x + reach) * wide + y + reach
    order = np.argsort(place, kind="stable")
    ranked = place[order]
    found = []
    for dx in range(-reach, reach + 1):
        for dy in range(-reach, reach + 1):
            if dx * dx + dy * dy <= radius * radius:
                at = np.minimum(np.searchsorted(ranked, place + dx * wide + dy), len(ranked) - 1)
                i = np.flatnonzero(ranked[at] == place + dx * wide + dy)
                found.append((i, order[at[i]], np.full(len(i), dx * dx + dy * dy)))
    return tuple(np.concatenate(c) for c in zip(*found))


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component; a, b: the links, both ways."""
    root = np.arange(n)
    while True:  # the least of each neighbour's root, then shortcuts to it
        new = root.copy()
        np.minimum.at(new, root[a], root[b])
        np.minimum.at(new, a, root[b])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def core_components(n: int, near: tuple[np.ndarray, np.ndarray, np.ndarray], eps: float, min_samples: int, counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(root of each cell, whether it is core, neighbours within eps, pairs within eps).

    counted: cells all of whose neighbours are there; others are never core.
    """
    i, j, d2 = near
    inside = d2 <= eps * eps
    i, j = i[inside], j[inside]
    n_near = np.bincount(i, minlength=n)
    core = n_near >= min_samples
    if counted is not None:
        core &= counted
    both = core[i] & core[j]
    return components(n, i[both], j[both]), core, n_near, (i, j)


def dbscan(n: int, near: tuple[np.ndarray, np.ndarray, np.ndarray], eps: float, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, neighbours within eps, itself included) of a whole day; cells are in scan order, noise is -1.

    near: neighbours() at eps or more. Clusters are the components of core cells, numbered
    by their first core cell; other cells take the smallest label among the core cells
    they are near.
    """
    root, core, n_near, (i, j) = core_components(n, near, eps, min_samples)
    labels = np.full(n, -1)
    labels[core] = np.searchsorted(np.unique(root[core]), root[core])
    edge = ~core[i] & core[j]
    if edge.any():
        least = np.full(n, n)
        np.minimum.at(least, i[edge], labels[j[edge]])
        labels = np.where(~core & (least < n), least, labels)
    return labels, n_near


#: Cells of a tile's side.
TILE = 256


def tiled(cells: DataFrame, step: float, reach: int, tile: int | None = None) -> DataFrame:
    """cells with their whole steps x, y and each tile (ti, tj) that they belong to or lie within 2 reach of.

    `own` is true in the tile that a cell belongs to.
    """
    tile = tile or TILE
    least = lambda c: cells.agg(F.min(c)).scalar()
    placed = cells.withColumns({"x": F.round((F.col("lon") - least("lon")) / step).cast("long"), "y": F.round((F.col("lat") - least("lat")) / step).cast("long")})
    at = lambda c, by: F.floor((F.col(c) + by) / tile).cast("int")
    around = lambda c: F.explode(F.sequence(at(c, -2 * reach), at(c, 2 * reach)))
    dealt = placed.withColumn("ti", around("x")).withColumn("tj", around("y"))
    return dealt.withColumn("own", (F.col("ti") == at("x", 0)) & (F.col("tj") == at("y", 0)))


class Tile:
    """One tile's cells, its own and those around, in scan order."""

    def __init__(self, cells: pd.DataFrame, reach: int, tile: int):
        self.cells = cells = cells.sort_values(["x", "y"], ignore_index=True)
        self.own = cells["own"].to_numpy()
        x, y = cells["x"].to_numpy() - cells["ti"].iloc[0] * tile, cells["y"].to_numpy() - cells["tj"].iloc[0] * tile
        outside = np.maximum.reduce([-x, x - (tile - 1), -y, y - (tile - 1)])
        self.counted = outside <= reach  # all their neighbours are here
        # what other tiles may know as well: own cells near the edge and others', if there are any
        self.shared = self.counted & (outside > -reach) & ~self.own.all()
        self.near = neighbours(cells["x"].to_numpy(), cells["y"].to_numpy(), 1.0, reach)


def _merged(exchanged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root): components of nodes that hold one place; exchanged: (keys, place, node)."""
    held = exchanged.groupBy(*keys, "place").agg(F.array_sort(F.collect_set("node")).alias("nodes")).where(F.size("nodes") > 1)
    links = held.select(*keys, F.get("nodes", F.lit(0)).alias("a"), F.explode(F.slice("nodes", 2, 16)).alias("b")).distinct()  # a place lies in few tiles
    schema = ", ".join(f"{k} {t}" for k, t in exchanged.dtypes if k in keys)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.r_[rows["a"], rows["b"]].astype(str), return_inverse=True)
        a, b = at[: len(rows)], at[len(rows) :]
        root = components(len(nodes), np.r_[a, b], np.r_[b, a])
        return pd.DataFrame({k: rows[k].iloc[0] for k in keys} | {"node": nodes, "root": nodes[root]})

    # one row for each two components that touch
    return links.groupBy(*keys).applyInPandas(merge, f"{schema}, node string, root string")


def cluster_counts(cells: DataFrame, step: float = 1.0, eps: tuple[float, ...] = EPS, min_samples: tuple[int, ...] = MIN_SAMPLES, tile: int | None = None) -> DataFrame:
    """(date, eps, min_samples, n_clusters) for every day and setting."""
    reach, tile = int(max(eps)), tile or TILE

    names = ["date", "eps", "min_samples", "n", "node", "place"]

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        if not rows["own"].any():
            return pd.DataFrame(columns=names, dtype=object)
        t, out = Tile(rows, reach, tile), []
        date, at = rows["date"].iloc[0], f"{rows['ti'].iloc[0]} {rows['tj'].iloc[0]}"
        places = [f"{x} {y}" for x, y in zip(t.cells["x"], t.cells["y"])] if t.shared.any() else []
        for e in eps:
            for m in min_samples:
                root, core, *_ = core_components(len(t.own), t.near, e, m, t.counted)
                own = np.unique(root[core & t.own])
                touching = np.intersect1d(own, root[core & t.shared])
                # components that no other tile can know of are counted here
                out.append((date, e, m, len(own) - len(touching), None, None))
                if len(touching):
                    out += [(date, e, m, 0, f"{at} {root[k]}", places[k]) for k in np.flatnonzero(core & t.shared & np.isin(root, touching))]
        return pd.DataFrame(out, columns=names, dtype=object)

    local = tiled(cells.select("date", "lon", "lat"), step, reach, tile).groupBy("date", "ti", "tj").applyInPandas(count, "date date, eps double, min_samples int, n int, node string, place string")
    local, keys = written(local, "tiles"), ["date", "eps", "min_samples"]
    inside = local.groupBy(*keys).agg(F.sum("n").alias("inside"))
    told = local.where("node is not null")
    if told.isEmpty():  # no tile has cells beside another's
        return inside.withColumnRenamed("inside", "n_clusters").withColumn("n_clusters", F.col("n_clusters").cast("int"))
    merged = _merged(told.select(*keys, "node", "place"), keys)
    # of components told of, those that weren't merged into another one
    across = told.select(*keys, "node").distinct().join(merged, [*keys, "node"], "left").where("root is null or root = node").groupBy(*keys).agg(F.count("*").alias("across"))
    return inside.join(across, keys, "left").select(*keys, (F.col("inside") + F.coalesce("across", F.lit(0))).cast("int").alias("n_clusters"))


def daily_settings(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per day: the modal cluster counts and the mean settings that give them.

    Zero counts only matter if a day has no other; all of several modal counts stay.
    """
    any_cluster = F.max(F.col("n_clusters")).over(W.partitionBy("date")) > 0
    rows = counts.withColumn("any", any_cluster).where((F.col("n_clusters") > 0) | ~F.col("any")).drop("any")
    often = rows.withColumn("freq", F.count("*").over(W.partitionBy("date", "n_clusters")))
    modal = often.withColumn("most", F.max("freq").over(W.partitionBy("date"))).where("freq = most")
    per_day = modal.groupBy("date").agg(
        F.concat_ws("|", F.transform(F.array_sort(F.collect_set("n_clusters")), lambda n: n.cast("string"))).alias("modal_cluster_counts"),
        F.max("most").alias("modal_frequency"), F.count("*").alias("n_pairs_retained"), F.avg("eps").alias("daily_eps"), F.avg("min_samples").alias("daily_min_samples_mean"),
    )
    per_day = per_day.withColumn("daily_min_samples", F.greatest(F.lit(1), F.floor(F.col("daily_min_samples_mean") + 0.5)).cast("int"))
    return cells.groupBy("date").agg(F.count("*").alias("n_heatwave_cells")).join(per_day, "date")


def with_runs(days: DataFrame) -> DataFrame:
    """days (date, ...) with `run`: the first date of its run of consecutive days."""
    ordered = W.orderBy("date")  # one row per selected day
    start = F.when(F.coalesce(F.datediff("date", F.lag("date").over(ordered)) > 1, F.lit(True)), F.col("date"))
    return days.withColumn("_s", start).withColumn("run", F.last("_s", ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def pooled(settings: DataFrame) -> DataFrame:
    """settings with the largest eps and min_samples of each run of consecutive days."""
    run = W.partitionBy("run")
    return with_runs(settings).withColumns({
        "sequence_eps": F.max("daily_eps").over(run), "sequence_min_samples": F.max("daily_min_samples").over(run), "sequence_end_date": F.max("date").over(run), "sequence_days": F.count("*").over(run).cast("int"),
    }).withColumnRenamed("run", "sequence_start_date")


LABELS = "date date, cell_id int, lat double, lon double, local_event_id int, tmax_c double, dbscan_label int, is_core_cell int, n_cells_within_eps int, eps_applied double, min_samples_applied int"
_LOCAL = LABELS.replace("dbscan_label int", "x long, y long, own boolean, shared boolean, comps array<int>, ti int, tj int")


def labelled(cells: DataFrame, settings: DataFrame, step: float = 1.0, reach: int = int(max(EPS)), tile: int | None = None) -> DataFrame:
    """cells with their final labels; scan order is west to east, then south to north.

    reach: whole steps that no eps exceeds.
    """
    tile = tile or TILE
    names = [c.split()[0] for c in _LOCAL.replace("<", " ").split(", ")]

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        if not rows["own"].any():
            return pd.DataFrame(columns=names, dtype=object)
        t = Tile(rows, reach, tile)
        e, m = rows["eps_applied"].iloc[0], int(rows["min_samples_applied"].iloc[0])
        root, core, n_near, (i, j) = core_components(len(t.own), t.near, e, m, t.counted)
        comps = [[int(r)] if c else [] for r, c in zip(root, core)]
        edge = ~core[i] & core[j] & t.own[i]
        for p, r in np.unique(np.stack([i[edge], root[j[edge]]]), axis=1).T:
            comps[p].append(int(r))
        wanted = np.isin(root, [r for c, own in zip(comps, t.own) if own for r in c])
        shared = core & t.shared & wanted
        out = t.cells.assign(is_core_cell=core.astype(int), n_cells_within_eps=n_near, shared=shared, comps=comps)
        return out[t.own | shared][names]

    applied = settings.select("date", F.col("sequence_eps").alias("eps_applied"), F.col("sequence_min_samples").alias("min_samples_applied"))
    dealt = tiled(cells, step, reach, tile).join(applied, "date")
    local = written(dealt.groupBy("date", "ti", "tj").applyInPandas(label, _LOCAL), "tiles")
    node = lambda comp: F.concat_ws(" ", "ti", "tj", comp)
    cores = local.where("is_core_cell = 1").withColumn("node", node(F.get("comps", F.lit(0))))
    nodes, told = cores.groupBy("date", "node").agg(F.min(F.struct("x", "y")).alias("first")), cores.where("shared")
    if told.isEmpty():  # no tile has cells beside another's
        nodes = nodes.withColumn("root", F.col("node"))
    else:
        merged = _merged(told.select("date", F.concat_ws(" ", "x", "y").alias("place"), "node"), ["date"])
        nodes = nodes.join(merged, ["date", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    firsts = nodes.groupBy("date", "root").agg(F.min("first").alias("first"))
    # one row for each cluster
    numbered = firsts.withColumn("label", F.row_number().over(W.partitionBy("date").orderBy("first")) - 1)
    labels = nodes.join(numbered, ["date", "root"]).select("date", "node", "label")
    own = local.where("own").drop("own", "shared", "x", "y")
    found = own.select("date", "cell_id", F.explode(F.transform("comps", node)).alias("node")).join(labels, ["date", "node"]).groupBy("date", "cell_id").agg(F.min("label").alias("dbscan_label"))
    out = own.join(found, ["date", "cell_id"], "left").withColumn("dbscan_label", F.coalesce("dbscan_label", F.lit(-1)))
    return out.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in LABELS.split(", ")])


def clustered(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, cells): global cluster ids from 1 by day and label; noise has none."""
    found = labels.where("dbscan_label >= 0").groupBy("date", "dbscan_label").agg(
        F.count("*").alias("n_member_cells"), F.sum("is_core_cell").alias("n_core_cells"), F.first("eps_applied").alias("eps_applied"), F.first("min_samples_applied").alias("min_samples_applied"))
    daily = labels.groupBy("date").agg((F.max("dbscan_label") + 1).alias("n_clusters_on_day"), F.count_if(F.col("dbscan_label") < 0).alias("n_noise_cells_on_day"))
    before = daily.select("date", "n_clusters_on_day", "n_noise_cells_on_day", (F.sum("n_clusters_on_day").over(W.orderBy("date")) - F.col("n_clusters_on_day")).alias("before"))
    clusters = found.join(before, "date").withColumn("cluster_id", (F.col("before") + F.col("dbscan_label") + 1).cast("int")).drop("before")
    cells = labels.join(before.select("date", "before"), "date").withColumns({
        "cluster_id": F.when(F.col("dbscan_label") >= 0, F.col("before") + F.col("dbscan_label") + 1).cast("int"), "is_noise": (F.col("dbscan_label") < 0).cast("int"),
    }).drop("before")
    return clusters.withColumn("cluster_number_in_day", F.col("dbscan_label")), cells
