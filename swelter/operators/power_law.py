"""Power-law tails of areas: cutoff by least Kolmogorov-Smirnov distance, seeded bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from swelter.functions.ordered import totals_by_value
from swelter.shared import written


def cutoff_scan(sample: DataFrame, group: str = "dataset", value: str = "area_km2") -> DataFrame:
    """(group, xmin, n_tail, alpha, ks_distance) for each candidate cutoff of each sample.

    Candidates are the distinct values but the largest. All distances are made, so this
    sets every cutoff against its tail; fitted() makes few of them.
    """
    rows = sample.select(group, F.col(value).cast("double").alias("v"))
    cuts = rows.distinct().withColumn("top", F.max("v").over(W.partitionBy(group))).where("v < top").select(group, F.col("v").alias("xmin"))
    return _distances(cuts, rows, group)


def _distances(cuts: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """(group, xmin, n_tail, alpha, ks_distance) of cutoffs (group, xmin), each with its tail of rows (group, v)."""
    tails = cuts.join(rows, group).where("v >= xmin")
    own = W.partitionBy(group, "xmin")
    tails = tails.withColumns({"n_tail": F.count("*").over(own), "logs": F.sum(F.log(F.col("v") / F.col("xmin"))).over(own), "i": F.row_number().over(own.orderBy("v"))})
    a = F.col("n_tail") / F.col("logs")
    fitted = 1 - F.pow(F.col("v") / F.col("xmin"), -a)
    gap = F.greatest(F.col("i") / F.col("n_tail") - fitted, fitted - (F.col("i") - 1) / F.col("n_tail"))
    return tails.withColumn("gap", gap).groupBy(group, "xmin").agg(F.max("n_tail").alias("n_tail"), (1 + F.max(a)).alias("alpha"), F.max("gap").alias("ks_distance"))


#: Places of a sample at which every cutoff's distance is looked at.
MARKS = 64


def _sorted_out(sample: DataFrame, group: str, value: str) -> DataFrame:
    """(group, xmin): the cutoffs that may have the least distance.

    One pass from the largest value down gives every tail's size and logarithms. A
    cutoff's gaps at MARKS places bound its distance from below; the exact distance of
    the one with the least bound is one that none of a larger bound can beat.
    """
    rows = sample.select(group, F.col(value).cast("double").alias("v"))
    each, keys = F.struct(group, "v"), (group,)
    logs = totals_by_value(rows, "v", F.log("v"), down=True, keys=keys).select(each.alias("_e"), (F.col("of") + F.col("before")).cast("double").alias("_logs"))
    counts = totals_by_value(rows, "v", F.lit(1), keys=keys).select(group, "v", each.alias("_e"), F.col("before").cast("long").alias("_below"), (F.col("before") + F.col("of")).cast("long").alias("_upto"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"), F.max("v").alias("_top"), F.percentile_approx("v", [k / MARKS for k in range(1, MARKS + 1)], 10_000).alias("_marks"))
    values = written(counts.join(logs, "_e").drop("_e").join(sizes, group), "tails")
    n = (F.col("_n") - F.col("_below")).alias("n_tail")
    cuts = values.where("v < _top").select(group, F.col("v").alias("xmin"), n, F.col("_below").alias("_first"), ((F.col("_n") - F.col("_below")) / (F.col("_logs") - (F.col("_n") - F.col("_below")) * F.log("v"))).alias("a"))
    marks = values.where(F.array_contains("_marks", F.col("v"))).select(F.col(group).alias("_g"), F.col("v").alias("_m"), "_below", "_upto")
    model = 1 - F.pow(F.col("_m") / F.col("xmin"), -F.col("a"))
    gap = F.greatest((F.col("_upto") - F.col("_first")) / F.col("n_tail") - model, model - (F.col("_below") - F.col("_first")) / F.col("n_tail"))
    bounds = cuts.join(marks, (F.col(group) == F.col("_g")) & (F.col("_m") >= F.col("xmin"))).groupBy(group, "xmin").agg(F.max(gap).alias("bound"))
    bounds = written(bounds, "bounds")
    one = bounds.groupBy(group).agg(F.min_by("xmin", F.struct("bound", "xmin")).alias("xmin"))
    reached = _distances(one, rows, group).select(F.col(group).alias("_g"), F.col("ks_distance").alias("_d"))
    return bounds.join(reached, F.col(group) == F.col("_g"), "left").where("_d is null or isnan(_d) or bound is null or isnan(bound) or bound <= _d + 1e-9").select(group, "xmin")


def fitted(sample: DataFrame, group: str = "dataset", value: str = "area_km2") -> DataFrame:
    """One row per sample: the cutoff of least distance (the smallest on ties), its tail and likelihood.

    Distances are made exactly for the cutoffs that may have the least. Samples of fewer
    than two values that differ have no candidates and say so.
    """
    rows = sample.select(group, F.col(value).cast("double").alias("v"))
    scan = _distances(_sorted_out(sample, group, value), rows, group)
    candidates = rows.groupBy(group).agg((F.count_distinct("v") - 1).alias("n_candidates"))
    best = scan.groupBy(group).agg(F.min(F.struct("ks_distance", "xmin", "n_tail", "alpha")).alias("b")).join(candidates, group)
    sizes = sample.groupBy(group).agg(F.count("*").alias("n"))
    out = sizes.join(best, group, "left").select(group, "n", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.col("b.n_tail").alias("n_tail"), F.col("b.xmin").alias("xmin_km2"), F.col("b.alpha").alias("alpha"), F.col("b.ks_distance").alias("ks_distance"))
    # the logs of a tail sum to n / (alpha - 1)
    a, n = F.col("alpha") - 1, F.col("n_tail")
    finite = F.abs(F.col("alpha")) < float("inf")
    status = F.when(F.col("n_candidates") == 0, "no_candidates").when(finite & (F.abs(F.col("ks_distance")) < float("inf")), "ok").otherwise("nonfinite_fit")
    return out.withColumns({"loglik": n * F.log(a / F.col("xmin_km2")) - F.col("alpha") * n / a, "status": status})


def fit(values: np.ndarray) -> tuple[float, float, float, int] | None:
    """(xmin, alpha, distance, n_tail) of one sample in numpy, or None without a candidate."""
    x = np.sort(values)
    n = len(x)
    cuts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])[:-1]
    best = None
    for at in cuts:
        tail = x[at:]
        m = n - at
        a = m / np.log(tail / tail[0]).sum()
        f = 1 - (tail / tail[0]) ** -a
        i = np.arange(1, m + 1)
        d = max((i / m - f).max(), (f - (i - 1) / m).max())
        if not math.isfinite(d):
            return None
        if best is None or d < best[2]:
            best = (float(tail[0]), 1 + a, float(d), m)
    return best


def uniforms(seed: int) -> np.random.RandomState:
    """The Mersenne Twister seeded by the recurrence s = 69069 s + 1, as the fixtures' numbers were drawn."""
    s = seed
    for _ in range(50):
        s = (69069 * s + 1) % 2**32
    words = []
    for _ in range(625):
        s = (69069 * s + 1) % 2**32
        words.append(s)
    state = np.random.RandomState()
    state.set_state(("MT19937", np.array(words[1:], dtype=np.uint32), 624))
    return state


def _draw(state: np.random.RandomState, n: int) -> np.ndarray:
    raw = state.randint(0, 2**32, size=n, dtype=np.uint32).astype(np.float64) * 2.3283064365386963e-10
    return np.clip(raw, 0.5 * 2.328306437080797e-10, 1 - 0.5 * 2.328306437080797e-10)


#: Numbers that the generator makes between two states that are kept for tasks to start at.
STATE_REPS = 250


def states(seed: int, reps: int, n: int) -> list[tuple[int, bytes, int]]:
    """(first repetition, the generator's words, its place) for every STATE_REPS repetitions of 2 n numbers."""
    state, out = uniforms(seed), []
    for first in range(0, reps, STATE_REPS):
        _, words, at, *_ = state.get_state()
        out.append((first, words.tobytes(), int(at)))
        _draw(state, 2 * n * STATE_REPS)
    return out


def bootstrap(spark: SparkSession, values: list[float], reps: int = 5000, seed: int = 20261020) -> DataFrame:
    """(rep, ks_distance, alpha): refits of samples drawn from the fit and the body below it.

    A repetition takes exactly 2 n numbers of the stream. The stream is run through once,
    and a task starts at the state that belongs to its repetitions, so results don't
    depend on how the work is divided. values keep their order.
    """
    x = np.asarray(values, dtype=np.float64)
    base = fit(x)
    schema = "rep int, ks_distance double, alpha double"
    if base is None:
        return spark.createDataFrame([], schema)
    xmin, alpha, _, n_tail = base
    body, n = x[x < xmin], len(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, words, at in zip(b["first"], b["words"], b["at"]):
                state, out = np.random.RandomState(), []
                state.set_state(("MT19937", np.frombuffer(words, dtype=np.uint32), int(at)))
                for rep in range(int(first), min(int(first) + STATE_REPS, reps)):
                    from_tail = _draw(state, n) <= n_tail / n
                    n1 = int((~from_tail).sum())
                    u1, u2 = _draw(state, n1), _draw(state, n - n1)
                    low = body[np.ceil(len(body) * u1).astype(int) - 1] if n1 else body[:0]
                    got = fit(np.concatenate([low, xmin * (1 - u2) ** (-1 / (alpha - 1))]))
                    out.append((rep, got[2] if got else None, got[1] if got else None))
                yield pd.DataFrame(out, columns=["rep", "ks_distance", "alpha"])

    starts = spark.createDataFrame(states(seed, reps, n), "first int, words binary, at int")
    return starts.repartition(max(1, -(-reps // STATE_REPS)), "first").mapInPandas(run, schema)


#: Names of the quantiles of alpha that a summary has.
QUANTILES = {0.025: "alpha_boot_q2.5", 0.25: "alpha_boot_q25", 0.5: "alpha_boot_median", 0.75: "alpha_boot_q75", 0.975: "alpha_boot_q97.5"}


def summary(draws: DataFrame, fits: DataFrame, group: str = "dataset") -> DataFrame:
    """fits with n_exceed, p and its bounds by undefined refits, its error, and quantiles of alpha.

    draws: (group, ks_distance, alpha); p is there only if every refit succeeded. A sample
    without a fit keeps its row, with nulls.
    """
    seen = fits.select(group, F.col("ks_distance").alias("_d")).join(draws, group)
    out = seen.groupBy(group).agg(
        F.count("*").alias("reps"), F.count_if(F.col("ks_distance").isNull()).alias("n_undefined"), F.count_if(F.col("ks_distance") >= F.col("_d")).alias("n_exceed"),
        F.percentile(draws["alpha"], F.array(*map(F.lit, QUANTILES))).alias("_q"),
    )
    p, whole = F.col("n_exceed") / F.col("reps"), F.col("n_undefined") == 0
    out = out.withColumns({"p_value": F.when(whole, p), "p_lower": p, "p_upper": (F.col("n_exceed") + F.col("n_undefined")) / F.col("reps"), "mc_se": F.when(whole, F.sqrt(p * (1 - p) / F.col("reps")))})
    for i, name in enumerate(QUANTILES.values()):
        out = out.withColumn(name, F.get("_q", F.lit(i)))
    return fits.join(out.drop("_q"), group, "left")
