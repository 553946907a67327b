"""Requests for daily maxima from a data service: planned by Spark, kept in a folder, resumed.

The plan is a DataFrame, one row a request. Its files are asked for one after the other,
as the service takes one at a time, over a backend that is given: anything with
submit(request), status(job), transfer(job, path) and delete(job).
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swelter.sources import netcdf

#: What is asked for, the step of its grid in degrees, and how its files are called.
DATASET = "derived-era5-single-levels-daily-statistics"
PRODUCT, VARIABLE, STATISTIC, ZONE, FREQUENCY = "reanalysis", "2m_temperature", "daily_maximum", "utc+00:00", "1_hourly"
STEP, PREFIX = 0.25, "era5_daily_tmax"
#: How often a request that the service drops is put again.
RESUBMISSIONS = 50


def plan(period: DataFrame, months: Sequence[int], by: str = "month") -> DataFrame:
    """(year, month, first, last, months, days) of the requests for a period (start, end), one row.

    By month, the days are clipped to the period; by year, whole months are asked for with
    days 01 to 31, month is null, and first and last tell the period's own days.
    """
    start = F.explode(F.sequence(F.trunc("start", "month"), F.col("end"), F.expr("interval 1 month")))
    rows = period.where("start <= end").withColumn("_m", start).where(F.month("_m").isin(list(months)))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    rows = rows.select(F.year("_m").alias("year"), F.month("_m").alias("month"), F.greatest("_m", "start").alias("first"), F.least(F.last_day("_m"), "end").alias("last"))
    if by == "month":
        return rows.select("*", F.array(two(F.col("month"))).alias("months"), F.transform(F.sequence("first", "last"), lambda d: two(F.day(d))).alias("days"))
    if by != "year":
        raise ValueError("requests are made by month or by year")
    whole = rows.groupBy("year").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.transform(F.array_sort(F.collect_set("month")), two).alias("months"))
    return whole.select("year", F.lit(None).cast("int").alias("month"), "first", "last", "months", F.transform(F.sequence(F.lit(1), F.lit(31)), two).alias("days"))


def _dates(year: Column, months: Column, days: Column) -> Column:
    """The days of the months that there are; day 31 of April is not."""
    texts = F.flatten(F.transform(months, lambda m: F.transform(days, lambda d: F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), m, d))))
    return F.array_sort(F.filter(F.transform(texts, lambda t: F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("date")), lambda d: d.isNotNull()))


def named(requests: DataFrame, area: Sequence[float]) -> DataFrame:
    """requests with `dates`, the whole request as a line (`key`), and the name of its file, which tells area and dates."""
    north, west, south, east = (f"{x:g}" for x in area)
    out = requests.withColumn("dates", _dates(F.col("year"), F.col("months"), F.col("days")))
    fixed = "|".join((DATASET, PRODUCT, VARIABLE, STATISTIC, ZONE, FREQUENCY, f"area={north},{west},{south},{east}"))
    key = F.concat(F.lit(f"{fixed}|year="), "year", F.lit("|month="), F.array_join("months", ","), F.lit("|day="), F.array_join("days", ","))
    whole = F.concat(F.col("year").cast("string"), F.lit("_months"), F.array_join("months", "-"))
    span = F.when(F.size("months") == 1, F.concat_ws("_", F.array_min("dates"), F.array_max("dates"))).otherwise(whole)
    return out.withColumns({"key": key, "file_name": F.concat(F.lit(f"{PREFIX}_N{north}_W{west}_S{south}_E{east}_"), span, F.lit(".nc"))})


@dataclass(frozen=True)
class Request:
    file_name: str
    key: str
    dates: tuple[dt.date, ...]
    area: tuple[float, ...]
    year: int
    months: tuple[str, ...]
    days: tuple[str, ...]


def listed(requests: DataFrame, area: Sequence[float]) -> list[Request]:
    """The plan on the driver, in order of time: a row for each month or year."""
    rows = named(requests, area).orderBy("first").collect()
    return [Request(r.file_name, r.key, tuple(r.dates), tuple(area), r.year, tuple(r.months), tuple(r.days)) for r in rows]


class Backend(Protocol):
    def submit(self, request: Request) -> str: ...

    def status(self, job: str) -> str: ...

    def transfer(self, job: str, path: str) -> None: ...

    def delete(self, job: str) -> None: ...


def file_problem(path: str, request: Request) -> str | None:
    """Why a file doesn't answer a request; None if it holds its grid and dates."""
    try:
        of = netcdf.layout(path, "auto", extra=("expver",), wrap=True)
    except (ValueError, KeyError, OSError) as e:
        return f"it can't be read as a grid ({e})"
    north, west, south, east = request.area
    for what, have, low, high in (("longitudes", of.lons, west, east), ("latitudes", of.lats, south, north)):
        want = [low + STEP * k for k in range(round((high - low) / STEP) + 1)]
        if len(have) != len(want) or max(abs(a - b) for a, b in zip(sorted(have), want)) >= 1e-6:
            return f"its {what} aren't those of the area"
    return None if tuple(sorted(set(of.dates))) == request.dates else "its dates aren't those that were asked for"


class Cache:
    """A folder of answered requests. Beside each file lies what was asked, and while it is waited for, its job."""

    def __init__(self, folder: str, say: Callable[[str], None] = lambda text: None):
        self.folder, self.say = folder, say
        os.makedirs(folder, exist_ok=True)

    def path(self, request: Request, more: str = "") -> str:
        return os.path.join(self.folder, request.file_name + more)

    def problem(self, request: Request) -> str | None:
        """Why the folder has no answer to a request yet; None if it has."""
        path = self.path(request)
        if not os.path.exists(path):
            return "it is not there"
        if not os.path.getsize(path):
            return "it is empty"
        if self._noted(request, ".request").get("key") != request.key:
            return "it answers no request that is on record, or another one"
        return file_problem(path, request)

    def _noted(self, request: Request, kind: str) -> dict:
        try:
            with open(self.path(request, kind), encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return {}

    def _note(self, request: Request, kind: str, what: dict | None) -> None:
        path = self.path(request, kind)
        if what is None:
            if os.path.exists(path):
                os.remove(path)
            return
        with open(path, "w", encoding="utf-8") as f:
            json.dump(what, f)

    def complete(self, requests: Iterable[Request], backend: Backend, time_out: float = 21600, pause: float = 60, sleep: Callable[[float], None] = time.sleep) -> list[str]:
        """Paths of all files, those that lack asked for; what is there but wrong is set aside as .invalid."""
        requests = list(requests)
        for r in requests:
            problem = self.problem(r)
            if problem is None:
                continue
            if os.path.exists(self.path(r)):
                os.replace(self.path(r), self.path(r, ".invalid"))
                self._note(r, ".request", None)
                self.say(f"{r.file_name} is set aside: {problem}")
            self._obtain(r, backend, time_out, pause, sleep)
        return [self.path(r) for r in requests]

    def _obtain(self, r: Request, backend: Backend, time_out: float, pause: float, sleep: Callable[[float], None]) -> None:
        note = self._noted(r, ".job")
        job = note.get("job") if note.get("key") == r.key else None
        waited, put_again = 0.0, 0
        while True:
            if job is None:
                try:
                    job = backend.submit(r)
                except Exception as e:
                    if any(x in str(e).lower() for x in ("too large", "cost limit")):
                        raise ValueError(f"{r.file_name} is too much for one request ({e}); ask by month or for a smaller area") from e
                    raise ValueError(f"the request for {r.file_name} was not taken: {e}") from e
                self._note(r, ".job", {"job": job, "key": r.key})
            state = backend.status(job)
            if state == "successful":
                return self._received(r, backend, job)
            if state == "failed":
                self._note(r, ".job", None)
                raise ValueError(f"the service could not make {r.file_name} (job {job})")
            if state in ("rejected", "missing", "dismissed"):
                put_again += 1
                if put_again > RESUBMISSIONS:
                    raise ValueError(f"the service keeps dropping the request for {r.file_name}")
                self._note(r, ".job", None)
                job = None
                sleep(5 * pause)
            elif waited > time_out:
                raise TimeoutError(f"{r.file_name} is still {state} after {waited:.0f} s; its job stays noted and is taken up again")
            else:
                sleep(pause)
                waited += pause

    def _received(self, r: Request, backend: Backend, job: str) -> None:
        backend.transfer(job, self.path(r, ".part"))
        problem = file_problem(self.path(r, ".part"), r)
        if problem:
            os.remove(self.path(r, ".part"))
            self._note(r, ".job", None)
            raise ValueError(f"what was delivered as {r.file_name} is removed: {problem}")
        os.replace(self.path(r, ".part"), self.path(r))
        self._note(r, ".request", {"key": r.key})
        backend.delete(job)
        self._note(r, ".job", None)
