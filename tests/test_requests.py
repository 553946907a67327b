"""Requests planned and named, and a folder of answers filled over a backend that is no network."""

import datetime as dt
import os

import numpy as np
import pytest

from hdf5_files import netcdf4
from swelter.plans import study
from swelter.plans.config import read_config
from swelter.sources import netcdf, requests

AREA = (40.5, -100.0, 40.0, -99.5)


def planned(spark, start, end, months=(4, 5), by="month"):
    return requests.plan(spark.createDataFrame([(dt.date.fromisoformat(start), dt.date.fromisoformat(end))], "start date, end date"), months, by)


def test_plans_are_clipped_to_the_period(spark):
    rows = planned(spark, "2001-04-10", "2002-05-03").orderBy("first").collect()
    assert [(r.year, r.month, str(r.first), str(r.last)) for r in rows] == [(2001, 4, "2001-04-10", "2001-04-30"), (2001, 5, "2001-05-01", "2001-05-31"), (2002, 4, "2002-04-01", "2002-04-30"), (2002, 5, "2002-05-01", "2002-05-03")]
    assert rows[0].months == ["04"] and rows[0].days[0] == "10" and rows[3].days == ["01", "02", "03"]
    years = requests.named(planned(spark, "2001-04-10", "2002-05-03", by="year"), AREA).orderBy("year").collect()
    assert [(r.year, r.month, r.months, len(r.days), len(r.dates)) for r in years] == [(2001, None, ["04", "05"], 31, 61), (2002, None, ["04", "05"], 31, 61)]
    assert years[0].file_name == "era5_daily_tmax_N40.5_W-100_S40_E-99.5_2001_months04-05.nc"
    winter = planned(spark, "2001-11-15", "2002-01-05", (11, 12, 1)).orderBy("first").collect()
    assert [(r.year, r.month) for r in winter] == [(2001, 11), (2001, 12), (2002, 1)]
    assert planned(spark, "2001-06-01", "2001-08-01").count() == 0 and planned(spark, "2002-04-01", "2001-04-01").count() == 0
    with pytest.raises(ValueError, match="by month or by year"):
        planned(spark, "2001-04-01", "2001-05-01", by="week")


class Service:
    """States of jobs as given, one after the other; delivers files of what was asked, or of something else."""

    def __init__(self, states=("queued", "successful"), shift=0):
        self.states, self.shift, self.asked, self.deleted, self.at = states, shift, [], [], {}

    def submit(self, request):
        self.asked.append(request)
        job = f"job{len(self.asked)}"
        self.at[job] = [iter(self.states), request]
        return job

    def status(self, job):
        return next(self.at[job][0], "successful") if job in self.at else "missing"

    def transfer(self, job, path):
        r = self.at[job][1]
        n, w, s, e = r.area
        lats, lons = np.arange(n, s - 0.01, -0.25), np.arange(w, e + 0.01, 0.25) + self.shift
        days = np.array([(d - r.dates[0]).days for d in r.dates], "<i8")
        netcdf4(path, {"valid_time": (days, {"units": f"days since {r.dates[0]}"}), "latitude": (lats, {}), "longitude": (lons, {})}, [
            ("t2m", ("valid_time", "latitude", "longitude"), np.full((len(days), len(lats), len(lons)), 290.0, "<f4"), {"units": "K"}, (10, 2, 2), (), None),
        ])

    def delete(self, job):
        self.deleted.append(job)


def test_answers_are_kept_and_resumed(spark, tmp_path):
    wanted, slept = requests.listed(planned(spark, "2001-04-01", "2001-05-31"), AREA), []
    cache, service = requests.Cache(str(tmp_path / "c")), Service()
    paths = cache.complete(wanted, service, sleep=slept.append)
    assert [os.path.basename(p) for p in paths] == [r.file_name for r in wanted] and len(service.asked) == 2 == len(service.deleted) and slept == [60, 60]
    assert sorted(os.listdir(cache.folder)) == sorted(x for r in wanted for x in (r.file_name, r.file_name + ".request"))
    # all there: nothing is asked for again
    again = Service()
    assert cache.complete(wanted, again) == paths and not again.asked
    # given up while queued, the job is taken up by the next run, and not put again
    late = requests.listed(planned(spark, "2002-04-01", "2002-04-30"), AREA)
    slow = Service(["queued"] * 4)
    with pytest.raises(TimeoutError, match="still queued"):
        cache.complete(late, slow, time_out=100, sleep=slept.append)
    assert os.path.exists(cache.path(late[0], ".job"))
    cache.complete(late, slow, sleep=slept.append)
    assert len(slow.asked) == 1 and cache.problem(late[0]) is None and not os.path.exists(cache.path(late[0], ".job"))


def test_dropped_refused_and_failed_requests(spark, tmp_path, monkeypatch):
    wanted = requests.listed(planned(spark, "2001-04-01", "2001-04-30"), AREA)
    cache, slept = requests.Cache(str(tmp_path / "c")), []
    for state in ("rejected", "missing", "dismissed"):
        service = Service()
        first = iter([state])
        plain = service.status
        monkeypatch.setattr(service, "status", lambda job: next(first, None) or plain(job))  # noqa: B023
        cache.complete(wanted, service, sleep=slept.append)
        assert len(service.asked) == 2 and 300 in slept
        os.remove(cache.path(wanted[0]))
    with pytest.raises(ValueError, match="keeps dropping"):
        cache.complete(wanted, Service(["rejected"]), sleep=slept.append)
    with pytest.raises(ValueError, match="could not make"):
        cache.complete(wanted, Service(["failed"]), sleep=slept.append)
    assert not os.path.exists(cache.path(wanted[0], ".job"))
    refusing = Service()
    monkeypatch.setattr(refusing, "submit", lambda r: (_ for _ in ()).throw(RuntimeError("cost limit exceeded")))
    with pytest.raises(ValueError, match="by month or for a smaller area"):
        cache.complete(wanted, refusing)
    with pytest.raises(ValueError, match="longitudes aren't those"):
        cache.complete(wanted, Service(shift=0.25), sleep=slept.append)
    assert os.listdir(cache.folder) == [] or not os.path.exists(cache.path(wanted[0]))


def test_old_files_answer_no_other_request(spark, tmp_path):
    april, shorter = (requests.listed(planned(spark, "2001-04-01", end), AREA)[0] for end in ("2001-04-30", "2001-04-29"))
    cache = requests.Cache(str(tmp_path / "c"))
    cache.complete([april], Service(), sleep=lambda s: None)
    other = requests.listed(planned(spark, "2001-04-01", "2001-04-30"), (41.0, *AREA[1:]))[0]
    assert cache.problem(april) is None and cache.problem(shorter) == cache.problem(other) == "it is not there"
    # a file by this name that holds something else is set aside and asked for again
    os.replace(cache.path(april), cache.path(shorter))
    os.replace(cache.path(april, ".request"), cache.path(shorter, ".request"))
    assert "another one" in cache.problem(shorter)
    service, said = Service(), []
    cache.say = said.append
    cache.complete([shorter], service, sleep=lambda s: None)
    assert os.path.exists(cache.path(shorter, ".invalid")) and cache.problem(shorter) is None and "set aside" in said[0]
    open(cache.path(shorter), "w").close()
    assert cache.problem(shorter) == "it is empty"


def test_settings_with_a_service(spark, tmp_path):
    config = read_config({
        "input": {"source": "cds", "era5_cell_size_deg": 0.25, "cds": {"area": list(AREA), "cache_directory": str(tmp_path / "c"), "processed_file": str(tmp_path / "grid.nc")}},
        "period": {"start_date": "2001-04-05", "end_date": "2001-05-02"},
    })
    with pytest.raises(ValueError, match="backend"):
        study.read_input(spark, config)
    service = Service(("successful",))
    got = study.read_input(spark, config, service)
    assert got.count() == 28 * 9 and len(service.asked) == 2 and got.select("cell_id").distinct().count() == 9
    assert {round(r.tmax_c, 2) for r in netcdf.read_tmax(spark, str(tmp_path / "grid.nc")).select("tmax_c").distinct().collect()} == {16.85}
