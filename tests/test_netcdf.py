"""Files: written and read back, reduced from hours to days, refused when they are no grid."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from swelter.sources import grid, netcdf

DAY = dt.date(2001, 6, 1)


def classic(path, dims, variables, record=None):
    """A version 1 file; variables: name, dims, type, values, attributes; record: the unlimited dimension."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    names = list(dims)

    def attributes(a):
        out = struct.pack(">ii", 12, len(a)) if a else struct.pack(">ii", 0, 0)
        for k, v in a.items():
            raw = v.encode() if isinstance(v, str) else np.array([v], ">f8").tobytes()
            out += text(k) + struct.pack(">ii", 2 if isinstance(v, str) else 6, len(raw) if isinstance(v, str) else 1) + raw + b"\0" * (-len(raw) % 4)
        return out

    def header(begins):
        out = b"CDF\x01" + struct.pack(">i", dims[record] if record else 0) + struct.pack(">ii", 10, len(dims))
        out += b"".join(text(n) + struct.pack(">i", 0 if n == record else dims[n]) for n in names) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, len(variables))
        for (name, of, kind, v, a), begin in zip(variables, begins):
            size = v.astype(netcdf.TYPES[kind]).nbytes // (dims[record] if record in of else 1)
            out += text(name) + struct.pack(">i", len(of)) + b"".join(struct.pack(">i", names.index(d)) for d in of) + attributes(a) + struct.pack(">iii", kind, size + -size % 4, begin)
        return out

    fixed, moving = [x for x in variables if record not in x[1]], [x for x in variables if record in x[1]]
    at, begins = len(header([0] * len(variables))), {}
    for x in fixed:
        begins[x[0]], at = at, at + x[3].astype(netcdf.TYPES[x[2]]).nbytes
        at += -at % 4
    body = {x[0]: x[3].astype(netcdf.TYPES[x[2]]) for x in variables}
    for x in moving:
        begins[x[0]], at = at, at + body[x[0]][0].nbytes + (-body[x[0]][0].nbytes % 4 if len(moving) > 1 else 0)
    with open(path, "wb") as f:
        f.write(header([begins[x[0]] for x in variables]))
        for x in fixed:
            f.write(body[x[0]].tobytes() + b"\0" * (-body[x[0]].nbytes % 4))
        for i in range(dims[record] if record else 0):
            for x in moving:
                raw = body[x[0]][i : i + 1].tobytes()
                f.write(raw + b"\0" * (-len(raw) % 4 if len(moving) > 1 else 0))


@pytest.mark.parametrize(("precision", "off"), [("int16", 0.005), ("float32", 1e-5)])
def test_written_grids_are_read_back(spark, tmp_path, precision, off):
    rng = np.random.default_rng(1)
    rows = [(DAY + dt.timedelta(d), x, y, float(rng.normal(25, 5))) for d in range(5) for x in (10.5, 11.5, 12.5) for y in (40.5, 41.5) if (x, y) != (11.5, 41.5)]
    made = grid.from_rows(spark.createDataFrame(rows, "date date, lon double, lat double, value double"))
    path = str(tmp_path / "t.nc")
    netcdf.write_tmax(made, path, precision, title="a test")
    back = {(r.date, r.cell_id, r.lon, r.lat): r.tmax_c for r in netcdf.read_tmax(spark, path).collect()}
    want = {(r.date, r.cell_id, r.lon, r.lat): r.tmax_c for r in made.collect()}
    assert set(back) == set(want) and max(abs(back[k] - want[k]) for k in want) <= off
    assert netcdf.read_tmax(spark, path, start="2001-06-02", end="2001-06-03").select("date").distinct().count() == 2
    with pytest.raises(ValueError, match="there already"):
        netcdf.write_tmax(made, path)
    with pytest.raises(ValueError, match="no temperature variable called 'x'"):
        netcdf.read_tmax(spark, path, variable="x")


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = [(DAY + dt.timedelta(d), x, y, 20.0) for d in range(4) for x in (10.5, 11.5) for y in (40.5, 41.5)]
    made = spark.createDataFrame(rows, "date date, lon double, lat double, tmax_c double")
    path = str(tmp_path / "t.nc")
    fails = made.withColumn("tmax_c", F.when((F.col("date") == DAY) & F.raise_error(F.lit("no value")).isNull(), 1.0).otherwise(F.col("tmax_c")))
    options = {"lons": "[10.5, 11.5]", "lats": "[40.5, 41.5]", "dates": str([str(DAY + dt.timedelta(d)) for d in range(4)]).replace("'", '"')}
    save = lambda df: df.repartition("date").write.format("swelter-grid").options(**options).mode("append").save(path)
    spark.dataSource.register(netcdf.GridSource)
    for df, says in ((fails, "no value"), (made.where(F.col("date") > DAY), "3 of 4 dates")):
        with pytest.raises(Exception, match=says):
            save(df)
        assert list(tmp_path.iterdir()) == []
    save(made)
    assert [x.name for x in tmp_path.iterdir()] == ["t.nc"]
    back = netcdf.read_tmax(spark, path)
    assert back.count() == 16 and back.agg(F.min("tmax_c"), F.max("tmax_c")).first() == (20.0, 20.0)
    # an overwrite that fails leaves what was there
    with pytest.raises(Exception, match="no value"):
        fails.repartition("date").write.format("swelter-grid").options(**options).mode("overwrite").save(path)
    assert netcdf.read_tmax(spark, path).count() == 16 and len(list(tmp_path.iterdir())) == 1


def hours(path, days, first=DAY, scale=1.0, lons=(359.25, 359.5, 359.75, 0.0), drop=0):
    """Hourly K values over 4 x 4 points, two versions, time unlimited."""
    n, lats = 24 * days - drop, (40.75, 40.5, 40.25, 40.0)
    v = 290 + np.arange(n * 2 * 16, dtype=float).reshape(n, 2, 4, 4) % 23 * scale
    stored = v.copy()
    stored[:, 0, 0, 0] = -999.0
    classic(path, {"valid_time": n, "expver": 2, "latitude": 4, "longitude": 4}, [
        ("valid_time", ("valid_time",), 6, np.arange(n, dtype=float), {"units": f"hours since {first} 00:00:00"}),
        ("latitude", ("latitude",), 6, np.array(lats), {}), ("longitude", ("longitude",), 6, np.array(lons), {}),
        ("t2m", ("valid_time", "expver", "latitude", "longitude"), 5, stored, {"units": "K", "_FillValue": -999.0}),
    ], record="valid_time")
    one = v[:, 0].copy()
    one[:, 0, 0] = v[:, 1, 0, 0]
    return one, lats, [(x + 180) % 360 - 180 for x in lons]


def test_hours_become_daily_maxima_of_cells(spark, tmp_path):
    a, lats, lons = hours(str(tmp_path / "a.nc"), 3)
    b, _, _ = hours(str(tmp_path / "b.nc"), 2, DAY + dt.timedelta(3), 0.5)
    got = {(r.date, r.lon, r.lat): r.tmax_c for r in netcdf.read_era5(spark, [str(tmp_path / "a.nc"), str(tmp_path / "b.nc")], cell_size=0.5).collect()}
    days = np.concatenate([a.reshape(3, 24, 4, 4).max(axis=1), b.reshape(2, 24, 4, 4).max(axis=1)]) - 273.15
    k = lambda v: int(np.floor(v / 0.5 + 1e-6))
    want = {}
    for d in range(5):
        for i in {k(x) for x in lons}:
            for j in {k(y) for y in lats}:
                own = [days[d, lats.index(y), lons.index(x)] for x in lons for y in lats if (k(x), k(y)) == (i, j)]
                if len(own) == 4:
                    want[DAY + dt.timedelta(d), (i + 0.5) * 0.5, (j + 0.5) * 0.5] = np.mean(own)
    assert set(got) == set(want) and len(got) == 10
    assert all(got[x] == pytest.approx(want[x], abs=1e-4) for x in want)
    hours(str(tmp_path / "c.nc"), 1)
    with pytest.raises(ValueError, match="lies in"):
        netcdf.read_era5(spark, [str(tmp_path / "a.nc"), str(tmp_path / "c.nc")])
    hours(str(tmp_path / "d.nc"), 2, drop=5)
    with pytest.raises(ValueError, match="19 of its 24"):
        netcdf.read_era5(spark, [str(tmp_path / "d.nc")])


@pytest.mark.parametrize(
    ("values", "units", "want"),
    [([0], "days since 2000-02-28", "2000-02-28"), ([36], "hours since 2000-01-01", "2000-01-02"), ([0], "hours since 2000-01-01 01:00 +02:00", "1999-12-31"), ([1440], "minutes since 2000-01-01T00:00:00Z", "2000-01-02"), ([86399], "seconds since 2000-01-01", "2000-01-01"), ([0], "days since 2000-01-01 23:30 -01:00", "2000-01-02")],
)
def test_times(values, units, want):
    assert grid.decode_time(values, units) == [dt.date.fromisoformat(want)]


@pytest.mark.parametrize("units", ["months since 2000-01-01", "h since 2000-01-01", "days since 2000-13-01", "days since 2000-01-01 25:00", "days since 2000-01-01 00:00 +15:00", "days", ""])
def test_times_that_are_refused(units):
    with pytest.raises(ValueError):
        grid.decode_time([0], units)
