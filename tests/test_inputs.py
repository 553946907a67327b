"""Grids out of arrays and rows, chosen days and guards, on small tables."""

import datetime as dt

import pytest

from swelter.operators import ellipses, figure_data
from swelter.sources import grid

D = dt.date(2001, 6, 1)
ONE, TWO = D, D + dt.timedelta(1)


def test_arrays_become_grids(spark):
    got = grid.from_array(spark, [[[300.0, 301.0], [302.0, 303.0]], [[304.0, 305.0], [306.0, 307.0]]], [ONE, TWO], [5.0, 6.0], [40.0, 41.0], "K")
    assert {(r.date, r.lon, r.lat, r.cell_id): round(r.tmax_c, 2) for r in got.collect()}[TWO, 6.0, 40.0, 2] == 32.85
    # a place without any value is none of the grid's
    nan = float("nan")
    left = grid.from_array(spark, [[[1.0, nan], [2.0, 3.0]]] * 2, [ONE, TWO], [5.0, 6.0], [40.0, 41.0])
    assert {r.cell_id for r in left.collect()} == {1, 2, 3} and left.count() == 6
    with pytest.raises(ValueError, match="1 dates by 2 longitudes by 2 latitudes"):
        grid.from_array(spark, [[[1.0, 2.0]]], [ONE], [5.0, 6.0], [40.0, 41.0])
    with pytest.raises(ValueError, match="repeat"):
        grid.from_array(spark, [[[1.0, 2.0], [1.0, 2.0]]] * 2, [ONE, ONE], [5.0, 6.0], [40.0, 41.0])


@pytest.mark.parametrize(
    ("rows", "says"),
    [
        ([(ONE, 1, 1.0), (TWO, 1, 1.0), (ONE, 2, 1.0), (TWO, 2, None)], "cell 2 has 1 values for 2"),
        ([(ONE, 1, 1.0), (TWO, 1, 1.0), (ONE, 2, 1.0), (TWO, 2, float("inf"))], "cell 2 has 1 values for 2"),
        ([(ONE, 1, 1.0), (TWO, 1, 1.0), (ONE, 2, 1.0)], "cell 2 has 1 values for 2"),
        ([(ONE, 1, 1.0), (TWO, 2, 1.0)], "for 2 dates"),
        ([(ONE, 1, 1.0), (ONE, 1, 1.0), (ONE, 2, 1.0)], "cell 1 has 2 values for 1"),
        ([(ONE, 1, 1.0), (TWO, 1, 1.0)], "two cells"), ([], "two cells"),
    ],
)
def test_grids_that_are_incomplete(spark, rows, says):
    with pytest.raises(ValueError, match=says):
        grid.complete(spark.createDataFrame(rows, "date date, cell_id int, tmax_c double"))


def test_a_complete_grid_passes(spark):
    rows = spark.createDataFrame([(d, c, 1.0) for d in (ONE, TWO) for c in (1, 2, 3)], "date date, cell_id int, tmax_c double")
    assert grid.complete(rows) is rows


def test_clusters_of_another_grid_are_refused(spark):
    schema = "date date, cell_id int, lon double, lat double"
    own = spark.createDataFrame([(ONE, 1, 5.0, 40.0), (ONE, 2, 6.0, 40.0)], schema)
    members = lambda *rows: spark.createDataFrame(rows, f"{schema}, cluster_id int, tmax_c double")
    good = members((ONE, 1, 5.0, 40.0, 1, 30.0), (ONE, 2, 9.0, 9.0, None, 30.0))
    assert ellipses.checked(good, own) is good
    for row in ((ONE, 1, 5.5, 40.0, 1, 30.0), (TWO, 1, 5.0, 40.0, 1, 30.0), (ONE, 7, 5.0, 40.0, 1, 30.0)):
        with pytest.raises(ValueError, match="another grid"):
            ellipses.checked(members(row), own)
    with pytest.raises(ValueError, match="above zero"):
        ellipses.checked(members((ONE, 1, 5.0, 40.0, 1, 0.0)), own)


def test_days_that_are_chosen(spark):
    day = lambda k: D + dt.timedelta(k)
    spans = [(1, 1, 0, 1), (2, 1, 5, 1), (3, 3, 10, 4), (4, 3, 20, 3), (5, 4, 30, 9), (6, 2, 50, 1)]
    events = spark.createDataFrame([(i, k, day(a), day(a + n - 1), n, float(i)) for i, k, a, n in spans], "compound_event_id int, event_type int, start_date date, end_date date, duration_days int, largest_ellipse_area_km2 double")
    days = spark.createDataFrame([(i, day(a + j), j + 1, 1) for i, _, a, n in spans for j in range(n)], "compound_event_id int, date date, day_in_event int, n_clusters int")
    got = lambda chosen: {(r.event_type, r.place, r.compound_event_id, r.date) for r in figure_data.chosen_days(events, days, chosen).collect()}
    plain = got({})
    assert (1, 1, 2, day(5)) in plain and (4, 1, 5, day(30)) in plain
    mine = got({1: [day(0)], 3: [day(21), day(12)], 4: [day(33)]})
    assert {x for x in mine if x[0] == 1} == {(1, 1, 1, day(0))} and {x for x in mine if x[0] == 2} == {x for x in plain if x[0] == 2}
    assert {x for x in mine if x[0] == 3} == {(3, 1, 4, day(21)), (3, 1, 4, day(22)), (3, 2, 3, day(12)), (3, 2, 3, day(13))}
    assert {x for x in mine if x[0] == 4} == {(4, 1, 5, day(k)) for k in range(33, 39)}
    for chosen, says in (({1: [day(10)]}, "no day of a type 1"), ({2: [day(3)]}, "no day of a type 2"), ({3: [day(10), day(11)]}, "several events"), ({3: [day(13)]}, "last day")):
        with pytest.raises(ValueError, match=says):
            got(chosen)
