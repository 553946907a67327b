"""Queries share the stages of a run that a result holds, and no others."""

import gc
import shutil

import pytest

from swelter import shared
from swelter.plans import catalogue


@pytest.fixture
def folder(tmp_path):
    shutil.copytree("/root/testdata/sf0.001", tmp_path / "sf")
    return str(tmp_path / "sf")


def test_runs_live_as_long_as_results(spark, folder):
    one = catalogue.QUERIES["regional_days"](spark, folder)
    n = one.count()
    run = one._runs[0]
    two = catalogue.QUERIES["daily_extent"](spark, folder)
    assert two._runs == [run] and len(run.tables) == 2  # days and daily, written once
    # closing one result leaves what the run has to others
    shared.close(one)
    assert two.count() > n == one.count()
    # another input is another run
    shutil.copy("/root/testdata/sf0.01/lineitem.parquet", f"{folder}/lineitem.parquet")
    three = catalogue.QUERIES["regional_days"](spark, folder)
    assert three._runs[0] is not run and three.count() > 0
    # tables that are gone are made again
    three._runs[0].close()
    four = catalogue.QUERIES["regional_days"](spark, folder)
    assert four._runs[0] is not three._runs[0] and four.count() > 0
    first = id(four._runs[0])
    del one, two, three, four, run
    gc.collect()
    assert not catalogue._live and first


def test_a_query_that_fails_holds_nothing(spark, tmp_path):
    with pytest.raises(Exception):  # noqa: B017
        catalogue.QUERIES["regional_days"](spark, str(tmp_path / "none"))
    assert not hasattr(catalogue._asked, "runs")
