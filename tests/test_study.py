"""Settings that are refused, and a whole study over a small grid."""

import os

import pytest
from pyspark.sql import functions as F

from swelter.plans import config, study
from swelter.sources import grid

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    ("section", "key", "value"),
    [
        ("heatwaves", "threshold_percentile", NAN), ("heatwaves", "threshold_percentile", 101), ("heatwaves", "min_duration_days", 2.5), ("heatwaves", "min_exceeding_days", 0),
        ("regional_days", "percentile", INF), ("regional_days", "percentile", -1), ("clustering", "eps_values", [1, INF]), ("clustering", "eps_values", [1, 0]), ("clustering", "eps_values", [1, 1]),
        ("clustering", "min_samples_values", [2, 2.5]), ("clustering", "min_samples_values", [2, NAN]), ("ellipses", "scale_factor", 0), ("ellipses", "scale_factor", INF),
        ("power_law", "bootstrap_repetitions", 0), ("power_law", "bootstrap_repetitions", 1.5), ("power_law", "seed_daily_maxima", 2147483648), ("power_law", "seed_event_maxima", NAN),
        ("lgcp", "raster_km", 0), ("lgcp", "window_margin_km", -1), ("lgcp", "covariates", "foo"), ("lgcp", "covariates", ["lon", "lon"]), ("lgcp", "covariates", []),
        ("period", "warm_season_months", [4, 4, 5]), ("period", "warm_season_months", [11, 1, 3]), ("period", "start_date", "2000-1-1"), ("input", "units", "F"), ("input", "file", ["a.nc", ""]), ("input", "format", "grib"),
        ("input", "cds", {"place": 1}), ("figures", "representative_events", {"type_1": ["2000-01-01", "2000-01-02"]}), ("other", "key", 1), ("heatwaves", "key", 1),
    ],
)
def test_settings_that_are_refused(section, key, value):
    with pytest.raises(ValueError, match=section if section == "other" else key):
        config.read_config({section: {key: value}}, False)


def test_settings_over_defaults(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("heatwaves: {threshold_percentile: 90}\nclustering: {eps_values: 2}\n")
    got = config.read_config(str(path), False)
    assert got["heatwaves"] == {"threshold_percentile": 90, "min_duration_days": 3, "min_exceeding_days": 3} and got["clustering"]["eps_values"] == [2]
    path.write_text("heatwaves: {threshold_percentile: 90, threshold_percentile: 91}\n")
    with pytest.raises(ValueError, match="repeats"):
        config.read_config(str(path), False)
    with pytest.raises(ValueError, match="not set"):
        config.read_config()
    with pytest.raises(ValueError, match="before"):
        config.read_config({"period": {"start_date": "2001-01-01", "end_date": "2000-12-31"}}, False)
    path.write_text(config.template())
    assert config.read_config(str(path), False) == config.read_config({}, False)


def test_a_whole_study_is_published(spark, tmp_path):
    cells = grid.lattice(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    out = str(tmp_path / "results")
    own = {"output": {"directory": out}, "power_law": {"bootstrap_repetitions": 20}}
    tables = study.run(spark, own, cells)
    assert set(study.WHOLE) <= set(tables) and tables["compound_events"].count() == 22 and tables["event_type_summary"].count() == 4
    assert tables["heatwave_events"].count() == 988
    os.makedirs(f"{out}/mine")
    with pytest.raises(ValueError, match="no selected day formed a cluster"):
        study.run(spark, own | {"clustering": {"eps_values": [1], "min_samples_values": [1000]}}, cells)
    left = {x for x in os.listdir(out) if not x.startswith(".")}
    assert left == {*study.PARTIAL, "README.txt", "mine"} and "Incomplete" in open(f"{out}/README.txt").read()
    assert spark.read.parquet(f"{out}/heatwave_events").agg(F.count("*")).first()[0] == 988
