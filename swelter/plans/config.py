"""Settings of a study: defaults, a YAML file or a dict over them, and what they must be."""

from __future__ import annotations

import copy
import datetime as dt
import math
import os
from collections.abc import Callable

from swelter.operators.events import season_start
from swelter.sources.grid import temperature_unit

#: The study's settings.
DEFAULTS = {
    "input": {"source": "file", "file": None, "format": "auto", "variable": "auto", "longitude": "auto", "latitude": "auto", "time": "auto", "units": "auto", "era5_cell_size_deg": 1,
              "cds": {"area": None, "cache_directory": "era5_cache", "request_period": "month", "processed_file": "era5_tmax_1deg.nc"}},
    "output": {"directory": "results"},
    "period": {"warm_season_months": [4, 5, 6, 7, 8, 9], "start_date": None, "end_date": None},
    "heatwaves": {"threshold_percentile": 95, "min_duration_days": 3, "min_exceeding_days": 3},
    "regional_days": {"percentile": 97.5},
    "clustering": {"eps_values": [1, 1.5, 2, 2.5, 3, 3.5, 4], "min_samples_values": [4, 5, 6, 7, 8, 9, 10, 11, 12]},
    "ellipses": {"scale_factor": 1.25},
    "power_law": {"bootstrap_repetitions": 5000, "seed_daily_maxima": 20261020, "seed_event_maxima": 20261120},
    "lgcp": {"covariates": ["lon", "lat", "mean_tmax", "std_tmax"], "raster_km": 25, "window_margin_km": 80},
    "figures": {"representative_events": {"type_1": None, "type_2": None, "type_3": None, "type_4": None}},
}
COVARIATES = ("lon", "lat", "mean_tmax", "std_tmax")


def _number(low: float = -math.inf, high: float = math.inf, whole: bool = False, above: bool = False) -> Callable:
    def check(v) -> str | None:
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
            return "must be one number"
        if whole and v != int(v):
            return "must be a whole number"
        if v < low or v > high or (above and v == low):
            return f"must be {'above' if above else 'at least'} {low:g}" + (f" and at most {high:g}" if high < math.inf else "")
        return None

    return check


def _numbers(whole: bool = False) -> Callable:
    one = _number(0, whole=whole, above=True)
    return lambda v: "must list numbers" if not isinstance(v, list) or not v else next((e for e in map(one, v) if e), None) or ("repeats a value" if len(set(v)) < len(v) else None)


def _among(*names: str) -> Callable:
    return lambda v: None if v in names else f"must be {' or '.join(names)}"


def _text(v) -> str | None:
    return None if isinstance(v, str) and v.strip() else "must be a text"


def _units(v) -> str | None:
    if v == "auto":
        return None
    try:
        temperature_unit(v)
    except (ValueError, AttributeError) as e:
        return str(e)
    return None


def _months(v) -> str | None:
    if not isinstance(v, list) or not v or any(isinstance(m, bool) or m not in range(1, 13) for m in v):
        return "must list months from 1 to 12"
    if len(set(v)) < len(v):
        return "names a month twice"
    try:
        season_start(tuple(v))
    except ValueError:
        return "must be contiguous months of one season"
    return None


def _covariates(v) -> str | None:
    return None if isinstance(v, list) and v and len(set(v)) == len(v) and set(v) <= set(COVARIATES) else f"takes {', '.join(COVARIATES)}, each once at most and one at least"


def _date(v) -> str | None:
    try:
        as_date(v)
    except ValueError:
        return "must be a date as YYYY-MM-DD"
    return None


def as_date(v) -> dt.date | None:
    if v is None or isinstance(v, dt.date):
        return v
    if not isinstance(v, str) or len(v) != 10:
        raise ValueError(v)
    return dt.date.fromisoformat(v)


SEED = 2**31 - 1
RULES = {
    ("input", "source"): _among("file", "cds"), ("input", "format"): _among("auto", "era5", "daily_tmax"),
    **{("input", k): _text for k in ("variable", "longitude", "latitude", "time")}, ("input", "units"): _units,
    ("input", "era5_cell_size_deg"): lambda v: v if v is None else _number(0, above=True)(v), ("output", "directory"): _text,
    ("period", "warm_season_months"): _months, ("period", "start_date"): _date, ("period", "end_date"): _date,
    ("heatwaves", "threshold_percentile"): _number(0, 100), ("heatwaves", "min_duration_days"): _number(1, whole=True), ("heatwaves", "min_exceeding_days"): _number(1, whole=True),
    ("regional_days", "percentile"): _number(0, 100), ("clustering", "eps_values"): _numbers(), ("clustering", "min_samples_values"): _numbers(True),
    ("ellipses", "scale_factor"): _number(0, above=True), ("power_law", "bootstrap_repetitions"): _number(1, whole=True),
    ("power_law", "seed_daily_maxima"): _number(-SEED, SEED, whole=True), ("power_law", "seed_event_maxima"): _number(-SEED, SEED, whole=True),
    ("lgcp", "covariates"): _covariates, ("lgcp", "raster_km"): _number(0, above=True), ("lgcp", "window_margin_km"): _number(0),
}


def _strict(loader, node):
    keys = [k.value for k, _ in node.value]
    twice = {k for k in keys if keys.count(k) > 1}
    if twice:
        raise ValueError(f"the configuration repeats {', '.join(sorted(twice))}")
    return {loader.construct_object(k, deep=True): loader.construct_object(v, deep=True) for k, v in node.value}


def loaded(path: str) -> dict:
    """A YAML file; a name that stands twice in a section is an error."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _strict)
    with open(path, encoding="utf-8") as f:
        return yaml.load(f, Loader) or {}


def read_config(config: str | dict | None = None, input_required: bool = True) -> dict:
    """The settings over the defaults, section by section; anything unknown or impossible is an error."""
    given = loaded(config) if isinstance(config, str) else config or {}
    if not isinstance(given, dict):
        raise ValueError("a configuration is a YAML file or a dict of sections")
    out = copy.deepcopy(DEFAULTS)
    for section, settings in given.items():
        if section not in DEFAULTS:
            raise ValueError(f"unknown section {section!r}")
        if not isinstance(settings, dict):
            raise ValueError(f"the section {section!r} must hold settings")
        unknown = set(settings) - set(DEFAULTS[section])
        if unknown:
            raise ValueError(f"unknown settings in {section!r}: {', '.join(map(str, sorted(unknown)))}")
        for key, value in settings.items():
            inner = DEFAULTS[section][key]
            if isinstance(inner, dict):
                if not isinstance(value, dict) or set(value) - set(inner):
                    raise ValueError(f"{section}: {key} must hold {', '.join(inner)}")
                value = inner | value
            elif isinstance(inner, list) and not isinstance(value, list):
                value = [value]
            out[section][key] = value
    for (section, key), rule in RULES.items():
        if message := rule(out[section][key]):
            raise ValueError(f"{section}: {key} {message}")
    for key in ("start_date", "end_date"):
        out["period"][key] = as_date(out["period"][key])
    first, last = out["period"]["start_date"], out["period"]["end_date"]
    if first and last and first > last:
        raise ValueError("period: end_date lies before start_date")
    named = [v for v in (out["input"][k] for k in ("longitude", "latitude", "time")) if v != "auto"]
    if len(set(named)) < len(named):
        raise ValueError("input: one dimension can't serve twice as longitude, latitude or time")
    _check_input(out, input_required)
    if os.path.isfile(out["output"]["directory"]):
        raise ValueError("output: directory is an existing file")
    for kind, dates in out["figures"]["representative_events"].items():
        most = 2 if kind == "type_3" else 1
        dates = dates if isinstance(dates, list) or dates is None else [dates]
        if dates is not None and (not 1 <= len(dates) <= most or any(map(_date, dates)) or len(set(map(str, dates))) < len(dates)):
            raise ValueError(f"figures: representative_events: {kind} needs up to {most} distinct dates as YYYY-MM-DD")
    return out


def _check_input(out: dict, required: bool) -> None:
    files = out["input"]["file"]
    files = [files] if isinstance(files, str) else files
    if files is not None and (not isinstance(files, list) or not files or any(_text(f) for f in files)):
        raise ValueError("input: file must be a path or a list of paths")
    if out["input"]["source"] == "cds":
        own = out["input"]["cds"]
        check_area(own["area"])
        for key, rule in {"cache_directory": _text, "processed_file": _text, "request_period": _among("month", "year")}.items():
            if message := rule(own[key]):
                raise ValueError(f"input: cds: {key} {message}")
        if not out["period"]["start_date"] or not out["period"]["end_date"]:
            raise ValueError("input: source cds needs period: start_date and end_date")
    elif required and files is None:
        raise ValueError("input: file is not set")
    elif required and (missing := [f for f in files if not os.path.exists(f)]):
        raise ValueError(f"input: file {missing[0]} does not exist")


def check_area(area) -> list[float]:
    """[north, west, south, east] in quarter degrees."""
    if not isinstance(area, list) or len(area) != 4 or any(_number()(x) for x in area):
        raise ValueError("input: cds: area must be [north, west, south, east]")
    north, west, south, east = area
    if not (-90 <= south < north <= 90 and -180 <= west < east <= 360) or any(abs(4 * x - round(4 * x)) > 1e-9 for x in area):
        raise ValueError("input: cds: area must go from south to north and west to east, in quarter degrees")
    return area


def as_yaml(settings: dict) -> str:
    import yaml

    return yaml.safe_dump(settings, sort_keys=False)


def template() -> str:
    """The defaults as YAML, to edit."""
    return as_yaml(DEFAULTS)
