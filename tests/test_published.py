"""Published numbers of the study: the event sample's fit and bootstrap, and projected centroids."""

import pytest
from pyspark.sql import functions as F

from swelter.functions import projection
from swelter.operators import power_law

#: Largest ellipse areas (km2) of the study's events, in order of time.
EVENT_AREAS = [
    790893.798233928, 3617358.70466645, 1391604.93628515, 1691752.04507695, 3719143.46332475, 2980790.49082269,
    2786813.40424396, 3261364.38076994, 2678205.37478572, 2349719.95529412, 4860803.72570241, 2008285.85418312,
    897540.185278645, 3158053.49171095, 2984801.28816302, 2090177.95506351, 2342560.33174277, 2349511.44311062,
    2267725.29311994, 3585652.39505466, 4079770.61232757, 3752825.0085132, 1711514.16484436, 4793893.81516227,
    1636214.79168516, 2609060.08680996, 2581618.07508956, 4750157.62914272, 2798038.87629478, 3630768.13770289,
    4204450.88888185, 3778092.61171746, 3280705.55687203, 1484707.70992636, 2142731.07612239, 2416638.83743077,
    4213116.00507659, 2773471.1021278, 2357307.68588787, 4268339.19254163, 2628545.67143199, 2378837.99756686,
    1186516.12545827, 6514507.33267634, 4600821.32167383, 5879192.19217634, 5915931.16521072, 4904080.67615317,
    2954199.32129361, 6274611.53994141, 2772356.97288526,
]
#: Lon, lat and their place (km) in the plane around 45 E, 28 N.
CENTROIDS = [
    (31.050475087611, 21.3900181985078, -1443.33935369977, -653.850851090725),
    (65.3462833380076, 43.3107558536013, 1648.09675152872, 1849.25443828632),
    (43.565988062887, 22.7293196423725, -147.447479204161, -582.87450672478),
    (25.3602147295869, 28.7169514135728, -1903.17133315874, 234.210141728163),
    (53.2761978242214, 28.2689193483788, 810.863893058087, 57.2604017947517),
    (38.153578499428, 34.0901390927072, -632.116149546141, 693.41180224876),
]


def test_event_sample_has_the_published_fit_and_bootstrap(spark):
    sample = spark.createDataFrame([("event_maxima", v) for v in EVENT_AREAS], "dataset string, area_km2 double")
    draws = power_law.bootstrap(spark, EVENT_AREAS, 5000, 20261120).select(F.lit("event_maxima").alias("dataset"), "*")
    r = power_law.summary(draws, power_law.fitted(sample)).first()
    assert (r.n, r.n_tail, r.n_exceed, r.reps, r.n_undefined, r.status) == (51, 19, 1680, 5000, 0, "ok")
    assert r.xmin_km2 == pytest.approx(3585652.39505466, rel=1e-12) and r.alpha == pytest.approx(5.34809238235305, rel=1e-12)
    assert r.ks_distance == pytest.approx(0.135429159065384, rel=1e-12) and r.p_value == 0.336


def test_a_sample_without_a_fit_says_so(spark):
    r = power_law.fitted(spark.createDataFrame([("a", 1.0)] * 3, "dataset string, area_km2 double")).first()
    assert (r.status, r.n, r.n_candidates, r.alpha) == ("no_candidates", 3, 0, None)


def test_projection_there_and_back(spark):
    df = spark.createDataFrame(CENTROIDS, "lon double, lat double, x double, y double")
    x, y = projection.forward(F.col("lon"), F.col("lat"), 45.0, 28.0)
    lon, lat = projection.inverse(F.col("x"), F.col("y"), 45.0, 28.0)
    for r in df.select("*", x.alias("px"), y.alias("py"), lon.alias("plon"), lat.alias("plat")).collect():
        assert (r.px, r.py) == pytest.approx((r.x, r.y), abs=1e-7) and (r.plon, r.plat) == pytest.approx((r.lon, r.lat), abs=1e-10)
    centre = spark.range(1).select(*projection.inverse(F.lit(0.0), F.lit(0.0), 45.0, 28.0)).first()
    assert tuple(centre) == pytest.approx((45.0, 28.0), abs=1e-12)
