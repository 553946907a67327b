"""Tables go with their scopes and results; threads of one session don't undo each other's setting."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from swelter import shared


def files(df):
    return [p.removeprefix("file://").removeprefix("file:") for p in df.inputFiles()]


def test_scopes_delete_what_they_do_not_give_on(spark):
    with shared.owned() as outer:
        with shared.scratch(spark):
            gone, kept = shared.written(spark.range(3), "gone"), shared.written(spark.range(4), "kept", keep=True)
        assert kept.count() == 4 and not any(os.path.exists(p) for p in files(gone)) and len(outer) == 1
    shared.delete(spark, outer)
    with pytest.raises(Exception, match="FILE_NOT_EXIST"):
        kept.count()


def test_results_own_their_tables(spark):
    @shared.owning
    def doubled(n):
        return shared.written(spark.range(n), "numbers").select((F.col("id") * 2).alias("x"))

    one, two = doubled(3), doubled(4)
    shared.close(one)
    assert two.count() == 4 and two.where("x > 2").count() == 2
    with pytest.raises(Exception, match="FILE_NOT_EXIST"):
        one.count()
    shared.close(two)


def test_threads_share_the_setting(spark):
    before, seen = spark.conf.get(shared.CLEANUP, "false"), []

    def work(k):
        for i in range(3):
            df = shared.written(spark.range(200).groupBy((F.col("id") % 7).alias("k")).count(), f"t{k}")
            seen.append(df.count())

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen == [7] * 12 and spark.conf.get(shared.CLEANUP, "false") == before and not shared._writes
