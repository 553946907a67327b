"""Exact ranks and running totals over a whole table, by many tasks.

Rows are dealt to buckets of their order's first column, at splits that a sketch of its
quantiles gives. Totals of buckets, one row each, are summed up in order; each bucket
sums its own rows. Equal values are one row first, and rows of one value are dealt again
by the column that breaks ties, so no bucket grows with a value that many rows share.
Totals are decimals, so they don't depend on the order in which tasks finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Buckets, and the sketch's accuracy: a bucket's share is off by less than 1 / ACCURACY.
BUCKETS, ACCURACY = 200, 10_000
TOTAL = "decimal(38,12)"


def bucketed(rows: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """rows with `_bucket`, which grows with the number `by`."""
    n = n or BUCKETS
    splits = rows.agg(F.array_distinct(F.percentile_approx(by, [k / n for k in range(1, n)] or [0.0], ACCURACY)).alias("s"))
    below = F.filter("_splits", lambda s: s < F.col(by))
    return rows.withColumn("_splits", splits.scalar()).withColumn("_bucket", F.coalesce(F.size(below), F.lit(0))).drop("_splits")


def _before(rows: DataFrame, by: str, total: str, down: bool, keys: tuple[str, ...] = (), n: int | None = None) -> DataFrame:
    """(keys, by, _before): total of all rows of the keys that come before; rows have one row for each by and keys."""
    order = F.desc if down else F.asc
    dealt = bucketed(rows, by, n)
    within = F.sum(total).over(W.partitionBy(*keys, "_bucket").orderBy(order(by)).rowsBetween(W.unboundedPreceding, -1))
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum(total).alias("_sum"))
    # one row for each bucket
    upto = F.sum("_sum").over(W.partitionBy(*(keys or (F.lit(0),))).orderBy(order("_bucket")).rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(*keys, "_bucket", F.coalesce(upto, F.lit(0).cast(TOTAL)).alias("_start"))
    out = dealt.withColumn("_within", F.coalesce(within, F.lit(0).cast(TOTAL))).join(starts, [*keys, "_bucket"])
    return out.select(*keys, by, (F.col("_within") + F.col("_start")).cast(TOTAL).alias("_before"))


def totals_by_value(rows: DataFrame, by: str, value: Column, down: bool = False, keys: tuple[str, ...] = (), n: int | None = None) -> DataFrame:
    """(keys, by, of, before): for each distinct by, the total of its rows and of all before it.

    Rows without a by (null) take no part.
    """
    own = rows.where(F.col(by).isNotNull()).groupBy(*keys, by).agg(F.sum(value.cast(TOTAL)).cast(TOTAL).alias("of"))
    before = _before(own, by, "of", down, keys, n).withColumnRenamed("_before", "before")
    return own.join(before, [*keys, by])


def running(rows: DataFrame, by: str, tie: str, value: Column, down: bool = False, name: str = "before", n: int | None = None) -> DataFrame:
    """rows with the total of value over the rows before each: by its number `by`, then by the number `tie`, which grows.

    Rows that agree in both are in no order, and each counts none of the others.
    """
    valued = rows.withColumn("_value", value.cast(TOTAL))
    firsts = totals_by_value(valued, by, F.col("_value"), down, n=n).select(F.col(by).alias("_by"), F.col("before").alias("_first"))
    each = valued.groupBy(by, tie).agg(F.sum("_value").cast(TOTAL).alias("_of"))
    later = _before(each, tie, "_of", False, (by,), n).select(F.col(by).alias("_by2"), F.col(tie).alias("_tie"), F.col("_before").alias("_later"))
    out = valued.join(firsts, F.col(by) == F.col("_by")).join(later, (F.col(by) == F.col("_by2")) & (F.col(tie) == F.col("_tie")))
    return out.withColumn(name, F.col("_first") + F.col("_later")).drop("_value", "_by", "_first", "_by2", "_tie", "_later")


def significant(x: Column, digits: int) -> Column:
    """x rounded to so many digits, whatever its size, so that sums made in another order are equal."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)
