"""Differences between two versions of a result table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame, keys: tuple[str, ...], tolerance: float = 1e-6) -> DataFrame:
    """(keys, problem, column, left, right): rows that only one has, and values that differ.

    Doubles may differ by tolerance times the larger of both, or of 1; null equals null
    and NaN NaN. Other columns than right's are a problem of the whole table (keys null).
    """
    columns = [c for c in left.columns if c not in keys]
    odd = sorted(set(left.columns) ^ set(right.columns))
    both = [c for c in columns if c in right.columns]
    doubles = {c for c, t in left.dtypes if t in ("double", "float")}

    def unlike(c: str) -> Column:
        a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
        if c in doubles:
            near = F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
            return ~(a.eqNullSafe(b) | F.coalesce(near, F.lit(False)))
        return ~a.eqNullSafe(b)

    here, there = left.withColumn("_here", F.lit(True)).alias("l"), right.withColumn("_there", F.lit(True)).alias("r")
    on = reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    found = here.join(there, on, "full")
    text = lambda c: F.col(c).cast("string")
    one = lambda problem, c, a, b: F.struct(F.lit(problem).alias("problem"), F.lit(c).cast("string").alias("column"), a.alias("left"), b.alias("right"))
    none = F.lit(None).cast("string")
    lone = F.when(F.col("_there").isNull(), F.array(one("only left", None, none, none))).when(F.col("_here").isNull(), F.array(one("only right", None, none, none)))
    values = F.filter(F.array(*[F.when(unlike(c), one("differs", c, text(f"l.{c}"), text(f"r.{c}"))) for c in both]), lambda x: x.isNotNull()) if both else F.array().cast("array<struct<problem string, column string, left string, right string>>")
    rows = found.select(*[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys], F.explode(F.coalesce(lone, values)).alias("p")).select(*keys, "p.*")
    if odd:
        table = left.sparkSession.range(1).select(*[F.lit(None).cast(left.schema[k].dataType).alias(k) for k in keys], F.explode(F.array(*[F.lit(c) for c in odd])).alias("column"))
        rows = rows.unionByName(table.select(*keys, F.lit("column of one").alias("problem"), "column", none.alias("left"), none.alias("right")))
    return rows
