"""Line dedup by overlapping three-line windows.

Windows of three consecutive lines that hold a word (blank lines are stepped over) are
hashed to 128 bits. A window found more than once anywhere keeps its first place, by
doc_id and then position; at every later place its three lines are covered. Covered
positions that overlap are merged, and the covered lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import hidden, let, scratch, written

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _numbered(lines: Column) -> Column:
    """Places of the lines that hold a word."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())


def _version(text: Column) -> Column:
    """Tells rows of one doc_id with other texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, version, k, h): the k-th window of a row, k counting lines with a word."""

    def hashed(lines: Column) -> Column:
        full = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        at = lambda f, k: F.concat_ws("\n", *[F.get(f, k + j) for j in range(WINDOW)])
        return let(full, lambda f: F.when(F.size(f) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(f) - WINDOW), lambda k: F.unhex(F.md5(at(f, k))))))

    rows = docs.select(F.col(key).alias("key"), _version(F.col(text)).alias("version"), let(_lines(F.col(text)), hashed).alias("w"))
    return rows.select("key", "version", F.posexplode("w").alias("k", "h"))


def later_places(found: DataFrame) -> DataFrame:
    """(key, version, ks): per row the sorted places of windows that occurred before.

    The first places are one aggregate with partial minima, so a window that a third of
    all rows share costs each task one row; looking them up is a join that the optimizer
    splits where one hash is hot. ks is as long as the document's lines at most.
    """
    place = F.struct("key", "version", "k")
    first = found.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("_h"), "first")
    later = found.join(first, F.col("h") == F.col("_h")).where(place > F.col("first"))
    return later.groupBy("key", "version").agg(F.sort_array(F.collect_set("k")).alias("ks"))


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `_text` (the lines that stay), `_n_lines` (with a word) and `_n_removed`.

    Null and empty texts, and those of fewer than three lines with a word, stay as they
    are. Rows that repeat in key and text are one document: they lose the same lines and
    none on each other's account. Rows of one key with other texts are told apart, the
    smaller hash first. Null keys come first. Texts move once, to meet their places.
    Columns of docs with these three names are replaced, others stay whatever they are called.
    """
    with scratch(docs.sparkSession):
        places = written(later_places(written(windows(docs, key, text), "windows")), "places", keep=True)
    docs, back = hidden(docs, ("_key", "_v", "_ks", "_version", "_cut"))
    places = places.select(F.col("key").alias("_key"), F.col("version").alias("_v"), F.col("ks").alias("_ks"))
    rows = docs.withColumn("_version", _version(F.col(text)))
    # places grow with the texts, so the join is the same at every size
    joined = rows.join(places.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_version") == F.col("_v")), "left")

    def cut(lines: Column) -> Column:
        def of(full: Column) -> Column:
            covered = F.array_distinct(F.flatten(F.transform(F.col("_ks"), lambda k: F.sequence(k, k + WINDOW - 1))))
            gone = F.transform(covered, lambda i: F.get(full, i))
            kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
            text_of = let(kept, lambda ks: F.array_join(F.transform(ks, lambda i: F.get(lines, i)), "\n"))
            return F.struct(text_of.alias("text"), F.size(covered).alias("n"), F.size(full).alias("full"))

        return let(_numbered(lines), of)

    plain = let(_lines(F.col(text)), lambda x: F.struct(F.col(text).alias("text"), F.lit(0).alias("n"), F.size(_numbered(x)).alias("full")))
    out = joined.withColumn("_cut", F.when(F.col("_ks").isNull(), plain).otherwise(let(_lines(F.col(text)), cut)))
    return out.withColumns({"_text": F.col("_cut.text"), "_n_lines": F.col("_cut.full").cast("long"), "_n_removed": F.col("_cut.n").cast("long")}).drop("_key", "_v", "_ks", "_version", "_cut").withColumnsRenamed(back)
