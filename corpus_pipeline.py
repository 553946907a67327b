"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as
Parquet in the shared folder and gives it, read again, to the next. A result owns the
tables that it reads: they stay until close() is called on it, or till Python ends.
run() closes its stages as soon as what they return is written.
"""

from __future__ import annotations

import atexit
import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swelter.llm import linededup, minhash, mixing, packing, quality
from swelter.llm.common import delete, owned, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def owning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with owned() as mine:
            out = f(spark, docs, sf_dir)
        return _with_tables(out, mine)

    return owning


def _with_tables(out: DataFrame, tables: list[str]) -> DataFrame:
    out._tables = tables
    atexit.register(delete, out.sparkSession, tables)
    return out


def close(result: DataFrame) -> None:
    """Deletes the tables that a stage's or run()'s result reads; neither it nor what was made of it can be read then."""
    delete(result.sparkSession, result._tables)


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base rules nor a certified cutoff rejects."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"), "lang").select(*COLUMNS)


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of three-line windows; n_chars follows, nothing else changes.

    A document of which no line with a word is left has no text any more and goes.
    """
    out = linededup.deduped(docs.select(*COLUMNS))
    left = out.where((F.col("_n_removed") < F.col("_n_lines")) | (F.col("_n_lines") == 0))
    changed = F.col("_n_removed") > 0
    return left.withColumns({"text": F.col("_text"), "n_chars": F.when(changed, F.length("_text").cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the least doc_id."""
    return minhash.one_of_each(docs.select(*COLUMNS))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so repeated rows are meant."""
    out = mixing.mixed(docs.select(*COLUMNS))
    return out.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_copies")))).where("_copies > 0").select(*COLUMNS)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048; copies are told apart by row."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack),
]

#: Tokenizing and alignment have no SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, f) in enumerate(STAGES):
        out = f(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return _with_tables(out, [*before, *out._tables])
        with owned() as mine:
            docs = written(out, f"stage{k}")
        close(out)
        delete(spark, before)
        before = mine
