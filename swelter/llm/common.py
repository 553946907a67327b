"""What several operators share: table access, free column names, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swelter.shared import delete, new_path, owned, owning, scratch, written  # noqa: F401

#: Words of the engine: runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(columns: list[str], name: str) -> str:
    """name, or name with so many underscores more that no column has it (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hidden(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """df with columns of these names renamed, and the names to give them back."""
    back = {free(df.columns, f"_kept_{c}"): c for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed({v: k for k, v in back.items()}), back


def cols(columns: list[str]) -> list[Column]:
    """Columns by their plain names, whatever characters those hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def words_of(text: Column) -> Column:
    """Array of words; null and blank texts have none."""
    trimmed = F.trim(text, F.lit(_SPACE_CHARS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a name bound inside an expression.

    An expression used inside a lambda is otherwise evaluated for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
