"""Tables of a run, published together: written aside, then moved into place, or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


class Target:
    """A folder in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def move(self, name: str, to: str) -> bool:
        """Whether name was there; an error if it can't be moved."""
        if not self.fs.exists(self.path(name)):
            return False
        self.fs.mkdirs(self.path(to).getParent())
        if not self.fs.rename(self.path(name), self.path(to)):
            raise OSError(f"{self.folder}/{name} could not be moved to {to}")
        return True


def publish(spark: SparkSession, tables: dict[str, DataFrame], texts: dict[str, str], folder: str, managed: Iterable[str]) -> None:
    """Writes tables (Parquet) and texts, then puts them in place of what an earlier run left there.

    managed: all names that a run may publish; those that this one lacks go too, so that
    nothing stale stays beside new results. Other files stay. If a move fails, everything
    is moved back and the error is raised.
    """
    at, mark = Target(spark, folder), uuid.uuid4().hex
    stage, backup = f".stage-{mark}", f".backup-{mark}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{at.folder}/{stage}/{name}")
        for name, text in texts.items():
            out = at.fs.create(at.path(f"{stage}/{name}"))
            out.write(bytearray(text.encode()))
            out.close()
        done: list[tuple[str, str]] = []
        try:
            for name in managed:
                if at.move(name, f"{backup}/{name}"):
                    done.append((f"{backup}/{name}", name))
            for name in (*tables, *texts):
                at.move(f"{stage}/{name}", name)
                done.append((name, f"{stage}/{name}"))
        except Exception:
            for here, there in reversed(done):
                at.move(here, there)
            raise
    finally:
        for name in (stage, backup):
            at.fs.delete(at.path(name), True)
