"""Intermediate tables in the folder that driver and executors share.

A table is written as Parquet, which cuts the lineage and survives lost executors, and is
deleted when its scope ends: scratch() opens one. A query's result owns what it reads
(owning()) until close() is called on it; what lies in no scope, or is never closed, goes
when the session's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_state = threading.local()
_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    In local mode, where it may be unset, a temporary folder takes its place; on a
    cluster a missing setting is an error, as no machine's own folder would do.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local") or "local-cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        global _local
        _local = _local or tempfile.mkdtemp(prefix="swelter-")
        path = f"file://{_local}"
    return path.rstrip("/")


def _scopes() -> list[list[str]]:
    if not hasattr(_state, "scopes"):
        _state.scopes = []
    return _state.scopes


def new_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path in the shared folder; keep gives it to the scope around the current one."""
    path = f"{shared_dir(spark)}/swelter/{label}-{uuid.uuid4().hex}"
    scopes = _scopes()
    at = len(scopes) - 1 - keep
    if at >= 0:
        scopes[at].append(path)
    else:
        atexit.register(delete, spark, [path])
    return path


def delete(spark: SparkSession, paths: list[str]) -> None:
    with contextlib.suppress(Exception):  # a lost session leaves its folder behind
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


@contextlib.contextmanager
def owned() -> Iterator[list[str]]:
    """Collects the paths made inside and not kept from; whoever opened it deletes them."""
    scopes, mine = _scopes(), []
    scopes.append(mine)
    try:
        yield mine
    finally:
        scopes.pop()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at its end, but for those written with keep=True.

    For loops and steps whose result is itself written, so nothing lazy reads them later.
    """
    with owned() as mine:
        yield
    delete(spark, mine)


def owning(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, whose result owns the tables that were written for it and not deleted since."""

    @functools.wraps(f)
    def made(*args, **kwargs) -> DataFrame:
        with owned() as mine:
            out = f(*args, **kwargs)
        out._tables = mine
        atexit.register(delete, out.sparkSession, mine)
        return out

    return made


def close(result: DataFrame) -> None:
    """Deletes the tables that an owning function's result reads; neither it nor what was made of it can be read then."""
    delete(result.sparkSession, result._tables)


#: Spark's setting by which an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
#: By session: how many writes are under way, and the setting before the first of them.
_writes: dict[str, tuple[int, str]] = {}


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting is on while any thread of the session writes; the last to end sets it back."""
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _writes.get(session, (0, ""))
        if not n:
            before = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writes[session] = (n + 1, before)
    try:
        yield
    finally:
        with _lock:
            n, before = _writes.pop(session)
            if n > 1:
                _writes[session] = (n - 1, before)
            else:
                spark.conf.set(CLEANUP, before)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder; its shuffle files go once it is written."""
    spark = df.sparkSession
    path = new_path(spark, label, keep)
    with _cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
