"""Intermediate tables that every executor can read again after a lost one.

They are plain Parquet tables below the folder the cluster names in ``spark.checkpoint.dir``. Where that setting is
absent a local master, whose executors are this process, gets a temporary folder; any other master is refused.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []
_on_the_way: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other table uses; it is removed when the driver ends."""
    path = f"{root(spark)}/tessella/{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    if (paths := _on_the_way.get()) is not None:
        paths.append(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once and read back: its lineage ends at files in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def alone(make: Callable[[], DataFrame], name: str, **options: str) -> DataFrame:
    """What ``make`` returns, written; the tables that ``make`` wrote on the way are removed, as nothing else may read them."""
    paths: list[str] = []
    outer = _on_the_way.set(paths)
    try:
        df = make()
    finally:
        _on_the_way.reset(outer)
    out = written(df, name, **options)
    for path in paths:
        remove(df.sparkSession, path)
    _written[:] = [x for x in _written if x[1] not in paths]
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already; the folder belongs to the job and goes with it
            return
