"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quern.work.dir", None)
    if not d:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.work.dir", d)
    return d.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """The session's setting ``key`` while what is inside runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def released(spark: SparkSession):
    """What is written inside leaves no shuffle files behind: they go when the write is over, not when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, name: str = "") -> DataFrame:
    """df as a table of its own: a short plan, and rows that outlive executors. name: what a trace calls the step."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/quern-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` gave; others stay as they are."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Temporary:
    """Takes the place of ``save`` in a step whose tables go when it is over."""

    def __init__(self, save=written):
        self.save, self.made = save, []

    def __call__(self, df: DataFrame, *name: str) -> DataFrame:
        self.made.append(self.save(df, *name))
        return self.made[-1]

    def drop(self, *keep: DataFrame) -> None:
        """Deletes all tables but those to keep."""
        dropped(*(t for t in self.made if not any(t is k for k in keep)))
        self.made = [t for t in self.made if any(t is k for k in keep)]
