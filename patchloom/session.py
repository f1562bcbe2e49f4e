"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that costs one more exchange after it
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str, name: str = "patchloom", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"patchloom-{application}-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A session that names none gets a temporary one, if it runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_dir(context.applicationId)


def materialize(df: DataFrame, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write a table into the shared folder and go on from it.

    That cuts the lineage, so a lost executor costs no recomputation, and as the table is columnar
    each later use reads only the columns it needs; with `partition_by`, only the folders of the values it asks for.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression) if compression else df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextlib.contextmanager
def joined_where_dealt(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside join where one key has dealt them out, though the join has more keys.

    Outside, Spark shuffles both sides anew by all keys of a join, and once more for what is grouped by the one key after it.
    """
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)
