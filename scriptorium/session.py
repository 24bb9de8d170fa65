"""Session settings, the shared scratch folder, and size-checked small sides."""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on.  Partition counts are left to
# adaptive execution: the initial number is an upper bound that it coalesces.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "scriptorium", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Bytes of one Arrow batch where whole texts or their words travel in it.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that the session's Python stages receive."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables.

    Taken from ``spark.checkpoint.dir``.  Only a local session without that
    setting gets a temporary folder, since a machine-local path would not be
    visible to the other executors of a cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="scriptorium-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_table(spark: SparkSession, name: str) -> str:
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def table_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(target)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage."""
    spark = df.sparkSession
    path = scratch_table(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Pinned(NamedTuple):
    """A small frame as a local relation, with its rows at hand on the driver."""

    frame: DataFrame
    rows: list[dict]


def pin_small(df: DataFrame, max_rows: int, max_bytes: int) -> Pinned | None:
    """Return ``df`` as a local relation when it is proven small, else ``None``.

    At most ``max_rows + 1`` rows come to the driver.  A local relation has an
    exact size, so Spark can choose a broadcast join for it by itself; when the
    bound is exceeded the caller goes on with the distributed frame.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > max_bytes:
        return None
    return Pinned(df.sparkSession.createDataFrame(table, schema=df.schema), table.to_pylist())
