"""Files on any Hadoop file system as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.convert import supported_suffixes
from scriptorium.functions.text import file_suffix


def _qualified(spark: SparkSession, root: str) -> tuple[str, bool]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = fs.makeQualified(path)
    if not fs.exists(full):
        raise FileNotFoundError(root)
    return full.toString(), fs.getFileStatus(full).isFile()


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, mtime, length, content) of all supported files below ``root``.

    Paths are relative to the folder.  A query that does not ask for
    ``content`` reads file metadata only.
    """
    full, single = _qualified(spark, root)
    base = full.rsplit("/", 1)[0] if single else full
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(full)
    relative = F.substring(F.col("path"), len(base) + 2, 2**31 - 1)
    rows = files.select(
        relative.alias("file_path"), F.col("modificationTime").alias("mtime"), "length", "content"
    )
    return rows.filter(file_suffix(F.col("file_path")).isin(*supported_suffixes()))


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    return scan_files(spark, root).select("file_path", "mtime")
