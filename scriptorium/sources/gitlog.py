"""Commit logs: the command that writes one, and the parser of its text.

A log is a run of records.  Each begins with the record separator and holds seven
fields between unit separators: hash, author, address, date, subject, body, and the
names of the files, which end in NUL.  None of these characters can stand in a field.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD, UNIT, NAME_END = "\x1e", "\x1f", "\x00"
FIELDS = {"hash": "%H", "author": "%an", "author_email": "%ae", "date": "%aI", "subject": "%s", "body": "%b"}
BLOCK_BYTES = 1 << 20


def log_arguments(merges: bool = False, **limits: str | None) -> list[str]:
    """Arguments of ``git`` for a log in our format; ``limits`` are its own options, such as since."""
    layout = "--format=tformat:%x1e" + "".join(code + "%x1f" for code in FIELDS.values())
    chosen = [f"--{option}={value}" for option, value in limits.items() if value]
    return ["log", "-z", "--name-only", layout, *([] if merges else ["--no-merges"]), *chosen]


def write_log(spark: SparkSession, repo: str, target: str, merges: bool = False, **limits: str | None) -> None:
    """Stream the log of a local repository into a file on any Hadoop file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        with subprocess.Popen(["git", "-C", repo, *log_arguments(merges, **limits)], stdout=subprocess.PIPE) as git:
            while block := git.stdout.read(BLOCK_BYTES):
                out.write(bytearray(block))
    finally:
        out.close()
    if git.returncode:
        raise RuntimeError(f"the log of {repo} cannot be read")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of one or many log files; Spark splits the files at the records."""
    records = spark.read.option("lineSep", RECORD).text(path)
    return parse_records(records.select(F.col("value").alias("record")))


def parse_records(records: DataFrame) -> DataFrame:
    """One commit per record that has a hash."""
    parts = F.split("record", UNIT, len(FIELDS) + 1)
    trimmed = {name: F.btrim(F.get(parts, F.lit(i)), F.lit(" \t\r\n" + NAME_END)) for i, name in enumerate(FIELDS)}
    names = F.split(F.coalesce(F.get(parts, F.lit(len(FIELDS))), F.lit("")), f"[\n{NAME_END}]+")
    commits = records.select(*[F.coalesce(value, F.lit("")).alias(name) for name, value in trimmed.items()], F.array_remove(names, "").alias("files"))
    return commits.where("hash <> ''")


def commit_tables(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, files) as the history operators take them."""
    heads = commits.withColumn("commit_id", F.col("hash")).drop("files")
    files = commits.select(F.col("hash").alias("commit_id"), F.explode("files").alias("file")).distinct()
    return heads, files
