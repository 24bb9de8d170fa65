"""A repository's log as a Spark data source with many readers.

``spark.dataSource.register(GitLogSource)``, then
``spark.read.format("git_log").option("repo", "/shared/repo").load()`` gives the records that
``gitlog.parse_records`` reads.  The repository has to be visible to the executors.  Options:
``repo``, ``revision`` (HEAD), ``merges`` (false), ``commits_per_task`` (5000), and the limits
``since``, ``until`` and ``author`` of the command itself.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scriptorium.sources import gitlog

COMMITS_PER_TASK = 5000
LIMITS = ("since", "until", "author")


class CommitRange(InputPartition):
    """``count`` commits of the log of one fixed revision, after the first ``skip``."""

    def __init__(self, revision: str, skip: int, count: int) -> None:
        self.revision, self.skip, self.count = revision, skip, count


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.repo = options["repo"]
        self.revision = options.get("revision", "HEAD")
        self.merges = options.get("merges", "false").lower() == "true"
        self.step = int(options.get("commits_per_task", COMMITS_PER_TASK))
        self.limits = {name: options[name] for name in LIMITS if options.get(name)}

    def _git(self, *arguments: str) -> str:
        return subprocess.run(["git", "-C", self.repo, *arguments], check=True, capture_output=True, text=True).stdout.strip()

    def partitions(self) -> list[InputPartition]:
        # The revision is fixed here, so commits that come in meanwhile shift no range.
        revision = self._git("rev-parse", self.revision)
        chosen = [f"--{name}={value}" for name, value in self.limits.items()]
        total = int(self._git("rev-list", "--count", *chosen, *([] if self.merges else ["--no-merges"]), revision))
        return [CommitRange(revision, at, min(self.step, total - at)) for at in range(0, total, self.step)] or [CommitRange(revision, 0, 0)]

    def read(self, partition: CommitRange) -> Iterator[tuple[str]]:
        if not partition.count:
            return
        window = [f"--skip={partition.skip}", f"--max-count={partition.count}", partition.revision]
        command = ["git", "-C", self.repo, *gitlog.log_arguments(self.merges, **self.limits), *window]
        rest = b""
        with subprocess.Popen(command, stdout=subprocess.PIPE) as git:
            while block := git.stdout.read(gitlog.BLOCK_BYTES):
                *whole, rest = (rest + block).split(gitlog.RECORD.encode())
                for record in whole:
                    yield (record.decode("utf-8", "replace"),)
        if rest:
            yield (rest.decode("utf-8", "replace"),)
        if git.returncode:
            raise RuntimeError(f"the log of {self.repo} cannot be read")


class GitLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(dict(self.options))


def read_repository(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    """Commits of a repository, read side by side."""
    spark.dataSource.register(GitLogSource)
    return gitlog.parse_records(spark.read.format("git_log").options(repo=repo, **options).load())
