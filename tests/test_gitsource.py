"""A repository read in ranges of commits gives the same commits as its whole log."""

import os
import subprocess

from scriptorium.sources import gitlog
from scriptorium.sources.gitsource import read_repository


def make_repo(path, commits=23):
    env = {**os.environ, "GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x"}

    def git(*arguments):
        subprocess.run(["git", "-C", str(path), *arguments], check=True, env=env, capture_output=True)

    git("init", "-q")
    for i in range(commits):
        (path / f"f{i % 3}.txt").write_text(str(i))
        git("add", "-A")
        git("commit", "-q", "-m", f"subject {i}", "-m", f"body {i}")


def test_ranges_give_the_whole_log(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    make_repo(repo)
    gitlog.write_log(spark, str(repo), str(tmp_path / "log"))
    want = sorted((r.hash, r.subject, r.body, tuple(r.files)) for r in gitlog.read_log(spark, str(tmp_path / "log")).collect())
    found = read_repository(spark, str(repo), commits_per_task="5")
    assert found.rdd.getNumPartitions() == 5
    assert sorted((r.hash, r.subject, r.body, tuple(r.files)) for r in found.collect()) == want and len(want) == 23
    assert read_repository(spark, str(repo), until="2001-01-01").count() == 0
