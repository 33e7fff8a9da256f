"""Version-control history as DataFrames, read by the ``git`` program: lists on the driver, changes and contents in tasks."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from codestrata.session import frame_stage, spread


def _git(root: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True).stdout


#: Commits that one call of the program reads in a task.
CALL = 256


def commits(spark: SparkSession, root: str, ref: str = "HEAD", max_commits: int = 20_000, window_days: int | None = 365) -> DataFrame:
    """``id, commit_time, author, files``: commits from ``ref`` on, each with the paths that differ from its first parent.

    At most ``max_commits`` are walked, and none older than the window before the newest. The first commit lists its
    whole tree; commits without a difference have no files. The driver lists ids and times only; what a commit changed
    is read in tasks, so ``root`` must be a folder that all executors see.
    """
    listed = [line.split() for line in _git(root, "log", ref, f"--max-count={max_commits}", "--format=%H %ct").decode().splitlines()]
    if listed and window_days is not None:
        oldest = int(listed[0][1]) - window_days * 86_400
        listed = [(i, t) for i, t in listed if int(t) >= oldest]
    calls = [([i for i, _ in listed[n : n + CALL]],) for n in range(0, len(listed), CALL)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        args = ["git", "-C", root, "log", "--no-walk=unsorted", "--stdin", "--format=%x01%h%x02%ct%x02%an", "--abbrev=7", "--diff-merges=first-parent", "--name-only", "--root", "--no-renames", "-z"]
        for pdf in batches:
            for ids in pdf["ids"]:
                out = subprocess.run(args, input="\n".join(ids).encode(), capture_output=True, check=True).stdout.decode(errors="replace")
                rows = []
                for entry in out.split("\x01")[1:]:
                    head, _, names = entry.partition("\0")
                    commit, time, author = head.strip("\n").split("\x02")
                    rows.append((commit[:7], int(time), author, sorted({n.lstrip("\n") for n in names.split("\0") if n.strip("\n")})))
                yield pd.DataFrame(rows, columns=["id", "commit_time", "author", "files"])

    asked = spark.createDataFrame(calls, "ids array<string>").repartition(max(1, len(calls)))
    return asked.mapInPandas(frame_stage(read), "id string, commit_time long, author string, files array<string>")


def files_at(spark: SparkSession, root: str, ref: str, wanted=lambda path: True) -> DataFrame:
    """``path, blob, content`` of the wanted files of a commit's tree.

    The driver lists paths and ids only; contents are read in tasks, one after the other, so ``root`` must be a folder
    that all executors see.
    """
    entries = [(line.split(b"\t", 1)) for line in _git(root, "ls-tree", "-r", "-z", ref).split(b"\0") if line]
    blobs = sorted((path.decode(errors="replace"), meta.split()[2].decode()) for meta, path in entries if meta.split()[1] == b"blob")
    rows = [(p, b) for p, b in blobs if wanted(p)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as program:
            for pdf in batches:
                contents = []
                for blob in pdf["blob"]:
                    program.stdin.write(f"{blob}\n".encode())
                    program.stdin.flush()
                    size = int(program.stdout.readline().split()[2])
                    contents.append(program.stdout.read(size + 1)[:size])
                yield pdf.assign(content=contents)
            program.stdin.close()

    listed = spark.createDataFrame(rows, "path string, blob string")
    return spread(listed, "path", shuffled=True).mapInPandas(frame_stage(read), "path string, blob string, content binary")


def branches(spark: SparkSession, root: str) -> DataFrame:
    """``name, head, current``: local branches, the current one first."""
    current = _git(root, "rev-parse", "--abbrev-ref", "HEAD").decode().strip()
    names = [line.split(" ", 1) for line in _git(root, "for-each-ref", "--format=%(objectname:short=7) %(refname:short)", "refs/heads").decode().splitlines()]
    rows = sorted(((n, h, n == current) for h, n in names), key=lambda r: (not r[2], r[0]))
    return spark.createDataFrame(rows, "name string, head string, current boolean")


def repo_info(spark: SparkSession, root: str, config_name: str = "codestrata.toml") -> DataFrame:
    """One row: ``root, name, branch, head, is_git, has_config``; branch and head are null outside version control."""
    from pathlib import Path

    top, branch, head = Path(root).resolve(), None, None
    try:
        head = _git(root, "rev-parse", "--short=7", "HEAD").decode().strip()
        branch = _git(root, "rev-parse", "--abbrev-ref", "HEAD").decode().strip()
    except (subprocess.CalledProcessError, OSError):
        pass
    return spark.createDataFrame([(str(top), top.name, branch, head, head is not None, (top / config_name).exists())], "root string, name string, branch string, head string, is_git boolean, has_config boolean")
