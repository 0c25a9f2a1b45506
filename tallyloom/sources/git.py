"""Git histories as data sources: ``git_log`` (commits of a window) and ``git_commits`` (raw records with files and diff).

    spark.dataSource.register(GitLog); spark.read.format("git_log").option("path", repo).option("since", "90 days ago").load()

The repository must be at the same path on every machine that reads it. Record reading is split by ranges of commits.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Formats of git's output.
LOG_FORMAT = "--format=%H%x1f%cI%x1f%aN"
RECORD = r"(?s)^\n?([0-9a-f]{40}|[0-9a-f]{64})\x1f([^\x1f]*)\x1f(.*)\z"
RENAMES = ("--find-renames", "--find-copies-harder", "-l20000")
PER_PARTITION = 200


def git(path: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", path, *args], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def is_repository(path: str) -> bool:
    done = subprocess.run(["git", "-C", path, "rev-parse", "--is-inside-work-tree"], capture_output=True, check=False)
    return done.returncode == 0 and done.stdout.strip() == b"true"


def log_records(text: str) -> Iterator[tuple[str, str, str, datetime]]:
    """sha, date, author, moment of each well-formed record; an author may hold any character but NUL."""
    pattern = re.compile(RECORD.replace(r"\z", r"\Z"))
    for record in text.split("\x00"):
        m = pattern.match(record)
        if m:
            try:
                yield m[1], m[2], m[3], datetime.fromisoformat(m[2]).astimezone(timezone.utc)
            except ValueError:
                continue


def records_column(raw: Column) -> Column:
    """The same as an array of struct(sha, date_iso, author), for log output that is already a column."""
    found = F.filter(F.split(raw, "\x00"), lambda x: x.rlike(RECORD) & F.try_to_timestamp(F.regexp_extract(x, RECORD, 2)).isNotNull())
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, RECORD, 1).alias("sha"), F.regexp_extract(x, RECORD, 2).alias("date_iso"), F.regexp_extract(x, RECORD, 3).alias("author")))


class _Range(InputPartition):
    def __init__(self, first: int, shas: list[str]):
        self.first, self.shas = first, shas


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path") or "."
        self.repo = options.get("repo") or self.path
        self.window = [f"--since={options.get('since') or '1970-01-01'}", *([f"--until={options['until']}"] if options.get("until") else [])]

    def commits(self) -> list[tuple[str, str, str, datetime]]:
        # The window goes to git, so older commits are never read.
        return list(log_records(git(self.path, "log", "-z", "--reverse", "--use-mailmap", *self.window, LOG_FORMAT)))


class _LogReader(_Reader):
    def read(self, partition):
        for seq, (sha, date, author, at) in enumerate(self.commits()):
            yield self.repo, seq, sha, author, date, at


class _RecordReader(_Reader):
    def partitions(self):
        shas = [c[0] for c in self.commits()]
        return [_Range(i, shas[i : i + PER_PARTITION]) for i in range(0, len(shas), PER_PARTITION)] or [_Range(0, [])]

    def read(self, partition):
        if not partition.shas:
            return
        parents = {x[0]: len(x) - 1 for line in git(self.path, "rev-list", "--no-walk=unsorted", "--parents", *partition.shas).split("\n") if (x := line.split())}
        both = self.by_commit(partition.shas, "--raw", "--numstat", "-z", "--no-abbrev")
        diffs = self.by_commit(partition.shas, "--patch", "--no-color", "--unified=3")
        for seq, sha in enumerate(partition.shas, partition.first):
            yield self.repo, seq, sha, parents[sha], changed_files(both[sha]), diffs[sha].lstrip("\n")

    def by_commit(self, shas: list[str], *args: str) -> dict[str, str]:
        """What git shows of each commit, by one process for all; a commit's part starts behind a line that no diff has, its own digest's."""
        mark = f"\x01{shas[0]}\x01"
        out = git(self.path, "show", f"--format={mark}%H{mark}", *args, *RENAMES, *shas)
        parts = out.split(mark)[1:]
        return {sha: text.lstrip("\x00") for sha, text in zip(parts[::2], parts[1::2], strict=True)}


def changed_files(text: str) -> list[tuple[int, str, str, int, int]]:
    """file_no, status letter with its share, path, lines added and removed from NUL-separated ``--raw --numstat`` output."""
    fields = [x.lstrip("\n") for x in text.split("\x00")]
    files, counts, at = [], [], 0
    while at < len(fields):
        x = fields[at]
        if x.startswith(":"):
            letter = x.split(" ")[-1]
            two = letter[0] in "RC"
            files.append((letter, fields[at + 2] if two else fields[at + 1]))
            at += 3 if two else 2
        elif x.count("\t") >= 2:
            added, removed, path = x.split("\t", 2)
            counts.append((int(added) if added.isdigit() else 0, int(removed) if removed.isdigit() else 0))
            at += 3 if path == "" else 1
        else:
            at += 1
    return [(i, letter, path, *(counts[i] if i < len(counts) else (0, 0))) for i, (letter, path) in enumerate(files)]


class GitLog(DataSource):
    """Options: path, since, until, repo (label)."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "repo string, seq bigint, sha string, author string, date_iso string, ts timestamp"

    def reader(self, schema):
        return _LogReader(self.options)


class GitCommits(DataSource):
    """Raw records: parents, files by name status zipped with numstat, and the unified diff."""

    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return "repo string, seq bigint, sha string, parents int, files array<struct<file_no:int,letter:string,path:string,added:int,removed:int>>, diff string"

    def reader(self, schema):
        return _RecordReader(self.options)


class _TreeReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.rev = options.get("rev") or "HEAD"

    def partitions(self):
        rows = [x.split("\t", 1) for x in git(self.path, "ls-tree", "-r", "-z", self.rev).split("\x00") if x]
        blobs = [f"{meta.split()[2]} {name}" for meta, name in rows if meta.split()[0] != "120000" and meta.split()[1] == "blob"]
        return [_Range(i, blobs[i : i + PER_PARTITION]) for i in range(0, len(blobs), PER_PARTITION)] or [_Range(0, [])]

    def read(self, partition):
        if not partition.shas:
            return
        rows = [row.split(" ", 1) for row in partition.shas]
        asked = "".join(f"{blob}\n" for blob, _ in rows).encode()
        done = subprocess.run(["git", "-C", self.path, "cat-file", "--batch"], input=asked, capture_output=True, check=False)
        if done.returncode:
            raise RuntimeError(f"git cat-file failed: {done.stderr.decode(errors='replace').strip()}")
        at = 0
        for _, name in rows:
            end = done.stdout.index(b"\n", at)
            size = int(done.stdout[at:end].split()[-1])
            yield self.repo, name, done.stdout[end + 1 : end + 1 + size].decode("utf-8", "replace")
            at = end + 2 + size


class GitTree(DataSource):
    """The files of a commit (option ``rev``), links left out: repo, path, text."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "repo string, path string, text string"

    def reader(self, schema):
        return _TreeReader(self.options)


class _FilesReader(_Reader):
    def partitions(self):
        names = sorted({x for x in git(self.path, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\x00") if x})
        return [_Range(i, names[i : i + PER_PARTITION]) for i in range(0, len(names), PER_PARTITION)] or [_Range(0, [])]

    def read(self, partition):
        for name in partition.shas:
            file = Path(self.path) / name
            if file.is_file() and not file.is_symlink():
                yield self.repo, name, file.read_bytes().decode("utf-8", "replace")


class GitFiles(DataSource):
    """The files of a working tree, tracked ones and new ones that no ignore rule names; links left out: repo, path, text."""

    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return "repo string, path string, text string"

    def reader(self, schema):
        return _FilesReader(self.options)


def tracked(path: str) -> list[str]:
    """The paths that a repository tracks."""
    return [x for x in git(path, "ls-files", "-z").split("\x00") if x]


def register(spark) -> None:
    for source in (GitLog, GitCommits, GitTree, GitFiles):
        spark.dataSource.register(source)
