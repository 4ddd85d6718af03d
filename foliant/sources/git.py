"""Git work trees, trees and histories as DataFrames, through git's own plumbing on the driver.

A repository's listing is metadata of one clone; contents are read by Spark from the work tree.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code, diff

HISTORY_LIMIT = 5000


class NotARepository(ValueError):
    pass


def git(root: str, *args: str) -> str:
    run = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    if run.returncode:
        raise NotARepository(f"{root}: {run.stderr.strip()[:200]}")
    return run.stdout


def head(root: str) -> str:
    return git(root, "rev-parse", "HEAD").strip()


def work_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, text of source files, ignore rules applied, in order of path."""
    listed = [p for p in git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0") if p.rpartition(".")[2].lower() in code.LANGUAGES]
    base = root.rstrip("/") + "/"
    if not listed:
        return spark.createDataFrame([], "path string, text string")
    raw = spark.read.format("binaryFile").load([base + p for p in sorted(listed)])
    rel = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(base) + 1, 1 << 30)
    return raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text")).orderBy("path")


def tree(spark: SparkSession, root: str, revision: str = "HEAD") -> DataFrame:
    """path, oid of the blobs of a commit."""
    rows = []
    for entry in filter(None, git(root, "ls-tree", "-r", "-z", revision).split("\0")):
        meta, path = entry.split("\t", 1)
        mode, kind, oid = meta.split(" ")
        if kind == "blob" and mode != "120000":
            rows.append((path, oid))
    return spark.createDataFrame(rows, "path string, oid string")


def source_tree(spark: SparkSession, root: str, revision: str = "HEAD") -> DataFrame:
    """path, oid of the files of a commit that an index of the work tree would hold: of a known language, and not ignored though checked in."""
    rows = tree(spark, root, revision).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*code.LANGUAGES))
    ignored = [p for p in git(root, "ls-files", "-z", "--cached", "--ignored", "--exclude-standard").split("\0") if p]
    return rows.join(F.broadcast(spark.createDataFrame([(p,) for p in ignored], "path string")), "path", "left_anti") if ignored else rows  # listed by git on the driver


def commits(spark: SparkSession, root: str, limit: int = HISTORY_LIMIT, known: set[str] = frozenset()) -> DataFrame:
    """id, nth, summary, body, author, time, paths (against the first parent, in order); commits in `known` carry no more than id and nth."""
    mark = "\x1e"
    out = git(root, "log", f"-{limit}", "--diff-merges=first-parent", "--name-only", "--no-renames", f"--format={mark}%H%x1f%an%x1f%at%x1f%B%x1f")
    rows = []
    for nth, part in enumerate(out.split(mark)[1:]):
        oid, author, time, message, names = part.split("\x1f")
        summary, _, body = message.strip().partition("\n")
        if oid in known:
            rows.append((oid, nth, None, None, None, None, None))
        else:
            rows.append((oid, nth, summary.strip(), body.strip() or None, author, int(time), sorted(x for x in names.strip().split("\n") if x)))
    return spark.createDataFrame(rows, "id string, nth int, summary string, body string, author string, time long, paths array<string>")


def matching(commits: DataFrame, text: str | None = None, touching: str | None = None) -> DataFrame:
    """Commits whose message holds a text, without case, and that touch a path or what lies under it."""
    if text:
        both = F.lower(F.concat_ws("\n", "summary", "body"))
        commits = commits.where(F.contains(both, F.lit(text.lower())))
    if touching:
        t = touching.rstrip("/")
        commits = commits.where(F.exists("paths", lambda p: (p == t) | p.startswith(t + "/")))
    return commits


def revision(spark: SparkSession, root: str) -> DataFrame:
    """id, short, dirty, label of the work tree."""
    changed = bool(git(root, "status", "--porcelain", "--untracked-files=normal").strip())
    oid = head(root)
    return spark.createDataFrame([(oid, oid[:8], changed, oid[:8] + "+dirty" * changed)], "id string, short string, dirty boolean, label string")


def changed_paths(spark: SparkSession, root: str, parent: str, child: str) -> DataFrame:
    return diff.symmetric_difference(tree(spark, root, parent), tree(spark, root, child))
