"""What changed: manifests against walked files, snapshots against snapshots. Hash joins on the path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_diff(before: DataFrame, after: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """key, change: added, changed, unchanged or removed."""
    b, a = before.select(key, F.col(value).alias("old")), after.select(key, F.col(value).alias("new"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return b.withColumn("b", F.lit(1)).join(a.withColumn("a", F.lit(1)), key, "full_outer").select(key, change.alias("change"))


def change_counts(diff: DataFrame) -> DataFrame:
    one = lambda c: F.count_if(F.col("change") == c).alias(c)
    parsed = F.count_if(F.col("change").isin("added", "changed"))
    return diff.agg(*map(one, ("added", "changed", "unchanged", "removed")), parsed.alias("parsed"), (F.count_if(F.col("change") != "unchanged") == 0).alias("no_op"))


def symmetric_difference(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Paths of two tree snapshots (path, oid) that differ, in order."""
    return change_diff(parent, child, "path", "oid").where("change != 'unchanged'").select("path")


def to_read(manifest: DataFrame, walked: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """walked files with `kept`: unchanged by size, time, source and reader, so need not be opened.

    refused(path, size, modified, source, reader, why): a file that was refused as it is now stays so, unless it could only not be opened.
    """
    cols = ["path", "size", "modified", "source", "reader"]
    known = manifest.select(*cols)
    if refused is not None:
        known = known.unionByName(refused.where("why != 'unopened'").select(*cols))
    known = known.select("path", *[F.col(c).alias(f"m_{c}") for c in cols[1:]])
    same = (F.col("size") == F.col("m_size")) & (F.col("modified") == F.col("m_modified")) & (F.col("source") == F.col("m_source")) & F.col("reader").eqNullSafe(F.col("m_reader"))
    kept = known.join(walked, "path").where(same).select("path").distinct().withColumn("kept", F.lit(True))
    return walked.join(kept, "path", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def removed(manifest: DataFrame, walked: DataFrame) -> DataFrame:
    return manifest.join(walked.select("path"), "path", "left_anti")


def dirty(committed: DataFrame, working: DataFrame) -> DataFrame:
    """One row: whether two sets of (path, hash) differ."""
    return change_diff(committed, working).agg(F.coalesce(F.max(F.col("change") != "unchanged"), F.lit(False)).alias("dirty"))


def reuse_history(reachable: DataFrame, stored: DataFrame) -> DataFrame:
    """reachable(id, nth) with what is stored of each commit; `read` marks those that must be read. Others vanish."""
    return reachable.join(stored.withColumn("here", F.lit(True)), "id", "left").withColumn("read", F.col("here").isNull()).drop("here")


def union_scope(left: DataFrame, right: DataFrame) -> DataFrame:
    """Scopes (everything, path): one that says everything absorbs the rest."""
    both = left.unionByName(right).distinct()
    whole = both.where("everything").select("everything", F.lit(None).cast("string").alias("path")).limit(1)
    return whole.unionByName(both.join(whole.select(F.lit(True).alias("w")), F.col("w"), "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, removed: DataFrame | None = None, key: str = "path") -> DataFrame:
    """table with all rows of the changed keys replaced and those of removed keys gone."""
    gone = rows.select(key) if removed is None else rows.select(key).unionByName(removed.select(key))
    return table.join(gone.distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def covers(stored: DataFrame, now: DataFrame) -> DataFrame:
    """One row: whether what is stored of one revision (id, dirty) stands for another: the same commit, and neither tree has edits."""
    a, b = stored.select(F.col("id").alias("a"), F.col("dirty").alias("da")), now.select(F.col("id").alias("b"), F.col("dirty").alias("db"))
    return a.join(b, F.col("a") == F.col("b")).agg((F.count_if(~F.col("da") & ~F.col("db")) > 0).alias("covers"))
