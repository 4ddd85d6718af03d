"""State of a library from its tables: what it holds, and which files could not be read in full."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status(manifest: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """documents, chunks; for each value of `by`, if given."""
    return manifest.groupBy(*by).agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def unread(manifest: DataFrame, skipped: DataFrame, sources: DataFrame) -> DataFrame:
    """why, path of files under a current source: skipped, textless, or read in a guessed encoding.

    manifest(path, source, textless, guessed), skipped(path, source, why), sources(path).
    """
    rows = skipped.select("path", "source", "why")
    rows = rows.unionByName(manifest.where("textless").select("path", "source", F.lit("textless").alias("why")))
    rows = rows.unionByName(manifest.where("guessed is not null").select("path", "source", F.concat(F.lit("guessed "), "guessed").alias("why")))
    return rows.join(sources.select(F.col("path").alias("source")), "source", "left_semi").select("why", "path")


def counts(unread: DataFrame) -> DataFrame:
    """why, n."""
    return unread.groupBy("why").agg(F.count("*").alias("n"))


def guessed_encodings(manifest: DataFrame) -> DataFrame:
    """encoding, n of documents whose encoding was guessed."""
    return manifest.where("guessed is not null").groupBy(F.col("guessed").alias("encoding")).agg(F.count("*").alias("n"))

