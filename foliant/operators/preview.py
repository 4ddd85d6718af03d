"""Chunks around a place: as-of lookup of the chunk that holds a line, and its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_chunk(places: DataFrame, chunks: DataFrame, keep: str = "body") -> DataFrame:
    """places(path, line) -> the chunk that starts last at or before the line, else the first of the document: path, line, start, keep."""
    c = chunks.select("path", F.col("line").alias("start"), F.col(keep).alias("kept"))
    at = F.struct("start", "kept")
    got = places.join(c, "path").groupBy("path", "line").agg(F.max_by(at, F.when(F.col("start") <= F.col("line"), F.col("start"))).alias("a"), F.min_by(at, "start").alias("b"))
    one = F.coalesce("a", "b")
    return got.select("path", "line", one["start"].alias("start"), one["kept"].alias(keep))


def asof_bookmark(pages: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """pages(path, page), bookmarks(path, page, ord, heading) -> pages with the last bookmark at or before each; list order breaks ties."""
    marks = bookmarks.select("path", "page", "ord", "heading", F.lit(0).alias("is_page"))
    both = marks.unionByName(pages.select("path", "page", F.lit(1).alias("is_page")), allowMissingColumns=True)
    order = W.partitionBy("path").orderBy("page", "is_page", "ord").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("heading", F.last("heading", True).over(order)).where("is_page = 1").select("path", "page", "heading")


def neighbours(chunks: DataFrame, hits: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """hits(path, line): chunks within reach of each hit chunk, with `offset` from it and how many lie outside either way."""
    own = W.partitionBy("path")
    numbered = chunks.join(hits.select("path").distinct(), "path", "left_semi").withColumns({"at": F.row_number().over(own.orderBy("line")), "n": F.count("*").over(own)})
    hit = numbered.join(hits.select("path", "line"), ["path", "line"], "left_semi").select("path", F.col("at").alias("hit_at"), F.col("line").alias("hit_line"))
    near = numbered.join(hit, "path").where(F.col("at").between(F.col("hit_at") - before, F.col("hit_at") + after))
    return near.select("path", "hit_line", "line", "body", (F.col("at") - F.col("hit_at")).alias("offset"), F.greatest(F.col("hit_at") - before - 1, F.lit(0)).alias("earlier"), F.greatest(F.col("n") - F.col("hit_at") - after, F.lit(0)).alias("later"))
