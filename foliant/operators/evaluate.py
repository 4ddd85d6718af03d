"""Retrieval quality: hit@1, @3, @10 and mean reciprocal rank, by engine and group and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 10


def first_ranks(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """results(engine, query_id, path, rank), qrels(query_id, group, path) -> engine, query_id, group, rank of the first expected document (null if none in DEPTH)."""
    engines = results.select("engine").distinct()
    asked = qrels.select("query_id", "group").distinct().join(F.broadcast(engines))  # a handful of engines
    found = results.where(F.col("rank") <= DEPTH).join(qrels.select("query_id", "path").distinct(), ["query_id", "path"]).groupBy("engine", "query_id").agg(F.min("rank").alias("rank"))
    return asked.join(found, ["engine", "query_id"], "left")


def metrics(ranks: DataFrame) -> DataFrame:
    """engine, group (null: overall), queries, hit1, hit3, hit10, mrr."""
    ranks.createOrReplaceTempView("foliant_ranks")
    hit = lambda k: f"avg(CASE WHEN rank <= {k} THEN 1.0D ELSE 0.0D END) AS hit{k}"
    return ranks.sparkSession.sql(
        f"SELECT engine, `group`, count(*) AS queries, {hit(1)}, {hit(3)}, {hit(10)}, avg(coalesce(1.0D / rank, 0.0D)) AS mrr FROM foliant_ranks GROUP BY GROUPING SETS ((engine), (engine, `group`))"
    )


def unknown_expected(qrels: DataFrame, documents: DataFrame) -> DataFrame:
    """Expected paths that the library doesn't hold; a set with any is refused."""
    return qrels.join(documents.select("path"), "path", "left_anti").select("path").distinct()
