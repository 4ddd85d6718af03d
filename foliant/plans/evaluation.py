"""A query set against a library: the rank of the first expected document by words, by meaning and in the one list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, passages
from ..sources.store import query_set
from .library import Library

ENGINES = ("words", "meaning", "hybrid")


class UnknownExpected(ValueError):
    """The set expects documents that the library doesn't hold."""


def expected_paths(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """asked(query_id, group, path) with each path as the library has it, or null; a path may leave leading folders out."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    there = documents.select(F.col("path").alias("full")).distinct().withColumn("name", name("full"))
    fits = (F.col("full") == F.col("path")) | F.col("full").endswith(F.concat(F.lit("/"), "path"))
    found = asked.withColumn("name", name("path")).join(there, "name").where(fits).groupBy("query_id", "path").agg(F.min("full").alias("full"))
    return asked.join(found, ["query_id", "path"], "left")


def evaluate_set(library: Library, path: str, now: int | None = None) -> DataFrame:
    """engine, group (null: overall), queries, hit1, hit3, hit10, mrr.

    Questions are written by people and asked one after another, each as one distributed search; what
    comes back is at most DEPTH rows for a question and engine.
    """
    spark = library.spark
    asked = query_set(spark, path)
    placed = expected_paths(asked.select("query_id", "group", "path"), library.chunks())
    unknown = [r["path"] for r in placed.where("full is null").select("path").distinct().limit(10).collect()]
    if unknown:
        raise UnknownExpected(", ".join(sorted(unknown)))
    rows = []
    for q in asked.select("query_id", "query").distinct().orderBy("query_id").collect():
        vector = spark.range(1).select(passages.word_hash_embedding(F.lit(q["query"])).alias("v")).first()["v"]
        lists = {
            "words": library.search_words(q["query"], evaluate.DEPTH)[0],
            "meaning": library.search_meaning(list(vector), evaluate.DEPTH),
            "hybrid": library.search(q["query"], evaluate.DEPTH, now=now)[0],
        }
        for engine in ENGINES:
            best = lists[engine].orderBy(F.desc("score"), "path").select("path").collect()
            rows += [(engine, q["query_id"], r["path"], k) for k, r in enumerate(best, 1)]
        # an engine that finds nothing still has its questions
        rows += [(engine, q["query_id"], None, evaluate.DEPTH + 1) for engine in ENGINES]
    results = spark.createDataFrame(rows, "engine string, query_id int, path string, rank int")
    return evaluate.metrics(evaluate.first_ranks(results, placed.select("query_id", "group", F.col("full").alias("path"))))
