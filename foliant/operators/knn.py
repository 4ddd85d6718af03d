"""Meaning half of the search: nearest vectors, exactly or by hashing, and the best passage of each document."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector as V
from ..sources.store import scratch

#: Bytes of questions that every task gets at once.
BLOCK_BYTES = 16 << 20


def exact(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vec: str = "embedding", axes: list[list[float]] = ()) -> DataFrame:
    """One question: the k largest cosines. One scan and a top-k; nothing is shuffled but k rows a task."""
    q, v = F.array(*[F.lit(float(x)) for x in query]), V.unit(F.col(vec))
    for axis in axes:
        a = F.array(*[F.lit(float(x)) for x in axis])
        q, v = V.unit(V.without_axis(q, a)), V.unit(V.without_axis(v, a))
    return vectors.select(key, F.round(V.dot(V.unit(q), v), 9).alias("score")).orderBy(F.desc("score"), key).limit(k)


def exact_many(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """queries(query_id, q) against all vectors, itself left out: query_id, key, score, rank.

    A set of questions against all rows, in blocks: a block of questions is a matrix of at most BLOCK_BYTES
    that every task gets, each task multiplies its vectors by it batch by batch and sends its own k best
    of each question. Blocks are written one after another, so neither plan nor memory grows with them.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("key"), V.unit(F.col(vec)).alias("v"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), V.unit(F.col("q")).alias("u")).where("u is not null")
    schema = "query_id long, key long, score double"
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("u")).alias("d")).first()
    blocks = -(-size["n"] * (size["d"] or 1) * 8 // BLOCK_BYTES)
    found = None
    for number in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
        got = _block(rows, part.orderBy("query_id").collect(), k, schema)  # a block's share of rows, about BLOCK_BYTES
        if blocks > 1:
            path = f"{scratch(spark)}/knn-{uuid.uuid4().hex}"
            got.write.parquet(path)
            got = path
        found = [*(found or []), got]
    if not found:
        out = spark.createDataFrame([], schema)
    else:
        out = found[0] if blocks == 1 else spark.read.schema(schema).parquet(*found)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "score", "rank")


def _block(rows: DataFrame, asked: list, k: int, schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in asked], np.int64), np.array([r["u"] for r in asked], float)))

    def run(batches):
        ids, q = shared.value
        best = [np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))]
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == q.shape[1] for v in pdf["v"]]]
            for a in range(0, len(pdf), 4096):
                part = pdf.iloc[a : a + 4096]
                who = part["key"].to_numpy(np.int64)
                score = np.round(q @ np.stack(part["v"].to_numpy()).T, 9)
                score[ids[:, None] == who[None, :]] = -np.inf
                best = _best(np.hstack([best[0], np.broadcast_to(who, score.shape)]), np.hstack([best[1], score]), k)
        keys, score = best
        at = np.isfinite(score)
        yield pd.DataFrame({"query_id": np.broadcast_to(ids[:, None], score.shape)[at], "key": keys[at], "score": score[at]})

    return rows.mapInPandas(run, schema)


def _best(keys: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to smaller keys."""
    by = np.lexsort((keys, -score), axis=1)[:, :k]
    return np.take_along_axis(keys, by, axis=1), np.take_along_axis(score, by, axis=1)


def hashed(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vec: str = "embedding", tables: int = 12, bucket: float = 1.0) -> DataFrame:
    """Approximate: random-projection hashing on unit vectors (Euclidean order is cosine order there), then exact scores."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    norm = sum(x * x for x in query) ** 0.5 or 1.0
    rows = vectors.select(key, V.unit(F.col(vec)).alias("v")).withColumn("f", array_to_vector("v"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=7).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense([x / norm for x in query]), k)
    q = F.array(*[F.lit(x / norm) for x in query])
    return near.select(key, F.round(V.dot(q, F.col("v")), 9).alias("score")).orderBy(F.desc("score"), key)


def best_passages(scores: DataFrame, passages: DataFrame, skip: str | None = None, limit: int | None = None) -> DataFrame:
    """scores(key, score) through passages(key, path, line): the best line of each document, ties to the lower.

    Documents that are no longer in `passages` drop out; `skip` leaves one path out before that. With a
    limit, the best documents are ranked; without one there is no rank, which would sort them all in one task.
    """
    rows = scores.join(passages, "key")
    if skip is not None:
        rows = rows.where(F.col("path") != skip)
    best = rows.groupBy("path").agg(F.max_by(F.struct("score", "line"), F.struct("score", -F.col("line"))).alias("b")).select("path", "b.*")
    if limit is None:
        return best
    return best.orderBy(F.desc("score"), "path").limit(limit).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "path")))  # `limit` rows


def nearest_documents(scores: DataFrame, places: DataFrame, limit: int, skip: str | None = None) -> list:
    """scores(key, score) -> rows (path, line, score, rank) of the `limit` documents with the best passages.

    Few passages usually hold enough documents: the nearest 4 x limit are looked up, then 4 times as many,
    then all, whichever first gives enough.
    """
    for k in (4 * limit, 16 * limit, None):
        top = scores if k is None else scores.orderBy(F.desc("score"), "key").limit(k)
        got = best_passages(top, places, skip, limit).orderBy("rank").collect()  # `limit` rows
        # passages as near as the last one taken may be missing, so a document counts only if it is nearer
        last = None if k is None else top.agg(F.min("score")).first()[0]
        if last is None or len(got) == limit and got[-1]["score"] > last:
            break
    return got
