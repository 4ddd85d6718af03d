"""Directions along which languages differ: leading eigenvectors of the second moments of paired differences."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V

AXES = 2


def moments(rows: DataFrame, vec: str, dims: int) -> np.ndarray:
    """The uncentred second-moment matrix: each task sums the products of its own vectors, and dims x dims sums are added up."""

    def run(batches):
        total = np.zeros((dims, dims))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(dims), "row": list(total)})

    part = rows.select(F.col(vec).cast("array<double>").alias("v")).where(F.size("v") == dims).mapInPandas(run, "i int, row array<double>")
    sums = part.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # dims x dims
    out = np.zeros((dims, dims))
    for r in sums:
        out[r["i"], r["j"]] = r["x"]
    return out


def leading(matrix: np.ndarray, n: int = AXES, steps: int = 256) -> list[list[float]]:
    """Eigenvectors by power iteration with deflation; the largest component of each is positive."""
    m, out = matrix.astype(float).copy(), []
    for _ in range(n):
        v = np.sin(np.arange(1, len(m) + 1))
        v /= np.linalg.norm(v)
        for _ in range(steps):
            w = m @ v
            size = np.linalg.norm(w)
            if size < 1e-12:
                break
            v = w / size
        v = v * np.sign(v[np.abs(v).argmax()])
        out.append(v.tolist())
        m -= (v @ m @ v) * np.outer(v, v)
    return out


def measure(pairs: DataFrame, dims: int, n: int = AXES) -> list[list[float]]:
    """pairs(a, b): vectors of one meaning in two languages."""
    return leading(moments(pairs.select(F.zip_with("a", "b", lambda x, y: x.cast("double") - y.cast("double")).alias("d")), "d", dims), n)


def parallel_set(spark, path: str) -> DataFrame:
    """nth, en, ru of {"pairs": [{"en", "ru"}]}; a set without pairs is refused."""
    rows = spark.read.schema("pairs array<struct<en:string,ru:string>>").option("multiLine", True).json(path).select(F.posexplode("pairs").alias("nth", "p")).select("nth", "p.*")
    if not rows.limit(1).count():
        raise ValueError("the parallel set has no pairs")
    return rows


def set_identity(pairs: DataFrame) -> DataFrame:
    """One row, hash: what names a set of pairs (nth, en, ru) is its texts in order, each with its length in bytes, not its file."""
    sized = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c))
    each = F.array_sort(F.collect_list(F.struct("nth", F.concat(sized("en"), sized("ru")).alias("t"))))  # a set is written by people
    return pairs.agg(F.sha2(F.array_join(F.transform(each, lambda x: x["t"]), ""), 256).alias("hash"))


def space_identity(axes: list[list[float]]) -> str:
    """What names the space that vectors are compared in once these axes are removed."""
    return hashlib.sha256(np.array(axes, "<f8").tobytes()).hexdigest()


def neutral(vec: Column, axes: list[list[float]]) -> Column:
    """vec less each axis in turn, at unit length."""
    for axis in axes:
        vec = V.without_axis(vec, F.array(*[F.lit(float(x)) for x in axis]))
    return V.unit(vec)
