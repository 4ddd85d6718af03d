"""Distinct passages to embed, what is missing, what is complete, and batches of like length."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vector as V

BATCH, SORT_WINDOW, DIMS, PARTS = 16, 256, 64, 8
_WORD = re.compile(r"[^\W_]+")


def passages(chunks: DataFrame) -> DataFrame:
    """key, passage, places array<(path, line)>: equal passages are embedded once."""
    text = X.embedding_passage(F.col("title"), F.col("headings"), F.col("body"))
    each = chunks.where(F.col("body") != "").select(text.alias("passage"), "path", "line").withColumn("key", F.sha2("passage", 256))
    return each.groupBy("key").agg(F.first("passage").alias("passage"), F.array_sort(F.collect_set(F.struct("path", "line"))).alias("places"))


def missing(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    return passages.join(vectors.select("key"), "key", "left_anti")


def live(vectors: DataFrame, passages: DataFrame) -> DataFrame:
    """Vectors that some passage still has; compaction writes these."""
    return vectors.join(passages.select("key"), "key", "left_semi")


def coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """path, complete: all of a document's passages have vectors."""
    each = passages(chunks).select("key", F.explode("places").alias("p")).select("key", "p.path")
    return each.join(vectors.select("key", F.lit(True).alias("here")), "key", "left").groupBy("path").agg(F.bool_and(F.coalesce("here", F.lit(False))).alias("complete"))


def length_windows(rows: DataFrame, text: str = "passage", key: str = "key", size: int = SORT_WINDOW, part: Column | None = None) -> DataFrame:
    """rows with `bucket`, `part` and `window`: runs of `size` rows of like length. Buckets are powers of two cut in sixteen, each dealt
    in PARTS parts by a number (of the key's hash, unless given), so that no task sorts more than a small share of all rows whatever their lengths."""
    n = F.greatest(F.length(text), F.lit(1))
    bucket = F.floor(16 * F.log2(n)).cast("int")
    nth = F.row_number().over(W.partitionBy("bucket", "part").orderBy(n, key))
    return rows.withColumns({"bucket": bucket, "part": F.pmod(F.crc32(F.col(key).cast("string")) if part is None else part, F.lit(PARTS)).cast("int")}).withColumn("window", F.floor((nth - 1) / size))


def word_hash_embedding(text, dims: int = DIMS):
    """The stand-in embedder as a column: a unit vector of word counts by the first byte of each word's MD5."""
    slots = F.transform(X.words(text), lambda w: (F.conv(F.left(F.md5(w), F.lit(2)), 16, 10).cast("int") % dims))
    # one-element arrays hold what is computed once and looked at from inside a lambda
    counts = F.transform(F.array(slots), lambda ss: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(ss, lambda s: s == i)).cast("double")))
    return F.get(F.transform(counts, V.unit), F.lit(0))


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        short = len(word.encode("utf-8", "surrogatepass")) < X.WORD_LIMIT
        k = self[word] = hashlib.md5(word.lower().encode("utf-8", "surrogatepass")).digest()[0] % DIMS if short else -1
        return k


_slots = _Slots()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def word_hash_vectors(texts: pd.Series) -> pd.Series:
    """The same as `word_hash_embedding` for many texts at once."""
    out = []
    for t in texts:
        if len(_slots) > 200_000:
            _slots.clear()
        slots = np.fromiter(map(_slots.__getitem__, _WORD.findall(t or "")), np.int64)
        counts = np.bincount(slots[slots >= 0], minlength=DIMS).astype(float)
        out.append(counts / (math.sqrt((counts * counts).sum()) or 1.0))
    return pd.Series(out)


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "passage", key: str = "key") -> DataFrame:
    """key, vec through a model given as a function over batches of texts; batches hold texts of like length."""

    def run(batches):
        for pdf in batches:
            pdf = pdf.iloc[pdf["t"].str.len().argsort(kind="stable")]
            for a in range(0, len(pdf), BATCH):
                part = pdf.iloc[a : a + BATCH]
                yield pd.DataFrame({"key": part["key"], "vec": [list(map(float, v)) for v in embedder(part["t"].tolist())]})

    return rows.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInPandas(run, "key string, vec array<double>")


def onnx_embedder(folder: str, prefix: str = "", pooling: str = "mean", max_tokens: int = 512) -> Callable[[list[str]], list[list[float]]]:
    """An embedder over model.onnx and tokenizer.json in a folder; weights are not part of this library."""

    def run(texts: list[str]) -> list[list[float]]:
        import numpy as np
        import onnxruntime as ort
        from tokenizers import Tokenizer

        if folder not in _sessions:
            tok = Tokenizer.from_file(f"{folder}/tokenizer.json")
            tok.enable_truncation(max_tokens)
            tok.enable_padding()
            _sessions[folder] = tok, ort.InferenceSession(f"{folder}/model.onnx", providers=["CPUExecutionProvider"])
        tok, session = _sessions[folder]
        coded = tok.encode_batch([prefix + t for t in texts])
        ids, mask = np.array([c.ids for c in coded], np.int64), np.array([c.attention_mask for c in coded], np.int64)
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        out = session.run(None, {i.name: feed[i.name] for i in session.get_inputs()})[0]
        v = out[:, 0] if pooling == "cls" else (out * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1, keepdims=True)
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).tolist()

    return run


_sessions: dict = {}
