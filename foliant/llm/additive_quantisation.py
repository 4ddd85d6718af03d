"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of one word from each of several full-dimensional codebooks. The
codebooks are fitted in turn to residuals on a bounded sample and, where the sample is many times
larger than the codebooks, may be refined together by least squares on its codes; all vectors are encoded by beam search, and the codes are stored with
the approximation's norm and the original. A query meets the codes through a table of its products
with all words; the best by approximate score are scored exactly on the original vectors.

Every row is indexed. Queries go through in blocks of at most `QUERY_BLOCK`, the only thing that is
ever broadcast; the results of a block are written before the next one starts, so the plan doesn't
grow with their number. Copies of one vector are interchangeable up to their ids, so a table slice
keeps one code for each distinct vector (told by a hash made when it is indexed), and of its ids the
smallest that any query could return: nothing else is dropped, and ties go to smaller ids however
many copies there are.

Defined results: vectors that are null, zero, of another dimension than most or that hold null
or non-finite components take no part; a query's own rows (equal id) are no candidates; with fewer
candidates than k all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import drawn, load, new_path, stage, tidy

#: Vectors that the codebooks are fitted on at most, those of least hash.
SAMPLE = 12_288
#: Queries that are broadcast at once at most.
QUERY_BLOCK = 8_192
#: Codes that are scored at once in a task, and queries against them.
CODES, ROWS = 16_384, 128


@dataclass
class Codebooks:
    words: np.ndarray  # (m, k, d)

    @classmethod
    def fit(cls, x: np.ndarray, m: int = 16, k: int = 256, rounds: int = 8, beam: int = 8, refine: int = 0, seed: int = 7) -> Codebooks:
        """x: (n, d) sample."""
        rng = np.random.default_rng(seed)
        k = max(1, min(k, len(x)))
        residual, words = x.astype(np.float64).copy(), []
        for _ in range(m):
            c = residual[rng.choice(len(x), k, replace=False)].copy()
            for _ in range(rounds):
                near = (residual @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
                n = np.bincount(near, minlength=k)
                by = np.argsort(near, kind="stable")
                full = np.flatnonzero(n)
                c[full] = np.add.reduceat(residual[by], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
            near = (residual @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
            residual -= c[near]
            words.append(c)
        out = cls(np.stack(words))
        for _ in range(refine):  # all words at once, given the codes
            code = out.encode(x, beam)
            size = m * k
            flat = code + np.arange(m) * k
            gram, right = np.zeros((size, size)), np.zeros((size, x.shape[1]))
            for a in range(m):
                np.add.at(right, flat[:, a], x)
                for b in range(m):
                    np.add.at(gram, (flat[:, a], flat[:, b]), 1.0)
            old = out.words.reshape(size, -1)
            out = cls(np.linalg.solve(gram + np.eye(size), right + old).reshape(out.words.shape))  # unused words stay
        return out

    def encode(self, x: np.ndarray, beam: int = 8) -> np.ndarray:
        """(n, m) codes; keeps the `beam` best partial sums of each vector."""
        m, k, _ = self.words.shape
        flat = self.words.reshape(m * k, -1).astype(np.float32)
        cross = flat @ flat.T
        norm = np.diag(cross)
        out = []
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024].astype(np.float32)
            dot = part @ flat.T
            n = len(part)
            codes = np.zeros((n, 1, 0), np.int64)
            cost = np.zeros((n, 1), np.float32)
            for j in range(m):
                # ||x - s - c||^2 = ||x - s||^2 - 2 x.c + 2 s.c + ||c||^2
                add = (norm[j * k : (j + 1) * k] - 2 * dot[:, j * k : (j + 1) * k])[:, None, :].repeat(codes.shape[1], axis=1)
                for i in range(j):
                    add += 2 * cross[i * k : (i + 1) * k, j * k : (j + 1) * k][codes[:, :, i]]
                total = (cost[:, :, None] + add).reshape(n, -1)
                width = min(beam, total.shape[1])
                best = np.argpartition(total, width - 1, axis=1)[:, :width]
                cost = np.take_along_axis(total, best, axis=1)
                codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], axis=1), (best % k)[:, :, None]], axis=2)
            out.append(np.take_along_axis(codes, cost.argmin(axis=1)[:, None, None], axis=1)[:, 0])
        return np.concatenate(out) if out else np.zeros((0, m), np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[j][codes[:, j]] for j in range(len(self.words)))


def usable(vec: str):
    """Vectors that take part: no null, no non-finite component, not all zero."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def index(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", books: int = 16, beam: int = 8, sample: int = SAMPLE) -> tuple[DataFrame, Codebooks | None]:
    """(staged rows (id, v array<double>, h (hash of v), codes binary, norm float), codebooks)."""
    rows = vectors.where(usable(vec)).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return stage(rows.selectExpr("id", "v", "0L h", "cast(null as binary) codes", "cast(null as float) norm"), "aq-index"), None
    d = sizes["d"]
    rows = rows.where(F.size("v") == d)
    model = Codebooks.fit(np.array([r["v"] for r in drawn(rows, F.xxhash64("v", "id"), sample).select("v").collect()]), m=books)

    def encode(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                codes = model.encode(x, beam)
                norm = np.sqrt((model.decode(codes) ** 2).sum(axis=1)).astype(np.float32)
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "h": pdf["h"], "codes": [c.tobytes() for c in codes.astype(np.uint8)], "norm": norm})

    coded = rows.withColumn("h", F.xxhash64("v")).mapInPandas(tidy(encode), "id long, v array<double>, h long, codes binary, norm float")
    return stage(coded, "aq-index"), model


def _search_slice(pdf: pd.DataFrame, q: np.ndarray, q_id: np.ndarray, model: Codebooks, k: int, rerank: int):
    """The k best of one slice of the table for each query: query number, id, score."""
    x = np.stack(pdf["v"].to_numpy())
    ids = pdf["id"].to_numpy(np.int64)
    # one code for each distinct vector; of its ids the k + 1 smallest (one may be the query's own)
    by = np.lexsort((ids, pdf["h"].to_numpy(np.int64)))
    x, ids = x[by], ids[by]
    head = np.r_[True, (x[1:] != x[:-1]).any(axis=1)]
    first = np.flatnonzero(head)
    count = np.diff(np.r_[first, len(ids)])
    codes = np.frombuffer(b"".join(pdf["codes"].iloc[by[first]]), np.uint8).reshape(len(first), -1).astype(np.int64)
    norm = pdf["norm"].to_numpy(np.float64)[by[first]]
    distinct = x[first]
    true_norm = np.sqrt((distinct**2).sum(axis=1))
    scale = (true_norm / np.maximum(norm, 1e-12)).astype(np.float32)  # the stored norm undoes the shrinking of the sums
    take = min(rerank, len(first))
    for a in range(0, len(q), ROWS):
        part = q[a : a + ROWS]
        table = np.einsum("qd,mkd->mqk", part, model.words).astype(np.float32)
        score = np.zeros((len(part), len(first)), np.float32)
        for m in range(codes.shape[1]):
            score += table[m][:, codes[:, m]]
        score *= scale
        best = np.argpartition(-score, take - 1, axis=1)[:, :take]
        exact = np.einsum("qd,qrd->qr", part, distinct[best])
        order = np.argsort(-exact, axis=1, kind="stable")
        n_rows, n_ids, n_scores = [], [], []
        for i in range(len(part)):
            # vectors in order of score until they surely hold k ids besides the query's own
            c, s = best[i][order[i]][: k + 1], exact[i][order[i]][: k + 1]
            keep = np.minimum(count[c], k + 1)
            if (s[:-1] == s[1:]).any() or take > k + 1 and exact[i][order[i][min(k + 1, take - 1)]] == s[-1]:
                c = best[i][exact[i] >= s[-1]]  # different vectors of equal score
                s, keep = exact[i][exact[i] >= s[-1]], np.minimum(count[c], k + 1)
            at = np.repeat(first[c], keep) + (np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep))
            sc, who = np.repeat(s, keep), ids[at]
            other = who != q_id[a + i]
            sc, who = sc[other], who[other]
            top = np.lexsort((who, -sc))[:k]
            n_rows.append(np.full(len(top), a + i))
            n_ids.append(who[top])
            n_scores.append(sc[top])
        yield np.concatenate(n_rows), np.concatenate(n_ids), np.concatenate(n_scores)


def search(table: DataFrame, model: Codebooks | None, queries: DataFrame, k: int = 20, rerank: int = 400) -> DataFrame:
    """table from index(); queries(id, v) -> query_id, rank, vec_id, score: the k best found, exact scores, ties to smaller ids."""
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if model is None:
        return spark.createDataFrame([], schema)
    d = model.words.shape[2]
    held = stage(queries.where(F.size("v") == d).withColumn("block", F.floor((F.row_number().over(W.partitionBy(F.spark_partition_id()).orderBy("id")) - 1) / QUERY_BLOCK)).withColumn("part", F.spark_partition_id()), "aq-queries")
    groups = [(r["part"], r["block"], r["n"]) for r in held.groupBy("part", "block").agg(F.count("*").alias("n")).orderBy("part", "block").collect()]
    # neighbouring small blocks go together
    batches: list[list] = []
    for part, block, n in groups:
        if not batches or sum(x[2] for x in batches[-1]) + n > QUERY_BLOCK:
            batches.append([])
        batches[-1].append((part, block, n))
    folder = new_path(spark, "aq-found")
    partial = "query_id long, n long, vec_id long, score double"
    spark.createDataFrame([], partial).write.parquet(f"{folder}/batch=-1")
    for number, batch in enumerate(batches):
        where = " OR ".join(f"(part = {p} AND block = {b})" for p, b, _ in batch)
        rows = held.where(where).orderBy("id").collect()  # at most QUERY_BLOCK
        shared = spark.sparkContext.broadcast((np.array([r["v"] for r in rows]), np.array([r["id"] for r in rows], np.int64)))

        def run(batches, shared=shared):
            q, q_id = shared.value
            best: list = []
            size = 0

            def shrink():
                r, i, s = (np.concatenate(c) for c in zip(*best))
                by = np.lexsort((i, -s, r))
                r, i, s = r[by], i[by], s[by]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                keep = nth < k
                return [(r[keep], i[keep], s[keep])]

            held: list[pd.DataFrame] = []

            def flush():
                nonlocal best, size
                pdf = pd.concat(held, ignore_index=True)
                held.clear()
                for got in _search_slice(pdf, q, q_id, model, k, rerank):
                    best.append(got)
                    size += len(got[0])
                if size > 4 * k * len(q):
                    best = shrink()
                    size = len(best[0][0])

            for pdf in batches:
                if len(pdf):
                    held.append(pdf)
                if sum(map(len, held)) >= CODES:
                    flush()
            if held:
                flush()
            if best:
                r, i, s = shrink()[0]
                yield pd.DataFrame({"query_id": q_id[r], "n": r, "vec_id": i, "score": s})

        table.mapInPandas(tidy(run), partial).write.parquet(f"{folder}/batch={number}")
        shared.destroy()

    out = spark.read.schema(partial + ", batch int").parquet(folder)
    rank = F.row_number().over(W.partitionBy("batch", "n").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_additive_quantisation(spark, sf_dir):
    table, model = index(load(spark, sf_dir, "embeddings"))
    return search(table, model, table.where("id % 20 = 0").select("id", "v"))
