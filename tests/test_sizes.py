"""What must not grow with the input: what one task reads and what a Python worker holds."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.functions import batches
from foliant.operators import index, many, words
from foliant.plans import queries
from foliant.sources.store import Store


def test_the_index_is_written_where_its_texts_are_read(spark, sf, monkeypatch):
    plans, add = {}, Store.add
    monkeypatch.setattr(Store, "add", lambda self, table, df, *a, **b: plans.update({table: df._jdf.queryExecution().executedPlan().toString()}) or add(self, table, df, *a, **b))
    monkeypatch.setattr(queries, "_STORES", {})
    monkeypatch.setattr(queries, "PIECE", 1 << 10, raising=False)
    store = queries.stored(spark, sf)
    assert "Exchange" not in plans["postings"]  # no bucket goes to one task
    assert "crc32" in plans["chunks"]  # nor do the texts of one
    first = store.read("postings").where("bucket = 3").select(F.input_file_name().alias("file"), "term", F.monotonically_increasing_id().alias("at")).toPandas()
    assert len(first) and all(list(f.sort_values("at")["term"]) == sorted(f["term"]) for _, f in first.groupby("file"))


def test_postings_of_a_batch_come_in_stored_order(spark):
    vocabulary = index.Vocabulary(False)
    row, term, tf, at, length, names = index._columns(["b a b", None, "c b " + "x" * 48], vocabulary)
    got = [(names["term"][int(t)].as_py(), int(r), int(n)) for t, r, n in zip(term, row, tf)]
    assert sorted(got) == [("a", 0, 1), ("b", 0, 2), ("b", 2, 1), ("c", 2, 1)] and list(length) == [3, 0, 2]
    assert got == sorted(got, key=lambda g: (index.bucket_of(g[0]), g[0], g[1]))
    assert [list(map(int, x)) for x in np.split(at, np.cumsum(tf)[:-1])] == [{("a", 0): [1], ("b", 0): [0, 2], ("b", 2): [1], ("c", 2): [0]}[g[:2]] for g in got]
    assert isinstance(names, pa.Table)


def test_pieces_bound_the_texts_held_at_once():
    assert list(batches.pieces(["aa", None, "bb", "cccccc", "d"], 4)) == [(0, 3), (3, 4), (4, 5)]
    assert list(batches.pieces([], 4)) == []


def test_many_questions_carry_only_their_best(spark, monkeypatch):
    monkeypatch.setattr(many, "TEXTS", 7)
    monkeypatch.setattr(many, "QUESTIONS", 2)
    bodies = [" ".join("abcdefgh"[j] for j in range(8) for _ in range((i * (j + 3)) % 5)) + " z" * (i % 3) for i in range(90)] + ["a b c z", "c z b a"] * 8 + [None]
    chunks = spark.createDataFrame([(f"p{i:03}", b) for i, b in enumerate(bodies)], "path string, body string").repartition(3)
    asks = {1: "abz", 2: "c", 3: "hgx", 4: "x", 5: "abcdefghz"}
    asked = spark.createDataFrame([(q, t) for q, ts in asks.items() for t in ts + ts[0]], "query_id long, term string")
    df = many.bm25_many(chunks, asked, 6, "path")
    found = [t.split() if t else [] for t in bodies]
    average = sum(map(len, found)) / len(found)
    want = []
    for q, ts in asks.items():
        scores = []
        for i, ws in enumerate(found):
            score = 0.0
            for t in ts:
                n = sum(t in x for x in found)
                score += words.idf(len(found), n) * ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / average))
            if score:
                scores.append((-round(score, 9), f"p{i:03}"))
        want += [(q, p, k, round(-s, 6)) for k, (s, p) in enumerate(sorted(scores)[:6], 1)]
    assert sorted((r["query_id"], r["path"], r["rank"], round(r["score"], 6)) for r in df.collect()) == sorted(want)
    assert df._jdf.queryExecution().toString().count("Exchange hashpartitioning(path") == 0  # texts and their terms are not dealt out
    held = many.leading(pd.DataFrame({"q": 0, "key": [f"p{i:04}" for i in range(5000)], "score": 1.5}), 6)
    assert list(held["key"]) == [f"p{i:04}" for i in range(6)]


@pytest.mark.parametrize("name", ["postings", "chunk_documents", "html_pages"])
def test_arrow_batches_are_cut_by_bytes(spark, sf, name):
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    spark.conf.unset(conf)
    try:
        queries.QUERIES[name](spark, sf)
        assert int(spark.conf.get(conf)) == batches.BATCH_BYTES
        spark.conf.set(conf, "1000000")
        queries.QUERIES[name](spark, sf)
        assert spark.conf.get(conf) == "1000000"
    finally:
        spark.conf.set(conf, before.rstrip("b"))
