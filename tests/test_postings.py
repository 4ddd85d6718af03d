"""The whole inverted index against brute force."""

import re

import pyarrow.parquet as pq

from foliant.plans.queries import QUERIES


def test_postings_hold_every_term_and_position(spark, sf):
    want = {}
    for d in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "source", "text"]).to_pylist():
        found = [w.lower() for w in re.findall(r"[^\W_]+", d["text"] or "") if len(w.encode()) < 48]
        for i, w in enumerate(found):
            want.setdefault((w, f"{d['source']}/{d['doc_id']}.txt"), []).append(i)
    rows = QUERIES["postings"](spark, sf).collect()
    assert {(r["term"], r["path"]): list(map(int, r["positions"].split(","))) for r in rows} == want
    assert len(rows) == len(want) and all(r["tf"] == len(r["positions"].split(",")) for r in rows)
    assert any(len(t) <= 8 for t, _ in want)
