"""Registered queries that SQL can't say, each held whole against brute force or against another way to the same rows."""

import datetime
import math
import re

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from foliant.functions.stem import stem
from foliant.operators import chunker, explain, fusion, index, knn, words
from foliant.plans.queries import NOW, QUERIES, QUESTION, library, load


def table(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def test_capped_bursts(spark, sf):
    quiet, cap = 3600 * 10**6, 6 * 3600 * 10**6
    zero = datetime.datetime(1970, 1, 1)
    want = []
    for kind in {e["event_type"] for e in table(sf, "events")}:
        burst = []
        for t in sorted((e["ts"].replace(tzinfo=None) - zero) // datetime.timedelta(microseconds=1) for e in table(sf, "events") if e["event_type"] == kind):
            if burst and (t - burst[-1] > quiet or t - burst[0] >= cap):
                want.append((kind, burst[0], burst[-1], len(burst)))
                burst = []
            burst.append(t)
        want.append((kind, burst[0], burst[-1], len(burst)))
    got = QUERIES["capped_bursts"](spark, sf).select("source", F.unix_micros(F.col("start").cast("timestamp")), F.unix_micros(F.col("end").cast("timestamp")), "n").collect()
    offset = min(r[1] for r in got) - min(w[1] for w in want)  # the table's times have no zone
    assert sorted((r[0], r[1] - offset, r[2] - offset, r[3]) for r in got) == sorted(want)


def test_chunks_hold_the_texts_in_order(spark, sf):
    """Every word of every text stands in its chunks, in order; none is longer than allowed, and lines rise."""
    got = {}
    for r in QUERIES["chunk_documents"](spark, sf).orderBy("path", "line").collect():
        assert len(r["body"]) <= chunker.LIMIT
        got.setdefault(r["path"], []).append(r["body"])
    for d in table(sf, "documents"):
        text = d["text"] or ""
        # a cut may fall inside a word that alone is longer than a chunk, so letters are compared
        assert "".join("".join(got.get(f"{d['source']}/{d['doc_id']}", [])).split()) == "".join(text.split())


def test_html_pages_hold_the_visible_words(spark, sf):
    """Each chunk's words stand in its page's source, and pages with a paragraph have a chunk."""
    pages = {p["page_id"]: p["html"] for p in table(sf, "pages")}
    seen = set()
    for r in QUERIES["html_pages"](spark, sf).collect():
        seen.add(r["page_id"])
        source = re.sub(r"<[^>]*>", " ", pages[r["page_id"]])
        plain = [w for w in re.findall(r"[A-Za-z]{4,}", r["body"])]
        assert all(w in source for w in plain)
    assert all(i in seen for i, h in pages.items() if re.search(r"<p>[^<]*[A-Za-z]{4,}", h or ""))


def test_stemmed_search_is_the_search_without_an_index(spark, sf):
    chunks = words.analyzed(library(spark, sf).select("path", "title", "body", "line"))
    want = words.search(chunks, QUESTION, 10)[0].select("path", "rank", F.round("score", 6).alias("score"), "share").collect()
    assert sorted(map(tuple, QUERIES["stemmed_search"](spark, sf).collect())) == sorted(map(tuple, want)) and want


def test_search_by_brute_force(spark, sf):
    """Fields, boosts, lengths and phrases over the stored index against a count in plain Python."""
    docs = {f"{d['source']}/{d['doc_id']}.txt": {"title": d["source"], "body": d["text"] or ""} for d in table(sf, "documents")}
    terms = lambda t: [stem(w.lower()) for w in re.findall(r"[^\W_]+", t) if len(w.encode()) < 48]
    held = {p: {f: terms(t) for f, t in d.items()} for p, d in docs.items()}
    rows = index.postings(library(spark, sf).select("path", "title", "body", "line")).cache()
    for query in ("the software", '"licensed under" the', "title:src1 was", "zeppelinesque", "the the software", "+the software"):
        clauses, _ = words.parse(query)
        n = len(held)
        average = {f: sum(len(d[f]) for d in held.values()) / n for f in ("title", "body")}
        tf = {(p, f, c): sum(d[f][i : i + len(c.terms)] == list(c.terms) for i in range(len(d[f]))) for p, d in held.items() for f in ("title", "body") for c in clauses if c.field in (None, f)}
        df = {(f, c): sum(tf[p, f, c] > 0 for p in held) for f in ("title", "body") for c in clauses if c.field in (None, f)}
        every = {p for p in held if all(any(tf.get((p, f, c)) for f in ("title", "body")) for c in clauses)}
        found, together = index.search(rows, index.figures(rows), query, 10)
        assert together == bool(every)
        assert words.answer(index.Indexed(rows, index.figures(rows), words.known_clauses(query)), query, 10) == (found, together)
        if not every:
            continue
        score = {p: round(sum(words.BOOSTS[f] * math.log(1 + (n - df[f, c] + 0.5) / (df[f, c] + 0.5)) * tf[p, f, c] * 2.2 / (tf[p, f, c] + 1.2 * (0.25 + 0.75 * len(held[p][f]) / average[f])) for f, c in df if tf[p, f, c]), 9) for p in every}
        want = sorted(score, key=lambda p: (-score[p], p))[:10]
        assert [f[0] for f in found] == want


def test_knn_hashed_recall(spark, sf):
    v = load(spark, sf, "embeddings")
    q = list(v.where("vec_id = 0").first()["embedding"])
    exact = {r["vec_id"] for r in knn.exact(v, q, 10).collect()}
    got = QUERIES["knn_hashed"](spark, sf).collect()
    assert len(exact & {r["vec_id"] for r in got}) >= 9
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)


def test_language_axes(spark, sf):
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in table(sf, "embeddings")}
    d = np.stack([v[i] - v[i + 1] for i in sorted(v) if i % 2 == 0 and i + 1 in v])
    values, vectors = np.linalg.eigh(d.T @ d)
    for r in QUERIES["language_axes"](spark, sf).collect():
        a = np.array(r["v"])
        m = d.T @ d
        # power iteration stops early where eigenvalues lie close, so the value is held and not the vector
        assert abs(np.linalg.norm(a) - 1) < 1e-9 and a @ m @ a >= 0.95 * values[-1 - r["axis"]]


def test_closest_sentence_and_marks(spark, sf):
    texts = {r["item_id"]: r["text"] for r in table(sf, "benchmark")}
    asked = set(words.terms_of(QUESTION))
    got = {r["item_id"]: [(m["start"], m["end"]) for m in r["marks"]] for r in QUERIES["highlight_marks"](spark, sf).collect()}
    for i, t in texts.items():
        want = []
        for m in re.finditer(r"[^\W_]+", t):
            if stem(m[0].lower()) in asked and len(m[0].encode()) < 48:
                at = len(t[: m.start()].encode())
                want.append((at, at + len(m[0].encode())))
        assert got[i] == want

    def vector(text):
        import hashlib

        c = np.zeros(64)
        for w in re.findall(r"[^\W_]+", text):
            c[hashlib.md5(w.lower().encode()).digest()[0] % 64] += 1
        return c / (np.linalg.norm(c) or 1)

    q = vector(QUESTION)
    for r in QUERIES["closest_sentence"](spark, sf).collect():
        each = explain.sentences(texts[r["item_id"]])[:32]
        scores = [round(float(q @ vector(s)), 9) for _, _, s in each]
        best = scores.index(max(scores))
        assert abs(r["score"] - max(scores)) < 1e-6 and (r["text"] == each[best][2] or abs(scores[best] - scores[r["nth"]]) < 1e-8)


def test_hybrid_search_is_the_fusion_of_both_halves(spark, sf):
    got = {r["path"]: r for r in QUERIES["hybrid_search"](spark, sf).collect()}
    chunks = words.analyzed(library(spark, sf).select("path", "title", "body", "line", "doc_id"))
    w = {r["path"]: r for r in words.search(chunks, QUESTION, 30)[0].collect()}
    docs = {f"{d['source']}/{d['doc_id']}.txt": d for d in table(sf, "documents")}
    for path, r in got.items():
        share, rank = (w[path]["share"], w[path]["rank"]) if path in w else (0.0, 1)
        part = 1.5 * share * share / (8 + rank) + (1 / (8 + r["meaning_rank"]) if r["meaning_rank"] else 0)
        fresh = 1 + 0.1 * 2.0 ** (-(docs[path]["doc_id"] % 90) / 30)
        assert abs(r["score"] - part * fresh) < 2e-6 and (r["words_rank"] == w[path]["rank"] if path in w else r["words_rank"] is None)
    assert len(got) == 10 and NOW and fusion.candidates(10) == 30


def test_marks_in_other_units():
    text = "ab é 𝄞 c"
    assert explain.utf16_ranges(text, [(3, 5), (6, 10), (4, 6), (11, 12)]) == [(3, 4), (5, 7), (8, 9)]
    assert explain.ordered_marks([(4, 6, "word"), (0, 3, "word"), (0, 5, "closest"), (7, 7, "word")]) == [(0, 5, "closest")]
    assert explain.split_highlights("an é b", [(3, 5), (0, 2), (4, 9)]) == [("an", True), (" ", False), ("é", True), (" b", False)]
