"""The stored inverted index: postings dealt out by term, each with its field's length, so that a question reads its own terms alone.

A row is one term in one field of one chunk. Rows of one term lie in one bucket (a partition folder)
sorted by term, so a question opens few buckets and of these few row groups. The bucket LENGTHS holds a
row for each field of each chunk, from which the corpus figures are summed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.batches import bounded, pieces
from ..functions.stem import stem
from . import words

BUCKETS, LENGTHS = 16, -1
#: Chunks beyond which a bucket is written by several tasks.
BUCKET_CHUNKS = 1_000_000
CACHE_WORDS = 200_000
_WORD = re.compile(r"[^\W_]+")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bucket_of(term: str) -> int:
    """The same on the driver: Spark's hash is XXH64 with seed 42."""
    return xxhash.xxh64_intdigest(term.encode(), 42) % BUCKETS


class Vocabulary(dict):
    """Numbers of terms by word, -1 for words that aren't indexed; a word is stemmed once in a worker's life."""

    def __init__(self, stemmed: bool):
        super().__init__()
        self.stemmed, self.terms, self.buckets, self.number = stemmed, [], [], {}

    def __missing__(self, word: str) -> int:
        if len(word.encode("utf-8", "surrogatepass")) >= X.WORD_LIMIT:
            k = -1
        else:
            term = stem(word.lower()) if self.stemmed else word.lower()
            k = self.number.setdefault(term, len(self.terms))
            if k == len(self.terms):
                self.terms.append(term)
                self.buckets.append(bucket_of(term))
        self[word] = k
        return k


def _columns(texts: list, vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """row, term, tf and all positions of each term of each text, by bucket, term and row; the lengths of the texts; the table of buckets and terms that `term` numbers."""
    ids = [np.fromiter(map(vocabulary.__getitem__, _WORD.findall(t or "")), np.int64) for t in texts]
    ids = [x[x >= 0] for x in ids]
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    term, row = np.concatenate(ids) if ids else np.zeros(0, np.int64), np.repeat(np.arange(len(ids)), length)
    starts, n = np.cumsum(length) - length, max(1, len(term))
    seen = np.zeros(len(vocabulary.terms), np.int64)
    seen[term] = 1
    used = np.flatnonzero(seen)
    names = pa.table({"bucket": pa.array([vocabulary.buckets[k] for k in used], pa.int32()), "term": pa.array([vocabulary.terms[k] for k in used], pa.string())})
    by = pc.sort_indices(names, sort_keys=[("bucket", "ascending"), ("term", "ascending")])
    seen[used[by.to_numpy()]] = np.arange(len(used))
    # numbers of tokens rise by row and position, so one sort of plain numbers orders all three
    term, token = np.divmod(np.sort(seen[term] * n + np.arange(len(term))), n)
    row = row[token]
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])]) if len(term) else np.zeros(0, np.int64)
    at = token - starts[row]
    return row[first], term[first], np.diff(np.r_[first, len(term)]), at, length, names.take(by)


def postings(chunks: DataFrame, stemmed: bool = True, order: str = "line") -> DataFrame:
    """chunks(path, order, fields, optionally backlink_count) -> bucket, term, field, path, order, links, len, tf, positions.

    Texts are taken a few megabytes at a time, and the rows of these come in the order in which they are stored, so a sort has runs to merge.
    """
    bounded(chunks.sparkSession)
    kinds = dict(chunks.dtypes)
    fields = [f for f in words.BOOSTS if f in kinds]
    links = F.col("backlink_count").cast("int") if "backlink_count" in kinds else F.lit(0)
    one = [(F.array_join(f, "\n") if kinds[f].startswith("array") else F.col(f)).alias(f"f_{f}") for f in fields]
    rows = chunks.select("path", F.col(order).cast("long").alias("at"), links.alias("links"), *one)

    def made(batch, field, place, names, term, length, tf, ends, at):
        place, names = pa.array(place), names.take(pa.array(term)).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [
                names["bucket"].combine_chunks(),
                names["term"].combine_chunks(),
                pa.array([field], pa.string()).take(pa.array(np.zeros(len(place), np.int64))),
                batch.column("path").take(place),
                batch.column("at").take(place),
                batch.column("links").take(place),
                pa.array(length.astype(np.int32)),
                pa.array(tf.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at.astype(np.int32))),
            ],
            names=["bucket", "term", "field", "path", "at", "links", "len", "tf", "positions"],
        )

    def run(batches):
        vocabulary, none = Vocabulary(stemmed), np.zeros(0, np.int64)
        lengths = pa.table({"bucket": pa.array([LENGTHS], pa.int32()), "term": pa.array([""], pa.string())})
        for batch in batches:
            for field in fields:
                texts = batch.column(f"f_{field}").to_pylist()
                for a, b in pieces(texts):
                    if len(vocabulary) > CACHE_WORDS:
                        vocabulary = Vocabulary(stemmed)
                    row, term, tf, at, length, names = _columns(texts[a:b], vocabulary)
                    every = np.arange(b - a)
                    yield made(batch, field, a + every, lengths, 0 * every, length, length, np.zeros(b - a + 1), none)
                    if len(row):
                        yield made(batch, field, a + row, names, term, length[row], tf, np.r_[0, np.cumsum(tf)], at)

    out = rows.mapInArrow(run, "bucket int, term string, field string, path string, at long, links int, len int, tf int, positions array<int>")
    return out.withColumnRenamed("at", order)


def stored_order(rows: DataFrame, order: str = "line") -> DataFrame:
    """Postings as they are written where they are made: no shuffle, each task has a file in each bucket, sorted by term."""
    return rows.sortWithinPartitions("bucket", "term", "path", order)


def dealt(rows: DataFrame, chunks: int, order: str = "line") -> DataFrame:
    """Postings as they are written: a bucket in as many tasks as `chunks` calls for, sorted by term."""
    share = F.pmod(F.xxhash64("path", order), F.lit(1 + chunks // BUCKET_CHUNKS))
    return rows.repartition(F.col("bucket"), share).sortWithinPartitions("bucket", "term", "path", order)


def figures(rows: DataFrame) -> DataFrame:
    """field, n, average length; from the rows of lengths."""
    return rows.where(F.col("bucket") == LENGTHS).groupBy("field").agg(F.count("*").alias("n"), F.avg("tf").alias("average"))


class Indexed:
    """What a search needs to know of each chunk that holds any asked term, from postings; see words.Counted."""

    def __init__(self, rows: DataFrame, totals: DataFrame, clauses: list[words.Clause], order: str = "line"):
        got = {r["field"]: r for r in totals.collect()}  # one row a field
        self.fields = [f for f in words.BOOSTS if f in got]
        self.n = max((r["n"] for r in got.values()), default=0)
        self.average = {f: got[f]["average"] or 0.0 for f in self.fields}
        self.at = {(c.terms, c.field): i for i, c in enumerate(clauses)}
        terms = sorted({t for c in clauses for t in c.terms})
        hits = rows.where(F.col("bucket").isin(sorted(set(map(bucket_of, terms)))) & F.col("term").isin(terms))
        joined = sorted({t for c in clauses if len(c.terms) > 1 for t in c.terms})
        mine = lambda t, f: (F.col("term") == t) & (F.col("field") == f)
        aggs = [F.max("links").alias("links")] + [F.coalesce(F.max(F.when(F.col("field") == f, F.col("len"))), F.lit(0)).alias(f"len_{f}") for f in self.fields]
        aggs += [F.max(F.when(mine(t, f), F.col("positions"))).alias(f"at_{f}_{k}") for k, t in enumerate(joined) for f in self.fields]
        aggs += [F.coalesce(F.max(F.when(mine(c.terms[0], f), F.col("tf"))), F.lit(0)).alias(f"tf_{f}_{i}") for i, c in enumerate(clauses) if len(c.terms) == 1 for f in words.of_fields(c, self.fields)]
        held = hits.groupBy("path", order).agg(*aggs)

        def phrase(c: words.Clause, f: str) -> Column:
            places = [F.col(f"at_{f}_{joined.index(t)}") for t in c.terms]
            starts = F.filter(places[0], lambda p: F.coalesce(_all(F.array_contains(q, p + i) for i, q in enumerate(places[1:], 1)), F.lit(False)))
            return F.coalesce(F.size(starts), F.lit(0)).alias(f"tf_{f}_{i_of[c.terms, c.field]}")

        i_of = self.at
        phrases = [phrase(c, f) for c in clauses if len(c.terms) > 1 for f in words.of_fields(c, self.fields)]
        self.rows = held.select("*", *phrases).drop(*[f"at_{f}_{k}" for k in range(len(joined)) for f in self.fields])


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def search(rows: DataFrame, totals: DataFrame, query: str, limit: int = 10, stemmed: bool = True, order: str = "line") -> tuple[list, bool]:
    """`words.answer` over stored postings and figures."""
    clauses, _ = words.parse(query, stemmed)
    if not query.strip() or limit <= 0 or not clauses:
        return [], False
    if len({c.terms[0] for c in clauses}) < 63 and all(len(c.terms) == 1 and c.field is None and not c.sign for c in clauses) and not words.parse(query, stemmed)[1]:
        return _plain(rows, totals, query, [c.terms[0] for c in clauses], limit, stemmed, order)
    return words.answer(Indexed(rows, totals, words.known_clauses(query, stemmed), order), query, limit, stemmed, order)


def _plain(rows: DataFrame, totals: DataFrame, query: str, asked: list[str], limit: int, stemmed: bool, order: str) -> tuple[list, bool]:
    """Words alone: each posting adds its own part to its chunk's score, so nothing is spread out by term and field.

    One small aggregate gives the document frequencies; in the other pass chunks with all words go before those with some.
    """
    figures = {r["field"]: r for r in totals.collect()}  # one row a field
    n = max((r["n"] for r in figures.values()), default=0)
    terms = sorted(set(asked))
    hits = rows.where(F.col("bucket").isin(sorted(set(map(bucket_of, terms)))) & F.col("term").isin(terms) & F.col("field").isin(*words.BOOSTS))
    df = {(r["field"], r["term"]): r["count"] for r in hits.groupBy("field", "term").count().collect()}  # asked terms by field
    if not df:
        return [], False
    body = {t: df.get(("body", t), 0) for t in terms}
    rest = {c.terms[0] for c in words.parse(words.drop_common(query, body, n, stemmed), stemmed)[0]} & set(terms)
    pair = lambda f, t: F.concat(f, F.lit("\n"), t)
    # a word that is asked for twice counts twice
    weight = F.create_map(*[F.lit(x) for (f, t), d in df.items() for x in (f"{f}\n{t}", words.BOOSTS[f] * words.idf(n, d))])
    times = F.create_map(*[F.lit(x) for t in terms for x in (t, float(asked.count(t)))])
    average = F.create_map(*[F.lit(x) for f, r in figures.items() for x in (f, float(r["average"] or 1.0))])
    bit = F.create_map(*[F.lit(x) for k, t in enumerate(terms) for x in (t, 1 << k)])[F.col("term")].cast("long")
    tf = F.col("tf").cast("double")
    part = weight[pair(F.col("field"), F.col("term"))] * tf * (words.K1 + 1) / (tf + words.K1 * (1 - words.B + words.B * F.col("len") / average[F.col("field")]))
    wanted = sum(1 << k for k, t in enumerate(terms) if t in rest)
    chosen = F.col("term").isin(sorted(rest)) if rest else F.lit(False)
    aggs = [F.max("links").alias("links"), F.bit_or(bit).alias("held"), F.sum(part * times[F.col("term")]).alias("whole"), F.sum(F.when(chosen, part * times[F.col("term")])).alias("some")]
    chunks = hits.groupBy("path", order).agg(*aggs).withColumn("every", F.col("held") == (1 << len(terms)) - 1)
    score = X.backlink_boost(F.when(F.col("every"), F.col("whole")).otherwise(F.col("some")), F.col("links"))
    share = F.when(F.col("every"), 1.0).otherwise(F.bit_count(F.col("held").bitwiseAND(F.lit(wanted).cast("long"))) / max(1, len(rest)))
    scored = chunks.where(F.col("every") | F.col("some").isNotNull()).select("path", order, "every", F.round(score, 9).alias("score"), share.alias("share"))
    best = scored.groupBy("path").agg(F.max_by(F.struct(order, "every", "score", "share"), F.struct("every", "score", -F.col(order))).alias("b")).select("path", "b.*")
    top = best.orderBy(F.desc("every"), F.desc("score"), "path").limit(limit).collect()  # `limit` rows
    together = bool(top) and top[0]["every"]
    return [(r["path"], r[order], r["score"], r["share"], k) for k, r in enumerate([r for r in top if r["every"] or not together], 1)], together
