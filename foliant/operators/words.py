"""Words half of the search: an inverted index, BM25 over boosted fields, all-words and any-words matching.

A query needs the counts of its few terms in each chunk: from a stored index (operators/index.py),
which is how libraries are searched, or counted inside the rows of analyzed chunks. Corpus figures
(document frequencies of the asked terms) are one aggregate row. Many queries at once go through
operators/many.py.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.stem import stem

BOOSTS = {"title": 3.0, "aliases": 3.0, "headings": 2.0, "tags": 2.0, "body": 1.0, "links": 1.0, "backlinks": 0.5}
K1, B = 1.2, 0.75


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_words(col: pd.Series) -> pd.Series:
    return col.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def analyze(text: Column, stemmed: bool = True) -> Column:
    """The terms of a text in order."""
    return stem_words(X.words(text)) if stemmed else X.words(text)


def terms_of(text: str, stemmed: bool = True) -> list[str]:
    """The same for a query string on the driver."""
    found = [w.lower() for w in re.findall(r"[^\W_]+", text) if len(w.encode()) < X.WORD_LIMIT]
    return [stem(w) for w in found] if stemmed else found


def analyzed(chunks: DataFrame, stemmed: bool = True) -> DataFrame:
    """chunks plus `terms`: a struct of the terms of each field; a field of several values counts as one text."""
    kinds = dict(chunks.dtypes)
    fields = [f for f in BOOSTS if f in kinds]
    one = {f: F.array_join(f, "\n") if kinds[f].startswith("array") else F.col(f) for f in fields}
    return chunks.withColumn("terms", F.struct(*[analyze(one[f], stemmed).alias(f) for f in fields]))


def term_df(chunks: DataFrame, field: str = "body") -> DataFrame:
    """term, df: chunks whose field holds the term."""
    return chunks.select(F.explode(F.array_distinct(f"terms.{field}")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@dataclass(frozen=True)
class Clause:
    """A word or phrase that is asked for; `field` narrows it, `sign` is '', '+' or '-'."""

    terms: tuple[str, ...]
    field: str | None = None
    sign: str = ""


def parse(query: str, stemmed: bool = True) -> tuple[list[Clause], bool]:
    """Lenient query language: words, "phrases", joined words as phrases, +word, -word, field:word, word^2, AND, OR. True if OR was said."""
    out, either = [], False
    for sign, name, quoted, bare in re.findall(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"?|(\S+))', query):
        if not quoted and bare in ("AND", "OR", "NOT"):
            either |= bare == "OR"
            continue
        field = name if name in BOOSTS else None
        text = (quoted or bare) if field or not name else f"{name} {quoted or bare}"
        terms = terms_of(re.sub(r"\^[\d.]+$", "", text), stemmed)
        if terms:
            out.append(Clause(tuple(terms), field, sign))
    return out, either


def _in(words: Column, clause: Clause) -> Column:
    """How often a clause stands in a list of words."""
    if len(clause.terms) == 1:
        return F.coalesce(F.size(words) - F.size(F.array_remove(words, clause.terms[0])), F.lit(0))
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.regexp_count(joined, F.lit(f"(?<= ){' '.join(clause.terms)}(?= )"))


@dataclass
class Corpus:
    """Figures of the index: rows, average field lengths, document frequencies of the asked clauses."""

    rows: int
    average: dict[str, float]
    df: dict[tuple[str, int], int]


def corpus(chunks: DataFrame, clauses: list[Clause]) -> Corpus:
    fields = chunks.schema["terms"].dataType.names
    aggs = [F.count("*").alias("n")] + [F.avg(F.size(f"terms.{f}")).alias(f"len_{f}") for f in fields]
    aggs += [F.count_if(_in(F.col(f"terms.{f}"), c) > 0).alias(f"df_{f}_{i}") for f in fields for i, c in enumerate(clauses)]
    row = chunks.agg(*aggs).first()
    return Corpus(row["n"], {f: row[f"len_{f}"] or 0.0 for f in fields}, {(f, i): row[f"df_{f}_{i}"] for f in fields for i in range(len(clauses))})


def idf(n: int, df: int) -> float:
    from math import log

    return log(1 + (n - df + 0.5) / (df + 0.5))


def of_fields(clause: Clause, fields) -> list[str]:
    return [f for f in fields if clause.field in (None, f)]


def holds(clause: Clause, fields) -> Column:
    return reduce(lambda a, b: a | b, [_in(F.col(f"terms.{f}"), clause) > 0 for f in of_fields(clause, fields)], F.lit(False))


def bm25(clauses: list[Clause], figures: Corpus, tf=None, length=None) -> Column:
    """Sum over clauses and fields, boosted; figures are constants in the expression.

    tf(field, i) and length(field) give columns where the counts have been made before.
    """
    tf = tf or (lambda f, i: _in(F.col(f"terms.{f}"), clauses[i]))
    length = length or (lambda f: F.size(f"terms.{f}"))
    parts = [F.lit(0.0)]
    for i, c in enumerate(clauses):
        if c.sign == "-":
            continue
        for f in of_fields(c, figures.average):
            df = figures.df[f, i]
            if df:
                n = tf(f, i).cast("double")
                long = K1 * (1 - B + B * length(f) / (figures.average[f] or 1.0))
                parts.append(F.lit(BOOSTS[f] * idf(figures.rows, df)) * n * (K1 + 1) / (n + long))
    return reduce(lambda a, b: a + b, parts)


def common(word: str, body_df: dict[str, int], rows: int, stemmed: bool = True) -> bool:
    """A plain word all of whose terms stand in more than half of the chunks."""
    bare = word.rstrip(",.;!?…")
    terms = terms_of(bare, stemmed)
    return bare.isalnum() and bool(terms) and all(2 * body_df.get(t, 0) > rows for t in terms)


def drop_common(query: str, df: dict[str, int], rows: int, stemmed: bool) -> str:
    return " ".join(w for w in query.split() if not common(w, df, rows, stemmed)) or query


def _query_terms(query: str, stemmed: bool) -> list[str]:
    return sorted({t for w in query.split() for t in terms_of(w, stemmed)})


def distinctive(query: str, chunks: DataFrame, stemmed: bool = True) -> str:
    """The query without common words; the whole query if nothing would remain."""
    terms = _query_terms(query, stemmed)
    if not terms:
        return query
    figures = corpus(chunks.select(F.struct(F.col("terms.body").alias("body")).alias("terms")), [Clause((t,)) for t in terms])
    return drop_common(query, {t: figures.df["body", i] for i, t in enumerate(terms)}, figures.rows, stemmed)


class Counted:
    """Chunks reduced to lengths and clause counts: path, order, links, len_<field>, tf_<field>_<clause>; with the corpus figures."""

    def __init__(self, chunks: DataFrame, clauses: list[Clause], order: str = "line"):
        self.fields = chunks.schema["terms"].dataType.names
        self.at = {(c.terms, c.field): i for i, c in enumerate(clauses)}
        links = F.col("backlink_count") if "backlink_count" in chunks.columns else F.lit(0)
        tf = [_in(F.col(f"terms.{f}"), c).alias(f"tf_{f}_{i}") for i, c in enumerate(clauses) for f in of_fields(c, self.fields)]
        self.rows = chunks.select("path", order, links.alias("links"), *[F.size(f"terms.{f}").alias(f"len_{f}") for f in self.fields], *tf)
        row = self.rows.agg(F.count("*").alias("n"), *[F.avg(f"len_{f}").alias(f) for f in self.fields]).first()
        self.n, self.average = row["n"], {f: row[f] or 0.0 for f in self.fields}


def _tf(counted, c: Clause, field: str) -> Column:
    return F.col(f"tf_{field}_{counted.at[c.terms, c.field]}")


def _holds(counted, c: Clause) -> Column:
    return reduce(lambda a, b: a | b, [_tf(counted, c, f) > 0 for f in of_fields(c, counted.fields)], F.lit(False))


def matched(counted, clauses: list[Clause], every: bool) -> Column:
    """Whether a chunk answers: every clause, or any, that is not excluded; what is required in any case."""
    asked = [c for c in clauses if c.sign != "-"]
    out = reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), [_holds(counted, c) for c in asked], F.lit(every))
    for c in clauses:
        out = out & _holds(counted, c) if c.sign == "+" else out & ~_holds(counted, c) if c.sign == "-" else out
    return out


def share(counted, terms: list[str]) -> Column:
    """Of the asked terms the share that a chunk holds."""
    each = sorted(set(terms))
    return reduce(lambda a, b: a + b, [_holds(counted, Clause((t,))).cast("int") for t in each], F.lit(0)) / len(each)


def known_clauses(query: str, stemmed: bool = True) -> list[Clause]:
    """All that an answer has to count: the query's clauses and its terms alone."""
    clauses, _ = parse(query, stemmed)
    alone = [Clause((t,)) for t in sorted({*_query_terms(query, stemmed), *(t for c in clauses for t in c.terms)})]
    return list({(c.terms, c.field): c for c in [*clauses, *alone]}.values())


def answer(counted, query: str, limit: int = 10, stemmed: bool = True, order: str = "line") -> tuple[list, bool]:
    """Rows (path, order, score, share, rank) of the best chunk of each of the `limit` best documents, in order; and whether all words were found together.

    counted: chunks as Counted or Indexed gives them. All words first, over all fields of a chunk; only
    if no chunk has them, any of the distinctive words. One aggregate gives all figures, one top-k the rows.
    """
    clauses, either = parse(query, stemmed)
    known = known_clauses(query, stemmed)
    fields = counted.fields
    aggs = [F.coalesce(F.max(matched(counted, clauses, not either)), F.lit(False)).alias("together")]
    aggs += [F.count_if(F.col(f"tf_{f}_{counted.at[c.terms, c.field]}") > 0).alias(f"df_{f}_{i}") for i, c in enumerate(known) for f in of_fields(c, fields)]
    row = counted.rows.agg(*aggs).first()
    all_words = row["together"]
    if all_words:
        every = matched(counted, clauses, not either)
    else:
        body = {c.terms[0]: row[f"df_body_{i}"] for i, c in enumerate(known) if c.field is None and len(c.terms) == 1} if "body" in fields else {}
        rest, _ = parse(drop_common(query, body, counted.n, stemmed), stemmed)
        if all((c.terms, c.field) in counted.at for c in rest):  # dropping a word from inside a phrase would make a new one
            clauses = rest
        every = matched(counted, clauses, False)
    at = {(c.terms, c.field): i for i, c in enumerate(known)}
    figures = Corpus(counted.n, counted.average, {(f, k): row[f"df_{f}_{at[c.terms, c.field]}"] for k, c in enumerate(clauses) for f in of_fields(c, fields)})
    score = bm25(clauses, figures, lambda f, k: _tf(counted, clauses[k], f), lambda f: F.col(f"len_{f}"))
    terms = sorted({t for c in clauses for t in c.terms})
    part = F.lit(1.0) if all_words or not terms else share(counted, terms)
    scored = counted.rows.where(every).select("path", order, F.round(X.backlink_boost(score, F.col("links")), 9).alias("score"), part.alias("share"))
    best = scored.groupBy("path").agg(F.max_by(F.struct(order, "score", "share"), F.struct("score", -F.col(order))).alias("b")).select("path", "b.*")
    top = best.orderBy(F.desc("score"), "path").limit(limit).collect()  # `limit` rows
    return [(r["path"], r[order], r["score"], r["share"], k) for k, r in enumerate(top, 1)], bool(all_words)


def shown(chunks: DataFrame, found: list, order: str = "line") -> DataFrame:
    """Rows of `answer` with their chunks' columns; only the chunks of the found paths are read."""
    spark = chunks.sparkSession
    ranked = spark.createDataFrame(found, f"path string, {order} long, score double, share double, rank int")
    kept = [c for c in chunks.columns if c != "terms"]
    near = chunks.where(F.col("path").isin([f[0] for f in found])) if found else chunks.limit(0)
    return near.select(*kept).join(F.broadcast(ranked), ["path", order]).orderBy("rank")  # as many rows as the caller asked for


def search(chunks: DataFrame, query: str, limit: int = 10, stemmed: bool = True, order: str = "line") -> tuple[DataFrame, bool]:
    """Chunks of `answer` over analyzed chunks (path, line, optionally backlink_count) that have no stored index: texts are read twice."""
    if not query.strip() or limit <= 0 or not parse(query, stemmed)[0]:
        return shown(chunks, [], order), False
    found, every = answer(Counted(chunks, known_clauses(query, stemmed), order), query, limit, stemmed, order)
    return shown(chunks, found, order), every
