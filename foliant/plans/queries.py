"""The registered queries of the search and code engine over the driver's tables, each with its SQL where SQL can say it.

`documents` stands for a library of plain texts, `conversations` for documents of numbered lines,
`embeddings` for stored vectors, `events` for a stream of changes, `pages` for web pages.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..operators import axes, chunker, code, diff, evaluate, explain, fusion, health, index, knn, links, many, passages, preview, words
from ..sources import files, git, markup
from ..sources.store import Store, scratch
from ..streaming import bursts

QUESTION = "the licensed software was and thing"
NOW = 1706745600  # 2024-02-01
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as one chunk each: path, body, line, modified, title."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").alias("body"), F.lit(1).cast("long").alias("line"), F.col("source").alias("title"), "lang")


_STORES: dict[tuple, Store] = {}
#: Bytes of the documents' files for which a bucket of the stored chunks is dealt to one more task.
PIECE = 8 << 20


def stored(spark: SparkSession, sf_dir: str, stemmed: bool = True) -> Store:
    """The documents as a stored index: chunks, postings, figures, vectors. Built when it is first asked for in an application, as long as the file stays the same."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    at = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, sf_dir, at.getModificationTime(), at.getLen(), stemmed)
    if key not in _STORES:
        store = Store(spark, f"{scratch(spark)}/index-{'-'.join(str(abs(hash(k)) % 10**8) for k in key)}-{time.time_ns()}")
        rows = library(spark, sf_dir).withColumn("modified", F.lit(NOW) - F.col("doc_id") % 90 * 86400).withColumn("headings", F.array().cast("array<string>"))
        rows = rows.select("path", "title", "body", "line", "modified", "headings").withColumn("bucket", index.bucket(F.col("path")))
        share = 1 + path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() // PIECE // index.BUCKETS
        piece = F.col("bucket") * F.lit(share) + F.pmod(F.crc32(F.col("path")), F.lit(share))
        store.add("chunks", rows.repartition(piece).sortWithinPartitions("bucket", "path", "line"), ("bucket",))
        chunks = store.read("chunks")
        store.add("postings", index.stored_order(index.postings(chunks, stemmed)), ("bucket",))
        store.add("figures", index.figures(store.read("postings")))
        store.add("vectors", chunks.select("path", "line", passages.word_hash_vectors(F.col("body")).alias("vec")))
        _STORES[key] = store
    return _STORES[key]


def found_words(store: Store, question: str, limit: int, stemmed: bool = True) -> DataFrame:
    """The words half over a stored index."""
    found, _ = index.search(store.read("postings"), store.read("figures"), question, limit, stemmed)
    return words.shown(_chunks_of(store, [f[0] for f in found]), found)


def found_meaning(store: Store, question: str, limit: int) -> DataFrame:
    """The meaning half: the nearest vectors, then the chunks of these alone."""
    q = passages.word_hash_embedding(F.lit(question))
    score = F.round(V.dot(q, F.col("vec")), 9)
    top = store.read("vectors").select("path", "line", score.alias("score")).orderBy(F.desc("score"), "path").limit(limit).collect()
    ranked = store.spark.createDataFrame([(r["path"], r["line"], r["score"], k) for k, r in enumerate(top, 1)], "path string, line long, score double, rank int")
    return _chunks_of(store, [r["path"] for r in top]).join(F.broadcast(ranked), ["path", "line"])  # `limit` rows


def _chunks_of(store: Store, paths: list[str]) -> DataFrame:
    near = F.col("bucket").isin(sorted(set(map(index.bucket_of, paths)))) & F.col("path").isin(paths)
    return store.read("chunks").where(near).drop("bucket")


#: DuckDB's form of the analyzer, and of the library.
D_WORDS = r"list_transform(list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'), lambda w: octet_length(encode(w)) < 48), lambda w: lower(w))"
D_LIB = "lib AS (SELECT doc_id, source || '/' || doc_id::VARCHAR || '.txt' AS path, text AS body, source AS title, " + D_WORDS.format("text") + " AS terms FROM documents)"
D_UNIT = "list_transform({0}, lambda x: x::DOUBLE / sqrt(list_sum(list_transform({0}, lambda y: y::DOUBLE * y::DOUBLE))))"


def _terms_sql(q: str) -> str:
    return "[" + ", ".join(f"'{t}'" for t in sorted(set(words.terms_of(q, False)))) + "]"


@query("WITH " + D_LIB + " SELECT doc_id, len(terms)::BIGINT AS n_terms, len(list_distinct(terms))::BIGINT AS n_distinct, array_to_string(terms[1:5], ' ') AS opening FROM lib")
def tokenize(spark, sf_dir):
    t = X.words(F.col("text"))
    return load(spark, sf_dir, "documents").withColumn("t", t).select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.slice("t", 1, 5), " ").alias("opening"))


@query("WITH " + D_LIB + " SELECT term, count(*)::BIGINT AS df FROM (SELECT DISTINCT doc_id, unnest(terms) AS term FROM lib) GROUP BY term")
def term_df(spark, sf_dir):
    return words.term_df(words.analyzed(library(spark, sf_dir).select("path", "body"), False))


@query("WITH " + D_LIB + ", p AS (SELECT path, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM lib) SELECT term, path, count(*)::INT AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p GROUP BY ALL")
def postings(spark, sf_dir):
    """The whole inverted index: every term of every document with all its positions."""
    got = index.postings(library(spark, sf_dir).select("path", "body", "line"), False).where(F.col("bucket") != index.LENGTHS)
    return got.select("term", "path", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("WITH " + D_LIB + f", f AS (SELECT 'body' AS field, len(terms) AS n FROM lib UNION ALL SELECT 'title', len({D_WORDS.format('title')}) FROM lib UNION ALL SELECT 'headings', 0 FROM lib) SELECT field, count(*)::BIGINT AS n, round(avg(n), 6) AS average FROM f GROUP BY field")
def index_figures(spark, sf_dir):
    """The corpus figures of the stored index, which is built here unless another query has asked for it."""
    return stored(spark, sf_dir).read("figures").select("field", "n", F.round("average", 6).alias("average"))


_BM25 = """
WITH {lib}, p AS (SELECT path, unnest(terms) AS term FROM lib), tf AS (SELECT path, term, count(*) AS tf FROM p GROUP BY ALL),
len AS (SELECT path, len(terms) AS len FROM lib), fig AS (SELECT count(*) AS n, avg(len) AS avg FROM len),
q AS (SELECT DISTINCT item_id AS query_id, unnest({words}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT q.query_id, tf.path, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (path), fig GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS rank FROM s)
SELECT query_id, path, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 10"""


@query(_BM25.format(lib=D_LIB, words=D_WORDS.format("text")))
def bm25_topk(spark, sf_dir):
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(X.words(F.col("text"))).alias("term"))
    return many.bm25_many(library(spark, sf_dir), asked, 10, "path").select("query_id", "path", "rank", F.round("score", 6).alias("score"))


_HAS = "list_has_all(terms, {0})"


@query("WITH " + D_LIB + f" SELECT doc_id FROM lib WHERE list_has_all(terms, {_terms_sql('the was and')})")
def all_words(spark, sf_dir):
    chunks = words.analyzed(library(spark, sf_dir).select("doc_id", "body"), False)
    clauses, _ = words.parse("the was and", False)
    keep = words.holds(clauses[0], ["body"])
    for c in clauses[1:]:
        keep = keep & words.holds(c, ["body"])
    return chunks.where(keep).select("doc_id")


@query("WITH " + D_LIB + f" SELECT path, round(len(list_intersect(list_distinct(terms), {_terms_sql(QUESTION)})) / {len(set(words.terms_of(QUESTION, False)))}, 6) AS share FROM lib WHERE list_has_any(terms, {_terms_sql(QUESTION)})")
def any_words_share(spark, sf_dir):
    clauses = words.known_clauses(QUESTION, False)
    counted = words.Counted(words.analyzed(library(spark, sf_dir).select("path", "line", "body"), False), clauses)
    return counted.rows.where(words.matched(counted, clauses, False)).select("path", F.round(words.share(counted, words.terms_of(QUESTION, False)), 6).alias("share"))


@query("WITH " + D_LIB + r""", d AS (SELECT word, 2 * (SELECT count(*) FROM lib WHERE list_contains(terms, word)) > (SELECT count(*) FROM lib) AS common FROM (SELECT unnest(string_split('""" + QUESTION + r"""', ' ')) AS word))
SELECT word, NOT common OR (SELECT bool_and(common) FROM d) AS kept FROM d""")
def distinctive_words(spark, sf_dir):
    kept = words.distinctive(QUESTION, words.analyzed(library(spark, sf_dir).select("body"), False), False).split()
    return spark.createDataFrame([(w, w in kept) for w in QUESTION.split()], "word string, kept boolean")


@query("WITH " + D_LIB + " SELECT doc_id, len(regexp_extract_all(' ' || array_to_string(terms, ' ') || ' ', '(licensed under the) '))::INT AS n FROM lib WHERE contains(' ' || array_to_string(terms, ' ') || ' ', ' licensed under the ')")
def phrase_match(spark, sf_dir):
    chunks = words.analyzed(library(spark, sf_dir).select("doc_id", "body"), False)
    clause = words.parse('"licensed under the"', False)[0][0]
    return chunks.select("doc_id", words._in(F.col("terms.body"), clause).alias("n")).where("n > 0")


@query("SELECT conv_id::VARCHAR AS path, turn AS line, score FROM (SELECT conv_id, turn, length(text)::DOUBLE AS score, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r = 1")
def best_chunk_per_doc(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    scores = c.select("key", F.length("text").cast("double").alias("score"))
    return knn.best_passages(scores, c.select("key", F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"))).select("path", "line", "score")


#: Rows of each half in `rrf_fuse`, as each engine answers with its best only.
DEPTH = 500

_FUSE = f"""
WITH w AS (SELECT path, rank, share, modified FROM (SELECT source || '/' || doc_id AS path, row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS rank, (doc_id % 4 + 1) / 4.0::DOUBLE AS share, doc_id * 3600 + 1704067200 AS modified FROM documents) WHERE rank <= {DEPTH}),
m AS (SELECT path, rank, modified FROM (SELECT source || '/' || doc_id AS path, row_number() OVER (ORDER BY md5(text), doc_id)::INT AS rank, doc_id * 3600 + 1704067200 AS modified FROM documents) WHERE rank <= {DEPTH}),
j AS (SELECT coalesce(w.path, m.path) AS path, w.rank AS words_rank, m.rank AS meaning_rank, coalesce(w.modified, m.modified) AS modified,
      coalesce(1.5 * w.share * w.share / (8 + w.rank), 0) + coalesce(1.0 / (8 + m.rank), 0) AS part FROM w FULL JOIN m ON w.path = m.path)
SELECT path, words_rank, meaning_rank, round(part * (1 + 0.1 * pow(2.0, -greatest({NOW} - modified, 0) / 86400.0 / 30.0)), 6) AS score FROM j"""


def _halves(spark, sf_dir):
    """Two rankings of all documents, by length and by hash of the text; the best of each."""
    d = load(spark, sf_dir, "documents")
    path, modified = F.concat_ws("/", "source", "doc_id").alias("path"), (F.col("doc_id") * 3600 + 1704067200).alias("modified")
    top = d.orderBy(F.desc("n_chars"), "doc_id").limit(DEPTH)
    w = top.select(path, F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"), F.col("n_chars").cast("double").alias("score"), ((F.col("doc_id") % 4 + 1) / 4.0).alias("share"), modified)
    top = d.select("*", F.md5("text").alias("h")).orderBy("h", "doc_id").limit(DEPTH)
    m = top.select(path, F.row_number().over(W.orderBy("h", "doc_id")).alias("rank"), F.lit(0.0).alias("score"), modified)
    return w, m


@query(_FUSE)
def rrf_fuse(spark, sf_dir):
    return fusion.fuse(*_halves(spark, sf_dir), NOW, None).select("path", "words_rank", "meaning_rank", F.round("score", 6).alias("score"))


@query(f"SELECT event_id, round(1 + 0.1 * pow(2.0, -greatest({NOW} - epoch(ts)::BIGINT, 0) / 86400.0 / 30.0), 6) AS freshness FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def freshness(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(X.freshness(F.unix_timestamp("ts"), F.lit(NOW)), 6).alias("freshness"))


@query("SELECT o_custkey, round(10.0 * (1 + 0.1 * ln(1 + count(*))), 6) AS score FROM orders GROUP BY o_custkey")
def backlink_boost(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", F.round(X.backlink_boost(F.lit(10.0), F.col("n")), 6).alias("score"))


def _linked(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    one = F.concat(F.lit("Note"), (F.col("doc_id") * 7 % 500).cast("string"), F.lit(".md"))
    two = F.concat(F.lit("./DE/note"), (F.col("doc_id") * 3 % 400).cast("string"))
    return d.select("source", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.col("lang"), F.lit("/note"), (F.col("doc_id") % 500).cast("string")).alias("rel"), F.array(one, two).alias("links"), F.col("source").alias("title"))


_LINKS = """
d AS (SELECT source, 'p' || doc_id AS path, lang || '/note' || (doc_id % 500) AS rel, unnest(['note' || (doc_id * 7 % 500), 'de/note' || (doc_id * 3 % 400)]) AS target FROM documents),
n AS (SELECT DISTINCT source, path, rel FROM d),
f AS (SELECT d.source, d.path AS from_path, d.target, count(*) AS c, min(n.path) AS to_path FROM d JOIN n ON d.source = n.source AND (n.rel = d.target OR ends_with(n.rel, '/' || d.target)) GROUP BY ALL),
e AS (SELECT DISTINCT from_path, to_path FROM f WHERE c = 1 AND from_path <> to_path)"""


@query(f"WITH {_LINKS} SELECT * FROM e")
def link_resolution(spark, sf_dir):
    return links.resolve_links(_linked(spark, sf_dir))


@query(f"WITH {_LINKS} SELECT to_path AS path, count(DISTINCT from_path)::INT AS backlink_count FROM e GROUP BY to_path")
def backlinks_per_document(spark, sf_dir):
    d = _linked(spark, sf_dir)
    return links.backlinks(links.resolve_links(d), d).select("path", "backlink_count")


@query(f"WITH {_LINKS} SELECT DISTINCT to_path AS path FROM e JOIN (SELECT 'p' || doc_id AS from_path FROM documents WHERE lang = 'fr') USING (from_path)")
def reindex_closure(spark, sf_dir):
    d = _linked(spark, sf_dir)
    e = links.resolve_links(d)
    return links.to_reindex(d.where(F.col("rel").startswith("fr/")).select("path"), e, e)


@query("""
WITH c AS (SELECT conv_id, turn * 10 + 3 AS start, text FROM conversations), p AS (SELECT DISTINCT conv_id, turn * 7 AS line FROM conversations),
r AS (SELECT p.conv_id, p.line, c.start, left(c.text, 20) AS body, row_number() OVER (PARTITION BY p.conv_id, p.line ORDER BY (c.start <= p.line) DESC, CASE WHEN c.start <= p.line THEN -c.start ELSE c.start END) AS n FROM p JOIN c USING (conv_id))
SELECT conv_id::VARCHAR AS path, line, start, body FROM r WHERE n = 1""")
def asof_chunk(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    chunks = c.select(F.col("conv_id").cast("string").alias("path"), (F.col("turn") * 10 + 3).alias("line"), F.left("text", F.lit(20)).alias("body"))
    return preview.asof_chunk(c.select(F.col("conv_id").cast("string").alias("path"), (F.col("turn") * 7).alias("line")).distinct(), chunks)


@query("""
WITH m AS (SELECT conv_id, turn * 3 AS page, turn AS ord, role || turn AS heading FROM conversations), p AS (SELECT conv_id, unnest(range(1, 12)) AS page FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT p.conv_id::VARCHAR AS path, p.page, arg_max(m.heading, m.ord) AS heading FROM p LEFT JOIN m ON m.conv_id = p.conv_id AND m.page <= p.page GROUP BY ALL""")
def asof_bookmark(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").withColumn("path", F.col("conv_id").cast("string"))
    marks = c.select("path", (F.col("turn") * 3).alias("page"), F.col("turn").alias("ord"), F.concat("role", F.col("turn").cast("string")).alias("heading"))
    pages = c.select("path").distinct().withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(11).cast("long"))))
    return preview.asof_bookmark(pages, marks)


@query("""
WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), h AS (SELECT * FROM c WHERE turn = 2)
SELECT c.conv_id::VARCHAR AS path, h.turn AS hit_line, c.turn AS line, (c.at - h.at)::INT AS "offset", greatest(h.at - 2, 0)::INT AS earlier, greatest(h.n - h.at - 2, 0)::BIGINT AS later
FROM c JOIN h ON c.conv_id = h.conv_id AND c.at BETWEEN h.at - 1 AND h.at + 2""")
def preview_neighbors(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"), F.col("text").alias("body"))
    return preview.neighbours(c, c.where("line = 2"), 1, 2).drop("body")


_KNN = f"""
WITH v AS (SELECT vec_id, {D_UNIT.format('embedding')} AS u FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: q.u[i] * v.u[i])), 9) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id {{0}}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT {{1}} round(score, 6) AS score FROM r WHERE rank <= 10"""


@query(_KNN.format("= 0", "vec_id,"))
def knn_exact(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    q = list(v.where("vec_id = 0").first()["embedding"])
    return knn.exact(v.where("vec_id != 0"), q, 10).select("vec_id", F.round("score", 6).alias("score"))


@query(_KNN.format("% 100 = 0", "query_id, vec_id, rank::INT AS rank,"))
def knn_join(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return knn.exact_many(v, q, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"""
WITH v AS (SELECT vec_id, label, {D_UNIT.format('embedding')} AS u FROM embeddings),
s AS (SELECT label, vec_id, round(list_sum(list_transform(range(1, 65), lambda i: q.u[i] * v.u[i])), 9) AS score FROM v, (SELECT u FROM v WHERE vec_id = 0) q),
b AS (SELECT label::VARCHAR AS path, arg_max(vec_id, (score, -vec_id)) AS line, max(score) AS score FROM s GROUP BY label)
SELECT path, line, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, path)::INT AS rank FROM b) WHERE rank <= 10""")
def best_passage_per_document(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in v.where("vec_id = 0").first()["embedding"]])
    scores = v.select(F.col("vec_id").alias("key"), F.round(V.dot(V.unit(q), V.unit(F.col("embedding"))), 9).alias("score"))
    places = v.select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("path"), F.col("vec_id").alias("line"))
    rows = [(r["path"], r["line"], round(r["score"], 6), r["rank"]) for r in knn.nearest_documents(scores, places, 10)]
    return spark.createDataFrame(rows, "path string, line long, score double, rank int")


@query(f"SELECT vec_id, round(u[1], 6) AS x1, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm FROM (SELECT vec_id, {D_UNIT.format('list_transform(embedding, lambda e: e::DOUBLE * 3.0)')} AS u FROM embeddings)")
def unit_vectors(spark, sf_dir):
    u = V.unit(F.transform("embedding", lambda e: e * F.lit(3.0)))
    return load(spark, sf_dir, "embeddings").withColumn("u", u).select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("x1"), F.round(V.norm(F.col("u")), 6).alias("norm"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), a AS (SELECT list_transform(range(64), lambda i: 0.125::DOUBLE) AS a),
p AS (SELECT vec_id, e, list_sum(list_transform(e, lambda x: x * 0.125)) AS d FROM v), w AS (SELECT vec_id, list_transform(e, lambda x: x - d * 0.125) AS w FROM p)
SELECT vec_id, round(w[1] / sqrt(list_sum(list_transform(w, lambda x: x * x))), 6) AS x1, round(w[64] / sqrt(list_sum(list_transform(w, lambda x: x * x))), 6) AS x64 FROM w""")
def language_axis_projection(spark, sf_dir):
    v = axes.neutral(F.col("embedding"), [[0.125] * 64])
    return load(spark, sf_dir, "embeddings").withColumn("v", v).select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("x1"), F.round(F.get("v", F.lit(63)), 6).alias("x64"))


_RANKS = """ranks AS (SELECT e.engine, doc_id AS query_id, lang AS "group", CASE WHEN (doc_id * e.k) % 13 < 10 THEN (doc_id * e.k) % 13 + 1 END AS rank FROM documents, (VALUES ('words', 3), ('meaning', 5)) e(engine, k))"""


@query("WITH " + _RANKS + """ SELECT engine, "group", count(*)::BIGINT AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit3, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit10, round(avg(coalesce(1.0::DOUBLE / rank, 0.0)), 6) AS mrr FROM ranks GROUP BY GROUPING SETS ((engine), (engine, "group"))""")
def eval_metrics(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    e = spark.createDataFrame([("words", 3), ("meaning", 5)], "engine string, k int")
    place = F.col("doc_id") * F.col("k") % 13
    qrels = d.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("group"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    results = d.join(F.broadcast(e)).select("engine", F.col("doc_id").alias("query_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), (place + 1).alias("rank"))
    m = evaluate.metrics(evaluate.first_ranks(results, qrels))
    return m.select("engine", "group", "queries", *[F.round(c, 6).alias(c) for c in ("hit1", "hit3", "hit10", "mrr")])


@query("SELECT DISTINCT 'd' || d.doc_id AS path FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def unknown_expected(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    lab = load(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    return evaluate.unknown_expected(d, lab)


def _snapshots(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    before = o.where("o_orderkey % 10 != 0").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("hash"))
    after = o.where("o_orderkey % 7 != 0").select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 5 == 0, "changed").otherwise(F.col("o_orderstatus")).alias("hash"))
    return before, after


_SNAP = """b AS (SELECT o_orderkey::VARCHAR AS path, o_orderstatus AS h FROM orders WHERE o_orderkey % 10 <> 0),
a AS (SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 7 <> 0),
d AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.path = b.path)"""


@query(f"WITH {_SNAP} SELECT path, change FROM d")
def change_diff(spark, sf_dir):
    return diff.change_diff(*_snapshots(spark, sf_dir))


@query(f"WITH {_SNAP} SELECT count_if(change = 'added')::BIGINT AS added, count_if(change = 'changed')::BIGINT AS changed, count_if(change = 'unchanged')::BIGINT AS unchanged, count_if(change = 'removed')::BIGINT AS removed, count_if(change IN ('added', 'changed'))::BIGINT AS parsed, false AS no_op FROM d")
def change_counts(spark, sf_dir):
    return diff.change_counts(diff.change_diff(*_snapshots(spark, sf_dir)))


@query(f"WITH {_SNAP} SELECT path FROM d WHERE change <> 'unchanged'")
def symmetric_diff_paths(spark, sf_dir):
    b, a = _snapshots(spark, sf_dir)
    return diff.symmetric_difference(b.withColumnRenamed("hash", "oid"), a.withColumnRenamed("hash", "oid"))


@query(f"WITH {_SNAP} SELECT b.path FROM b ANTI JOIN a USING (path)")
def removed_docs(spark, sf_dir):
    b, a = _snapshots(spark, sf_dir)
    return diff.removed(b, a).select("path")


@query(f"WITH {_SNAP} SELECT bool_or(change <> 'unchanged') AS dirty FROM d")
def dirty_flag(spark, sf_dir):
    return diff.dirty(*_snapshots(spark, sf_dir))


@query(f"WITH {_SNAP} SELECT path, h AS hash FROM a UNION ALL SELECT path, h FROM b ANTI JOIN a USING (path)")
def upsert(spark, sf_dir):
    return diff.upsert(*_snapshots(spark, sf_dir))


@query("SELECT o_orderkey::VARCHAR AS path, o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 AS kept FROM orders")
def walked_unchanged(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("size"), F.unix_timestamp("o_orderdate").alias("modified"), F.lit("s").alias("source"), F.lit("1").alias("reader"), "o_orderkey")
    walked = o.withColumn("size", F.col("size") + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)).drop("o_orderkey")
    return diff.to_read(o.where("o_orderkey % 3 != 0"), walked).select("path", "kept")


@query("SELECT e.event_id AS id, e.event_id % 3 = 0 AS read FROM events e")
def history_reuse(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    got = diff.reuse_history(e.select(F.col("event_id").alias("id"), F.col("event_id").alias("nth")), e.where("event_id % 3 != 0").select(F.col("event_id").alias("id"), "event_type"))
    return got.select("id", "read")


@query("SELECT DISTINCT false AS everything, path FROM (SELECT event_type AS path FROM events UNION SELECT 'u' || user_id FROM events)")
def scope_union(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    one = e.select(F.lit(False).alias("everything"), F.col("event_type").alias("path"))
    return diff.union_scope(one, e.select(F.lit(False).alias("everything"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path")))


@query("SELECT DISTINCT true AS everything, NULL::VARCHAR AS path FROM events WHERE user_id % 7 = 0")
def scope_everything(spark, sf_dir):
    """A scope that says everything absorbs the rest."""
    e = load(spark, sf_dir, "events")
    one = e.select(F.lit(False).alias("everything"), F.col("event_type").alias("path"))
    return diff.union_scope(one, e.select((F.col("user_id") % 7 == 0).alias("everything"), F.lit(None).cast("string").alias("path")))


@query("SELECT sha256(text) AS key, count(*)::INT AS places, min(doc_id) AS first FROM documents WHERE text <> '' GROUP BY ALL")
def dedup_passages(spark, sf_dir):
    c = load(spark, sf_dir, "documents").select(F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("headings"), F.col("text").alias("body"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("line"))
    return passages.passages(c).select("key", F.size("places").alias("places"), F.array_min(F.transform("places", lambda p: p["line"])).alias("first"))


@query("SELECT source AS path, bool_and(doc_id % 50 <> 7) AS complete FROM (SELECT source, min(doc_id) OVER (PARTITION BY text) AS doc_id FROM documents) GROUP BY source")
def index_coverage(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    c = d.select(F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("headings"), F.col("text").alias("body"), F.col("source").alias("path"), F.col("doc_id").alias("line"))
    have = d.groupBy("text").agg(F.min("doc_id").alias("m")).where("m % 50 != 7").select(F.sha2("text", 256).alias("key"))
    return passages.coverage(c, have)


@query(r"""SELECT doc_id, CASE WHEN c = 0 AND l = 0 THEN 'other' WHEN c >= l THEN 'cyrillic' ELSE 'latin' END AS script FROM (
SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '[\x{0400}-\x{04FF}]'))) AS c, len(list_filter(w, lambda x: NOT regexp_matches(x, '[\x{0400}-\x{04FF}]') AND regexp_matches(x, '[A-Za-z]'))) AS l FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents))""")
def script_of_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.script_of_text(F.col("text")).alias("script"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def session_bursts(spark, sf_dir):
    return bursts.sessions(load(spark, sf_dir, "events"), 30 * 60 * 1000, ("user_id",))


@query()
def capped_bursts(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "ts")
    return bursts.capped_bursts(e, 60 * 60 * 1000, 6 * 60 * 60 * 1000)


@query("""
WITH f AS (SELECT 'src/' || event_type || '/' || (event_id % 100) || '.ts' AS path FROM events UNION SELECT 'src/click/index.ts'),
i AS (SELECT DISTINCT 'src/' || event_type || '/' || (event_id % 100) || '.ts' AS from_path, unnest(['./' || (event_id % 50), '../click', 'react']) AS module FROM events),
c AS (SELECT from_path, module, CASE WHEN starts_with(module, './') THEN regexp_replace(from_path, '[^/]*$', '') || module[3:] || '.ts' ELSE 'src/click/index.ts' END AS to_path FROM i WHERE starts_with(module, '.'))
SELECT DISTINCT c.from_path, c.to_path FROM c JOIN f ON f.path = c.to_path""")
def import_resolution(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    path = F.concat(F.lit("src/"), "event_type", F.lit("/"), (F.col("event_id") % 100).cast("string"), F.lit(".ts"))
    modules = F.array(F.concat(F.lit("./"), (F.col("event_id") % 50).cast("string")), F.lit("../click"), F.lit("react"))
    every = e.select(path.alias("path")).distinct().unionByName(spark.createDataFrame([("src/click/index.ts",)], "path string"))
    asked = e.select(path.alias("path"), F.lit("typescript").alias("language"), F.explode(modules).alias("module")).distinct()
    return links.resolve_imports(asked, every)


@query("""
WITH s AS (SELECT l_orderkey AS path, l_linenumber AS id, l_linenumber * 10 AS start, CASE WHEN l_linenumber = 1 THEN 1000 WHEN l_linenumber % 2 = 0 THEN l_linenumber * 10 + 15 ELSE l_linenumber * 10 + 3 END AS "end" FROM lineitem)
SELECT i.path::VARCHAR AS path, i.id, arg_max(o.id, o.start) FILTER (WHERE o.id <> i.id AND o.start <= i.start AND o."end" >= i."end") AS parent FROM s i JOIN s o ON i.path = o.path GROUP BY i.path, i.id""")
def innermost_parent(spark, sf_dir):
    n = F.col("l_linenumber")
    end = F.when(n == 1, 1000).when(n % 2 == 0, n * 10 + 15).otherwise(n * 10 + 3)
    s = load(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").cast("string").alias("path"), n.alias("id"), (n * 10).alias("start"), end.alias("end"))
    return links.innermost_parent(s).select("path", "id", "parent")


_STATE = """m AS (SELECT doc_id, source, text, CASE WHEN doc_id % 11 = 3 THEN 'windows-1251' END AS guessed FROM documents WHERE length(text) BETWEEN 1 AND 20000),
s AS (SELECT source, CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' ELSE 'too large' END AS why FROM documents WHERE NOT coalesce(length(text) BETWEEN 1 AND 20000, false)),
h AS (SELECT source, why FROM s UNION ALL SELECT source, 'textless' FROM m WHERE length(text) < 40 UNION ALL SELECT source, 'guessed ' || guessed FROM m WHERE guessed IS NOT NULL)"""


def _state(spark, sf_dir):
    """Manifest and skipped files as a library would have them of `documents`, each source but the first registered."""
    d = load(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    good = F.coalesce(F.length("text").between(1, 20000), F.lit(False))
    m = d.where(good).select("path", "source", (F.length("text") < 40).alias("textless"), F.when(F.col("doc_id") % 11 == 3, "windows-1251").alias("guessed"), F.ceil(F.length("text") / 1500).alias("chunks"))
    skipped = d.where(~good).select("path", "source", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty").otherwise("too large").alias("why"))
    sources = d.select(F.col("source").alias("path")).distinct()
    return m, skipped, sources.join(sources.agg(F.min("path").alias("path")), "path", "left_anti")


@query(f"WITH {_STATE} SELECT why, count(*)::BIGINT AS n FROM h WHERE source <> (SELECT min(source) FROM documents) GROUP BY why")
def health_counts(spark, sf_dir):
    return health.counts(health.unread(*_state(spark, sf_dir)))


@query(f"WITH {_STATE} SELECT guessed AS encoding, count(*)::BIGINT AS n FROM m WHERE guessed IS NOT NULL GROUP BY guessed")
def guessed_encodings(spark, sf_dir):
    return health.guessed_encodings(_state(spark, sf_dir)[0])


@query("SELECT doc_id, CASE WHEN length(text) > 240 THEN rtrim(left(text, 240), ' ') || '…' ELSE text END AS fragment FROM documents")
def opening_fragment(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.opening_fragment(F.col("text")).alias("fragment"))


@query("""SELECT doc_id, bucket, floor((row_number() OVER (PARTITION BY bucket, part ORDER BY n, doc_id) - 1) / 256)::BIGINT AS "window" FROM (SELECT doc_id, greatest(length(text), 1) AS n, floor(16 * log2(greatest(length(text), 1)))::INT AS bucket, doc_id % 8 AS part FROM documents)""")
def length_windows(spark, sf_dir):
    return passages.length_windows(load(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", part=F.col("doc_id")).select("doc_id", "bucket", "window")


@query(r"SELECT page_id, lower(trim(regexp_replace(list_last(string_split(url, '/')), '(\.md|\.MD)$', ''))) AS key FROM pages")
def link_keys(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", X.link_key(F.col("url")).alias("key"))


@query("SELECT conv_id, turn, ['role ' || role, 'turn' || turn] AS targets FROM conversations")
def wikilinks(spark, sf_dir):
    t = F.concat(F.lit("see [[role "), "role", F.lit("|x]] and [[ turn"), F.col("turn").cast("string"), F.lit("#head ]] [[role "), "role", F.lit("]] [[]]"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", X.wikilinks(t).alias("targets"))


@query("""
WITH w AS (SELECT item_id, """ + D_WORDS.format("text") + """ AS w FROM benchmark),
s AS (SELECT item_id, list_transform(w, lambda x: ('0x' || left(md5(x), 2))::INT % 64) AS s FROM w),
c AS (SELECT item_id, list_transform(range(64), lambda i: len(list_filter(s, lambda x: x = i))::DOUBLE) AS c FROM s)
SELECT item_id, round(c[1] / n, 6) AS x1, round(c[33] / n, 6) AS x33, round(c[64] / n, 6) AS x64 FROM (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM c)""")
def word_hash_embedding(spark, sf_dir):
    v = load(spark, sf_dir, "benchmark").select("item_id", passages.word_hash_embedding(F.col("text")).alias("v"))
    return v.select("item_id", *[F.round(F.get("v", F.lit(i)), 6).alias(f"x{i + 1}") for i in (0, 32, 63)])


@query("SELECT conv_id, turn, role || chr(10) || (CASE WHEN turn % 2 = 0 THEN 'a › b' ELSE role || ' › b' END) || chr(10) || text AS passage FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN role ELSE role END AS role, text FROM conversations WHERE turn % 2 = 0) UNION ALL SELECT conv_id, turn, role || chr(10) || 'b' || chr(10) || text FROM conversations WHERE turn % 2 = 1")
def embedding_passage(spark, sf_dir):
    headings = F.when(F.col("turn") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.col("role"), F.lit("b")))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", X.embedding_passage(F.col("role"), headings, F.col("text")).alias("passage"))


@query("SELECT event_id, concat_ws(' + ', CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'words' ELSE 'some words' END END, CASE WHEN event_id % 5 = 0 THEN 'meaning ' || printf('%.2f', (event_id % 100) / 100.0) END, CASE WHEN event_id % 7 = 0 THEN 'another language' END) AS label FROM events")
def found_by_label(spark, sf_dir):
    i = F.col("event_id")
    label = X.found_by(F.when(i % 3 == 0, i), i % 2 == 0, F.when(i % 5 == 0, (i % 100) / 100.0), i % 7 == 0)
    return load(spark, sf_dir, "events").select("event_id", label.alias("label"))


@query("SELECT page_id, lower(regexp_extract(url, '[^/]\\.([^./]+)$', 1)) IN ('md', 'markdown', 'txt', 'text', 'pdf', 'docx', 'epub') OR regexp_extract(url, '[^/]\\.([^./]+)$', 1) = '' AS offered FROM pages")
def offered_files(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", files.offered(F.col("url")).alias("offered"))


@query("""SELECT event_id, ['pdf', 'zip', 'image', 'image', 'other', 'image', 'other', 'image', 'text', 'text', 'image', 'ole'][event_id % 12 + 1] AS format FROM events""")
def sniff_formats(spark, sf_dir):
    """One head of each sort: PDF, ZIP, PNG, WebP, another RIFF, HEIF, another ISO medium, BMP, a text that begins like one, plain text, JPEG, an OLE container."""
    heads = ["255044462D312E37", "504B030414", "89504E470D0A1A0A00", "524946460000000057454250", "524946460000000057415645", "0000001866747970686569630000", "000000186674797069736F6D0000", "424D" + "00" * 12 + "28000000", "424D57206973206120636172", "616263", "FFD8FFE000", "D0CF11E0A1B11AE1"]
    return load(spark, sf_dir, "events").select("event_id", files.sniff(F.unhex(F.get(F.array(*map(F.lit, heads)), (F.col("event_id") % 12).cast("int"))))["format"].alias("format"))


@query("SELECT user_id, count(*)::BIGINT AS n FROM events WHERE contains(lower(event_type || ' ' || props), 'click') AND user_id % 10 = 1 GROUP BY user_id")
def history_filters(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("summary"), F.col("props").alias("body"), F.array(F.concat(F.lit("src/"), (F.col("user_id") % 10).cast("string"), F.lit("/f"), F.col("user_id").cast("string")), F.lit("README")).alias("paths"))
    return git.matching(e, "CLICK", "src/1/").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN v >= 1000000000 THEN printf('%.1f GB', v / 1e9) WHEN v >= 1000000 THEN round_even(v / 1e6, 0)::BIGINT || ' MB' ELSE ceil(v / 1e3)::BIGINT || ' KB' END AS size FROM (SELECT event_id, (event_id * 370037)::BIGINT AS v FROM events)")
def human_sizes(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", X.human_size(F.col("event_id") * 370037).alias("size"))


@query("SELECT event_id, CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN ceil(s / 60.0)::BIGINT || ' min' ELSE s // 3600 || ' h ' || s % 3600 // 60 || ' min' END AS took FROM (SELECT event_id, round(event_id * 0.75)::BIGINT AS s FROM events)")
def human_durations(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", X.human_duration(F.col("event_id") * F.lit(0.75)).alias("took"))


_COMMENTS = ["@ts-check ", "go:build ", "https://a.b/", "see https://a.b/", " eslint-disable ", "About ", "type: ignore ", "!/usr/bin/env ", "global x ", "globally "]


@query("SELECT conv_id, turn, len(list_filter(['@', 'go:', '+build', 'eslint', 'prettier', 'type: ignore', '!/', 'global '], lambda p: starts_with(trim(c), p))) > 0 OR regexp_full_match(trim(c), 'https?://[^ \\t\\n\\r]*') AS directive FROM (SELECT conv_id, turn, [" + ", ".join(f"'{c}'" for c in _COMMENTS) + "][turn % 10 + 1] || CASE WHEN conv_id % 3 = 0 THEN '' ELSE text END AS c FROM conversations)")
def comment_directives(spark, sf_dir):
    head = F.get(F.array(*map(F.lit, _COMMENTS)), (F.col("turn") % 10).cast("int"))
    comment = F.concat(head, F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.col("text")))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", X.is_directive(comment).alias("directive"))


@query(r"""WITH w AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[^ \t\n\r]+'), lambda t: regexp_replace(t, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda t: NOT regexp_matches(t, '\p{N}')) AS w FROM benchmark),
l AS (SELECT item_id, list_transform(w, lambda t: regexp_replace(t, '\P{L}', '', 'g')) AS l FROM w)
SELECT item_id, greatest(coalesce(list_sum(list_transform(list_filter(l, lambda t: regexp_full_match(t, '\p{Latin}+')), lambda t: length(t))), 0), coalesce(list_sum(list_transform(list_filter(l, lambda t: regexp_full_match(t, '\p{Cyrillic}+')), lambda t: length(t))), 0), coalesce(list_sum(list_transform(list_filter(l, lambda t: regexp_full_match(t, '[^\p{Latin}\p{Cyrillic}]+')), lambda t: length(t))), 0))::INT AS letters FROM l""")
def clean_letters(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", X.clean_letters(F.col("text")).alias("letters"))


@query("""
WITH p AS (SELECT conv_id::VARCHAR AS path, turn AS page, CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END AS text FROM conversations), r AS (SELECT conv_id::VARCHAR AS path, turn AS page, CASE WHEN conv_id % 4 = 0 THEN '' ELSE role END AS text FROM conversations WHERE turn % 2 = 0)
SELECT path, page, CASE WHEN trim(p.text) = '' AND trim(coalesce(r.text, '')) <> '' THEN r.text ELSE p.text END AS text, trim(p.text) = '' AND trim(coalesce(r.text, '')) <> '' AS recognized FROM p LEFT JOIN r USING (path, page)""")
def filled_pages(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").withColumns({"path": F.col("conv_id").cast("string"), "page": F.col("turn")})
    pages = c.select("path", "page", F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")).alias("text"))
    seen = c.where("turn % 2 = 0").select("path", "page", F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.col("role")).alias("text"))
    return markup.fill_pages(pages, seen)


@query("SELECT sha256(string_agg(octet_length(encode(role)) || ':' || role || octet_length(encode(text)) || ':' || text, '' ORDER BY conv_id, turn)) AS hash FROM conversations WHERE conv_id < 20")
def parallel_set_identity(spark, sf_dir):
    """A set is a few hundred sentences that people translated; the first twenty conversations stand for one."""
    few = load(spark, sf_dir, "conversations").where("conv_id < 20")
    return axes.set_identity(few.select((F.col("conv_id") * 1000 + F.col("turn")).alias("nth"), F.col("role").alias("en"), F.col("text").alias("ru")))


@query("SELECT o_orderkey::VARCHAR AS path, (o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0) OR (o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0) AS kept FROM orders")
def refused_unchanged(spark, sf_dir):
    """Refused files stay refused unless they changed or could only not be opened."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("size"), F.unix_timestamp("o_orderdate").alias("modified"), F.lit("s").alias("source"), F.lit("1").alias("reader"), "o_orderkey")
    walked = o.withColumn("size", F.col("size") + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)).drop("o_orderkey")
    refused = o.where("o_orderkey % 3 = 0").withColumn("why", F.when(F.col("o_orderkey") % 5 == 0, "unopened").otherwise("damaged"))
    return diff.to_read(o.where("o_orderkey % 3 != 0"), walked, refused).select("path", "kept")


@query("SELECT event_type, bool_or(NOT s.dirty AND NOT n.dirty) AS covers FROM (SELECT DISTINCT event_type, event_type = 'click' AS dirty FROM events) s, (SELECT false AS dirty) n GROUP BY event_type")
def revision_covers(spark, sf_dir):
    """A stored revision stands for another of the same commit if neither tree has edits; one row for each of a few commits."""
    kinds = [r["event_type"] for r in load(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    out = None
    for kind in kinds:
        a, b = (spark.createDataFrame([(kind, dirty)], "id string, dirty boolean") for dirty in (kind == "click", False))
        one = diff.covers(a, b).select(F.lit(kind).alias("event_type"), "covers")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id, contains(text, chr(10)) OR length(text) >= 140 AS passage FROM documents")
def passage_or_question(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.is_passage(F.col("text")).alias("passage"))


@query("SELECT doc_id, (len(string_split(left(text, 300), chr(10))))::INT AS line FROM documents")
def line_of_offset(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.line_of_offset(F.col("text"), F.lit(300)).alias("line"))


@query(f"WITH {_STATE} SELECT source, count(*)::BIGINT AS documents, sum(ceil(length(text) / 1500))::BIGINT AS chunks FROM m GROUP BY source")
def library_status(spark, sf_dir):
    return health.status(_state(spark, sf_dir)[0], ("source",))


# Not to be said in SQL: tests/test_whole.py holds each of these against brute force, whole.


@query()
def chunk_documents(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.lit("text").alias("kind"), "text")
    return chunker.chunks(chunker.documents(d)).select("path", "line", "headings", "body")


@query()
def html_pages(spark, sf_dir):
    return chunker.chunks(markup.html_documents(load(spark, sf_dir, "pages"), "page_id", "html")).select("page_id", "title", "headings", "line", "body")


@query()
def stemmed_search(spark, sf_dir):
    return found_words(stored(spark, sf_dir), QUESTION, 10).select("path", "rank", F.round("score", 6).alias("score"), "share")


_SENTENCES = r"""
WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS l FROM benchmark),
p AS (SELECT item_id, l, unnest(string_split(regexp_replace(line, '([.!?…])([ \t])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS piece, unnest(range(len(string_split(regexp_replace(line, '([.!?…])([ \t])', '\1' || chr(1) || '\2', 'g'), chr(1))))) AS i FROM l),
s AS (SELECT item_id, l, i, trim(piece) AS text FROM p WHERE regexp_matches(piece, '[\p{L}\p{N}]')),
n AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY l, i) - 1)::INT AS nth FROM s)
SELECT item_id, nth, text, octet_length(encode(text))::BIGINT AS size FROM n WHERE nth < 32"""


@query(_SENTENCES)
def sentences(spark, sf_dir):
    """The first 32 sentences of each text, as many as an explanation looks at."""
    return explain.each_sentence(load(spark, sf_dir, "benchmark"), "text", "item_id").select("item_id", "nth", "text", (F.col("end") - F.col("start")).alias("size"))


@query()
def knn_hashed(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    return knn.hashed(v, list(v.where("vec_id = 0").first()["embedding"]), 10)


@query()
def language_axes(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    a, b = v.where("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("long").alias("i"), F.col("embedding").alias("a")), v.where("vec_id % 2 = 1").select(((F.col("vec_id") - 1) / 2).cast("long").alias("i"), F.col("embedding").alias("b"))
    found = axes.measure(a.join(b, "i"), 64)
    return spark.createDataFrame([(k, [float(x) for x in axis]) for k, axis in enumerate(found)], "axis int, v array<double>")


@query()
def closest_sentence(spark, sf_dir):
    s = explain.each_sentence(load(spark, sf_dir, "benchmark"), "text", "item_id")
    q = passages.word_hash_embedding(F.lit(QUESTION))
    scored = s.withColumn("score", F.round(V.dot(q, passages.word_hash_embedding(F.col("text"))), 9))
    return explain.closest_sentence(scored, "item_id")


@query()
def highlight_marks(spark, sf_dir):
    marks = explain.marks_column(F.col("text"), words.terms_of(QUESTION))
    return load(spark, sf_dir, "benchmark").select("item_id", marks.alias("marks"))


_SOURCE = "import os" + chr(10) + "from .part{k} import x" + chr(10) + chr(10) + "class S{k}:" + chr(10) + "    def run(self, n: int) -> int:" + chr(10) + "        return n" + chr(10) + chr(10) + "def _help{k}():" + chr(10) + "    pass" + chr(10)


@query("""
WITH f AS (SELECT s_suppkey AS k, 'src/s' || s_suppkey || '.py' AS path FROM supplier)
SELECT path, 'S' || k AS name, 'type' AS kind, 4 AS line, NULL::VARCHAR AS parent, 'class S' || k AS signature, true AS public FROM f
UNION ALL SELECT path, 'run', 'function', 5, 'S' || k, 'def run(self, n: int) -> int', true FROM f
UNION ALL SELECT path, '_help' || k, 'function', 8, NULL, 'def _help' || k || '()', false FROM f""")
def code_symbols(spark, sf_dir):
    """A source file for each supplier."""
    k = F.col("s_suppkey").cast("string")
    files = load(spark, sf_dir, "supplier").select(F.concat(F.lit("src/s"), k, F.lit(".py")).alias("path"), F.replace(F.lit(_SOURCE), F.lit("{k}"), k).alias("text"))
    return code.symbols(code.index_files(files)).select("path", "name", "kind", "line", "parent", "signature", "public")


@query("""
WITH f AS (SELECT s_suppkey AS k, 'src/s' || s_suppkey || '.py' AS path FROM supplier)
SELECT path, 'os' AS module, 1 AS line FROM f UNION ALL SELECT path, '.part' || k, 2 FROM f""")
def code_imports(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    files = load(spark, sf_dir, "supplier").select(F.concat(F.lit("src/s"), k, F.lit(".py")).alias("path"), F.replace(F.lit(_SOURCE), F.lit("{k}"), k).alias("text"))
    return code.imports(code.index_files(files)).select("path", "module", "line")


@query()
def hybrid_search(spark, sf_dir):
    """The flagship: words and meaning over all documents, fused into one list."""
    return _hybrid(stored(spark, sf_dir), QUESTION).select("path", F.round("score", 6).alias("score"), "words_rank", "meaning_rank", F.round("share", 6).alias("share"), "across", "line", "fragment")


def _hybrid(store: Store, question: str, stemmed: bool = True) -> DataFrame:
    depth, fragment = fusion.candidates(10), X.opening_fragment(F.col("body")).alias("fragment")
    kept = ["path", "rank", "score", "title", "headings", "line", "modified", fragment]
    return fusion.mark_across(fusion.fuse(found_words(store, question, depth, stemmed).select(*kept, "share"), found_meaning(store, question, depth).select(*kept), NOW, 10), question)


_Q_TERMS = _terms_sql(QUESTION)
_HYBRID = f"""
WITH {D_LIB}, f AS (SELECT path, 'body' AS field, 1.0 AS boost, terms AS t FROM lib UNION ALL SELECT path, 'title', 3.0, {D_WORDS.format('title')} FROM lib),
q AS (SELECT unnest({_Q_TERMS}) AS term), n AS (SELECT count(*)::DOUBLE AS n FROM lib), avgs AS (SELECT field, avg(len(t)) AS avg FROM f GROUP BY field),
tf AS (SELECT path, field, boost, term, len(t)::DOUBLE AS len, len(list_filter(t, lambda x: x = term))::DOUBLE AS tf FROM f, q WHERE list_contains(t, term)),
df AS (SELECT field, term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
held AS (SELECT path, count(DISTINCT term) AS held FROM tf GROUP BY path), together AS (SELECT coalesce(max(held), 0) = {len(set(words.terms_of(QUESTION, False)))} AS yes FROM held),
rare AS (SELECT term FROM q WHERE 2 * coalesce((SELECT df FROM df WHERE df.term = q.term AND field = 'body'), 0) <= (SELECT n FROM n)),
used AS (SELECT term FROM q WHERE (SELECT yes FROM together) OR term IN (SELECT term FROM rare) OR (SELECT count(*) FROM rare) = 0),
s AS (SELECT path, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS score, count(DISTINCT term) AS held
      FROM tf JOIN used USING (term) JOIN df USING (field, term) JOIN avgs USING (field), n GROUP BY path),
w AS (SELECT path, held / (SELECT count(*) FROM used)::DOUBLE AS share, row_number() OVER (ORDER BY round(score, 9) DESC, path)::INT AS rank FROM s WHERE NOT (SELECT yes FROM together) OR held = (SELECT count(*) FROM used)),
h AS (SELECT path, list_transform(terms, lambda x: ('0x' || left(md5(x), 2))::INT % 64) AS s FROM lib),
c AS (SELECT path, list_transform(range(64), lambda i: len(list_filter(s, lambda x: x = i))::DOUBLE) AS c FROM h),
qs AS (SELECT list_transform({D_WORDS.format("'" + QUESTION + "'")}, lambda x: ('0x' || left(md5(x), 2))::INT % 64) AS s),
qc AS (SELECT list_transform(range(64), lambda i: len(list_filter(s, lambda x: x = i))::DOUBLE) AS q FROM qs),
d AS (SELECT path, round(coalesce(list_sum(list_transform(range(1, 65), lambda i: (c[i] / greatest(sqrt(list_sum(list_transform(c, lambda x: x * x))), 1e-300)) * (q[i] / sqrt(list_sum(list_transform(q, lambda x: x * x)))))), 0), 9) AS score FROM c, qc),
m AS (SELECT path, row_number() OVER (ORDER BY score DESC, path)::INT AS rank FROM d),
w30 AS (SELECT * FROM w WHERE rank <= 30), m30 AS (SELECT * FROM m WHERE rank <= 30),
j AS (SELECT coalesce(w30.path, m30.path) AS path, w30.rank AS words_rank, m30.rank AS meaning_rank, w30.share AS share, coalesce(1.5 * share * share / (8 + w30.rank), 0) + coalesce(1.0 / (8 + m30.rank), 0) AS part FROM w30 FULL JOIN m30 ON w30.path = m30.path),
r AS (SELECT j.*, part * (1 + 0.1 * pow(2.0, -(doc_id % 90 * 86400) / 86400.0 / 30.0)) AS score FROM j JOIN lib USING (path))
SELECT path, round(score, 6) AS score, words_rank, meaning_rank, round(share, 6) AS share FROM r ORDER BY r.score DESC, path LIMIT 10"""


@query(_HYBRID)
def hybrid_plain(spark, sf_dir):
    """The same list over unstemmed terms, which SQL can say whole."""
    return _hybrid(stored(spark, sf_dir, False), QUESTION, False).select("path", F.round("score", 6).alias("score"), "words_rank", "meaning_rank", F.round("share", 6).alias("share"))
