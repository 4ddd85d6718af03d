"""The library: registered folders kept as tables, incremental updates, and hybrid search over them.

Chunks, postings, passages and vectors grow by segments: an update writes the rows of changed documents
only, under a generation of its own, and the manifest, written last, says which generation of each
document counts. Rows of other generations are dead; they go when segments are merged. A question
reads the postings of its own terms and the chunks of what it found.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..operators import axes as A
from ..operators import chunker, diff, explain, fusion, health, index, knn, links, passages, preview, words
from ..sources import decode, files, markup
from ..sources.store import Store

VERSION = 2
READER = "1"
#: Segments of a table beyond which an update merges them.
SEGMENTS = 12


MANIFEST = (
    "path string, rel string, modified long, size long, source string, kind string, reader string, hash string, title string, links array<string>, "
    "chunks int, guessed string, textless boolean, generation long"
)


class Overlap(ValueError):
    pass


class VectorsBehind(RuntimeError):
    pass


@dataclass
class UpdateReport:
    added: int = 0
    changed: int = 0
    unchanged: int = 0
    removed: int = 0
    skipped: int = 0
    reindexed: int = 0

    @property
    def no_op(self) -> bool:
        return not (self.added or self.changed or self.removed)


class Library:
    """Tables under a root folder: sources, manifest, skipped, edges, figures; in segments chunks, postings, places, vectors."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root, VERSION)

    # sources

    def sources(self) -> DataFrame:
        return self.store.read("sources") or self.spark.createDataFrame([], "path string, exclude array<string>")

    def add_source(self, path: str, exclude: list[str] = ()) -> None:
        path = path.rstrip("/")
        with self.store.lock():
            if files.overlaps(self.sources(), path).limit(1).count():
                raise Overlap(path)
            row = self.spark.createDataFrame([(path, list(exclude))], "path string, exclude array<string>")
            self.store.write("sources", self.sources().unionByName(row))

    def remove_source(self, path: str) -> None:
        """Its documents leave at the next update."""
        with self.store.lock():
            self.store.write("sources", self.sources().where(F.col("path") != path.rstrip("/")))

    # update

    def _walk(self, source: str, exclude: list[str], within: list[str] | None) -> DataFrame:
        rows = files.scan(self.spark, source, markup.ocr_engine is not None, within)
        rules = files.ignore_rules(source, exclude)
        rows = files.not_ignored(rows, rules).withColumn("source", F.lit(source))
        fmt = files.sniff(F.col("content"))
        return rows.withColumn("kind", files.kind_of(F.col("path"), fmt["format"])).withColumn("reader", F.lit(READER))

    def update(self, scope: list[str] | None = None) -> UpdateReport:
        """Bring the tables up to date: everything, or the given paths of any source. Writes nothing if nothing changed."""
        with self.store.lock():
            return self._update(scope)

    def _update(self, scope: list[str] | None) -> UpdateReport:
        import os

        manifest = self.store.read("manifest")
        if manifest is None:
            scope = None  # a new index always covers everything
        registered = [(r["path"], list(r["exclude"] or [])) for r in self.sources().collect()]  # folders a user named
        walked = None
        gone = []  # a source that can't be reached keeps its documents
        for path, exclude in registered:
            if not os.path.isdir(path):
                gone.append(path)
                continue
            within = None if scope is None else [os.path.relpath(p, path) for p in scope if (p + "/").startswith(path + "/")]
            if within is not None:  # a changed rule may let other files of its folder in or out
                within = [os.path.dirname(p) or "." if os.path.basename(p) in files.RULE_FILES else p for p in within]
            if within is not None and not within:
                continue
            there = None if within is None else [p for p in within if os.path.exists(os.path.join(path, p))]
            if there is not None and not there:
                continue
            part = self._walk(path, exclude, there)
            walked = part if walked is None else walked.unionByName(part)
        empty = "path string, rel string, modified long, size long, content binary, source string, kind string, reader string"
        walked = walked if walked is not None else self.spark.createDataFrame([], empty)
        old = manifest if manifest is not None else self.spark.createDataFrame([], MANIFEST)
        known = self.store.read("skipped")
        seen = diff.to_read(old, walked, known)
        fresh = seen.where(~F.col("kept") & files.within_limit(F.col("kind"), F.col("size")) & ~files.encrypted_package(F.when(F.hex(F.substring("content", 1, 8)) == "D0CF11E0A1B11AE1", F.col("content"))).eqNullSafe(True))
        d = decode.decoded(F.when(F.col("kind").isin("text", "markdown"), F.col("content")))
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
        read = fresh.withColumn("t", d).withColumn("hash", F.sha2("content", 256)).withColumn("d", markup.read_udf(stem, F.when(F.col("t.error").isNull() | ~F.col("kind").isin("text", "markdown"), F.col("kind")), F.col("t.text"), F.col("content")))
        work = f"{self.store.root}/_read"
        fs = self.store._fs()
        fs.delete(self.store._path("_read"), True)  # of an update that died
        generation = f"{work}/{time.time_ns()}"
        kept = ["path", "rel", "modified", "size", "source", "reader", "hash"]
        read.select(*kept, F.col("d.kind").alias("kind"), F.col("t.guessed").alias("is_guess"), F.col("t.encoding").alias("encoding"), "d.error", *[f"d.{c}" for c in ("title", "aliases", "tags", "links", "chunks")]).write.parquet(generation)
        got = self.spark.read.parquet(generation)
        good = got.where("error is null")
        entries = good.select(*kept, "kind", "title", "links", F.size("chunks").alias("chunks"), F.when(F.col("is_guess"), F.col("encoding")).alias("guessed"), (~F.col("kind").isin("text", "markdown") & F.forall("chunks", lambda c: c["text"] == "")).alias("textless")).withColumn("rel", X.relative_name(F.col("rel"), F.col("kind")))
        current = [p for p, _ in registered]
        reachable = F.col("source").isin(*[p for p in current if p not in gone]) if current else F.lit(False)
        looked = reachable if scope is None else reachable & F.exists(F.array(*map(F.lit, scope or [""])), lambda p: (F.col("path") == p) | F.col("path").startswith(F.concat(p, F.lit("/"))))
        lost = diff.removed(old.where(looked | ~F.col("source").isin(*current) if current else F.lit(True)), walked)
        changes = diff.change_diff(old.select("path", "hash"), entries.select("path", "hash"))
        c = changes.groupBy("change").count().collect()
        counts = {r["change"]: r["count"] for r in c}
        report = UpdateReport(counts.get("added", 0), counts.get("changed", 0), old.count(), lost.count(), got.where("error is not null").count())
        report.unchanged = report.unchanged - report.changed - report.removed
        if not report.no_op or manifest is None:
            self._commit(old, good, entries, lost, report)
        skipped = got.where("error is not null").select("path", "source", "size", "modified", F.col("error").alias("why"), "reader")
        if known is not None:  # files that were not read again stay refused while they are there
            there = known.join(walked.select("path"), "path", "left_semi").unionByName(known.where(F.col("source").isin(*current) & ~looked if current else F.lit(False))).distinct()
            skipped = skipped.unionByName(there.join(got.select("path"), "path", "left_anti"))
        self.store.write("skipped", skipped)
        fs.delete(self.store._path("_read"), True)
        return report

    def _commit(self, old: DataFrame, good: DataFrame, entries: DataFrame, lost: DataFrame, report: UpdateReport) -> None:
        """Write what has changed as a new generation; the manifest comes last, so it is never ahead of the index."""
        generation = time.time_ns()
        new = diff.upsert(old, entries.withColumn("generation", F.lit(generation)), lost)
        before = self.store.read("edges")
        before = before if before is not None else self.spark.createDataFrame([], "from_path string, to_path string")
        edges = links.resolve_links(new)
        touched = entries.select("path").unionByName(lost.select("path"))
        again = links.to_reindex(touched, before, edges)
        report.reindexed = again.count()
        again = again.join(entries, "path", "left_anti").join(new.select("path"), "path", "left_semi")
        rows = chunker.chunks(good.select("path", "kind", "source", "modified", "title", "aliases", "tags", "links", "chunks"))
        if report.reindexed and self.store.meta("chunks"):
            rows = rows.unionByName(self.chunks().join(again, "path", "left_semi").select(*rows.columns))
        new = new.join(again.withColumn("moved", F.lit(generation)), "path", "left").withColumn("generation", F.coalesce("moved", "generation")).drop("moved")
        back = links.backlinks(edges, new)
        rows = rows.join(back, "path", "left").withColumns({"backlinks": F.coalesce("backlinks", F.array().cast("array<string>")), "backlink_count": F.coalesce("backlink_count", F.lit(0)), "generation": F.lit(generation)})
        number = self.store.add("chunks", self._by_path(rows), ("bucket",))
        written = self.store.read("chunks", segments=True).where(F.col("seg") == number)
        self._add_index(written, generation)
        live = new.select("path", "generation")
        lengths = self.store.read("postings").where(F.col("bucket") == index.LENGTHS).join(live, ["path", "generation"], "left_semi")
        self.store.write("figures", index.figures(lengths))
        self.store.write("edges", edges)
        self.store.write("manifest", new.select(*old.columns))
        if len(self.store.meta("chunks")["segments"]) > SEGMENTS:
            self.merge()

    @staticmethod
    def _by_path(rows: DataFrame) -> DataFrame:
        by = rows.withColumn("bucket", index.bucket(F.col("path")))
        return by.repartition("bucket").sortWithinPartitions("bucket", "path", "line")

    def _add_index(self, chunks: DataFrame, generation: int) -> None:
        made = index.postings(chunks).withColumn("generation", F.lit(generation))
        self.store.add("postings", index.dealt(made, chunks.count()), ("bucket",))
        places = passages.passages(chunks).select("key", F.explode("places").alias("p")).select("key", "p.path", "p.line", F.lit(generation).alias("generation"))
        self.store.add("places", places)

    def _live(self, table: str) -> DataFrame:
        """Rows of the generation that counts; a filter on their columns reaches the scan."""
        manifest = self.store.read("manifest").select("path", "generation")
        return self.store.read(table).join(manifest, ["path", "generation"], "left_semi")

    def merge(self) -> None:
        """Write the live rows of each table in one segment and forget the dead ones."""
        for table, partition in (("chunks", ("bucket",)), ("postings", ("bucket",)), ("places", ())):
            rows = self._live(table)
            if table == "chunks":
                rows = self._by_path(rows.drop("bucket"))
            elif table == "postings":
                rows = index.dealt(rows, self.status().first()["chunks"])
            self.store.write(table, rows.select(*[c for c in rows.columns if c not in partition], *partition), partition)

    # state

    def chunks(self, paths: list[str] | None = None) -> DataFrame:
        """All chunks, or those of some documents, of which only the buckets are opened."""
        if self.store.meta("chunks") is None:
            return self.spark.createDataFrame([], "path string")
        rows = self._live("chunks")
        if paths is not None:
            rows = rows.where(F.col("bucket").isin(sorted(set(map(index.bucket_of, paths)))) & F.col("path").isin(list(paths)))
        return rows.drop("bucket", "generation")

    def status(self) -> DataFrame:
        return health.status(self.store.read("manifest"))

    def health(self) -> DataFrame:
        """why, path of files under a current source that could not be read in full: skipped, textless, guessed encoding."""
        return health.unread(self.store.read("manifest"), self.store.read("skipped"), self.sources()).orderBy("why", "path")

    def guessed(self) -> DataFrame:
        return health.guessed_encodings(self.store.read("manifest"))

    # vectors

    def update_vectors(self, embedder: Callable[[list[str]], list[list[float]]] | None = None, recipe: str = "words-md5/64") -> int:
        """Embed passages that have no vector yet; an index of another recipe starts anew. The stand-in embedder hashes words."""
        with self.store.lock():
            meta = self.store.meta("vectors_meta")
            if meta and meta["extra"]["recipe"] != recipe:
                self.store.drop("vectors")
            places = self._live("places")
            have = self.store.log("vectors")
            keys = places if have is None else passages.missing(places, have)
            at = keys.groupBy("key").agg(F.min(F.struct("path", "line")).alias("at")).select("key", "at.*")
            n = at.count()
            if n:
                text = X.embedding_passage(F.col("title"), F.col("headings"), F.col("body"))
                todo = self.chunks().join(at, ["path", "line"]).select("key", text.alias("passage"))
                self.store.add("vectors", todo.select("key", passages.word_hash_vectors(F.col("passage")).alias("vec")) if embedder is None else passages.embed(todo, embedder))
                self.store.compact("vectors", places)
            self.store.write("vectors_meta", self.spark.createDataFrame([(recipe,)], "recipe string"), recipe=recipe)
            return n

    # search

    def search_words(self, query: str, limit: int = 10) -> tuple[DataFrame, bool]:
        found, every = [], False
        if self.store.meta("figures"):
            found, every = index.search(self._live("postings"), self.store.read("figures"), query, limit)
        frag = explain.fragment_column(F.col("body"), words.terms_of(query))
        kept = ["path", "rank", "score", "share", "title", "headings", "line", "modified"]
        return words.shown(self.chunks([f[0] for f in found]), found).withColumn("f", frag).select(*kept, "f.fragment", "f.highlights"), every

    def search_meaning(self, vector: list[float], limit: int = 10, skip: str | None = None, axes: list[list[float]] = ()) -> DataFrame:
        """The documents nearest to a vector by their best passage. The nearest passages are few at first and grow until they hold enough documents."""
        vectors = self.store.log("vectors")
        if vectors is None:
            raise VectorsBehind("no vectors yet")
        v = A.neutral(F.col("vec"), axes) if axes else V.unit(F.col("vec"))
        q = A.neutral(F.array(*map(F.lit, vector)), axes) if axes else V.unit(F.array(*map(F.lit, map(float, vector))))
        best = knn.nearest_documents(vectors.select("key", V.dot(q, v).alias("score")), self._live("places"), limit, skip)
        shown = self.chunks([r["path"] for r in best]).select("path", "line", "title", "headings", "modified", X.opening_fragment(F.col("body")).alias("fragment"), F.array().cast("array<struct<start:long,end:long>>").alias("highlights"))
        ranked = self.spark.createDataFrame([(r["path"], r["line"], r["score"], r["rank"]) for r in best], "path string, line long, score double, rank int")
        return shown.join(F.broadcast(ranked), ["path", "line"]).select("path", "line", "score", "rank", "title", "headings", "modified", "fragment", "highlights")  # `limit` rows

    def search(self, query: str, limit: int = 10, embed: Callable[[str], list[float]] | None = None, now: int | None = None) -> tuple[DataFrame, bool]:
        """One list: words and meaning fused; rows in another script than the question's are marked."""
        now = int(time.time()) if now is None else now
        depth = fusion.candidates(limit)
        w, every = self.search_words(query, depth)
        m = self.search_meaning(self._embedded(query, embed), depth)
        return fusion.mark_across(fusion.fuse(w, m, now, limit), query), every

    def similar(self, path: str | None = None, limit: int = 10, now: int | None = None, passage: str | None = None, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
        """Documents close to the opening passage of one, which is left out itself, or to a passage that is given; words are not asked."""
        now = int(time.time()) if now is None else now
        if passage is not None:
            vector = self._embedded(passage, embed)
        else:
            first = self._live("places").where(F.col("path") == path).orderBy("line").limit(1)
            row = first.join(self.store.log("vectors"), "key").select("vec").first()
            if row is None:
                raise VectorsBehind(f"no vector of {path}")
            vector = list(row["vec"])
        m = self.search_meaning(vector, fusion.candidates(limit), skip=path)
        none = m.limit(0).withColumn("share", F.lit(1.0))
        return fusion.fuse(none, m, now, limit)

    def _embedded(self, text: str, embed: Callable[[str], list[float]] | None) -> list[float]:
        return list(embed(text)) if embed else list(self.spark.range(1).select(passages.word_hash_embedding(F.lit(text)).alias("v")).first()["v"])

    def explain(self, found: DataFrame, query: str, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
        """found (rows of `search`) with `why`: for rows found by meaning alone, the closest of the chunk's first sentences in the window shown for it."""
        rows = [(r["path"], r["line"]) for r in found.where(F.col("meaning_rank").isNotNull() & F.col("words_rank").isNull()).select("path", "line").collect()]  # of one list
        at = self.spark.createDataFrame(rows, "path string, line long")
        body = self.chunks([p for p, _ in rows]).join(F.broadcast(at), ["path", "line"]).select("path", "line", "body")
        each = explain.each_sentence(body, "body", "path", "line")
        if embed is None:
            scored = each.withColumn("score", V.dot(F.array(*map(F.lit, self._embedded(query, None))), passages.word_hash_vectors(F.col("text"))))
        else:
            q = V.unit(F.array(*[F.lit(float(x)) for x in embed([query])[0]]))
            made = passages.embed(each.select(F.concat_ws(":", "path", "line", "nth").alias("key"), "text"), embed, "text")
            scored = each.withColumn("key", F.concat_ws(":", "path", "line", "nth")).join(made, "key").withColumn("score", V.dot(q, V.unit(F.col("vec"))))
        best = explain.closest_sentence(scored, "path", "line").join(body, ["path", "line"])
        why = best.select("path", "line", F.struct(explain.window_udf("body", "start", "end").alias("window"), F.col("text").alias("sentence"), F.col("score").alias("closeness")).alias("why"))
        return found.join(why, ["path", "line"], "left")

    def preview(self, path: str, line: int, before: int = 1, after: int = 1) -> DataFrame:
        place = self.spark.createDataFrame([(path, line)], "path string, line long")
        mine = self.chunks([path])
        at = preview.asof_chunk(place, mine).select("path", F.col("start").alias("line"))
        return preview.neighbours(mine, at, before, after)
