"""Command line over libraries and repositories: `python -m foliant.cli COMMAND`; results are JSON, one row a line."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import code, fusion, links
from .plans.evaluation import evaluate_set
from .plans.library import Library
from .sources import decode, files, git, markup, models
from .sources.store import Stale, Store

def show(df: DataFrame) -> None:
    for row in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        print(row["j"])


def find(lib: Library, a) -> None:
    limit = fusion.shown_results(a.limit)
    if a.words:
        found, every = lib.search_words(a.query, limit)
        label = X.found_by(F.col("rank"), F.lit(every), F.lit(None).cast("double"), F.lit(False))
    else:
        found, every = lib.search(a.query, limit)
        meaning = F.col("meaning_score") if "meaning_score" in found.columns else F.lit(None).cast("double")
        label = X.found_by(F.col("words_rank"), F.lit(every), meaning, F.coalesce("across", F.lit(False)))
    show(found.withColumn("found_by", label).orderBy(F.desc("score"), "path"))


def index(lib: Library, a) -> None:
    report = lib.update([os.path.abspath(p) for p in a.scope] or None)
    row = asdict(report) | {"no_op": report.no_op, "embedded": lib.update_vectors() if a.vectors else 0}
    show(lib.spark.createDataFrame([row], "added int, changed int, unchanged int, removed int, skipped int, reindexed int, no_op boolean, embedded int"))


def source(lib: Library, a) -> None:
    if a.action == "add":
        lib.add_source(os.path.abspath(a.path), a.exclude)
    elif a.action == "remove":
        lib.remove_source(os.path.abspath(a.path))
    else:
        show(lib.sources().orderBy("path"))


def model(spark: SparkSession, a) -> None:
    if a.action == "verify":
        print("true" if models.verify(a.path, a.sha256) else "false")
    else:
        rows = [(m.name, m.repository, m.revision, m.license, m.dims, m.pooling, m.max_tokens, m.recipe) for m in models.MODELS.values()]
        show(spark.createDataFrame(rows, "name string, repository string, revision string, license string, dims int, pooling string, max_tokens int, recipe string"))


def repo(spark: SparkSession, a) -> None:
    root = os.path.abspath(a.root)
    if a.action == "status":
        return show(git.revision(spark, root))
    if a.action == "history":
        found = git.matching(git.commits(spark, root, a.limit), a.text, a.touching)
        return show(found.orderBy("nth").drop("nth"))
    store = Store(spark, f"file://{os.path.join(root, '.foliant')}")
    if a.action == "index":
        try:
            before = store.read("code")
        except Stale:
            before = None
        written = store.write("code", code.reindex(git.work_tree(spark, root), before), revision=git.head(root))
        rows = store.read("code").agg(F.count("*").alias("files"), F.sum(F.size("symbols")).alias("symbols"))
        return show(rows.withColumn("written", F.lit(written)))
    indexed = store.read("code")
    if indexed is None:
        raise SystemExit("not indexed yet: run `repo index` first")
    if a.action == "symbols":
        show(code.symbols(indexed, a.text, a.kind, a.under))
    elif a.action == "deps":
        edges = links.resolve_imports(code.imports(indexed), indexed.select("path"))
        show((edges.where((F.col("from_path") == a.under) | (F.col("to_path") == a.under)) if a.under else edges).orderBy("from_path", "to_path"))
    else:
        rows = code.summaries(indexed, a.all)
        show((rows.where(F.col("path").startswith(a.under)) if a.under else rows).orderBy("path"))


def passage_of(spark: SparkSession, path: str) -> str:
    """The opening chunk of a file, in the form in which passages are embedded."""
    rows = files.scan(spark, os.path.dirname(path), within=[os.path.basename(path)])
    kind = files.kind_of(F.col("path"), files.sniff(F.col("content"))["format"])
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    text = F.when(kind.isin("text", "markdown"), decode.decoded(F.col("content"))["text"])
    first = rows.withColumn("d", markup.read_udf(stem, kind, text, F.col("content"))).where("size(d.chunks) > 0").select("d.title", F.get("d.chunks", F.lit(0)).alias("c"))
    row = first.select(X.embedding_passage(F.col("title"), F.col("c.headings"), F.col("c.text")).alias("p")).first()
    if row is None:
        raise SystemExit(f"{path} holds no text")
    return row["p"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliant", description=__doc__)
    p.add_argument("--library", default=os.environ.get("FOLIANT_LIBRARY", os.path.expanduser("~/.foliant")), help="folder of the library's tables")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("find")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--words", action="store_true", help="words alone")
    c = sub.add_parser("similar")
    c.add_argument("path")
    c.add_argument("--limit", type=int, default=10)
    c = sub.add_parser("preview")
    c.add_argument("path")
    c.add_argument("line", type=int)
    c = sub.add_parser("index")
    c.add_argument("scope", nargs="*", help="only these files or folders")
    c.add_argument("--vectors", action="store_true", help="embed new passages as well")
    c = sub.add_parser("source")
    c.add_argument("action", choices=("add", "remove", "list"))
    c.add_argument("path", nargs="?", default=".")
    c.add_argument("--exclude", action="append", default=[])
    sub.add_parser("health")
    sub.add_parser("status")
    c = sub.add_parser("model")
    c.add_argument("action", choices=("list", "verify"))
    c.add_argument("path", nargs="?")
    c.add_argument("sha256", nargs="?")
    c = sub.add_parser("eval")
    c.add_argument("path", help="query set in JSON")
    c = sub.add_parser("repo")
    c.add_argument("action", choices=("index", "symbols", "deps", "summary", "history", "status"))
    c.add_argument("text", nargs="?", help="part of a name, or of a message")
    c.add_argument("--root", default=".")
    c.add_argument("--kind")
    c.add_argument("--under")
    c.add_argument("--touching")
    c.add_argument("--all", action="store_true", help="private declarations as well")
    c.add_argument("--limit", type=int, default=git.HISTORY_LIMIT)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("foliant").getOrCreate()
    if a.command == "model":
        return model(spark, a)
    if a.command == "repo":
        return repo(spark, a)
    lib = Library(spark, a.library if ":/" in a.library else f"file://{os.path.abspath(a.library)}")
    if a.command == "similar":
        # "-" is a passage from stdin; a file outside the library is read as the library would read it
        known = a.path != "-" and lib.chunks([os.path.abspath(a.path)]).limit(1).count()
        passage = None if known else sys.stdin.read() if a.path == "-" else passage_of(spark, os.path.abspath(a.path))
        show(lib.similar(os.path.abspath(a.path) if known else None, fusion.shown_results(a.limit), passage=passage).orderBy(F.desc("score"), "path"))
    elif a.command == "preview":
        show(lib.preview(os.path.abspath(a.path), a.line))
    elif a.command == "eval":
        show(evaluate_set(lib, f"file://{os.path.abspath(a.path)}").orderBy("engine", F.col("group").asc_nulls_first()))
    elif a.command in ("health", "status"):
        show(getattr(lib, a.command)())
    else:
        {"find": find, "index": index, "source": source}[a.command](lib, a)


if __name__ == "__main__":
    main(sys.argv[1:])
