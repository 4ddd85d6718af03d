"""The link graph: wikilinks to documents, backlinks, who must be read again, import edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Suffixes tried in order after the bare path, by language.
SUFFIXES = {
    "typescript": (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".d.ts", "/index.ts", "/index.tsx", "/index.js"),
    "python": (".py", ".pyi", "/__init__.py"),
    "rust": (),
    "go": (),
}


def resolve_links(docs: DataFrame) -> DataFrame:
    """docs(source, path, rel, links) -> edges(from_path, to_path): links that mean exactly one other document of the same source.

    A bare name is looked up by the last segment of rel; a path by every suffix of rel at a slash. Both
    are equi-joins: the suffixes of a name are few, so the table of names is exploded rather than compared.
    """
    names = docs.select("source", F.col("path").alias("to_path"), "rel")
    depth = F.size(F.split("rel", "/"))
    tails = names.withColumn("n", F.explode(F.sequence(F.lit(1), depth))).select("source", "to_path", "n", F.array_join(F.slice(F.split("rel", "/"), -F.col("n"), F.col("n")), "/").alias("target"))
    asked = docs.select("source", F.col("path").alias("from_path"), F.explode("links").alias("link")).withColumn("target", X.link_target(F.col("link")))
    asked = asked.withColumn("target", F.when(F.contains("target", F.lit("/")), F.col("target")).otherwise(X.link_key(F.col("target"))))
    one = asked.join(tails, ["source", "target"]).groupBy("source", "from_path", "link").agg(F.count("*").alias("n"), F.min("to_path").alias("to_path")).where("n = 1 AND to_path != from_path")
    return one.select("from_path", "to_path").distinct()


def backlinks(edges: DataFrame, titles: DataFrame) -> DataFrame:
    """path, backlinks (titles of linkers in order of their paths), backlink_count; titles(path, title)."""
    named = edges.join(titles.select(F.col("path").alias("from_path"), "title"), "from_path")
    got = named.groupBy(F.col("to_path").alias("path")).agg(F.array_sort(F.collect_set(F.struct("from_path", "title"))).alias("b"))
    return got.select("path", F.transform("b", lambda x: x["title"]).alias("backlinks"), F.size("b").alias("backlink_count"))


def to_reindex(changed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """path: documents whose backlinks differ because a linker changed, by old or new edges; changed(path)."""
    touched = before.unionByName(after).join(changed.select(F.col("path").alias("from_path")), "from_path", "left_semi")
    return touched.select(F.col("to_path").alias("path")).distinct()


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(path, language, module), files(path) -> edges(from_path, to_path).

    Only relative modules resolve: the bare path first, then the language's suffixes in order. Python's
    relative modules are split on slashes as well, so that only the package itself is found.
    """
    relative = imports.where(F.col("module").startswith("."))
    folder = F.filter(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda s: s != "")
    steps = F.filter(F.split("module", "/"), lambda s: (s != "") & (s != "."))

    def walk(acc, s):
        return F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    base = relative.withColumn("base", F.array_join(F.aggregate(steps, folder, walk), "/"))
    tried = F.lit(None).cast("array<string>")
    for language, suffixes in SUFFIXES.items():
        tried = F.when(F.col("language") == language, F.array(*[F.lit(s) for s in ("", *suffixes)])).otherwise(tried)
    each = base.select("path", "module", "base", F.posexplode(F.coalesce(tried, F.array(F.lit("")))).alias("nth", "suffix"))
    found = each.withColumn("to_path", F.concat("base", "suffix")).join(files.select(F.col("path").alias("to_path")), "to_path")
    best = found.groupBy("path", "module").agg(F.min_by("to_path", "nth").alias("to_path"))
    return best.select(F.col("path").alias("from_path"), "to_path").distinct()


@F.pandas_udf(T.ArrayType(T.LongType()))
def _parents(ends: pd.Series) -> pd.Series:
    """Of spans in order of start, given by their ends: the number of the innermost other one around each, or null."""
    out = []
    for file in ends:
        file = file.tolist()
        opened, parents = [], []
        for k, end in enumerate(file):
            while opened and file[opened[-1]] < end:
                opened.pop()
            parents.append(opened[-1] if opened else None)
            opened.append(k)
        out.append(parents)
    return pd.Series(out)


def innermost_parent(symbols: DataFrame) -> DataFrame:
    """symbols(path, id, start, end) plus parent: the id of the innermost other symbol around it.

    Intervals of one file nest or are apart, so a pass in order of start with a stack of open symbols
    needs no range join: what ends before this one's end has closed, the top of the rest is the parent.
    """
    order = F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), (-F.col("end").cast("long")).alias("back"), F.col("id").alias("id"))))
    files = symbols.groupBy("path").agg(order.alias("all"))
    files = files.withColumn("parents", _parents(F.transform("all", lambda s: -s["back"])))
    ids = F.transform("all", lambda s: s["id"])
    both = F.arrays_zip(ids.alias("id"), F.transform("parents", lambda k: F.get(ids, k.cast("int"))).alias("parent"))
    found = files.select("path", F.explode(both).alias("b")).select("path", F.col("b.id").alias("id"), F.col("b.parent").alias("parent"))
    return symbols.join(found, ["path", "id"], "left")
