"""Files: what is offered, what the first bytes say, size limits, ignore rules, scopes."""

from __future__ import annotations

import fnmatch
import os
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_EXTENSIONS = ("md", "markdown", "txt", "text", "pdf", "docx", "epub")
PICTURE_EXTENSIONS = ("png", "jpg", "jpeg", "jfif", "gif", "tif", "tiff", "bmp", "webp", "heic", "heif", "avif")
MIB = 1 << 20
LIMITS = {"text": 16 * MIB, "markdown": 16 * MIB, "image": 64 * MIB, "pdf": 256 * MIB, "docx": 256 * MIB, "epub": 256 * MIB, "zip": 256 * MIB}
HEAD = 8192
RULE_FILES = (".gitignore", ".foliant-ignore")

#: Leading bytes (hex), format, detail.
SIGNATURES = [
    ("255044462D", "pdf", None),
    ("504B0304", "zip", None),
    ("504B0506", "zip", None),
    ("D0CF11E0A1B11AE1", "ole", None),
    ("89504E470D0A1A0A", "image", "PNG"),
    ("FFD8FF", "image", "JPEG"),
    ("47494638", "image", "GIF"),
    ("49492A00", "image", "TIFF"),
    ("4D4D002A", "image", "TIFF"),
]
OTHERS = [("52494646", "audio or video"), ("1F8B", "gzip"), ("377ABCAF271C", "7z"), ("52617221", "rar"), ("7B5C727466", "rtf"), ("494433", "mp3"), ("4F676753", "ogg"), ("664C6143", "flac")]
BRANDS = {"heic": "HEIC", "heix": "HEIC", "heim": "HEIC", "heis": "HEIC", "hevc": "HEIC", "hevx": "HEIC", "hevm": "HEIC", "hevs": "HEIC", "mif1": "HEIF", "msf1": "HEIF", "avif": "AVIF", "avis": "AVIF"}
BMP_HEADERS = ("0C000000", "28000000", "34000000", "38000000", "40000000", "6C000000", "7C000000")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def claims_a_document(path: Column, pictures: bool = False) -> Column:
    return extension(path).isin(*DOCUMENT_EXTENSIONS, *(PICTURE_EXTENSIONS if pictures else ()))


def offered(path: Column, pictures: bool = False) -> Column:
    return (extension(path) == "") | claims_a_document(path, pictures)


def sniff(content: Column) -> Column:
    """(format, detail) from the first bytes; inside the JVM, on the hex of the head."""
    head = F.hex(F.substring(content, 1, 32))
    out = F.struct(F.lit("text").alias("format"), F.lit(None).cast("string").alias("detail"))

    def when(test: Column, fmt: str, detail, rest: Column) -> Column:
        return F.when(test, F.struct(F.lit(fmt).alias("format"), (F.lit(detail) if isinstance(detail, str) else detail if detail is not None else F.lit(None).cast("string")).alias("detail"))).otherwise(rest)

    for magic, what in reversed(OTHERS):
        out = when(head.startswith(magic), "other", what, out)
    brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    known = F.create_map(*[x for k, v in BRANDS.items() for x in (F.lit(k), F.lit(v))])
    is_box = F.substring(head, 9, 8) == "66747970"
    out = when(is_box, "other", "video", out)
    out = when(is_box & brand.isin(*BRANDS), "image", known[brand], out)
    out = when(head.startswith("424D") & F.substring(head, 29, 8).isin(*BMP_HEADERS), "image", "BMP", out)
    out = when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image", "WebP", out)
    for magic, fmt, detail in reversed(SIGNATURES):
        out = when(head.startswith(magic), fmt, detail, out)
    return out


def kind_of(path: Column, fmt: Column) -> Column:
    """markdown, text, pdf, image, zip (a container to look into) or null."""
    text = F.when(extension(path).isin("md", "markdown"), "markdown").otherwise("text")
    return F.when(fmt == "text", text).when(fmt.isin("pdf", "image", "zip"), fmt)


def within_limit(kind: Column, length: Column) -> Column:
    limit = reduce(lambda rest, kv: F.when(kind == kv[0], F.lit(kv[1])).otherwise(rest), LIMITS.items(), F.lit(LIMITS["text"]))
    return length <= limit


def encrypted_package(content: Column) -> Column:
    """An office container that is locked by a password."""
    return F.contains(F.hex(content), F.lit("EncryptedPackage".encode("utf-16-le").hex().upper()))


def scan(spark: SparkSession, folder: str, pictures: bool = False, within: list[str] | None = None) -> DataFrame:
    """path, rel, modified (epoch seconds), size, content of the offered files under a folder, by Spark's own file source.

    Hidden files and files over the largest limit are dropped before any content is read; `within`
    narrows the scan to paths or folders, which prunes the listing.
    """
    paths = [os.path.join(folder, p) for p in within] if within else [folder]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    rows = raw.where(F.col("length") <= max(LIMITS.values())).where(offered(F.col("path"), pictures) & ~F.col("path").rlike(r"/\.[^/]+(/|$)"))
    plain = F.regexp_replace("path", "^file:/*", "/")
    root = folder.removeprefix("file://").rstrip("/") + "/"
    return rows.select(plain.alias("path"), F.when(plain.startswith(root), F.substring(plain, len(root) + 1, 1 << 30)).otherwise(plain).alias("rel"), F.unix_timestamp("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def ignore_rules(folder: str, exclude: list[str] = ()) -> list[tuple[str, str, bool]]:
    """(folder of the rule, pattern, negated) from the rule files of a local tree and a source's own patterns; a short driver-side list."""
    out = [("", p, False) for p in exclude]
    for at, folders, names in os.walk(folder):
        folders[:] = sorted(d for d in folders if not d.startswith("."))
        for name in RULE_FILES:
            if name in names:
                base = os.path.relpath(at, folder).replace(os.sep, "/").removeprefix(".").lstrip("/")
                for line in open(os.path.join(at, name), encoding="utf-8", errors="replace"):
                    line = line.rstrip("\n").rstrip()
                    if line and not line.startswith("#"):
                        out.append((base, line.removeprefix("!"), line.startswith("!")))
    return out


def ignored(rel: str, rules: list[tuple[str, str, bool]]) -> bool:
    """Whether the last matching rule leaves a relative path out; rules name files or folders at any depth below their own."""
    out = False
    for base, pattern, negated in rules:
        if base and not rel.startswith(base + "/"):
            continue
        inner = rel[len(base) + 1 :] if base else rel
        only_folders, pattern = pattern.endswith("/"), pattern.rstrip("/")
        parts = inner.split("/")
        heads = ["/".join(parts[: i + 1]) for i in range(len(parts) - only_folders)]
        rooted = "/" in pattern
        bare = pattern.lstrip("/")
        hit = any(_glob(h if rooted else h.rsplit("/", 1)[-1], bare) for h in heads)
        if hit:
            out = not negated
    return out


def _glob(name: str, pattern: str) -> bool:
    if "**" in pattern:
        return fnmatch.fnmatchcase(name, pattern.replace("**/", "*")) or fnmatch.fnmatchcase(name, pattern.replace("**/", ""))
    return name.count("/") == pattern.count("/") and fnmatch.fnmatchcase(name, pattern)


def not_ignored(files: DataFrame, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """files(rel, ...) without ignored ones; the rules are few, so they become one column function."""
    if not rules:
        return files

    @F.pandas_udf("boolean")
    def keep(rel: pd.Series) -> pd.Series:
        return rel.map(lambda r: not ignored(r, rules))

    return files.where(keep("rel"))


def overlaps(sources: DataFrame, path: str) -> DataFrame:
    """Registered sources that hold the path or lie under it."""
    p = F.lit(path.rstrip("/") + "/")
    own = F.concat(F.regexp_replace("path", "/+$", ""), F.lit("/"))
    return sources.where(own.startswith(p) | p.startswith(own))


def source_of(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """paths(path) with the registered source of the longest matching prefix; sources are a handful of rows."""
    s = sources.select(F.regexp_replace("path", "/+$", "").alias("source"))
    both = paths.join(F.broadcast(s), (F.col("path") == F.col("source")) | F.col("path").startswith(F.concat("source", F.lit("/"))))
    return both.groupBy("path").agg(F.max_by("source", F.length("source")).alias("source"))
