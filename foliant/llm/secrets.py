"""Secret scan with multipart credential linking, in DataFrame functions only.

Three kinds of span stand by themselves: assignments of secrets, access identifiers and long hex
runs. Weak candidates (mixed opaque runs and endpoints) are common in clean text, so they are
reported only where a complementary part lies within `scope` characters: an opaque run next to an
access identifier or an endpoint, an endpoint next to an identifier or a secret, opaque or not. The interval join sweeps the spans
of one text in order of their starts: the furthest end before and the nearest start after, by part,
decide without any pair being formed. A weak secret and a weak endpoint complete each other.

Offsets come from cutting a text at the matches: a start is the sum of the lengths before it. Only
lengths leave the scan, never texts; texts without matches aren't cut at all.

Defined results: null and empty texts have no spans; repeated rows get equal results; offsets are
code points, ends exclusive; an empty table gives an empty result; `scan` ignores other columns and
`redact` keeps them. A null doc_id is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import free_prefix, load, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order in which equal starts are listed. Runs too short to keep are left out by their patterns.
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "opaque": r"[A-Za-z0-9+/_=-]{30,}",
    "endpoint": r"""(?:https?|jdbc:[a-z]+|s3|redis|postgres(?:ql)?|mysql|mongodb|amqps?)://[^\x20\x09-\x0D"'<>]+""",
}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
SCOPE = 200
KEY = ["k", "h", "n"]


def _parts(kind: str):
    """Of one kind: an array of (kind index, order, gap before, length, kept)."""
    text, pattern = F.col("t"), F.lit(PATTERNS[kind])
    kept = {
        "assign": lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 8,
        "opaque": lambda x: x.rlike("[A-Z]") & x.rlike("[a-z]") & x.rlike("[0-9]"),
    }.get(kind, lambda x: F.lit(True))
    cut = F.zip_with(F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(gap).alias("gap"), F.length(x).alias("len"), (x.isNotNull() & F.coalesce(kept(x), F.lit(False))).alias("kept")))
    return F.when(text.rlike(PATTERNS[kind]), cut).otherwise(F.array().cast("array<struct<kind:int,gap:int,len:int,kept:boolean>>"))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Equal rows share k, h, n; the original columns stay."""
    return docs.withColumns({"k": F.col(key), "t": text_or_empty(text)}).withColumns({"h": F.xxhash64("t"), "n": F.length("t")})


def find(docs: DataFrame, scope: int = SCOPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, h, n (the row's key, its text's hash and length) -> spans array<struct<start, kind, end>>, in order; only rows that have any."""
    rows = _keyed(docs.select(key, text), key, text)
    some = rows.where(" OR ".join(f"rlike(t, {_literal(p)})" for p in PATTERNS.values()))
    cut = some.select(*KEY, F.concat(*[_parts(k) for k in KINDS]).alias("parts")).groupBy(KEY).agg(F.first("parts").alias("parts"))
    each = cut.select(*KEY, F.posexplode("parts").alias("i", "p")).select(*KEY, "i", "p.*")
    before = W.partitionBy(*KEY, "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(before)
    spans = each.withColumn("end", end).where("kept").select(*KEY, "kind", (F.col("end") - F.col("len")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    order = W.partitionBy(*KEY).orderBy("start", "kind", "end")
    earlier, later = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    near = {}
    parts = {"strong": BASE, "id": ["access"], "key": ["assign", "hex"], "url": ["endpoint"], "weak": ["opaque"]}

    def distances(names: list[str], allowed: Column) -> dict[str, Column]:
        """How far the nearest span of each part is, below zero where it overlaps."""
        out = {}
        for name in names:
            one = F.col("kind").isin([KINDS.index(k) for k in parts[name]]) & allowed
            last, first = F.max(F.when(one, F.col("end"))).over(earlier), F.min(F.when(one, F.col("start"))).over(later)
            out[f"to_{name}"] = F.least(F.col("start") - last, first - F.col("end"))  # least() skips nulls
        return out

    within = lambda name: F.coalesce(F.col(f"to_{name}") <= scope, F.lit(False))
    weak, url = F.col("kind") == KINDS.index("opaque"), F.col("kind") == KINDS.index("endpoint")
    clear = lambda name: F.coalesce(F.col(f"to_{name}") >= 0, F.lit(True))
    measured = spans.withColumns(distances(["strong", "id", "key", "url"], F.lit(True)))
    # an opaque run inside another span is part of that, so it completes nothing
    measured = measured.withColumn("own", ~weak | (clear("strong") & clear("url")))
    measured = measured.withColumns(distances(["weak"], F.col("own")))
    opaque = weak & F.col("own") & (within("id") | within("url"))
    endpoint = url & (within("id") | within("key") | within("weak"))
    reported = measured.where((F.col("kind") < len(BASE)) | opaque | endpoint)
    return reported.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _listed(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, scope: int = SCOPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: key, n_assign, n_access, n_hex, n_linked long, base_sha256, spans."""
    rows = _keyed(docs.select(key, text), key, text).select(*KEY)
    found = find(docs, scope, key, text).withColumnsRenamed({c: f"f_{c}" for c in KEY})
    same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in KEY]
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    out = rows.join(found, same[0] & same[1] & same[2], "left").select(F.col("k"), spans.alias("spans"))
    return out.select(
        F.col("k").alias(key),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] >= len(BASE))).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, scope: int = SCOPE, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The same rows and columns, each span in the text replaced by [kind]; `length` follows if there is such a column."""
    kept = docs.columns
    mark = free_prefix(kept)
    names = {c: f"{mark}{c}" for c in [*KEY, "spans"]}
    found = find(docs, scope, key, text).withColumnsRenamed(names)
    raw = docs.withColumn(f"{mark}t", text_or_empty(text))
    t = F.col(f"{mark}t")
    same = F.col(key).eqNullSafe(F.col(names["k"])) & (F.xxhash64(t) == F.col(names["h"])) & (F.length(t) == F.col(names["n"]))
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def fold(acc, s):
        fresh = s["start"] >= acc["pos"]
        more = F.concat(acc["out"], F.substring(t, acc["pos"] + 1, s["start"] - acc["pos"]), F.get(kinds, s["kind"]))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(names["spans"], start, fold, lambda acc: F.concat(acc["out"], F.substring(t, acc["pos"] + 1, F.length(t))))
    out = raw.join(found, same, "left").withColumn(text, F.when(F.col(names["spans"]).isNull(), F.col(text)).otherwise(clean))
    if length in kept:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(F.col(names["spans"]).isNull(), F.col(length)).otherwise(F.length(text).cast(kind)))
    return out.select(*kept)


def op5_credential_linking(spark, sf_dir):
    return scan(load(spark, sf_dir, "documents"))
