"""Sharding by extendible hashing.

A directory of hash-prefix bits maps rows to buckets. A bucket is the shortest prefix whose rows
weigh at most `max_bytes`; only oversized prefixes are looked at with further bits. Only byte sums
by prefix are shuffled, never texts, and the directory stays a distributed table.

Defined results: a null text weighs 0 bytes; a null key hashes as the text 'null'; rows of equal
key part company on the bits after the 60th, which come from a number given to each row; a row
that alone exceeds the limit gets a shard of its own ("x..."), since no prefix could make it fit;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_prefix, release, settle, stage

KEY_BITS, ALL_BITS = 60, 120


def _bits60(text):
    return F.lpad(F.bin(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")), KEY_BITS, "0")


def _prefix(depth: int):
    bits = F.concat(_bits60(F.col("k")), _bits60(F.concat_ws(":", F.col("k"), F.col("uid").cast("string")))) if depth > KEY_BITS else _bits60(F.col("k"))
    return F.substring(bits, 1, depth)


def extendible_shards(docs: DataFrame, max_bytes: int = 256 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: key, shard string, depth int, n_bytes long, shard_bytes long."""
    rows = _weighed(docs, F.monotonically_increasing_id(), key, text)
    return _assigned(rows, max_bytes).select(F.col("key").alias(key), "shard", "depth", F.col("n").alias("n_bytes"), "shard_bytes")


def _weighed(docs: DataFrame, uid: Column, key: str, text: str) -> DataFrame:
    """Staged: key, k (as text), uid (the row's number), n (bytes of text)."""
    n = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return stage(docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), uid.alias("uid"), n.alias("n")), "shard-rows")


def _assigned(rows: DataFrame, max_bytes: int) -> DataFrame:
    """rows of `_weighed` -> key, uid, shard, depth, n, shard_bytes."""
    large = rows.where(F.col("n") > max_bytes).select(
        "key", "uid", F.concat(F.lit("x"), F.substring(F.md5(F.col("k")), 1, 15), F.lit("-"), F.col("uid").cast("string")).alias("shard"), F.lit(ALL_BITS).alias("depth"), "n", F.col("n").alias("shard_bytes")
    )
    rest = rows.where(F.col("n") <= max_bytes)
    total = rest.agg(F.sum("n")).first()[0] or 0
    parts = [large]
    low, high = 0, min(ALL_BITS, 3 + max(0, math.ceil(math.log2(max(1, total / max_bytes)))))
    while True:
        leaves = rest.groupBy(_prefix(high).alias("leaf")).agg(F.sum("n").alias("n"))
        depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        up = stage(leaves.select("leaf", "n", depths).select("leaf", "n", "depth", F.substring("leaf", F.lit(1), F.col("depth")).alias("p")), "shard-prefixes")
        sums = up.groupBy("depth", "p").agg(F.sum("n").alias("shard_bytes")).where(F.col("shard_bytes") <= max_bytes)
        # the shortest prefix that fits is the leaf's bucket
        buckets = stage(
            up.join(sums, ["depth", "p"]).groupBy("leaf").agg(F.min(F.struct("depth", "p", "shard_bytes")).alias("b")).select("leaf", "b.*"),
            "shard-buckets",
        )
        release(up)
        placed = rest.withColumn("leaf", _prefix(high)).join(buckets, "leaf")
        parts.append(placed.select("key", "uid", F.concat(F.lit("b"), "p").alias("shard"), "depth", "n", "shard_bytes"))
        full = leaves.where(F.col("n") > max_bytes).select("leaf")
        if high >= ALL_BITS or not full.limit(1).count():
            break
        rest = stage(rest.withColumn("leaf", _prefix(high)).join(stage(full, "shard-full"), "leaf", "left_semi").drop("leaf"), "shard-rest")
        low, high = high + 1, min(ALL_BITS, high + (8 if high < KEY_BITS else 20))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    settle()
    return out.withColumn("depth", F.col("depth").cast("int"))


def write_shards(docs: DataFrame, path: str, max_bytes: int = 256 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write every row into the folder of its shard; returns the assignment: key, shard, depth, n_bytes, shard_bytes.

    Rows go by a number of their own, so null and repeated keys are written as often as they stand in
    the input. The folders are named shard=...; where the input has such a column, _shard=...
    """
    mark = free_prefix(docs.columns)
    numbered = stage(docs.withColumn(f"{mark}uid", F.monotonically_increasing_id()), "shard-numbered")
    where = stage(_assigned(_weighed(numbered, F.col(f"{mark}uid"), key, text), max_bytes), "shard-assignment")
    folder = "shard"
    while folder in [c.lower() for c in docs.columns]:
        folder = "_" + folder
    placed = numbered.join(where.select(F.col("uid").alias(f"{mark}uid"), F.col("shard").alias(folder)), f"{mark}uid")
    placed.drop(f"{mark}uid").repartition(folder).write.partitionBy(folder).parquet(path)
    release(numbered)
    return where.select(F.col("key").alias(key), "shard", "depth", F.col("n").alias("n_bytes"), "shard_bytes")


#: Of the registered query: small enough that the smallest tables split.
QUERY_BYTES = 1 << 20


def op3_extendible_shards(spark, sf_dir):
    from ._common import load

    return extendible_shards(load(spark, sf_dir, "documents"), QUERY_BYTES)


OP3_SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n,
         lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), {KEY_BITS}, '0') AS bits
  FROM documents),
g AS (SELECT r.doc_id, r.n, d.depth, substr(r.bits, 1, d.depth) AS p FROM r, (SELECT unnest(range(0, 25))::INT AS depth) d),
s AS (SELECT depth, p, sum(n)::BIGINT AS shard_bytes FROM g GROUP BY ALL HAVING sum(n) <= {QUERY_BYTES}),
m AS (SELECT g.doc_id, g.n, g.depth, g.p, s.shard_bytes, row_number() OVER (PARTITION BY g.doc_id ORDER BY g.depth) AS rn
      FROM g JOIN s USING (depth, p))
SELECT doc_id, 'b' || p AS shard, depth, n AS n_bytes, shard_bytes FROM m WHERE rn = 1
"""
