"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are hashed once for each document; equal ones collapse. Distinct fingerprints within
`radius` bits agree in whole on some choice of bands (pigeonhole), so they meet in a bucket. Inside
a bucket the fingerprints stand as bit planes, 64 members to a machine word: each member's distances
to a whole word of members grow together in carry-save counters that start so that the carry out of
the top counter says "beyond the radius", and a block is abandoned once all its lanes have carried.
Buckets beyond CHUNK members are dealt as pairs of chunks, so that no task holds one whole. Each
unit reports a spanning star of its links, never all pairs, and star contraction joins the units.

Defined results: null and word-less texts have fingerprint zero and link like any other; repeated
rows and equal texts share a component; a null doc_id takes part but never names a component that
has another id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import load, settle, slices, stage, text_or_empty, tidy
from .graph import connected_components
from .planes import bit_sliced_links, components_of, majority  # noqa: F401
from .shingles import one_of_each  # noqa: F401  (the pipeline's stage, by exact sets)

CHUNK = 4096


def fingerprints_of(texts: list[str], shingle: int, seed: int = 42) -> np.ndarray:
    """Signed 64-bit fingerprints."""
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    owner: list[int] = []
    digest = xxhash.xxh64_intdigest

    def flush() -> None:
        if not owner:
            return
        fp = majority(np.array(hashes, np.uint64), np.array([n for _, n in owner]))
        # a long text comes in several pieces only through `carry`
        out[[i for i, _ in owner]] = fp
        hashes.clear()
        owner.clear()

    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        n = max(1, len(words) - shingle + 1)
        if n == 1:
            hashes.append(digest(joined, seed))
        else:
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(lengths)
            a = (ends - lengths)[:n].tolist()
            b = (ends[shingle - 1 :] - 1).tolist()
            hashes.extend([digest(joined[x:y], seed) for x, y in zip(a, b)])
        owner.append((i, n))
        if len(hashes) > 1 << 17:
            flush()
    flush()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, h (the text's hash), fp array of `words` longs: bit j is set if it is set in over half of the shingles' XXH64 (seeds from 42)."""

    def run(batches):
        for pdf in batches:
            texts = pdf["t"].tolist()
            for a, b in slices(texts):
                fp = np.stack([fingerprints_of(texts[a:b], shingle, 42 + i) for i in range(words)], axis=1)
                yield pd.DataFrame({"k": pdf["k"].iloc[a:b].values, "h": pdf["h"].iloc[a:b].values, "fp": list(fp)})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    return rows.select("k", F.xxhash64("t").alias("h"), "t").mapInPandas(tidy(run), f"k {kind}, h long, fp array<long>")


def band_masks(n: int, radius: int) -> list[int]:
    """Masks of 64 bits such that fingerprints within the radius agree under one at least; more and longer ones as n grows."""
    best = None
    for b in range(radius + 1, radius + 5):
        cost = comb(b, radius) * (1 + n / 2 ** (64 * (b - radius) / b) / 64)
        if best is None or cost < best[0]:
            best = cost, b
    b = best[1]
    edges = [64 * i // b for i in range(b + 1)]
    bands = [((1 << edges[i + 1]) - 1) & ~((1 << edges[i]) - 1) for i in range(b)]
    return [sum(c) for c in combinations(bands, b - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, n: int, radius: int = 4, meet: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """prints(fp) distinct -> edges (a, b) of fingerprints that span the same components as all pairs within the radius
    whose first words, where there are several, meet under the bands of radius `meet`."""
    masks = band_masks(n, radius if meet is None else meet)
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.get("fp", F.lit(0)).bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("s")).select("fp", "s.t", "s.key")
    hot = stage(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "simhash-hot")
    units = keyed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if hot.limit(1).count():
        parts = F.ceil(F.col("n") / chunk).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
        wide = keyed.join(hot.withColumn("c", parts).drop("n"), ["t", "key"]).withColumn("own", own)
        wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        wide = wide.select("fp", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        units = keyed.join(hot.select("t", "key"), ["t", "key"], "left_anti").withColumns({"i": F.lit(0), "j": F.lit(0)}).unionByName(wide)

    def run(batches):
        carry = None
        for pdf in batches:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            cols = pdf[["t", "key", "i", "j"]].to_numpy()
            change = np.r_[True, (cols[1:] != cols[:-1]).any(axis=1)] if len(cols) else np.zeros(0, bool)
            last = int(np.flatnonzero(change)[-1]) if len(cols) else 0
            carry = pdf.iloc[last:]
            if last:
                yield forest(pdf["fp"].to_numpy()[:last], np.cumsum(change[:last]))
        if carry is not None and len(carry):
            yield forest(carry["fp"].to_numpy(), np.zeros(len(carry), np.int64))

    def forest(fp, group):
        fp = np.stack(fp).astype(np.int64)
        a, b = bit_sliced_links(fp.view(np.uint64), np.asarray(group), radius)
        return pd.DataFrame({"a": pd.Series(list(fp[a]), dtype=object), "b": pd.Series(list(fp[b]), dtype=object)})

    ready = units.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    return ready.mapInPandas(tidy(run), "a array<long>, b array<long>")


def components(docs: DataFrame, shingle: int, radius: int, words: int = 1, meet: int | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(prints(k, h, fp), names(fp, component): the component is the smallest fingerprint reachable)."""
    prints = stage(fingerprints(docs, shingle, words, key, text), "simhash-prints")
    distinct = stage(prints.select("fp").distinct(), "simhash-distinct")
    settle()
    roots = connected_components(links(distinct, distinct.count(), radius, meet))
    names = distinct.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"))
    return prints, stage(names, "simhash-names")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: key, fp long, component_id (the smallest key reachable through links)."""
    prints, names = components(docs, shingle, radius, key=key, text=text)
    least = prints.groupBy("fp").agg(F.min("k").alias("lo")).join(names, "fp")
    low = stage(least, "simhash-least")
    component = low.groupBy("component").agg(F.min("lo").alias("component_id"))
    ids = stage(low.join(component, "component").select("fp", "component_id"), "simhash-ids")
    return prints.join(ids, "fp").select(F.col("k").alias(key), F.get("fp", F.lit(0)).alias("fp"), "component_id")


def op7_simhash_components(spark, sf_dir):
    out = near_duplicates(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
