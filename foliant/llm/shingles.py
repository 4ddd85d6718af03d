"""Near duplicates by bit-sliced SimHash, with exact Jaccard similarity: links are complete and each one is verified.

The comparison is that of `op7`: a SimHash of each set (128 bits), bit planes, carry-save counters,
blocks abandoned once all lanes are beyond the radius. 64 bits can't tell 0.8, and no bands meet at a
radius that does, so the buckets in which fingerprints are compared are those of a prefix filter:
sets that are at least 4/5 alike share one of their first n - ceil(4n/5) + 1 shingles under any one
order of all shingles, so all such pairs meet in the bucket of a shingle. The order is by hash, with
shingles that a sample shows to be common put last; it decides only how large buckets get, never
which pairs are found. Each bucket, or pair of chunks of a large one, reports a forest of links
within the radius; each of these is verified on the whole sets, and star contraction joins what
holds.

Fingerprints are a matter of chance, so whatever meets in a bucket and is still apart after that is
compared once more in an exact way, whatever its fingerprints say. There a pair is given up early
only by bounds that lose none: sizes, and parities of shingle counts in 2n to 4n cells, of which no
more can differ than there are shingles in one set alone. The members of small buckets are compared
with each other; large buckets go on as pairs of chunks, first with the parities alone; members that
these leave a partner carry their sets there in a second pass, and each pair of chunks reports a
forest of verified links, so that a large group of near copies isn't expanded into pairs. To be
verified, the partners of a set come to it in groups of bounded size, so that each travels once for
a pair and the set itself once for a group.
Every link given has 9 |A and B| >= 4 (|A| + |B|), which is Jaccard >= 4/5.

Candidates are told by 64 bits of a shingle's hash. What travels for verification is 32 bits of each
shingle, so in about one of 2^32 / n pairs of sets of n shingles a count is too high by one.

Defined results: shingles are of ASCII-lower-case words; a text of fewer words is one shingle; texts
without words are one set; equal sets are one node (64-bit hashes of sets and of shingles).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import free_prefix, release, settle, slices, stage, text_or_empty, tidy
from .graph import connected_components
from .planes import bit_sliced_forest, majority

#: Texts of the sample from which the common shingles are told, and how many are remembered. No result depends on them.
SAMPLE, COMMON = 4096, 65_536
#: Members of a bucket that are paired by a join; larger ones are dealt in chunks of so many shingles.
SMALL, CHUNK_SHINGLES = 32, 1 << 18
#: Longs of a fingerprint, and the differing bits at which it makes a candidate. Sets just 4/5 alike differ in 19 of 128 bits
#: on average (standard deviation 4), unrelated ones in 64 (6). No result depends on them.
WORDS, RADIUS = 2, 36
#: Members of a bucket whose fingerprints are compared in one place; pairs of chunks beyond that.
CHUNK = 4096
#: Partners that are compared with a set in one place.
MEMBERS = 1024


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Distinct hashes, ascending, signed."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        a = np.r_[0, ends[:-1]][: len(words) - shingle + 1].tolist()
        b = (ends[shingle - 1 :] - 1).tolist()
        hashes = [xxhash.xxh64_intdigest(joined[x:y], 42) for x, y in zip(a, b)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set, (n, WORDS) signed; that of an empty set is zero."""
    out = np.zeros((len(sets), WORDS), np.uint64)
    there = [i for i, s in enumerate(sets) if len(s)]
    size = np.array([len(sets[i]) for i in there], np.int64)
    block = np.cumsum(size) >> 17  # of bounded size, but for a longer set
    for b in np.unique(block):
        own = np.flatnonzero(block == b)
        tokens = np.concatenate([sets[there[i]] for i in own]).view(np.uint64)
        for w in range(WORDS):
            out[[there[i] for i in own], w] = majority(tokens, size[own])
            tokens = (tokens ^ tokens >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
            tokens = (tokens ^ tokens >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            tokens ^= tokens >> np.uint64(32)
    return out.view(np.int64)


def prefix(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles, of which sets at least 4/5 alike share one; common ones (sorted) come last."""
    n = len(tokens)
    if n and len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        tokens = tokens[np.argsort(common[at] == tokens, kind="stable")]
    return tokens[: n - -(-4 * n // 5) + 1]


def parities(tokens: np.ndarray) -> bytes:
    """A bit for each cell of a power of two: whether an odd number of shingles falls into it."""
    cells = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    return np.packbits(np.bincount(tokens & (cells - 1), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_be_alike(a: bytes, na: int, b: bytes, nb: int) -> bool:
    """False only if more than (na + nb) / 9 shingles are in one set alone, which is Jaccard < 4/5."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= na + nb


def plausible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """pairs(a, b) -> those that the bounds leave; bits(sid, n, bits)."""

    def run(batches):
        for pdf in batches:
            yield pdf.loc[[may_be_alike(*x) for x in zip(pdf["ba"], pdf["na"], pdf["bb"], pdf["nb"])], ["a", "b"]]

    a, b = (bits.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    return both.select("a", "b", "ba", "na", "bb", "nb").mapInPandas(tidy(run), "a long, b long")


def common_shingles(rows: DataFrame, shingle: int) -> np.ndarray:
    """Shingles met in three or more texts of a sample, at most COMMON of them, sorted."""
    n = rows.count()
    if n > SAMPLE:
        rows = rows.where(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(1 << 20)) < max(1, (SAMPLE << 20) // n))

    def run(batches):
        for pdf in batches:
            for t in pdf["t"]:
                yield pd.DataFrame({"tok": shingle_set(t, shingle)})

    seen = rows.select("t").distinct().mapInPandas(tidy(run), "tok long").groupBy("tok").agg(F.count("*").alias("n")).where("n > 2")
    return np.sort(np.array([r["tok"] for r in seen.orderBy(F.desc("n"), "tok").limit(COMMON).collect()], np.int64))


def packed(tokens: np.ndarray) -> bytes:
    """Half of each hash, ascending."""
    return np.sort((tokens.view(np.uint64) >> np.uint64(32)).astype(np.uint32)).tobytes()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b), each once -> those whose sets(sid, s packed) are at least 4/5 alike."""
    led = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(led, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("sid"))
    leaders = led.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("sid"))
    carried = members.unionByName(leaders).join(sets, "sid")

    def run(batches):
        leader = np.zeros(0, np.uint32)
        for pdf in batches:
            a, b = [], []
            for x, role, sid, s in zip(pdf["a"].tolist(), pdf["role"].tolist(), pdf["sid"].tolist(), pdf["s"]):
                mine = np.frombuffer(s, np.uint32)
                if not role:
                    leader = mine
                    continue
                both = np.sort(np.concatenate([leader, mine]))
                if 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both):
                    a.append(x)
                    b.append(sid)
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    ready = carried.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return ready.mapInPandas(tidy(run), "a long, b long")


def forest(sid: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Verified links among some sets that join what is not joined yet."""
    sid, first = np.unique(sid, return_index=True)  # repeated rows
    sets, label = [sets[i] for i in first], np.unique(label[first], return_inverse=True)[1]
    n = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(n) - n
    mark = np.zeros(len(flat), bool)
    a, b = [], []
    for i in range(len(sid) - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        mine = flat[starts[i] : starts[i] + n[i]]
        mark[mine] = True
        shared = np.add.reduceat(mark[flat[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)
        mark[mine] = False
        for j in (np.flatnonzero((9 * shared >= 4 * (n[i] + n[i + 1 :])) & (label[i + 1 :] != label[i])) + i + 1).tolist():
            if label[j] != label[i]:
                a.append(int(sid[i]))
                b.append(int(sid[j]))
                label[label == label[j]] = label[i]
    return a, b


def hopeful(n: np.ndarray, label: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Marks members that the bounds leave a partner of another label. Sizes that fit have equal parities' lengths or one twice the other's."""
    out = np.zeros(len(n), bool)
    size = np.array([len(b) for b in bits])
    for c in np.unique(size):
        mine, twice = np.flatnonzero(size == c), np.flatnonzero(size == 2 * c)
        own = np.frombuffer(b"".join(bits[i] for i in mine), np.uint64).reshape(len(mine), -1)
        far = np.frombuffer(b"".join(bits[i] for i in twice), np.uint64).reshape(len(twice), own.shape[1] * 2)
        all_of, planes = np.r_[mine, twice], np.concatenate([own, far[:, : own.shape[1]] ^ far[:, own.shape[1] :]])
        for k, i in enumerate(mine[:-1] if not len(twice) else mine):
            other = all_of[k + 1 :]
            fits = (label[other] != label[i]) & (5 * np.minimum(n[other], n[i]) >= 4 * np.maximum(n[other], n[i])) & ~(out[other] & out[i])
            at = np.flatnonzero(fits) + k + 1
            if len(at):
                near = at[9 * np.bitwise_count(planes[at] ^ own[k]).sum(axis=1, dtype=np.int64) <= n[i] + n[all_of[at]]]
                out[all_of[near]] = True
                out[i] |= len(near) > 0
    return out


def compared(met: DataFrame, prints: DataFrame) -> DataFrame:
    """met(same, sid), the members of buckets; prints(sid, fp) -> candidates (a, b), each once: in every bucket a forest of the links within RADIUS."""
    sized = met.groupBy("same").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("c")).where("c > 1")
    wide = met.join(sized, "same", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    wide = wide.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("c")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    units = wide.select("same", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid").join(prints, "sid")

    def candidates(sid: np.ndarray, fp, group: np.ndarray) -> pd.DataFrame:
        _, a, b = bit_sliced_forest(np.stack(fp).astype(np.int64).view(np.uint64), group, RADIUS)
        return pd.DataFrame({"a": np.minimum(sid[a], sid[b]), "b": np.maximum(sid[a], sid[b])})

    def run(batches):
        carry = None
        for pdf in batches:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            cols = pdf[["same", "i", "j"]].to_numpy()
            change = np.r_[True, (cols[1:] != cols[:-1]).any(axis=1)] if len(cols) else np.zeros(0, bool)
            last = int(np.flatnonzero(change)[-1]) if len(cols) else 0
            carry = pdf.iloc[last:]
            if last:
                yield candidates(pdf["sid"].to_numpy()[:last], pdf["fp"].to_numpy()[:last], np.cumsum(change[:last]))
        if carry is not None and len(carry):
            yield candidates(carry["sid"].to_numpy(), carry["fp"].to_numpy(), np.zeros(len(carry), np.int64))

    ready = units.repartition("same", "i", "j").sortWithinPartitions("same", "i", "j")
    return ready.mapInPandas(tidy(run), "a long, b long").distinct()


def by_units(wide: DataFrame, unit, schema: str) -> DataFrame:
    """unit(rows) for the rows of each tok, i, j, which are of bounded size."""

    def run(batches):
        carry = None
        for pdf in batches:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            cols = pdf[["tok", "i", "j"]].to_numpy()
            edges = np.flatnonzero(np.r_[True, (cols[1:] != cols[:-1]).any(axis=1)]) if len(cols) else np.zeros(1, int)
            for x, y in zip(edges[:-1], edges[1:]):
                yield unit(pdf.iloc[x:y])
            carry = pdf.iloc[edges[-1] :]
        if carry is not None and len(carry):
            yield unit(carry)

    ready = wide.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j")
    return ready.mapInPandas(tidy(run), schema)


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = forest(pdf["sid"].to_numpy(np.int64), pdf["lab"].to_numpy(np.int64), [np.frombuffer(s, np.uint32) for s in pdf["s"]])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _hopeful(pdf: pd.DataFrame) -> pd.DataFrame:
    keep = hopeful(pdf["n"].to_numpy(np.int64), pdf["lab"].to_numpy(np.int64), pdf["bits"].tolist())
    return pdf.loc[keep, ["tok", "i", "j", "sid", "lab"]]


def components(docs: DataFrame, shingle: int = 5, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(read(k, h, sid, n): each row's text hash, set and its size; roots(node, root) of the sets that have links)."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).select("k", F.xxhash64("t").alias("h"), "t")
    common = common_shingles(rows, shingle)

    def prefixes(batches):
        for pdf in batches:
            texts = pdf["t"].tolist()
            for a, b in slices(texts):
                sets = [shingle_set(t, shingle) for t in texts[a:b]]
                sid = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
                yield pd.DataFrame({"k": pdf["k"].iloc[a:b].values, "h": pdf["h"].iloc[a:b].values, "sid": np.array(sid, np.uint64).view(np.int64), "n": [len(s) for s in sets], "bits": [parities(s) for s in sets], "fp": list(fingerprints(sets)), "pre": [prefix(s, common) for s in sets], "s": [packed(s) for s in sets]})

    read = stage(rows.mapInPandas(tidy(prefixes), f"k {kind}, h long, sid long, n long, bits binary, fp array<long>, pre array<long>, s binary"), "shingle-sets")
    of_one = W.partitionBy("tok")
    met = read.select("sid", "n", F.explode("pre").alias("tok")).repartition("tok").dropDuplicates(["tok", "sid"])
    met = met.withColumns({"lo": F.min("sid").over(of_one), "hi": F.max("sid").over(of_one), "sum": F.sum(F.shiftright(F.xxhash64("sid"), 20)).over(of_one)}).where("lo < hi")
    # buckets of the same members have the same fingerprints to compare
    met = stage(met.withColumn("same", F.xxhash64("lo", "hi", "sum")).drop("lo", "hi", "sum"), "shingle-met")
    settle()
    bits = stage(read.select("sid", "n", "bits", "fp").join(met.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"]), "shingle-bits")
    settle()

    def whole(sids: DataFrame) -> DataFrame:
        """sid, s of some sets, once each."""
        out = stage(read.select("sid", "s").join(sids.distinct(), "sid", "left_semi").dropDuplicates(["sid"]), "shingle-whole")
        settle()
        return out

    pairs = stage(compared(met.select("same", "sid").distinct(), bits.select("sid", "fp")), "shingle-compared")
    settle()
    sets = whole(pairs.select(F.explode(F.array("a", "b")).alias("sid")))
    links = stage(verified(pairs, sets), "shingle-links")
    release(pairs, sets)
    # whatever meets and is still apart
    roots = connected_components(links).withColumnsRenamed({"node": "sid", "root": "lab"})
    left = met.drop("same").join(roots, "sid", "left").withColumn("lab", F.coalesce("lab", "sid"))
    left = left.withColumns({"lo": F.min("lab").over(of_one), "hi": F.max("lab").over(of_one), "m": F.count("*").over(of_one), "total": F.sum("n").over(of_one)})
    left = stage(left.where("lo < hi").drop("lo", "hi"), "shingle-left")
    release(met)
    x, y = (left.where(F.col("m") <= SMALL).select("tok", F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("lab").alias(f"l{s}")) for s in "ab")
    near = x.join(y, "tok").where("a < b and la <> lb and 5 * least(na, nb) >= 4 * greatest(na, nb)").select("a", "b").distinct()
    near = stage(plausible(near, bits.drop("fp")), "shingle-near")
    sets = whole(near.select(F.explode(F.array("a", "b")).alias("sid")))
    few = stage(verified(near, sets), "shingle-few")
    release(near, sets)
    links = links.unionByName(few)
    large = left.where(F.col("m") > SMALL)
    if not large.limit(1).count():
        release(left, bits)
        return read.drop("pre", "bits", "fp", "s"), connected_components(links)
    wide = large.withColumn("c", F.ceil(F.col("total") / CHUNK_SHINGLES).cast("int")).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("c")).cast("int"))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select("tok", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid", "lab")
    some = stage(by_units(wide.join(bits.drop("fp"), "sid"), _hopeful, "tok long, i int, j int, sid long, lab long"), "shingle-some")
    release(bits)
    sets = whole(some.select("sid"))
    many = stage(by_units(some.join(sets, "sid"), _linked, "a long, b long"), "shingle-many")
    release(left, some, sets)
    return read.drop("pre", "bits", "fp", "s"), connected_components(links.unionByName(many))


def one_of_each(docs: DataFrame, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows without near duplicates: of each group that links of similarity 4/5 or more join, the row of the smallest key stays, once.

    Rows without a key stay only where no row of their group has one.
    """
    read, roots = components(docs, shingle, key, text)
    named = read.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("root", "sid"))
    mark = free_prefix(docs.columns)
    keep = named.groupBy("component").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h")).alias("best")).select(F.col("best.k").alias(f"{mark}k"), F.col("best.h").alias(f"{mark}h"))
    keep = stage(keep, "shingle-kept")
    same = F.col(key).eqNullSafe(F.col(f"{mark}k")) & (F.xxhash64(text_or_empty(text)) == F.col(f"{mark}h"))
    # rows that are equal in key and text are one
    return docs.join(keep, same).dropDuplicates([f"{mark}k", f"{mark}h"]).select(*docs.columns)
