"""Substring duplicates by relative Lempel-Ziv parsing.

All earlier text is the reference. Its index is dealt out in blocks by content: every window of
`window` words has an anchor, the run of RUN words in it whose hash is least, and the block of an
anchor holds the passage around its first occurrence in the corpus. A document is parsed against
every block that one of its anchors names: from the anchor on, the match with the block's passage is
extended word by word to both sides as far as the texts agree. Matches of `window` words or more are
factors; factors that go on in the same reference text become one, greedily.

Windows that straddle the ends of matches can stand in a third text, so each window of an occurrence
that its factor doesn't hold is looked up by a 128-bit hash among all such windows. Nothing is lost
by that: a window agrees with its anchor's first occurrence or is, with all its copies, among those
looked up. Whole copies are settled by one hash of the text, repeats inside a text while it is read.

Defined results: words are runs of other than ASCII white space, null texts have none; texts shorter
than a window stay; a null doc_id counts as greater than all others; different texts under one
doc_id, or under none, are documents of their own, in the order of their hashes; rows equal in doc_id
and text are one document (none of them starts earlier than the other); an empty table gives an empty
result; other columns are ignored by `duplicate_words` and kept by `without_duplicates`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_prefix, load, release, settle, slices, stage, text_or_empty, tidy

#: Words of the runs whose least hash is a window's anchor.
RUN = 6
LAST = (1 << 63) - 1
CACHE_WORDS = 300_000
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
TEXT_CHARS = 2 << 20


class WordHashes(dict):
    def __missing__(self, word):
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_hashes = WordHashes()


def gram_hashes(h: np.ndarray, n: int, multiplier: int) -> np.ndarray:
    """Polynomial hashes of all runs of n words, by doubling; the last n - 1 are of shorter runs."""
    power, done, out = multiplier, 0, np.zeros_like(h)
    piece, length, shift = h.copy(), 1, 1
    while n >> 0 and length <= n:
        if n & length:
            moved = np.zeros_like(h)
            if done < len(h):
                moved[: len(h) - done] = piece[done:]
            out = out + moved * np.uint64(shift)
            shift = shift * pow(multiplier, length, 1 << 64) % (1 << 64)
            done += length
        twice = piece.copy()
        if length < len(h):
            twice[:-length] += piece[length:] * np.uint64(power)
        piece, power, length = twice, power * power % (1 << 64), length * 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sliding_least(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of x[i : i + n] and its first place; near the end of fewer."""
    value, at = x.copy(), np.arange(len(x))

    def take(v: np.ndarray, p: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """The lesser of each place and the one `shift` further on."""
        out_v, out_p = v.copy(), p.copy()
        if shift < len(v):
            less = v[shift:] < v[:-shift]
            out_v[:-shift][less], out_p[:-shift][less] = v[shift:][less], p[shift:][less]
        return out_v, out_p

    length = 1
    while length * 2 <= n:
        value, at = take(value, at, length)
        length *= 2
    return take(value, at, n - length) if length < n else (value, at)


class Cut:
    """The words of some texts, their windows, and the occurrences of anchors: runs of windows that share one."""

    def __init__(self, texts: list[str], window: int):
        if len(_hashes) > CACHE_WORDS:
            _hashes.clear()
        self.window = window
        self.words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        self.n = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.first_word = np.cumsum(self.n) - self.n
        h = np.fromiter((x for w in self.words for x in map(_hashes.__getitem__, w)), np.uint64, int(self.n.sum()))
        doc = np.repeat(np.arange(len(texts)), self.n)
        at = np.flatnonzero(np.arange(len(h)) - self.first_word[doc] + window <= self.n[doc])  # flat starts of whole windows
        self.owner, self.place = doc[at], at - self.first_word[doc[at]]
        least, where = sliding_least(gram_hashes(h, RUN, MULTIPLIERS[0]), window - RUN + 1)
        self._find_repeats(gram_hashes(h, window, MULTIPLIERS[0])[at], gram_hashes(h, window, MULTIPLIERS[1])[at])
        run = where[at]
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(at) else np.zeros(0, np.int64)
        self.o_doc, self.o_start, self.o_windows = self.owner[first], self.place[first], np.diff(np.r_[first, len(at)])
        self.o_run, self.o_hash = run[first] - at[first], least[at[first]].view(np.int64)
        self.o_live = np.add.reduceat(self.earlier < 0, first) > 0 if len(first) else np.zeros(0, bool)
        self.o_edge = np.searchsorted(self.o_doc, np.arange(len(texts) + 1))

    def _find_repeats(self, key: np.ndarray, key2: np.ndarray) -> None:
        """earlier: of each window the place of its first copy in the same text, or -1."""
        self.earlier = np.full(len(key), -1, np.int64)
        if not len(key):
            return
        mixed = key + self.owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        by = np.argsort(mixed, kind="stable")
        a, b = by[:-1], by[1:]
        same = np.r_[False, (mixed[a] == mixed[b]) & (self.owner[a] == self.owner[b]) & (key2[a] == key2[b])]
        leader = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
        self.earlier[by[same]] = self.place[leader[same]]

    def text_hashes(self, i: int) -> tuple[int, int, str]:
        joined = b" ".join(self.words[i])
        h = xxhash.xxh3_128_digest(joined)
        return *np.frombuffer(h, np.int64).tolist(), hashlib.sha256(joined).hexdigest()

    def own_repeats(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows of a text that start in it before, and where they do."""
        a, b = np.searchsorted(self.owner, (i, i + 1))
        again = np.flatnonzero(self.earlier[a:b] >= 0) + a
        return self.place[again], self.earlier[again]

    def live(self, i: int) -> np.ndarray:
        """Occurrences in a text that hold a window which isn't a repeat."""
        a, b = self.o_edge[i], self.o_edge[i + 1]
        return np.flatnonzero(self.o_live[a:b]) + a

    def passage(self, o: int) -> bytes:
        start = self.o_start[o]
        return b" ".join(self.words[self.o_doc[o]][start : start + self.o_windows[o] - 1 + self.window])


def _cuts(batches, window: int):
    for pdf in batches:
        texts = pdf["t"].tolist()
        for a, b in slices(texts, TEXT_CHARS):
            yield pdf.iloc[a:b], Cut(texts[a:b], window)
    _hashes.clear()  # workers live on and have other work


def read_texts(rows: DataFrame, window: int) -> DataFrame:
    """k, x, n_words, ha, hb (of the whole text), sha, anchors (once each), twice (those that stand at several places), own and own_from (repeats inside the text)."""

    def run(batches):
        for pdf, cut in _cuts(batches, window):
            each = range(len(pdf))
            ha, hb, sha = zip(*map(cut.text_hashes, each))
            own, own_from = zip(*map(cut.own_repeats, each))
            anchors, twice = [], []
            for i in each:
                h, c = np.unique(cut.o_hash[cut.live(i)], return_counts=True)
                anchors.append(h)
                twice.append(h[c > 1])
            yield pd.DataFrame({"k": pdf["k"].values, "x": pdf["x"].values, "n_words": cut.n, "ha": ha, "hb": hb, "sha": sha, "anchors": anchors, "twice": twice, "own": own, "own_from": own_from})

    return rows.mapInPandas(tidy(run), "k long, x long, n_words long, ha long, hb long, sha string, anchors array<long>, twice array<long>, own array<long>, own_from array<long>")


def passages(rows: DataFrame, window: int) -> DataFrame:
    """rows(r, t, wanted array<(h, first)>) -> h, r, block (this is the anchor's first occurrence), start, run (words before the anchor), words.

    One row for each occurrence of a wanted anchor, with all words that windows on it can hold.
    """

    def run(batches):
        for pdf, cut in _cuts(batches, window):
            out = []
            for i, (r, wanted) in enumerate(zip(pdf["r"].tolist(), pdf["wanted"])):
                leads = {w["h"]: w["first"] for w in wanted}
                for o in cut.live(i).tolist():
                    h = int(cut.o_hash[o])
                    lead = leads.get(h)
                    if lead is not None:
                        out.append((h, r, lead, int(cut.o_start[o]), int(cut.o_run[o]), cut.passage(o)))
                        leads[h] = False
            yield pd.DataFrame(out, columns=["h", "r", "block", "start", "run", "words"])

    return rows.mapInPandas(tidy(run), "h long, r long, block boolean, start long, run long, words binary")


def extend(mine: list, run: int, other: list, other_run: int) -> tuple[int, int]:
    """How far two word lists agree around the anchor runs at `run` and `other_run`: [start, end) in the first; empty if the runs differ."""
    if mine[run : run + RUN] != other[other_run : other_run + RUN]:
        return run, run
    a = 0
    while a < min(run, other_run) and mine[run - 1 - a] == other[other_run - 1 - a]:
        a += 1
    b, most = RUN, min(len(mine) - run, len(other) - other_run)
    while b < most and mine[run + b] == other[other_run + b]:
        b += 1
    return run - a, run + b


def matched(occurrences: DataFrame, window: int) -> DataFrame:
    """occurrences(r, start, run, words, b_r, b_start, b_run, b_words) -> factors (r, start, end, ref, from) and windows that
    no factor holds (r, start, w1, w2), in one table."""
    schema = "r long, start long, end long, ref long, from long, w1 long, w2 long"

    def run(batches):
        for pdf in batches:
            out, left = [], []
            for r, start, at, words, ref, b_start, b_at, b_words in zip(*(pdf[c].tolist() for c in ("r", "start", "run", "words", "b_r", "b_start", "b_run", "b_words"))):
                mine = words.split(b" ")
                a, b = (0, len(mine)) if words == b_words and at == b_at else extend(mine, at, b_words.split(b" "), b_at)
                held = range(a, b - window + 1)
                if held:
                    out.append((r, start + a, start + b, ref, b_start + b_at - at + a))
                for i in range(len(mine) - window + 1):
                    if i not in held:
                        left.append((r, start + i, *np.frombuffer(xxhash.xxh3_128_digest(b" ".join(mine[i : i + window])), np.int64).tolist()))
            for rows, names in ((out, ["r", "start", "end", "ref", "from"]), (left, ["r", "start", "w1", "w2"])):
                yield pd.DataFrame(rows, columns=names, dtype="Int64").reindex(columns=["r", "start", "end", "ref", "from", "w1", "w2"])

    return occurrences.mapInPandas(tidy(run), schema)


def string_together(pieces: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Matches (start, end, ref, from) -> factors: matches that overlap and go on in one reference text become one; what lies inside another one goes."""
    by_line: dict[tuple[int, int], list[list[int]]] = {}
    for start, end, ref, source in sorted(pieces):
        line = by_line.setdefault((ref, source - start), [])
        if line and start <= line[-1][1]:
            line[-1][1] = max(line[-1][1], end)
        else:
            line.append([start, end])
    out: list[tuple[int, int, int, int]] = []
    for start, end, ref, shift in sorted(((a, b, ref, d) for (ref, d), line in by_line.items() for a, b in line), key=lambda p: (p[0], -p[1], p[2])):
        if not out or end > out[-1][1]:
            out.append((start, end, ref, start + shift))
    return out


def keyed(docs: DataFrame, key: str, text: str) -> list:
    """The columns k and x that tell documents apart: the key (null last) and the text's hash."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(text_or_empty(text)).alias("x")]


def parse(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text"):
    """(rows, texts, factors): rows(k, x, t); texts as read_texts plus `r` (the document's number, in the order of k and x) and
    `copy_of` (the least number of an equal text, if smaller and long enough); factors(k, x, spans): factors of each text that
    isn't such a copy, as word spans [start, end) that equal the words from `from` on in document `ref`."""
    rows = docs.select(*keyed(docs, key, text), text_or_empty(text).alias("t"))
    read = stage(read_texts(rows, window), "rlz-read")
    same = ["ha", "hb", "n_words"]
    # partitions of a sorted table are numbered in its order, so these numbers rise with k and x
    numbers = stage(read.select("k", "x", *same).distinct().orderBy("k", "x").withColumn("r", F.monotonically_increasing_id()), "rlz-numbers")
    least = numbers.where(F.col("n_words") >= window).groupBy(same).agg(F.min("r").alias("lo"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = stage(numbers.join(least, same, "left").select("k", "x", "r", F.when(F.col("lo") < F.col("r"), F.col("lo")).alias("copy_of")), "rlz-copies")
    texts = stage(read.join(copies, ["k", "x"]), "rlz-texts")
    release(read, numbers, copies)
    fresh = texts.where("copy_of is null")
    anchors = fresh.select("k", "x", "r", F.explode("anchors").alias("h"))
    twice = fresh.select("r", F.explode("twice").alias("h"), F.lit(True).alias("again"))
    seen = anchors.select("r", "h", F.lit(False).alias("again")).unionByName(twice)
    blocks = stage(seen.groupBy("h").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("again").alias("again")).where("lo < hi or again").select("h", "lo"), "rlz-blocks")
    settle()
    wanted = stage(anchors.join(blocks, "h").groupBy("k", "x", "r").agg(F.collect_set(F.struct("h", (F.col("r") == F.col("lo")).alias("first"))).alias("wanted")), "rlz-wanted")
    release(blocks)
    found = stage(passages(rows.join(wanted, ["k", "x"]), window), "rlz-passages")
    release(wanted)
    index = stage(found.where("block").dropDuplicates(["h"]).select("h", *[F.col(c).alias(f"b_{c}") for c in ("r", "start", "run", "words")]), "rlz-index")
    pieces = stage(matched(found.where("not block").join(index, "h").select("r", "start", "run", "words", "b_r", "b_start", "b_run", "b_words"), window), "rlz-matched")
    release(found, index)
    loose = pieces.where("w1 is not null").select("w1", "w2", "r", "start")
    place = F.struct("r", "start")
    first = stage(loose.groupBy("w1", "w2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").select("w1", "w2", "lo"), "rlz-first")
    straddling = loose.join(first, ["w1", "w2"]).where(place > F.col("lo")).select("r", "start", (F.col("start") + window).alias("end"), F.col("lo.r").alias("ref"), F.col("lo.start").alias("from"))
    every = pieces.where("w1 is null").select("r", "start", "end", "ref", "from").unionByName(straddling)
    every = every.groupBy("r").agg(F.collect_set(F.struct("start", "end", "ref", "from")).alias("pieces"))

    def run(batches):
        for pdf in batches:
            spans = []
            for r, found, at, source in zip(pdf["r"].tolist(), pdf["pieces"], pdf["own"], pdf["own_from"]):
                got = [] if found is None else [(p["start"], p["end"], p["ref"], p["from"]) for p in found]
                got += [] if at is None else [(a, a + window, r, b) for a, b in zip(at.tolist(), source.tolist())]
                spans.append([dict(zip(("start", "end", "ref", "from"), f)) for f in string_together(got)])
            yield pd.DataFrame({"k": pdf["k"].values, "x": pdf["x"].values, "spans": spans})

    all_of = fresh.select("k", "x", "r", F.when(F.size("own") > 0, F.col("own")).alias("own"), F.when(F.size("own") > 0, F.col("own_from")).alias("own_from"))
    parts = all_of.dropDuplicates(["r"]).join(every, "r", "left").where("own is not null or pieces is not null")
    factors = stage(parts.mapInPandas(tidy(run), "k long, x long, spans array<struct<start:long,end:long,ref:long,from:long>>"), "rlz-factors")
    release(pieces, first)
    return rows, texts, factors


def _covered(spans, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[s["start"]] += 1
        edge[s["end"]] -= 1
    return np.cumsum(edge)[:n] > 0


def duplicate_words(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: key, n_words, n_removed long, kept_sha256 (kept words joined by one space)."""
    rows, texts, factors = parse(docs, window, key, text)

    def run(batches):
        for pdf in batches:
            out = []
            for k, x, t, spans in zip(pdf["k"], pdf["x"], pdf["t"], pdf["spans"]):
                words = t.encode("utf-8", "surrogatepass").split()
                gone = _covered(spans, len(words))
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((k, x, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.DataFrame(out, columns=["k", "x", "cut", "cut_sha"])

    changed = rows.join(factors, ["k", "x"]).mapInPandas(tidy(run), "k long, x long, cut long, cut_sha string").dropDuplicates(["k", "x"])
    none = hashlib.sha256(b"").hexdigest()
    copy = F.col("copy_of").isNotNull()
    return texts.join(changed, ["k", "x"], "left").select(
        F.when(F.col("k") != LAST, F.col("k")).alias(key),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(none)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans) -> str:
    """The text without the words of the spans and the white space after them."""
    data = text.encode("utf-8", "surrogatepass")
    at = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    out, pos = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        a, b = at[min(s["start"], len(at) - 1)], at[min(s["end"], len(at) - 1)]
        if a > pos:
            out.append(data[pos:a])
        pos = max(pos, b)
    out.append(data[pos:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def without_duplicates(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The input rows with duplicate passages cut out of their texts; rows that lose all their words go. `length` follows if there is such a column."""
    _, texts, factors = parse(docs, window, key, text)
    zero = F.lit(0).cast("long")
    whole = texts.where("copy_of is not null").select("k", "x", F.array(F.struct(zero.alias("start"), F.col("n_words").alias("end"), F.col("copy_of").alias("ref"), zero.alias("from"))).alias("spans"))
    mark = free_prefix(docs.columns)
    changes = stage(factors.unionByName(whole.dropDuplicates(["k", "x"])).select(*[F.col(c).alias(mark + c) for c in ("k", "x", "spans")]), "rlz-changes")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut_words(t, s) for t, s in zip(texts, spans)])

    kept = docs.columns
    k, x = keyed(docs, key, text)
    rows = docs.join(changes, (k == F.col(f"{mark}k")) & (x == F.col(f"{mark}x")), "left")
    some = F.col(f"{mark}spans").isNotNull()
    rows = rows.withColumn(text, F.when(some, cut(text_or_empty(text), f"{mark}spans")).otherwise(F.col(text)))
    if length in kept:
        rows = rows.withColumn(length, F.when(some, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return rows.where(~some | F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(*kept)


def op10_relative_lempel_ziv(spark, sf_dir):
    return duplicate_words(load(spark, sf_dir, "documents"))
