"""Best-fit packing by exact-complement hashing.

Texts become token pieces once. From then on only the histogram of piece lengths matters: it has at
most `capacity` rows whatever the corpus holds, so it may go to the driver. There single lengths and
sums of pairs and triples are indexed, combinations that exactly fill a gap are used as often as
their counts allow, and what is left is packed best-fit decreasing, a whole run of equal lengths at
a time. Pieces find their place by their rank among those of equal length: a rank inside the task
that cut them plus a prefix sum over tasks.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows are
packed each; only documents over the capacity are cut; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import load, settle, slices, stage, text_or_empty, tidy
from .bpe import PairIndex

CACHE_WORDS = 300_000
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Numbers(dict):
    """Numbers words as they come and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word):
        k = self[word] = len(self)
        self.new.append(word)
        return k


class WordCodec:
    """Ids of whole texts with the vocabulary of word ends: lower case, white space dropped.

    No token spans white space, so distinct words are encoded once each: Latin ones by the pair
    index, others by the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.index = PairIndex(path, "</w>")
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(WORD_PATTERN)
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def learn(self) -> None:
        new, self.number.new = self.number.new, []
        if not new:
            return
        tokens = Numbers()
        cut: list[list[int]] = []
        direct: dict[int, list[int]] = {}
        for k, word in enumerate(new):
            text = word.decode("utf-8", "replace")
            try:
                text.encode("latin-1")
                plain = "<|" not in text
            except UnicodeEncodeError:
                plain = False
            if plain:
                cut.append([tokens[t] for t in self.pattern.findall(text.lower())])
            else:
                cut.append([])
                direct[k] = self.library.encode(text, add_special_tokens=False).ids
        flat, counts = self.index.encode([t.encode() for t in tokens.new])
        begin = np.cumsum(counts) - counts
        use = np.array([t for x in cut for t in x], np.int64)
        per_word = np.fromiter(map(len, cut), np.int64, len(cut))
        own = gather(flat, begin[use], counts[use])
        ends = np.r_[0, np.cumsum(counts[use])]
        edge = np.r_[0, np.cumsum(per_word)]
        n = ends[edge[1:]] - ends[edge[:-1]]
        if direct:
            own = np.split(own, np.cumsum(n)[:-1])
            for k, ids in direct.items():
                own[k], n[k] = np.array(ids, np.int32), len(ids)
            own = np.concatenate(own).astype(np.int32)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        self.count = np.concatenate([self.count, n])
        self.flat = np.concatenate([self.flat, own])

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if len(self.number) > CACHE_WORDS:
            self.clear()
        used = []
        for t in texts:
            data = t.encode("utf-8", "surrogatepass")
            words = (data if b"<|" in data else data.lower()).split()
            used.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.learn()
        words = np.concatenate(used) if used else np.zeros(0, np.int32)
        n = self.count[words]
        ends = np.r_[0, np.cumsum(n)]
        edge = np.r_[0, np.cumsum([len(u) for u in used])].astype(np.int64)
        return gather(self.flat, self.start[words], n), ends[edge[1:]] - ends[edge[:-1]]


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - (ends - count), count)]


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """counts[n]: pieces of length n. Patterns of (length, how many) with the number of sequences that follow each."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[tuple[int, int]], int]] = []

    def use(*parts: int) -> bool:
        need: dict[int, int] = {}
        for p in parts:
            need[p] = need.get(p, 0) + 1
        times = min(int(left[p]) // k for p, k in need.items())
        if times < 1:
            return False
        for p, k in need.items():
            left[p] -= times * k
        out.append((list(need.items()), times))
        return True

    def pairs(total: int, most: int) -> list[tuple[int, int]]:
        """Available a >= b with a + b = total, the largest a first."""
        lo, hi = -(-total // 2), min(total - 1, most)
        if lo > hi:
            return []
        a = np.arange(hi, lo - 1, -1)
        ok = (left[a] > 0) & (left[total - a] > 0) & ((a * 2 != total) | (left[a] > 1))
        return [(int(x), total - int(x)) for x in a[ok][:8]]

    def index() -> int:
        """Bit s is set if two available lengths add up to s."""
        there = [int(x) for x in np.flatnonzero(left)]
        bits = sum(1 << x for x in there)
        sums = 0
        for x in there:
            sums |= bits << x
        return sums

    if left[capacity]:
        use(capacity)
    sums, misses = index(), 0
    for n in range(capacity - 1, 0, -1):
        while left[n]:
            gap = capacity - n
            if gap <= n and left[gap] and use(n, gap):
                continue
            if any(use(n, a, b) for a, b in pairs(gap, n)):
                continue
            if misses > 64:
                sums, misses = index(), 0
            done = False
            for a in np.flatnonzero(left[1 : min(gap - 1, n) + 1])[::-1] + 1 if gap > 2 else ():
                a = int(a)
                if gap - a > 1 and sums >> (gap - a) & 1:
                    found = pairs(gap - a, a)
                    misses += not found
                    if any(use(n, a, b, c) for b, c in found):
                        done = True
                        break
            if not done:
                break
    # best fit for the rest: bins by gap, equal bins together
    bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(gap: int, parts: list[tuple[int, int]], times: int) -> None:
        if times:
            bins.setdefault(gap, []).append((parts, times))

    for n in range(capacity, 0, -1):
        rest = int(left[n])
        while rest:
            fit = min((g for g in bins if g >= n), default=None)
            if fit is None or fit >= capacity:
                k = capacity // n
                full, last = divmod(rest, k)
                put(capacity - k * n, [(n, k)], full)
                put(capacity - last * n, [(n, last)], 1 if last else 0)
                rest = 0
                continue
            parts, times = bins[fit].pop()
            if not bins[fit]:
                del bins[fit]
            k = min(fit // n, max(1, rest // times))  # so many into each of these, as best fit would
            now = min(times, rest // k)
            put(fit - k * n, [*parts, (n, k)], now)
            put(fit, parts, times - now)
            rest -= now * k
    out += [x for xs in bins.values() for x in xs]
    return out


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece int, start, length, ids_crc32 long, task and rank_in_task among equal lengths."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for pdf in batches:
            texts = pdf["t"].tolist()
            for a, b in slices(texts, 2 << 20):
                flat, counts = codec(path).encode_batch(texts[a:b])
                keys, ends = pdf["k"].iloc[a:b].tolist(), np.cumsum(counts)
                rows = []
                for k, n, e in zip(keys, counts.tolist(), ends.tolist()):
                    ids = np.append(flat[e - n : e], end_id).astype("<u4")
                    for i, at in enumerate(range(0, n + 1, capacity)):
                        part = ids[at : at + capacity]
                        rows.append((k, i, at, len(part), zlib.crc32(part), task, int(seen[len(part)])))
                        seen[len(part)] += 1
                yield pd.DataFrame(rows, columns=["k", "piece", "start", "length", "ids_crc32", "task", "nth"])
        codec(path).clear()  # workers live on and have other work

    return docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInPandas(tidy(run), f"k {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece int, start, length, ids_crc32, sequence_id, offset long."""
    cut = stage(pieces(docs, path, capacity, end_id, key, text), "pack-pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    length, low, base, per, at = [], [], [], [], []
    taken, sequence = np.zeros(capacity + 1, np.int64), 0
    for parts, times in plan(counts, capacity):
        offset = 0
        for n, k in parts:
            length.append(n)
            low.append(int(taken[n]))
            base.append(sequence)
            per.append(k)
            at.append(offset)
            taken[n] += times * k
            offset += n * k
        sequence += times
    table = np.array([length, low, base, per, at], np.int64).reshape(5, -1)
    where = (table[0] << 44) + table[1]
    by = np.argsort(where, kind="stable")
    where, table = where[by], table[:, by]

    def place(batches):
        for pdf in batches:
            n = pdf["length"].to_numpy(np.int64)
            rank = pdf["before"].to_numpy(np.int64) + pdf["nth"].to_numpy(np.int64)
            i = np.searchsorted(where, (n << 44) + rank, side="right") - 1
            k = rank - table[1][i]
            pdf["sequence_id"] = table[2][i] + k // table[3][i]
            pdf["offset"] = table[4][i] + k % table[3][i] * n
            yield pdf[["k", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    kind = docs.schema[key].dataType.simpleString()
    settle()
    out = cut.join(before, ["length", "task"]).mapInPandas(tidy(place), f"k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("k", key)


def op8_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
