"""Byte-pair encoding and decoding by a pair occurrence index.

The distinct words of many texts lie in one flat array of symbols. Each pair of neighbours that has
a merge rank is listed with all its positions; active ranks are applied in ascending order from a
heap, each to all its positions at once, and only the lists of pairs next to a merge change. Words
met before come from a bounded cache. Vocabulary and merges are read from a public tokenizer file;
nothing is trained.

Defined results: a null text encodes like an empty one, to no ids; special strings in a text become
their ids, as the library does by default; repeated rows repeat; an empty table gives an empty
result; other columns are ignored. Characters whose class the regular expression engine might see
in another way than the library are checked once each, and texts with differing ones are cut up by
the library itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import load, slices, text_or_empty, tidy

#: Words held in a worker's cache; beyond that it starts anew.
CACHE_WORDS = 500_000
#: Characters of text whose new words are merged together.
TEXT_CHARS = 2 << 20
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class PairIndex:
    """Merges of one vocabulary, applied to many words at once."""

    def __init__(self, path: str, end: str = ""):
        model = json.load(open(path, encoding="utf-8"))
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.vocab, self.special = vocab, {x["content"]: x["id"] for x in model["added_tokens"]}
        chars = byte_chars()
        self.base = np.array([vocab.get(c, -1) for c in chars], np.int32)
        self.last = np.array([vocab.get(c + end, -1) for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = self.left << 20 | self.right
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        code = {c: b for b, c in enumerate(chars)}
        self.bytes = {i: bytes(code[c] for c in t.removesuffix(end) if c in code) + (b" " if end and t.endswith(end) else b"") for t, i in vocab.items()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.tail = bool(end)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. No word is empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        n = len(flat)
        if not n:
            return np.zeros(0, np.int32), lengths
        sym = self.base[flat]
        ends = np.cumsum(lengths) - 1
        if self.tail:
            sym[ends] = self.last[flat[ends]]
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[ends] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[ends[:-1] + 1] = -1
        prv[0] = -1
        # the index: positions by rank
        first = np.flatnonzero(nxt >= 0).astype(np.int32)
        rank = self.ranks(sym[first], sym[nxt[first]])
        first, rank = first[rank >= 0], rank[rank >= 0]
        by = np.argsort(rank, kind="stable")
        first, rank = first[by], rank[by]
        cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)
        lists: dict[int, list[np.ndarray]] = {int(rank[c]): [first[c:d]] for c, d in zip(cuts, [*cuts[1:], len(rank)])}
        active = list(lists)
        heapq.heapify(active)
        left, right, made = self.left.tolist(), self.right.tolist(), self.made.tolist()
        while active:
            r = heapq.heappop(active)
            held = lists.pop(r)
            pos = held[0] if len(held) == 1 else np.concatenate(held)
            a, b = left[r], right[r]
            pos = pos[sym[pos] == a]
            to = nxt[pos]
            ok = (to >= 0) & (sym[to] == b)
            if not ok.all():
                pos, to = pos[ok], to[ok]
            if not len(pos):
                continue
            if a == b and len(pos) > 1:  # of overlapping pairs every second one, from the left
                by = np.argsort(pos)
                pos, to = pos[by], to[by]
                head = np.r_[True, to[:-1] != pos[1:]]
                run = np.maximum.accumulate(np.where(head, np.arange(len(pos)), 0))
                even = (np.arange(len(pos)) - run) % 2 == 0
                pos, to = pos[even], to[even]
            after = nxt[to]
            sym[pos] = made[r]
            sym[to] = -1
            nxt[pos] = after
            linked = after >= 0
            prv[after[linked]] = pos[linked]
            before = prv[pos]
            # pairs that now start at a merged symbol or right before one
            fresh = np.concatenate([pos[linked], before[before >= 0]])
            if not len(fresh):
                continue
            rank = self.ranks(sym[fresh], sym[nxt[fresh]])
            ok = rank >= 0
            if not ok.any():
                continue
            fresh, rank = fresh[ok], rank[ok]
            if len(fresh) > 1:
                key = np.unique(rank.astype(np.int64) << 32 | fresh)
                fresh, rank = (key & 0xFFFFFFFF).astype(np.int32), key >> 32
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                groups = zip(rank[np.r_[0, cuts]].tolist(), np.split(fresh, cuts))
            else:
                groups = ((int(rank[0]), fresh),)
            for k, where in groups:
                if k in lists:
                    lists[k].append(where)
                else:
                    lists[k] = [where]
                    heapq.heappush(active, k)
        live = sym >= 0
        counts = np.add.reduceat(live, np.cumsum(lengths) - lengths, dtype=np.int64)
        return sym[live], counts


class ByteCodec:
    """Encodes and decodes whole texts with a byte-level vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.index = PairIndex(path)
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(GPT_PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.index.special)) + ")") if self.index.special else None
        self.safe: set[str] = set()
        self.odd: set[str] = set()
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.text_of: list[str] = []
        self.bytes_of: list[bytes] = []
        self.count_of: list[int] = []

    def cut(self, text: str) -> list[str]:
        new = set(text) - self.safe
        for c in new - self.odd:
            probe = f"a{c}1{c}!{c}{c} {c}a {c}1 {c}!{c} "
            same = self.pattern.findall(probe) == [probe[x:y] for _, (x, y) in self.library.pre_tokenizer.pre_tokenize_str(probe)]
            (self.safe if same else self.odd).add(c)
        if new & self.odd:
            return [text[x:y] for _, (x, y) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def words(self, text: str) -> list[str]:
        """Pre-tokens; special strings stand alone."""
        if self.marks is None or "<|" not in text:
            return self.cut(text)
        out: list[str] = []
        for k, piece in enumerate(self.marks.split(text)):
            out += [piece] if k % 2 else self.cut(piece)
        return out

    def learn(self, words: list[str]) -> None:
        """Encode the words that aren't cached."""
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        plain = [w for w in new if w not in self.index.special]
        flat, counts = self.index.encode([w.encode("utf-8", "surrogatepass") for w in plain])
        at = len(self.ids)
        self.ids += np.split(flat, np.cumsum(counts)[:-1]) if plain else []
        self.number |= {w: at + k for k, w in enumerate(plain)}
        for w in new:
            if w in self.index.special:
                self.number[w] = len(self.ids)
                self.ids.append(np.array([self.index.special[w]], np.int32))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.words(t) for t in texts]
        if len(self.number) > CACHE_WORDS:
            self.clear()
        self.learn([w for x in cut for w in x])
        none = [np.zeros(0, np.int32)]
        return [np.concatenate([self.ids[k] for k in map(self.number.__getitem__, x)] or none) for x in cut]

    def decode(self, ids) -> str:
        return b"".join(map(self.index.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids and of the decoded text; works on each distinct word once."""
        cut = [self.words(t) for t in texts]
        if len(self.number) > CACHE_WORDS:
            self.clear()
        self.learn([w for x in cut for w in x])
        known = len(self.text_of)
        back = self.index.bytes.__getitem__
        for ids in self.ids[known:]:
            ids = ids.tolist()
            self.text_of.append(",".join(map(str, ids)))
            self.bytes_of.append(b"".join(map(back, ids)))
            self.count_of.append(len(ids))
        out = []
        for x in cut:
            at = list(map(self.number.__getitem__, x))
            ids = ",".join(map(self.text_of.__getitem__, at))
            decoded = b"".join(map(self.bytes_of.__getitem__, at)).decode("utf-8", "replace")
            out.append((sum(map(self.count_of.__getitem__, at)), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


_codecs: dict[str, ByteCodec] = {}


def codec(path: str) -> ByteCodec:
    """One for each worker process, so that its cache lasts over tasks."""
    if path not in _codecs:
        _codecs[path] = ByteCodec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            texts = pdf["t"].tolist()
            for a, b in slices(texts, TEXT_CHARS):
                yield pd.DataFrame({"k": pdf["k"].iloc[a:b].values, "ids": codec(path).encode_batch(texts[a:b])})

    return docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInPandas(tidy(run), f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text; null ids decode to the empty text."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "text": [codec(path).decode([] if x is None else list(x)) for x in pdf["i"]]})

    return tokens.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInPandas(tidy(run), f"k {kind}, text string").withColumnRenamed("k", key)


def round_trip_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass over the texts."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            texts = pdf["t"].tolist()
            for a, b in slices(texts, TEXT_CHARS):
                n, i, d = zip(*codec(path).digests(texts[a:b]))
                yield pd.DataFrame({"k": pdf["k"].iloc[a:b].values, "n_tokens": n, "ids_sha256": i, "decoded_sha256": d})

    out = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInPandas(tidy(run), f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("k", key)


def op4_pair_index_bpe(spark, sf_dir):
    import public_tokenizers

    return round_trip_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
