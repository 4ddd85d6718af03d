"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a few counts and shares. Each feature has a lookup table over quantile bins, each
chosen pair of features one over coarse bins; boosting goes round the features in turn, and each
step adds a shallow tree, fitted to the gradient summed by bin, to one table. A score is the sum of
one entry from each table, through the logistic function.

The model is fitted on the driver on at most `max_rows` labelled rows, those of least hash; all rows
are scored. Defined results: null and empty texts are scored like any other (all features zero);
labels that are null or belong to no row are not used, several for one doc_id are averaged; with no
usable labels every score is 0.5, with labels of one kind only it is their share; repeated rows get
equal scores; an empty table gives an empty result; other columns are never inputs.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import drawn, load, text_or_empty

FEATURES = (
    "log_words", "word_length", "distinct_share", "top_word_share", "same_as_before", "upper_share", "exclamations", "symbols",
    "bars", "digits", "stops", "other_bytes", "same_lines", "words_per_line", "short_words", "lone_marks", "tagged_words",
)
#: Labelled rows that the model is fitted on at most.
MAX_ROWS = 40_000

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SYMBOL = np.isin(_BYTES, np.frombuffer(b"#*$%&<>@^~=+{}[]\\/_", np.uint8))
_STOP = np.isin(_BYTES, np.frombuffer(b".,;:?", np.uint8))


def features_of(text: str) -> np.ndarray:
    out = np.zeros(len(FEATURES), np.float32)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return out
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    length = np.fromiter(map(len, words), np.int64, n)
    chars = max(1, int(length.sum()))
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = max(1, by[_UPPER].sum() + by[_LOWER].sum())
    out[:] = (
        np.log1p(n),
        chars / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        by[_UPPER].sum() / letters,
        by[33] / n,
        by[_SYMBOL].sum() / n,
        by[124] / n,
        by[_DIGIT].sum() / chars,
        by[_STOP].sum() / n,
        by[128:].sum() / chars,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        (length <= 3).sum() / n,
        (length == 1).sum() / n,
        sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,;:?!") / n,
    )
    return out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def text_features(texts: pd.Series) -> pd.Series:
    return pd.Series([features_of(t) for t in texts])


class AdditiveModel:
    """Lookup tables by bin, for single features and for pairs."""

    def __init__(self, bins: int = 48, coarse: int = 12, rounds: int = 120, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.15, leaves: int = 4):
        self.bins, self.coarse, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.leaves = bins, coarse, rounds, pair_rounds, pairs, rate, leaves
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.wide: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.base, self.constant = 0.0, 0.5

    def _binned(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)

    @staticmethod
    def _cuts(col: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.quantile(col, np.linspace(0, 1, n + 1)[1:-1]))

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Leaf values over ordered bins: the split that gains most, until there are enough leaves."""
        G, H = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
        parts = [(0, len(g))]
        worth = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)
        while len(parts) < self.leaves:
            best = (1e-9, None, None)
            for a, b in parts:
                if b - a > 1:
                    c = np.arange(a + 1, b)
                    gain = (G[c] - G[a]) ** 2 / (H[c] - H[a] + 1.0) + (G[b] - G[c]) ** 2 / (H[b] - H[c] + 1.0) - worth(a, b)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], (a, b), int(c[i]))
            if best[1] is None:
                break
            (a, b), c = best[1], best[2]
            parts.remove((a, b))
            parts += [(a, c), (c, b)]
        out = np.zeros(len(g))
        for a, b in parts:
            out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
        return out

    def _tree2(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One cut of each axis: the row cut, and in each half a column cut of its own."""
        best, out = -1.0, np.zeros_like(g)
        for c in range(1, g.shape[0]):
            value, gain = np.zeros_like(g), 0.0
            for part in (slice(0, c), slice(c, None)):
                G, H = np.cumsum(g[part].sum(axis=0)), np.cumsum(h[part].sum(axis=0))
                left, right = G[:-1] / (H[:-1] + 1.0), (G[-1] - G[:-1]) / (H[-1] - H[:-1] + 1.0)
                score = G[:-1] * left + (G[-1] - G[:-1]) * right
                i = int(score.argmax())
                gain += score[i]
                value[part, : i + 1], value[part, i + 1 :] = left[i], right[i]
            if gain > best:
                best, out = gain, value
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        if not len(y):
            return self
        self.constant = float(y.mean())
        if self.constant in (0.0, 1.0):
            return self
        self.base = float(np.log(self.constant / (1 - self.constant)))
        n, k = x.shape
        self.edges = [self._cuts(x[:, f], self.bins) for f in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        at = self._binned(x, self.edges)
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            for f in range(k):
                p = 1 / (1 + np.exp(-score))
                size = len(self.tables[f])
                step = self.rate * self._tree(np.bincount(at[:, f], y - p, size), np.bincount(at[:, f], p * (1 - p), size))
                self.tables[f] += step
                score += step[at[:, f]]
        # pairs by what one tree on their residuals would gain
        self.wide = [self._cuts(x[:, f], self.coarse) for f in range(k)]
        at = self._binned(x, self.wide)
        shape = [len(e) + 1 for e in self.wide]
        p = 1 / (1 + np.exp(-score))

        def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
            return np.bincount(at[:, i] * shape[j] + at[:, j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

        gains = []
        for i, j in combinations(range(k), 2):
            if shape[i] > 1 and shape[j] > 1:
                g, h = sums(i, j, y - p), sums(i, j, p * (1 - p))
                v = self._tree2(g, h)
                gains.append(((g * v).sum(), i, j))
        chosen = sorted(gains, reverse=True)[: self.n_pairs]
        self.pairs = [(i, j, np.zeros((shape[i], shape[j]))) for _, i, j in chosen]
        for _ in range(self.pair_rounds):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-score))
                step = self.rate * self._tree2(sums(i, j, y - p), sums(i, j, p * (1 - p)))
                table += step
                score += step[at[:, i], at[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.tables:
            return np.full(len(x), self.constant)
        at, wide = self._binned(x, self.edges), self._binned(x, self.wide)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[at[:, f]]
        for i, j, table in self.pairs:
            total += table[wide[:, i], wide[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, key: str = "doc_id", label: str = "quality", text: str = "text", **options) -> AdditiveModel:
    """Learns from the texts of labelled rows that aren't held out; a key that several rows have counts once, with its least text.

    The labels of least hash are chosen first, so texts of other rows are neither cut into features nor
    moved, and what goes to the driver is the features of `max_rows` rows at most.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(key).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("y"))
    marks = drawn(marks.where(~held_out(key)).select(F.col(key).alias("k"), "y"), F.xxhash64(F.col("k").cast("string")), max_rows)
    each = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).join(F.broadcast(marks), "k").groupBy("k", "y").agg(F.min("t").alias("t"))
    rows = each.select("k", "y", text_features("t").alias("x")).orderBy(F.xxhash64(F.col("k").cast("string")), "k").select("x", "y").collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return AdditiveModel(**options).fit(x, np.array([r["y"] for r in rows], np.float64))


def text_scorer(model: AdditiveModel):
    """A column function from texts to scores."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([features_of(t) for t in texts]).astype(np.float64)) if len(texts) else np.zeros(0))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each input row: key, held_out boolean, score double, predicted int."""
    model = fit(docs, labels, key=key, text=text, **options)
    out = docs.select(key, held_out(key).alias("held_out"), text_scorer(model)(text_or_empty(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_additive_quality(spark, sf_dir):
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
