"""Quality rules: base statistics of a text and a learned decision list, in DataFrame functions only.

Sequential covering: a rule that rejects grows one threshold at a time by information gain, is pruned
on rows kept apart for that, and what it covers is set aside before the next one is grown. The list
becomes one ordered conditional expression that Spark evaluates; only the learning, on at most
`max_rows` labelled rows of least hash, happens on the driver; rows that can't be among these are left
out before they leave their tasks.

Defined results: null and empty texts have zero statistics and fail the base rules; labels that are
null or belong to no row are not used, several for one doc_id are averaged; without labels of both
kinds the list is empty and keeps all that the base rules keep; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drawn, load, stage, text_or_empty

MAX_ROWS = 20_000
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test, as SQL over the statistics.
SHARES = {
    "n_words": "n_words",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
}


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, although use may look at it from inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without(chars: str) -> Column:
    return F.length(F.translate("t", chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more: equal windows stand together once sorted by hash and place."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j + 1)["h"] == x["h"]) | (F.get(s, j - 1)["h"] == x["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.when(b.isNull(), 3).otherwise(F.least(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    return F.when(n < 4, 0).otherwise(_let(_let(F.array_sort(grams), starts), covered))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the counts of each text; all longs."""
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split("t", r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    by_words = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), _repeat_words(w).alias("n_repeat_words")))
    by_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    all_chars = F.length("t")
    counts = {
        "word_chars": _without(BLANK),
        "n_symbols": all_chars - _without(SYMBOLS),
        "n_upper": all_chars - _without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_bangs": all_chars - _without("!"),
        "n_words": F.col("w.n_words"),
        "n_distinct": F.col("w.n_distinct"),
        "n_repeat_words": F.col("w.n_repeat_words"),
        "n_lines": F.col("l.n_lines"),
        "n_dup_lines": F.col("l.n_dup_lines"),
    }
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).withColumns({"w": by_words, "l": by_lines})
    return rows.select(F.col("k").alias(key), *[F.coalesce(v, F.lit(0)).cast("long").alias(c) for c, v in counts.items()])


class DecisionList:
    """Ordered rules; each is a conjunction of (feature, "<=" or ">", threshold) that rejects."""

    def __init__(self, max_rules: int = 12, max_tests: int = 4, cuts: int = 40, precision: float = 0.9, least: int = 3):
        self.max_rules, self.max_tests, self.cuts, self.precision, self.least = max_rules, max_tests, cuts, precision, least
        self.rules: list[list[tuple[str, str, float]]] = []

    def fit(self, x: np.ndarray, reject: np.ndarray, names: list[str]) -> DecisionList:
        if not reject.any() or reject.all():
            return self
        apart = np.arange(len(x)) % 3 == 2  # rows come in hash order
        tests = [(f, op, t) for f in range(x.shape[1]) for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.cuts + 2)[:-1]).round(6)) for op in ("<=", ">")]
        hits = np.stack([x[:, f] <= t if op == "<=" else x[:, f] > t for f, op, t in tests])
        left = np.ones(len(x), bool)
        for _ in range(self.max_rules):
            grown = self._grow(hits, reject, left & ~apart)
            for rule in (self._prune(grown, hits, reject, left & apart), grown):
                covered = hits[rule].all(axis=0) & left
                if rule and covered.sum() >= self.least and reject[covered].mean() >= self.precision:
                    break
            else:
                break
            self.rules.append([(names[tests[r][0]], tests[r][1], float(tests[r][2])) for r in rule])
            left &= ~covered
            if not (reject & left).any():
                break
        return self

    def _grow(self, hits: np.ndarray, reject: np.ndarray, rows: np.ndarray) -> list[int]:
        rule: list[int] = []
        while len(rule) < self.max_tests:
            p, n = (rows & reject).sum(), (rows & ~reject).sum()
            if not p or not n:
                break
            P, N = hits[:, rows & reject].sum(axis=1), hits[:, rows & ~reject].sum(axis=1)
            gain = P * (np.log2((P + 1e-9) / (P + N + 1e-9)) - np.log2(p / (p + n)))
            best = int(gain.argmax())
            if gain[best] <= 1e-6:
                break
            rule.append(best)
            rows = rows & hits[best]
        return rule

    def _prune(self, rule: list[int], hits: np.ndarray, reject: np.ndarray, rows: np.ndarray) -> list[int]:
        def worth(r: list[int]) -> float:
            c = hits[r].all(axis=0) & rows
            p, n = (c & reject).sum(), (c & ~reject).sum()
            return (p - n) / (p + n) if p + n else -1.0

        best = rule
        for k in range(len(rule) - 1, 0, -1):
            if worth(rule[:k]) >= worth(best):
                best = rule[:k]
        return best

    def expression(self) -> str:
        """The list as SQL over the statistics: true where a text is kept."""
        if not self.rules:
            return "true"
        when = " ".join("WHEN " + " AND ".join(f"{SHARES[f]} {op} {t!r}D" for f, op, t in rule) + " THEN false" for rule in self.rules)
        return f"CASE {when} ELSE true END"


def learn(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, key: str = "doc_id", label: str = "quality", **options) -> DecisionList:
    """stats from `statistics`; rows whose crc32(key as text) mod 3 is 1 are left for measuring. A key that several rows have counts once, with the least of each count."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(key).agg((F.avg(F.col(label).cast("double")) < 0.5).alias("reject"))
    order = F.xxhash64(F.col(key).cast("string"))
    marks = drawn(marks.where(F.crc32(F.col(key).cast("string")) % 3 != 1), order, max_rows)
    each = stats.join(F.broadcast(marks), key).groupBy(key).agg(*[F.min(c).alias(c) for c in stats.columns if c != key], F.first("reject").alias("reject"))  # one row of a key, `max_rows` at most
    rows = each.withColumn("o", order).orderBy("o")
    got = rows.selectExpr("reject", *[f"CAST({v} AS DOUBLE)" for v in SHARES.values()]).collect()
    x = np.array([tuple(r)[1:] for r in got], float).reshape(len(got), len(SHARES))
    return DecisionList(**options).fit(x, np.array([r[0] for r in got], bool), list(SHARES))


def apply_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each input row: key, the base statistics, base_failed, kept, rule (number of the one that rejects, from 1)."""
    stats = stage(statistics(docs, key, text), "rules-stats")
    rules = learn(stats, labels, key=key, **options)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fired = F.lit(None).cast("int")
    for i in range(len(rules.rules), 0, -1):
        test = " AND ".join(f"{SHARES[f]} {op} {t!r}D" for f, op, t in rules.rules[i - 1])
        fired = F.when(F.expr(test), F.lit(i)).otherwise(fired)
    out = stats.withColumn("base_failed", base).withColumn("kept", ~base & F.expr(rules.expression()))
    return out.select(key, *STATS, "base_failed", "kept", fired.alias("rule"))


def op6_decision_list(spark, sf_dir):
    return apply_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
