"""One list from the words half and the meaning half: weighted reciprocal ranks, share squared, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

RANK_K, WORDS_WEIGHT, LEAST_CANDIDATES = 8, 1.5, 30
#: Rows of a list and chunks around a place that a window shows at most.
MOST_RESULTS, MOST_AROUND = 50, 60


def shown_results(asked: int) -> int:
    return max(0, min(asked, MOST_RESULTS))


def shown_around(asked: int) -> int:
    return max(0, min(asked, MOST_AROUND))


def candidates(limit: int) -> int:
    """How many rows each half is asked for."""
    return max(limit, LEAST_CANDIDATES)


def from_words(rank: Column, share: Column) -> Column:
    return F.coalesce(WORDS_WEIGHT * share * share / (RANK_K + rank), F.lit(0.0))


def from_meaning(rank: Column) -> Column:
    return F.coalesce(1.0 / (RANK_K + rank), F.lit(0.0))


def fuse(words: DataFrame, meaning: DataFrame, now: Column | int, limit: int | None = 10) -> DataFrame:
    """words(path, rank, score, share, modified, ...) full outer meaning(path, rank, score, modified, ...) on path.

    Columns that both halves have are shown from the half that counts for more, the words' on a tie.
    """
    now = F.lit(now) if isinstance(now, int) else now
    shown = [c for c in words.columns if c in meaning.columns and c not in ("path", "rank", "score")]
    w = words.select("path", *[F.col(c).alias(f"w_{c}") for c in words.columns if c != "path"])
    m = meaning.select("path", *[F.col(c).alias(f"m_{c}") for c in meaning.columns if c != "path"])
    both = w.join(m, "path", "full_outer").withColumns({"part_w": from_words(F.col("w_rank"), F.col("w_share")), "part_m": from_meaning(F.col("m_rank"))})
    mine = F.when(F.col("part_w") >= F.col("part_m"), F.col("w_rank").isNotNull()).otherwise(F.col("m_rank").isNull())
    out = both.select(
        "path",
        *[F.when(mine, F.col(f"w_{c}")).otherwise(F.col(f"m_{c}")).alias(c) for c in shown],
        (F.col("part_w") + F.col("part_m")).alias("part"),
        F.col("w_rank").alias("words_rank"),
        F.col("w_score").alias("words_score"),
        F.col("w_share").alias("share"),
        F.col("m_rank").alias("meaning_rank"),
        F.col("m_score").alias("meaning_score"),
    )
    out = out.withColumn("score", F.col("part") * X.freshness(F.col("modified"), now)).drop("part")
    return out if limit is None else out.orderBy(F.desc("score"), "path").limit(limit)


def mark_across(answer: DataFrame, asked: str) -> DataFrame:
    """Adds `across`: found by meaning alone, in another script than the question's."""
    mine = X.script_of_text(F.lit(asked))
    shown = X.script_of_text(F.concat_ws(" ", "title", F.array_join("headings", " "), "fragment"))
    only = F.col("meaning_rank").isNotNull() & F.col("words_rank").isNull()
    return answer.withColumn("across", only & (mine != "other") & (shown != "other") & (shown != mine))
