"""Change streams: bursts of events, scopes, and micro-batches that run the same update as a batch.

An event only says where to look, so a late or lost one costs freshness, never correctness: bursts
need no watermark beyond the one that lets state go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUIET_MS, LONGEST_MS, CATCH_UP_S = 500, 5000, 120


def worth_looking(events: DataFrame, store: str | None = None) -> DataFrame:
    """events(path, kind, ...) without reads, without the store's own files and hidden ones, but for rule files."""
    hidden = F.col("path").rlike(r"/\.[^/]+") & ~F.col("path").rlike(r"/\.(gitignore|foliant-ignore)$")
    keep = (F.col("kind") != "access") & (~hidden | F.col("path").isNull())
    return events.where(keep & ~F.col("path").startswith(store.rstrip("/") + "/") if store else keep)


def sessions(events: DataFrame, gap_ms: int = QUIET_MS, by: tuple[str, ...] = (), watermark: str = "10 seconds") -> DataFrame:
    """Bursts by quiet time, for batch and stream alike: by, start, end (of the last event), n."""
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
    s = F.session_window("ts", f"{gap_ms} milliseconds")
    got = events.groupBy(s.alias("s"), *by).agg(F.count("*").alias("n"), F.max("ts").alias("end"))
    return got.select(*by, F.col("s.start").alias("start"), "end", "n")


def capped_bursts(events: DataFrame, gap_ms: int = QUIET_MS, longest_ms: int = LONGEST_MS, by: str = "source") -> DataFrame:
    """Batch form with the hard cap: bursts close after a quiet time, and after `longest_ms` from their first event.

    A quiet time cuts first; inside such a run the cap is a pass from left to right.
    """
    order = W.partitionBy(by).orderBy("ts")
    timed = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    timed = timed.withColumn("new", F.coalesce((F.col("us") - F.lag("us").over(order) > 1000 * gap_ms).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    # a run is dealt out by itself, so a source that never rests long is not one task's work
    runs = timed.groupBy(by, "run").agg(F.array_sort(F.collect_list("us")).alias("all"))
    bursts = F.explode(_capped("all", F.lit(1000 * longest_ms))).alias("b")
    return runs.select(by, bursts).select(by, F.timestamp_micros(F.col("b.first")).alias("start"), F.timestamp_micros(F.col("b.last")).alias("end"), "b.n")


@F.pandas_udf(T.ArrayType(T.StructType().add("first", "long").add("last", "long").add("n", "integer")))
def _capped(runs: pd.Series, longest: pd.Series) -> pd.Series:
    """Each run of times in order cut greedily: a burst ends before the first event that is `longest` or more after its first."""
    out = []
    for at, cap in zip(runs, longest):
        at, i, cuts = np.asarray(at, np.int64), 0, []
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(at, at[i] + cap)))
            cuts.append({"first": at[i], "last": at[j - 1], "n": j - i})
            i = j
        out.append(cuts)
    return pd.Series(out)


def streaming_bursts(events: DataFrame, gap_ms: int = QUIET_MS, longest_ms: int = LONGEST_MS) -> DataFrame:
    """events(source, path, everything) as a stream -> source, everything, paths once a burst is over.

    Processing-time timers: each event moves the quiet timer, but never past the cap after the first.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, everything, paths = state.get
            state.remove()
            yield pd.DataFrame({"source": [key[0]], "everything": [bool(everything)], "paths": [[] if everything else sorted(set(paths))]})
            return
        now = state.getCurrentProcessingTimeMs()
        first, everything, paths = state.get if state.exists else (now, False, [])
        paths = set(paths)
        for pdf in batches:
            everything = everything or bool(pdf["everything"].any())
            paths |= set(pdf["path"].dropna())
        state.update((first, everything, sorted(paths)))
        state.setTimeoutDuration(max(1, min(gap_ms, first + longest_ms - now)))

    return events.groupBy("source").applyInPandasWithState(fold, "source string, everything boolean, paths array<string>", "first long, everything boolean, paths array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def each_burst(bursts: DataFrame, update: Callable[[list[str] | None], object], checkpoint: str, name: str = "foliant-watch"):
    """Run update(paths, or None for everything) for each micro-batch of bursts; scopes that wait for one another coalesce."""

    def run(batch: DataFrame, _: int) -> None:
        row = batch.agg(F.max("everything").alias("e"), F.array_distinct(F.flatten(F.collect_list("paths"))).alias("p")).first()
        if row["e"] is None:
            return
        update(None if row["e"] else list(row["p"]))

    return bursts.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(run).outputMode("append").start()


def needs_catch_up(last_scan: Column, now: Column) -> Column:
    return (now - last_scan) > CATCH_UP_S


def watch_folder(spark, folder: str, source: str) -> DataFrame:
    """New and changed files of a folder as a stream of events."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return raw.select(F.lit(source).alias("source"), F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("ts"), F.lit("modify").alias("kind"), F.lit(False).alias("everything"))
