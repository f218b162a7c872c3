"""From responses to intervals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import save
from . import blocks


def val2idx(values, x):
    """I1 as a column: positions of x whose values were named; a row counts once for each dimension that matches."""
    hit = F.transform(x, lambda r, i: F.transform(F.filter(r, lambda v: F.array_contains(values, v)), lambda v: i.cast("bigint")))
    return F.flatten(hit)


def vote_in_windows(votes: DataFrame, alpha: float = 0.5) -> DataFrame:
    """A4: (signal_id, win, first_index, sample, positions) -> (.., idx) named by ceil(alpha * samples) at least.

    Empty answers count as samples; the vote needs one shuffle, on the window.
    """
    per = votes.groupBy("signal_id", "win", "first_index").agg(F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("positions")).alias("all"))
    counted = per.select("signal_id", "win", "first_index", "n", F.explode("all").alias("idx")).groupBy("signal_id", "win", "first_index", "n", "idx").count()
    return counted.filter(F.col("count") >= F.ceil(F.lit(alpha) * F.col("n"))).select("signal_id", "win", "first_index", "idx")


def vote_across_windows(found: DataFrame, window_size: int, step_size: int, beta: float = 0.5, by_coverage: bool = False) -> DataFrame:
    """A5: positions of the signal named by ceil(beta * windows over a position) at least.

    by_coverage counts the windows that do cover an edge position from its left.
    """
    pos = found.select("signal_id", (F.col("first_index") + F.col("idx")).alias("idx")).groupBy("signal_id", "idx").count()
    least = F.lit(math.ceil(beta * window_size / step_size))
    if by_coverage:
        least = F.least(least, F.greatest(F.lit(1), F.ceil(F.lit(beta) * (F.floor(F.col("idx") / step_size) + 1))))
    return pos.filter(F.col("count") >= least).select("signal_id", "idx")


def merge_intervals(df: DataFrame, score: str | None = None) -> DataFrame:
    """I4: overlapping or touching (start, end) of a signal become one; the highest score stays (0 without scores). Beyond a block of intervals a signal is gone through in blocks."""
    df = save(df.select("signal_id", "start", "end", *([score] if score else [])), "intervals")
    if blocks.largest(df, ["signal_id"]) > blocks.BLOCK:
        df = blocks.islands(df, ["signal_id"], "start", "end")
    else:
        w = Window.partitionBy("signal_id").orderBy("start", "end")
        before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        head = F.when(before.isNull() | (F.col("start") > before), F.col("start"))
        df = df.withColumn("_head", head).withColumn("_island", F.max("_head").over(w))
    severity = F.max(score) if score else F.lit(0.0)
    return df.groupBy("signal_id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), severity.alias("severity")).drop("_island")


def format_anomalies(idx: DataFrame, samples: DataFrame, padding_size: int = 50) -> DataFrame:
    """Positions to times (I2), padded and clamped to the signal (I3), merged (I4)."""
    times = samples.select("signal_id", "idx", "ts").distinct()
    ends = times.groupBy("signal_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), (F.min(F.when(F.col("idx") == 1, F.col("ts"))) - F.min(F.when(F.col("idx") == 0, F.col("ts")))).alias("gap"))
    pad = F.coalesce(F.col("gap"), F.lit(0)) * padding_size
    padded = idx.join(times, ["signal_id", "idx"]).join(ends, "signal_id").select("signal_id", F.greatest(F.col("ts") - pad, F.col("lo")).alias("start"), F.least(F.col("ts") + pad, F.col("hi")).alias("end"))
    return merge_intervals(padded)
