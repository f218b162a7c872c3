"""Sliding windows (W1, W2). Only whole windows are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def rows_of_dims(df: DataFrame, column: str = "x") -> DataFrame:
    """(signal_id, idx, ts, row): the dimensions of a position as one array."""
    return df.groupBy("signal_id", "idx", "ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", column))), lambda s: s[column]).alias("row"))


def rolling_window_sequences(rows: DataFrame, window_size: int = 500, step_size: int = 100, target_size: int = 0, target_column: int = 0) -> DataFrame:
    """W1, and W2 if target_size > 0: (signal_id, win, first_index, x[, y, target_ts]).

    A row goes only to the windows that cover it, so nothing is as large as a
    signal. With a step of 1 a frame over sorted rows is cheaper than as many copies
    of each row: a signal is cut into blocks of positions, each with the rows after
    it that its last windows reach into.
    """
    span = window_size + target_size
    if step_size == 1:
        block = max(blocks.BLOCK, 4 * span)
        own = F.floor(F.col("idx") / block)
        reach = F.greatest(F.lit(0), F.floor((F.col("idx") - (span - 1)) / block))
        spread = rows.withColumn("_block", F.explode(F.sequence(reach.cast("bigint"), own.cast("bigint"))))
        w = Window.partitionBy("signal_id", "_block").orderBy("idx")
        got = spread.select("signal_id", "_block", F.col("idx").alias("first_index"), F.collect_list(F.struct("idx", "ts", "row")).over(w.rowsBetween(0, span - 1)).alias("w"))
        got = got.filter(F.floor(F.col("first_index") / block) == F.col("_block")).drop("_block")
    else:
        last, first = F.floor(F.col("idx") / step_size), F.greatest(F.lit(0), F.ceil((F.col("idx") - (span - 1)) / step_size))
        spread = rows.filter(first <= last).withColumn("win", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
        got = spread.groupBy("signal_id", "win").agg(F.array_sort(F.collect_list(F.struct("idx", "ts", "row"))).alias("w")).withColumn("first_index", F.col("win") * step_size)
    got = got.filter(F.size("w") == span).withColumn("win", F.floor(F.col("first_index") / step_size).cast("bigint"))
    body = F.transform(F.slice("w", 1, window_size), lambda s: s["row"]).alias("x")
    if not target_size:
        return got.select("signal_id", "win", "first_index", body)
    tail = F.slice("w", window_size + 1, target_size)
    return got.select("signal_id", "win", "first_index", body, F.transform(tail, lambda s: s["row"][target_column]).alias("y"), F.get(tail, F.lit(0))["ts"].alias("target_ts"))
