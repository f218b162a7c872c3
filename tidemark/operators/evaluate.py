"""Interval metrics, scores and the leaderboard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import save
from . import blocks


def contextual_confusion(truth: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """(keys, tp, fp, fn) of intervals that overlap. A truth that is met counts once, as does a finding that meets nothing. tn has no meaning and is NULL.

    Each side is read once and both are shuffled once, by the keys. An interval meets
    one of the other side if, of those that begin up to its end, the furthest end
    reaches its start: a running maximum, so nothing grows with the pairs. Beyond a
    block of intervals a key is gone through in blocks.
    """
    side = lambda df, is_truth: df.select(*keys, "start", "end", F.lit(is_truth).alias("_t"))
    both = save(side(truth, True).unionByName(side(found, False)), "intervals")
    long = blocks.largest(both, list(keys)) > blocks.BLOCK
    for name, other in (("_of_found", ~F.col("_t")), ("_of_truth", F.col("_t"))):
        # the other side stands at its starts and goes first where an end meets one
        at, then, value = F.when(other, F.col("start")).otherwise(F.col("end")), F.when(other, 0).otherwise(1), F.when(other, F.col("end"))
        if long:
            both = blocks.running_max(blocks.in_blocks(both.withColumn("_at", at), list(keys), "_at"), list(keys), "_at", then, value, name).drop("_at", "_block")
        else:
            both = both.withColumn(name, F.max(value).over(Window.partitionBy(*keys).orderBy(at, then)))
    met = F.coalesce(F.when(F.col("_t"), F.col("_of_found")).otherwise(F.col("_of_truth")) >= F.col("start"), F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    return both.groupBy(*keys).agg(count(F.col("_t") & met).alias("tp"), count(~F.col("_t") & ~met).alias("fp"), count(F.col("_t") & ~met).alias("fn"), F.lit(None).cast("bigint").alias("tn"))


def _ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


#: E5: metrics over the confusion columns, by name.
METRICS: dict[str, Callable] = {
    "precision": lambda tp, fp, fn: _ratio(tp, tp + fp),
    "recall": lambda tp, fp, fn: _ratio(tp, tp + fn),
    "f1": lambda tp, fp, fn: _ratio(2 * tp, 2 * tp + fp + fn),
    "accuracy": lambda tp, fp, fn: _ratio(tp, tp + fp + fn),
}


def resolve_metrics(metrics) -> dict[str, Callable]:
    """Names, callables (by their own name) or a dict; unknown names are an error."""
    if isinstance(metrics, dict):
        return metrics
    out = {}
    for m in metrics or METRICS:
        if callable(m):
            out[m.__name__] = m
        elif m in METRICS:
            out[m] = METRICS[m]
        else:
            raise ValueError(f"unknown metric {m!r}")
    return out


def scores(confusion: DataFrame, metrics=None) -> DataFrame:
    args = [F.col(c) for c in ("tp", "fp", "fn")]
    return confusion.select("*", *[f(*args).alias(name) for name, f in resolve_metrics(metrics).items()])


def paper_table(rows: DataFrame, datasets: list[str] | None = None) -> DataFrame:
    """f1 from summed counts by (pipeline, dataset), datasets as columns."""
    s = scores(rows.groupBy("pipeline", "dataset").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]), ["f1"])
    return s.groupBy("pipeline").pivot("dataset", datasets).agg(F.first("f1"))


def leaderboard(rows: DataFrame, metrics: list[str], rank: str = "f1") -> DataFrame:
    """Mean metrics by pipeline, best first. The window is over pipelines only, a few rows."""
    if rank not in metrics:
        rank = metrics[0]
    mean = rows.groupBy("pipeline").agg(*[F.avg(m).alias(m) for m in metrics])
    return mean.withColumn("rank", F.dense_rank().over(Window.orderBy(F.col(rank).desc())).cast("bigint"))


def pending(jobs: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("pipeline", "dataset", "signal", "iteration")) -> DataFrame:
    """The jobs without a score."""
    return jobs.join(done.select(*keys), list(keys), "left_anti")
