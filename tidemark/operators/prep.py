"""Bucketing, imputation, scaling and binning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import save
from .blocks import numbered
from .quantiles import exact_quantiles

#: P1m: what a bucket's rows reduce to. first and last go by ts.
METHODS = {
    "mean": lambda v, t: F.avg(v),
    "median": None,  # exact_quantiles
    "min": lambda v, t: F.min(v),
    "max": lambda v, t: F.max(v),
    "sum": lambda v, t: F.sum(v),
    "count": lambda v, t: F.count(v).cast("double"),
    "first": lambda v, t: F.min_by(v, t),
    "last": lambda v, t: F.max_by(v, t),
}


def time_segments_aggregate(df: DataFrame, interval: int, method: str | list[str] = "mean", digits: int = 6) -> DataFrame:
    """Equi-spaced samples (signal_id, dim, idx, ts, value), a row for each interval, empty ones NULL. Of a median, NaN has no part.

    The bucket sums combine on the map side, so a hot signal costs no more than its
    buckets. A list of methods gives a column for each. Values are rounded so that
    the order of summation can't move a later floor().
    """
    names = [method] if isinstance(method, str) else list(method)
    if unknown := [m for m in names if m not in METHODS]:
        raise ValueError(f"unknown aggregation methods: {unknown}")
    # one pass for the bounds: a row for each column of a signal, on which both sides below stand
    per = Window.partitionBy("signal_id")
    ends = df.groupBy("signal_id", "dim").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")).select("signal_id", "dim", F.min("t0").over(per).alias("t0"), F.max("t1").over(per).alias("t1"))
    label = lambda m: "value" if isinstance(method, str) else m
    placed, keys = df.join(ends, ["signal_id", "dim"]).withColumn("idx", F.floor((F.col("ts") - F.col("t0")) / interval).cast("bigint")), ["signal_id", "dim", "idx"]
    if "median" in names:
        placed = save(placed.select(*keys, "ts", "value"), "bucketed")
    # a bucket without any other reducer still has its row
    outs = [F.round(METHODS[m](F.col("value"), F.col("ts")), digits).alias(label(m)) for m in names if m != "median"] or [F.count(F.lit(1)).alias("_any")]
    cells = placed.groupBy(*keys).agg(*outs)
    if "median" in names:
        medians = exact_quantiles(placed.filter("value IS NOT NULL AND NOT isnan(value)"), keys, "value", [0.5])
        cells = cells.join(medians, keys, "left").withColumn(label("median"), F.round(F.col("_q")[0], digits)).select(*keys, *map(label, names))
    spine = ends.select("signal_id", "dim", "t0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("t1") - F.col("t0")) / interval).cast("bigint"))).alias("idx"))
    return spine.join(cells, ["signal_id", "dim", "idx"], "left").select("signal_id", "dim", "idx", (F.col("t0") + F.col("idx") * interval).alias("ts"), *[c for c in cells.columns if c not in ("signal_id", "dim", "idx")])


def impute(df: DataFrame, strategy: str = "mean", fill: float | None = None, digits: int = 6) -> DataFrame:
    """Fills NULL and NaN by column: mean, median, most_frequent or a constant."""
    v = F.when(~F.isnan("value"), F.col("value"))
    if strategy == "constant":
        return df.withColumn("value", F.coalesce(v, F.lit(fill or 0.0)))
    per = Window.partitionBy("signal_id", "dim")
    fills = {"mean": F.avg(v), "median": F.median(v), "most_frequent": F.mode(v, deterministic=True)}
    if strategy not in fills:
        raise ValueError(f"unknown strategy {strategy!r}")
    stand_in = df.groupBy("signal_id", "dim").agg(F.round(fills[strategy], digits).alias("_fill"))
    return df.join(stand_in, ["signal_id", "dim"]).withColumn("value", F.coalesce(v, F.col("_fill"))).drop("_fill") if strategy != "mean" else df.withColumn("value", F.coalesce(v, F.round(F.avg(v).over(per), digits)))


def fit_scalar(df: DataFrame) -> DataFrame:
    """The least value of a signal over all its dimensions."""
    return df.groupBy("signal_id").agg(F.min("value").alias("minimum"))


def fixed_point(v, decimal: int):
    """Signed fixed point: a product within 1e-8 of a whole number is that number, else its floor."""
    p = v * F.lit(float(10**decimal))
    return F.when(F.abs(p - F.rint(p)) < 1e-8, F.rint(p)).otherwise(F.floor(p)).cast("bigint")


def float_to_scalar(df: DataFrame, fitted: DataFrame | None = None, decimal: int = 2, rescale: bool = True) -> DataFrame:
    """Adds x (whole numbers), minimum and decimal."""
    joined = df.join(fit_scalar(df) if fitted is None else fitted, "signal_id")
    v = F.col("value") - F.col("minimum") if rescale else F.col("value")
    return joined.withColumn("x", fixed_point(v, decimal)).withColumn("decimal", F.lit(decimal))


def scalar_to_float(x, minimum, decimal: int = 2):
    """P5 as a column."""
    return x * F.lit(10.0**-decimal) + minimum


def kmeans_1d(v: np.ndarray, k: int, counts: np.ndarray | None = None) -> np.ndarray:
    """Sorted centres of the best partition into k clusters, of values that each stand for so many rows.

    On a line clusters are runs of sorted values. The best cost of the first i values in
    m runs follows from that in m - 1; where the last run begins never goes back as i
    grows, so each of the k rounds halves its ranges and looks at some n log n
    beginnings. Of equal costs the earlier beginning counts.
    """
    order = np.argsort(v, kind="stable")
    v = np.asarray(v, float)[order]
    n = (np.ones(len(v)) if counts is None else np.asarray(counts, float))[order]
    k = min(k, len(v))
    middle = float(n @ v / n.sum())
    sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (n, n * (v - middle), n * (v - middle) ** 2)]

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        w, s, q = (x[j] - x[i] for x in sums)
        return np.maximum(q - s * s / w, 0.0)

    best, begins = cost(np.zeros(len(v), int), np.arange(1, len(v) + 1)), []
    best = np.concatenate([[0.0], best])
    for m in range(2, k + 1):
        now, begin = np.full(len(v) + 1, np.inf), np.zeros(len(v) + 1, int)
        lo, hi, a, b = (np.array([x]) for x in (m, len(v), m - 1, len(v) - 1))
        while len(lo):
            mid = (lo + hi) // 2
            many = np.minimum(b, mid - 1) - a + 1
            first = np.concatenate([[0], np.cumsum(many)[:-1]])
            of = np.repeat(np.arange(len(mid)), many)
            at = a[of] + np.arange(many.sum()) - first[of]
            costs = best[at] + cost(at, mid[of])
            least = np.minimum.reduceat(costs, first)
            hit = np.flatnonzero(costs == least[of])
            hit = hit[np.unique(of[hit], return_index=True)[1]]
            now[mid], begin[mid] = least, at[hit]
            left, right = lo < mid, mid < hi
            lo, hi, a, b = (np.concatenate(x) for x in ((lo[left], mid[right] + 1), (mid[left] - 1, hi[right]), (a[left], at[hit][right]), (at[hit][left], b[right])))
        best = now
        begins.append(begin)
    cuts = [len(v)]
    for begin in reversed(begins):
        cuts.append(begin[cuts[-1]])
    cuts = np.array([0, *reversed(cuts)])
    w, s = (x[cuts[1:]] - x[cuts[:-1]] for x in sums[:2])
    return middle + s / w


#: Distinct values of a column that are clustered as they are.
CELLS = 16_384


def fit_cluster(df: DataFrame, n_clusters: int = 100, fit_fraction: float = 1.0) -> DataFrame:
    """(signal_id, dim, centroids). Few distinct values are their own centres; only the other columns go to k-means, as value counts.

    Of more than CELLS distinct values, neighbours are taken together, equally many in
    each of CELLS cells, and clusters end between cells: a task holds CELLS rows at most.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("signal_id", "dim"))
    head = df.withColumn("_n", n).filter(F.col("idx") < F.greatest(F.lit(1), F.floor(F.col("_n") * fit_fraction))) if fit_fraction < 1 else df
    counts = save(head.groupBy("signal_id", "dim", "value").count(), "values")
    sizes = counts.groupBy("signal_id", "dim").agg(F.count(F.lit(1)).alias("_k"))
    exact = counts.join(sizes.filter(F.col("_k") <= n_clusters), ["signal_id", "dim"]).groupBy("signal_id", "dim").agg(F.array_sort(F.collect_list("value")).alias("centroids"))
    most = sizes.agg(F.max("_k")).first()[0] or 0
    if most <= n_clusters:
        return exact

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        centres = kmeans_1d(pdf["value"].to_numpy(), n_clusters, pdf["count"].to_numpy())
        return pd.DataFrame({"signal_id": [pdf["signal_id"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "centroids": [centres.tolist()]})

    rest = counts.join(sizes.filter(F.col("_k") > n_clusters), ["signal_id", "dim"])
    if most > CELLS:
        placed = numbered(rest, ["signal_id", "dim"], ["value"], "_at", None, "values").withColumn("_cell", F.floor(F.col("_at") * F.least(F.lit(CELLS), F.col("_k")) / F.col("_k")))
        rest = placed.groupBy("signal_id", "dim", "_cell").agg((F.sum(F.col("value") * F.col("count")) / F.sum("count")).alias("value"), F.sum("count").alias("count"))
    return exact.unionByName(rest.select("signal_id", "dim", "value", "count").groupBy("signal_id", "dim").applyInPandas(solve, "signal_id string, dim int, centroids array<double>"))


def nearest(v, centroids):
    """P7 as a column: position of the nearest centre, ties to the lower."""
    d = F.transform(centroids, lambda c: F.abs(v - c))
    return (F.array_position(d, F.array_min(d)) - 1).cast("bigint")


def float_to_cluster(df: DataFrame, fitted: DataFrame) -> DataFrame:
    return df.join(fitted, ["signal_id", "dim"]).withColumn("x", nearest(F.col("value"), F.col("centroids")))


def cluster_to_float(x, centroids):
    """P8 as a column: labels outside the range are clipped."""
    return F.element_at(centroids, (F.least(F.greatest(x, F.lit(0)), F.size(centroids) - 1) + 1).cast("int"))


def normalize(df: DataFrame) -> DataFrame:
    """Z-scores by column with the sample deviation."""
    w = Window.partitionBy("signal_id", "dim")
    return df.withColumn("value", (F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w))


def streaming_imputer(batches: Iterator[pd.DataFrame], fills: dict) -> Iterator[pd.DataFrame]:
    """P2 for a stream: fills known beforehand, by (signal_id, dim)."""
    for pdf in batches:
        stand_in = pd.Series([fills.get(k, 0.0) for k in zip(pdf["signal_id"], pdf["dim"], strict=True)], index=pdf.index)
        yield pdf.assign(value=pdf["value"].fillna(stand_in))
