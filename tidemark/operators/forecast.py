"""From forecasts to intervals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import save
from . import blocks
from .blocks import islands, numbered, with_carry
from .quantiles import exact_quantiles
from .votes import merge_intervals

NAN = float("nan")


def _gone(y) -> Column:
    return y.isNull() | F.isnan(y)


#: A2: reducers by name. Those without nan propagate NaN, as arrays do; NULL counts as NaN.
REDUCERS = {
    "median": F.median,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "std": F.stddev_pop,
    "var": F.var_pop,
}


def reducer(name: str, y) -> Column:
    clean = F.when(~_gone(y), y)
    if name.startswith("nan") and name[3:] in REDUCERS:
        return REDUCERS[name[3:]](clean)
    if name not in REDUCERS:
        raise ValueError(f"unknown aggregation {name!r}")
    return F.when(F.max(_gone(y).cast("int")) == 1, F.lit(NAN)).otherwise(REDUCERS[name](clean))


def outliers(pred: DataFrame) -> DataFrame:
    """A1: y_hat outside 1.5 interquartile ranges of its signal becomes NaN; one NaN in a signal makes its bounds void."""
    pred = save(pred, "forecasts")
    y = F.col("y_hat").cast("double")
    void = pred.groupBy("signal_id").agg(F.max(_gone(y).cast("int")).alias("_void"))
    q = exact_quantiles(pred.filter(~_gone(y)), ["signal_id"], "y_hat", [0.25, 0.75]).join(void, "signal_id")
    iqr = F.col("_q")[1] - F.col("_q")[0]
    out = (F.col("_void") == 0) & ((y < F.col("_q")[0] - 1.5 * iqr) | (y > F.col("_q")[1] + 1.5 * iqr))
    return pred.join(q, "signal_id", "left").withColumn("y_hat", F.when(out, F.lit(NAN)).otherwise(y)).drop("_void", "_q")


def aggregate_rolling_window(pred: DataFrame, step_size: int = 1, agg: str = "median", remove_outliers: bool = False) -> DataFrame:
    """A2: (signal_id, win, sample, step, y_hat) -> (signal_id, position, y_hat), position = win * step_size + step."""
    df = outliers(pred) if remove_outliers else pred
    return df.groupBy("signal_id", (F.col("win") * step_size + F.col("step")).alias("position")).agg(reducer(agg, F.col("y_hat").cast("double")).alias("y_hat"))


def regression_errors(df: DataFrame, smooth: bool = False, smoothing_window: float = 0.01) -> DataFrame:
    """Adds error = |y - y_hat|; smoothed by an exponentially weighted mean along each signal if asked for."""
    out = df.withColumn("error", F.abs(F.col("y") - F.col("y_hat")))
    return ewma(out, smoothing_window) if smooth else out


#: Weights within a block stay above e to the minus this.
RANGE = 230.0


def ewma(df: DataFrame, share: float) -> DataFrame:
    """error as the exponentially weighted mean of the signal so far, with a span of share of its rows.

    The mean is a quotient of two sums that each step of the signal maps by
    s -> keep * s + x. Blocks of rows are summed apart; a block's map is applied to what
    the blocks before it leave, which is a row each; then every row takes its block's
    carry. Blocks are short enough for weights not to vanish in them, and a carry
    reaches back over two ranges of RANGE, beyond which no weight is left. A missing
    error keeps its place, counts for nothing, and shows the mean before it.
    """
    columns = df.columns
    e = numbered(df, ["signal_id"], ["ts"], "_i", "_n", "errors")
    span = F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("_n")))
    keep = ((span - 1) / (span + 1)).cast("double")
    # with a span of 1 nothing is kept: weights that are never used stand in
    fade = F.when(span > 1, -F.log(keep)).otherwise(F.lit(RANGE))
    rows = F.least(F.lit(blocks.BLOCK), F.greatest(F.lit(1), F.floor(F.lit(RANGE) / fade)))
    e = e.withColumn("_keep", keep).withColumn("_fade", fade).withColumn("_rows", rows).withColumn("_block", F.floor(F.col("_i") / F.col("_rows"))).drop("_n")
    e = e.withColumn("_o", F.col("_i") - F.col("_block") * F.col("_rows"))
    there = ~_gone(F.col("error"))
    w = F.when(there, F.exp(F.col("_o") * F.col("_fade")))
    e = e.withColumn("_w", F.coalesce(w, F.lit(0.0))).withColumn("_x", F.coalesce(w * F.col("error"), F.lit(0.0)))

    size = F.col("_fade") * F.col("_rows")  # of a block, in powers of e
    block = e.groupBy("signal_id", "_block", "_keep", "_fade", "_rows").agg(F.sum("_x").alias("_x"), F.sum("_w").alias("_w"), F.max_by(F.when(there, F.col("error")), F.when(there, F.col("_i"))).alias("_last"))
    end = F.exp(-(F.col("_rows") - 1) * F.col("_fade"))
    block = block.withColumn("_x", F.col("_x") * end).withColumn("_w", F.col("_w") * end).withColumn("_range", F.floor(F.col("_block") * size / RANGE))
    by = Window.partitionBy("signal_id", "_range").orderBy("_block")
    block = block.withColumn("_at", (F.col("_block") - F.min("_block").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) * size)
    up = {c: F.col(c) * F.exp("_at") for c in ("_x", "_w")}
    ranges = block.groupBy("signal_id", (F.col("_range") + 1).alias("_range")).agg(*[(F.sum(v) * F.exp(-F.max("_at"))).alias(f"{c}_range") for c, v in up.items()])
    inside = by.rowsBetween(Window.unboundedPreceding, -1)
    block = block.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0.0)).alias(f"{c}_in") for c, v in up.items()], F.last("_last", True).over(Window.partitionBy("signal_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_held")).join(ranges, ["signal_id", "_range"], "left")
    # what stands just before the block: earlier blocks of its range, and the range before that
    carry = [(F.col(f"{c}_in") * F.exp(size - F.col("_at")) + F.coalesce(F.col(f"{c}_range"), F.lit(0.0)) * F.exp(-F.col("_at"))).alias(f"{c}_carry") for c in ("_x", "_w")]
    carried = block.select("signal_id", "_block", "_held", *carry)

    here = Window.partitionBy("signal_id", "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    met = e.join(carried, ["signal_id", "_block"])
    total = {c: F.sum(c).over(here) + F.col("_keep") * F.col(f"{c}_carry") for c in ("_x", "_w")}
    last = F.coalesce(F.last(F.when(there, F.col("error")), True).over(here), F.col("_held"))
    met = met.withColumn("_num", total["_x"]).withColumn("_den", total["_w"]).withColumn("_now", last)
    return met.withColumn("error", F.when((F.col("_keep") > 0) & (F.col("_den") > 0), F.col("_num") / F.col("_den")).otherwise(F.col("_now"))).select(*columns)


def _span(part: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * part)).cast("bigint")


def _windows_of(first: Column, last: Column, n: Column, portion: float, step: float) -> Column:
    """The error windows that hold any of the positions first to last; NULL if there is none."""
    size, st = _span(F.lit(portion), n), _span(F.lit(step), n)
    lo = F.greatest(F.lit(0), F.ceil((first - size + 1) / st)).cast("bigint")
    hi = F.least(F.floor(last / st), F.ceil((n - size) / st)).cast("bigint")
    return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi)))


class _Windows:
    """Errors of signals in overlapping windows of positions. Windows are met block by block: a row takes its windows' values from its block's few, so a window may be as long as it likes."""

    def __init__(self, errors: DataFrame, portion: float, step: float):
        self.portion, self.step = portion, step
        self.all = numbered(errors.select("signal_id", "ts", "error"), ["signal_id"], ["ts"], "_i", "_n", "errors").withColumn("_block", F.floor(F.col("_i") / blocks.BLOCK))
        self.rows = self.all.filter(~_gone(F.col("error")))
        edges = self.all.groupBy("signal_id", "_block").agg(F.min("_i").alias("_a"), F.max("_i").alias("_b"), F.first("_n").alias("_n"))
        self.met = edges.withColumn("_win", F.explode(_windows_of(F.col("_a"), F.col("_b"), F.col("_n"), portion, step))).select("signal_id", "_block", "_win")

    def copied(self, rows: DataFrame) -> DataFrame:
        """A row for each window that holds it."""
        return rows.withColumn("_win", F.explode(_windows_of(F.col("_i"), F.col("_i"), F.col("_n"), self.portion, self.step)))

    def with_values(self, rows: DataFrame, values: DataFrame) -> DataFrame:
        """Rows once for each window that holds them, with what values (signal_id, _win, ...) says of it."""
        met = rows.join(self.met.join(values, ["signal_id", "_win"]), ["signal_id", "_block"])
        begin = F.col("_win") * _span(F.lit(self.step), F.col("_n"))
        return met.filter((F.col("_i") >= begin) & (F.col("_i") < begin + _span(F.lit(self.portion), F.col("_n"))))

    def stats(self) -> DataFrame:
        return self.copied(self.rows).groupBy("signal_id", "_win").agg(F.avg("error").alias("_mean"), F.stddev_pop("error").alias("_std"))

    def with_previous(self) -> DataFrame:
        """Rows with position and error of the row before them that isn't missing."""
        here = Window.partitionBy("signal_id", "_block").orderBy("_i")
        place = F.struct("_i", "error")
        last = self.rows.groupBy("signal_id", "_block").agg(F.max(place).alias("_last"))
        return with_carry(self.rows, ["signal_id"], last, {"_prev": F.max("_last")}).withColumn("_prev", F.coalesce(F.lag(place).over(here), "_prev"))


def best_thresholds(w: _Windows, stats: DataFrame, zs: list[float]) -> DataFrame:
    """signal_id, _win, _mean, _std, _thr, _below: the threshold mean + z deviations with the best gain, and the largest error that it doesn't flag.

    A row's level is the number of thresholds it exceeds. Counts, sums and squares by
    level, summed from the lowest, give mean and deviation of what each threshold
    leaves; the runs it flags are the rows above it less those that follow one above
    it. So rows are read once, whatever the number of thresholds. Gains are compared
    to twelve digits, the higher threshold first.
    """
    rows = w.with_values(w.with_previous(), stats)
    exceeds = lambda v: sum(((v > F.col("_mean") + F.lit(z) * F.col("_std")).cast("int") for z in zs), F.lit(0))
    begin = F.col("_win") * _span(F.lit(w.step), F.col("_n"))
    d = F.col("error") - F.col("_mean")
    rows = rows.withColumn("_level", exceeds(F.col("error"))).withColumn("_both", F.when(F.col("_prev._i") >= begin, F.least("_level", exceeds(F.col("_prev.error")))))
    own = rows.groupBy("signal_id", "_win", "_level").agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q"), F.max("error").alias("top"), F.lit(0).cast("bigint").alias("p"))
    pairs = rows.filter("_both IS NOT NULL").groupBy("signal_id", "_win", F.col("_both").alias("_level")).agg(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(None).cast("double").alias("top"), F.count(F.lit(1)).alias("p"))
    every = stats.select("signal_id", "_win", F.explode(F.sequence(F.lit(0), F.lit(len(zs)))).alias("_level"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(None).cast("double").alias("top"), F.lit(0).cast("bigint").alias("p"))
    cells = own.unionByName(pairs).unionByName(every).groupBy("signal_id", "_win", "_level").agg(*[F.sum(c).alias(c) for c in "nsqp"], F.max("top").alias("top"))
    upto, per = Window.partitionBy("signal_id", "_win").orderBy("_level"), Window.partitionBy("signal_id", "_win")
    cells = cells.select("signal_id", "_win", "_level", *[F.sum(c).over(upto).alias(c) for c in "nsqp"], F.max("top").over(upto).alias("_below"), *[F.sum(c).over(per).alias(f"{c}_all") for c in "np"])
    at = cells.join(stats, ["signal_id", "_win"]).filter(F.col("_level") < len(zs))
    above = F.col("n_all") - F.col("n")
    runs = above - (F.col("p_all") - F.col("p"))
    left = F.col("s") / F.col("n")
    deviation = F.sqrt(F.greatest(F.col("q") / F.col("n") - left * left, F.lit(0.0)))
    gain = (-left / F.col("_mean") + (F.col("_std") - deviation) / F.col("_std")) / (above + runs * runs)
    usable = (above > 0) & (F.col("n") > 0) & (F.col("_mean") != 0) & (F.col("_std") > 0)
    thr = F.col("_mean") + F.element_at(F.array(*map(F.lit, zs)), F.col("_level") + 1) * F.col("_std")
    order = F.struct(F.coalesce(F.round(F.when(usable, gain), 12), F.lit(float("-inf"))).alias("gain"), F.col("_level"))
    return at.withColumn("_thr", thr).groupBy("signal_id", "_win", "_mean", "_std").agg(F.max_by(F.struct("_thr", "_below"), order).alias("x")).select("signal_id", "_win", "_mean", "_std", "x._thr", "x._below")


def find_anomalies(errors: DataFrame, window_size_portion: float = 0.33, window_step_size_portion: float = 0.1, fixed_threshold: bool = True, anomaly_padding: int = 50, k: float = 4.0, z_range: tuple[float, float, float] = (2.0, 10.0, 0.5), min_percent: float = 0.1) -> DataFrame:
    """(signal_id, ts, error) -> (signal_id, start, end, severity) in ts.

    A missing error (NaN, NULL) keeps its position but counts for nothing.
    fixed: an error over mean + k deviations of its window. Else the threshold with
    the best gain in mean and deviation for what it flags, and runs pruned by the
    drop of their peaks (ties by position). A window without deviation flags nothing.
    """
    w = _Windows(errors, window_size_portion, window_step_size_portion)
    stats = save(w.stats(), "windows")
    if fixed_threshold:
        chosen = stats.withColumn("_thr", F.col("_mean") + F.lit(k) * F.col("_std")).withColumn("_below", F.lit(None).cast("double"))
    else:
        # a constant window has a deviation of rounding errors only
        stats = stats.filter(F.col("_std") > 1e-9 * F.abs(F.col("_mean")))
        lo, hi, by = z_range
        chosen = save(best_thresholds(w, stats, [float(z) for z in np.arange(lo, hi, by)]), "thresholds")
    clear = F.col("error") - F.col("_mean") > 1e-9 * F.abs(F.col("_mean"))
    flagged = w.with_values(w.rows, chosen).filter((F.col("error") > F.col("_thr")) & clear)
    # two flagged rows are one run if their paddings touch
    flagged = save(flagged.withColumn("_to", F.col("_i") + 2 * anomaly_padding + 1), "flagged")
    key = ["signal_id", "_win"]
    runs = islands(flagged, key, "_i", "_to").groupBy(*key, "_island").agg(F.min("_i").alias("_a"), F.max("_i").alias("_b"), F.max("error").alias("_peak"), *[F.first(c).alias(c) for c in ("_thr", "_mean", "_std", "_below", "_n")])
    if not fixed_threshold:
        order = Window.partitionBy(*key).orderBy(F.desc("_peak"), "_a")
        lower = F.coalesce(F.lead("_peak").over(order), "_below", F.lit(0.0))
        runs = runs.withColumn("_rank", F.row_number().over(order)).withColumn("_drop", (F.col("_peak") - lower) / F.greatest("_peak", F.lit(1e-12)) > min_percent)
        runs = runs.withColumn("_upto", F.max(F.when(F.col("_drop"), F.col("_rank"))).over(Window.partitionBy(*key))).filter("_rank <= _upto")
    seq = runs.select("signal_id", F.greatest(F.col("_a") - anomaly_padding, F.lit(0)).cast("bigint").alias("start"), F.least(F.col("_b") + anomaly_padding, F.col("_n") - 1).cast("bigint").alias("end"), ((F.col("_peak") - F.col("_thr")) / (F.col("_mean") + F.col("_std"))).alias("severity"))
    merged = merge_intervals(seq, "severity")
    at = w.all.select("signal_id", "_i", "ts")
    begin, stop = at.select("signal_id", F.col("_i").alias("start"), F.col("ts").alias("_from")), at.select("signal_id", F.col("_i").alias("end"), F.col("ts").alias("_to"))
    return merged.join(begin, ["signal_id", "start"]).join(stop, ["signal_id", "end"]).select("signal_id", F.col("_from").alias("start"), F.col("_to").alias("end"), "severity")


def multistep_errors(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Median over samples without NaN and NULL, then round(y_hat - y, 7), for each window and step."""
    y_hat = pred.groupBy("signal_id", "win", "step").agg(reducer("nanmedian", F.col("y_hat").cast("double")).alias("y_hat"))
    return y_hat.join(truth, ["signal_id", "win", "step"]).withColumn("error", F.round(F.col("y_hat") - F.col("y"), 7))
