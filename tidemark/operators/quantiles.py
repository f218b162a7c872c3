"""Exact quantiles by narrowing: no buffer holds a key's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import drop_saved, save
from .blocks import largest, quoted, same

#: Bins of a pass; values of a key that a buffer may hold in the end.
BINS, HELD = 1024, 100_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, _q: the quantiles of a key's values by linear interpolation, as percentile gives them; NULL and NaN must have gone.

    The values on either side of a quantile have known ranks. A pass counts the values
    of each rank's range in BINS bins and goes on with the bin that holds the rank, until
    it has HELD values at most, or only one distinct value. A pass shuffles counts.
    Where no key has more than HELD values, no pass is needed. df is read several
    times: a saved table is best.
    """
    rows = df.select(*quoted(keys), F.col(value).cast("double").alias("_v"))
    if largest(rows, keys) <= HELD:
        return rows.groupBy(*quoted(keys)).agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias("_q"))
    sizes = rows.groupBy(*quoted(keys)).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("_n") - 1) * s), F.ceil((F.col("_n") - 1) * s)) for s in shares])))
    # a range: from lo to hi, with so many values, the wanted rank among them
    state = save(sizes.select(*quoted(keys), "_n", F.explode(ranks).alias("_rank"), "_lo", "_hi").withColumn("_left", F.col("_n")).withColumn("_in", F.col("_rank")), "ranks")
    open_ = (F.col("_left") > HELD) & (F.col("_lo") < F.col("_hi"))
    within = same("a", "b", keys) & (F.col("a._v") >= F.col("b._lo")) & (F.col("a._v") <= F.col("b._hi"))
    cell = [*keys, "_rank"]
    while state.filter(open_).limit(1).count():
        # halves are divided apart, as a range may be wider than the largest double
        bin_ = F.least(F.floor((F.col("a._v") / 2 - F.col("b._lo") / 2) / (F.col("b._hi") / 2 - F.col("b._lo") / 2) * BINS), F.lit(BINS - 1))
        met = rows.alias("a").join(state.filter(open_).alias("b"), within)
        bins = met.groupBy(*[F.col(f"b.`{c}`").alias(c) for c in cell], "b._n", "b._in", bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_left"), F.min("a._v").alias("_lo"), F.max("a._v").alias("_hi"))
        before = F.coalesce(F.sum("_left").over(Window.partitionBy(*quoted(cell)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = bins.withColumn("_before", before).filter((F.col("_in") >= F.col("_before")) & (F.col("_in") < F.col("_before") + F.col("_left"))).withColumn("_in", F.col("_in") - F.col("_before"))
        had, state = state, save(state.filter(~open_).unionByName(found.select(*state.columns)), "ranks")
        drop_saved(had)
    few = rows.alias("a").join(state.filter("_lo < _hi").alias("b"), within).groupBy(*[F.col(f"b.`{c}`").alias(c) for c in cell], "b._n", "b._in").agg(F.sort_array(F.collect_list("a._v")).alias("_vs"))
    at = few.select(*quoted(cell), "_n", F.get("_vs", F.col("_in").cast("int")).alias("_v")).unionByName(state.filter("_lo = _hi").select(*quoted(cell), "_n", F.col("_lo").alias("_v")))
    by = at.groupBy(*quoted(keys)).agg(F.max("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    picks = []
    for s in shares:
        p = (F.col("_n") - 1) * s
        low, high = F.element_at("_at", F.floor(p)), F.element_at("_at", F.ceil(p))
        picks.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high))
    return by.select(*quoted(keys), F.array(*picks).alias("_q"))
