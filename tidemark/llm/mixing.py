"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Inside, a row's own columns travel as one struct (row), so no name of theirs can clash
with those that are added on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_saved, save, text_key

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of code point, repeating; the share of all sizes that is asked for; how often a document is used at most.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
SEED = 7
#: Slices of a source's key range at each of two levels: by the key's logarithm, then evenly.
SLICES = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1: the share of characters that aren't symbols of markup or code, to the fourth power."""
    clean = F.try_divide(F.length(F.translate(text, "#*$%&|<>{}", "")), F.length(text))
    return F.greatest(F.lit(0.05), F.coalesce(F.pow(clean, 4), F.lit(1.0)))


def exponential_key(weight: Column, *identity, seed: int = SEED) -> Column:
    """-ln(u) / weight, u from a hash of the row: the same at every run. Ascending keys are a weighted draw without replacement."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identity), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def ranked(names: DataFrame) -> DataFrame:
    """Adds place: the position of a source by code point, null last, from 0. Ranges are numbered by themselves and begin where the one before ends, so no task holds all sources."""
    apart = save(names.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "ranges")
    # a row for each range of a shuffle
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = apart.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", before.alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1
    return apart.withColumn("place", inside).join(starts, "_range").withColumn("place", (F.col("place") + F.col("_start")).cast("long")).drop("_range", "_start")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> with target. Sources rise to the same level of target per weight until each stops at most times its size.

    The level is raised, a pass over the sources at a time, until no more of them stop:
    at each step the sources that have stopped give their sizes, the others share what
    is left by weight. Two numbers come to the driver at each pass.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = save(ranked(sizes).withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(most)).drop("place"), "sources")  # a row for each source
    total, weight, zero = s.agg(F.sum("source_size"), F.sum("_w"), F.sum(F.when(F.col("_cap") <= 0, F.col("_w")))).first()
    asked = float(total or 0) * share
    level = asked / (weight - (zero or 0.0)) if total else 0.0
    while total:
        stopped = F.col("_cap") <= F.col("_w") * level
        caps, open_ = s.agg(F.sum(F.when(stopped, F.col("_cap"))), F.sum(F.when(~stopped, F.col("_w")))).first()
        if not open_ or (asked - (caps or 0.0)) / open_ <= level:
            break
        level = (asked - (caps or 0.0)) / open_
    return s.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * level).alias("target"))


def _boundary(rows: DataFrame) -> DataFrame:
    """The rows that lie in the slice (_slice) in which their source's budget ends, with _base, the sizes before it, and its least and greatest key."""
    run = Window.partitionBy("_s").orderBy("_slice")
    sums = rows.groupBy("_s", "_slice", "_budget", "_base").agg(F.sum("_size").alias("_sum"), F.min("_key").alias("_low"), F.max("_key").alias("_high"))
    ends = sums.withColumn("_upto", F.sum("_sum").over(run) + F.col("_base")).withColumn("_from", F.col("_upto") - F.col("_sum")).filter((F.col("_from") < F.col("_budget")) & (F.col("_upto") >= F.col("_budget")))
    ends = ends.select(F.col("_s").alias("_e"), F.col("_slice").alias("_end"), F.col("_from").alias("_before"), "_low", "_high")
    return rows.join(ends, F.col("_s").eqNullSafe(F.col("_e")) & (F.col("_slice") == F.col("_end"))).drop("_e", "_end", "_base", "_slice").withColumnRenamed("_before", "_base")


def cutoffs(rows: DataFrame, plan: DataFrame, slices: int = SLICES) -> DataFrame:
    """For each source: epochs, and the document at which its fractional selection ends (_ckey, _cid, _ctext) with the words taken of each row like it (_part).

    Keys are cut into slices by their logarithm; of the slice in which the budget ends
    only, keys are cut again, evenly between its least and greatest; only the one of
    those in which it ends is put in order: a share of the source's rows of a
    hundred-thousandth or so, whatever the weights. Sums by slice are all that is
    shuffled of the others. Equal rows stand for one document.
    """
    known = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    known = save(known.withColumn("_budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "budgets")
    budgets = known.filter("_budget > 0").select(F.col("source").alias("_s"), "_budget")
    # 64 octaves from 2^-55 on, what lies beyond in the first and last slice
    by_log = F.least(F.greatest(F.floor((F.log2("_key") + 55) * (slices / 64)), F.lit(0)), F.lit(slices - 1)).cast("long")
    first = rows.join(budgets, F.col("source").eqNullSafe(F.col("_s"))).drop("source").withColumn("_base", F.lit(0).cast("long")).withColumn("_slice", by_log)
    inner = save(_boundary(first), "slice")
    even = F.floor(F.try_divide(F.col("_key") - F.col("_low"), F.col("_high") - F.col("_low")) * slices)
    last = _boundary(inner.withColumn("_slice", F.least(F.coalesce(even, F.lit(0)), F.lit(slices - 1)).cast("long")).drop("_low", "_high"))
    units = last.groupBy("_s", "_key", "_id", "_text", "_base", "_budget").agg(F.sum("_size").alias("_size"), F.count(F.lit(1)).alias("_copies"))
    w = Window.partitionBy("_s").orderBy("_key", "_id", "_text")
    at = units.withColumn("_upto", F.col("_base") + F.sum("_size").over(w)).withColumn("_from", F.col("_upto") - F.col("_size")).filter((F.col("_from") < F.col("_budget")) & (F.col("_upto") >= F.col("_budget")))
    at = at.select(F.col("_s").alias("_a"), F.col("_key").alias("_ckey"), F.col("_id").alias("_cid"), F.col("_text").alias("_ctext"), F.floor((F.col("_budget") - F.col("_from")) / F.col("_copies")).cast("long").alias("_part"))
    out = save(known.join(at, F.col("source").eqNullSafe(F.col("_a")), "left").select(F.col("source").alias("_source"), "source_size", "target", "epochs", "_ckey", "_cid", "_ctext", "_part"), "cutoffs")
    drop_saved(known, inner)
    return out


ADDED = ("size", "source_size", "target", "taken", "epochs")


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row (a struct of the columns), source, _key, _id, _text, _size."""
    text = F.col("row.text")
    met = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")).select("row", F.col("row.source").alias("source"), F.col("row.doc_id").alias("_id"), text_key("row.text").alias("_text"), size_of(text).alias("_size"), quality_weight(text).alias("_weight"))
    return met.withColumn("_key", exponential_key(F.col("_weight"), "_id", "_text")).drop("_weight")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = EPOCHS, slices: int = SLICES) -> DataFrame:
    """docs (all columns) with size, source_size, target, taken and epochs added: complete epochs of a source first, then its documents in key order until the target is met.

    The document at the boundary counts for the words that are still missing. A null
    text has size 0 and a null source is a source, the last. Only sizes and keys are
    shuffled; the texts are read again for the result and meet one row per source.
    Columns of docs that are called as the added ones are replaced; any other name is kept as it is.
    """
    rows = save(_sized(docs, ["doc_id", "source", "text"]).drop("row"), "sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, most)
    cuts = cutoffs(rows, plan, slices)
    drop_saved(rows)
    kept = [c for c in docs.columns if c not in ADDED]
    met = _sized(docs, kept).join(cuts, F.col("source").eqNullSafe(F.col("_source")))
    here, there = F.struct("_key", "_id", "_text"), F.struct("_ckey", "_cid", "_ctext")
    part = F.when(F.col("_ckey").isNull(), F.lit(0)).when(here < there, F.col("_size")).when(here == there, F.least("_part", "_size")).otherwise(F.lit(0))
    taken = (F.col("epochs") * F.col("_size") + part).cast("long")
    return met.select("row.*", F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), "epochs")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as it is taken, whole; the one at a boundary is taken if half of it or more is."""
    columns = docs.columns
    m = mix(docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole")), **params)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.col("epochs")).cast("int")
    return m.select("whole", F.explode(F.when(times > 0, F.array_repeat(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select("whole.*")
