"""Ordered work on signals of any length: no task holds more than a block of one.

Rows get their positions in two passes (counts by range, then offsets). Running maxima
and islands are found within blocks, and what the blocks before have left is carried in:
one row a block, so the carries are small even where a signal is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import save

#: Rows of a block.
BLOCK = 65_536


def quoted(names) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def same(left: str, right: str, names) -> Column:
    """Equality on columns of two frames by alias; NULL is a key like any other."""
    out = F.lit(True)
    for c in names:
        out = out & F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`"))
    return out


def numbered(df: DataFrame, keys: list[str], order: list[str], pos: str = "_i", total: str | None = None, name: str = "numbered") -> DataFrame:
    """df with each row's position in its key, from 0, and the key's rows if asked for.

    Rows are range-partitioned by key and order, sorted and written; a partition's rows
    of a key are a run, so a position is the run's offset plus the place in it. Only a
    row for each run meets in a window. Rows that tie are numbered as they were written.
    """
    laid = df.repartitionByRange(*quoted([*keys, *order])).sortWithinPartitions(*quoted([*keys, *order])).withColumn("_at", F.monotonically_increasing_id())
    laid = save(laid, name).withColumn("_part", F.shiftright("_at", 33))
    runs = laid.groupBy(*quoted(keys), "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    of = Window.partitionBy(*quoted(keys))
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first"))
    if total:
        runs = runs.withColumn(total, F.sum("_rows").over(of))
    met = laid.alias("a").join(runs.alias("b"), same("a", "b", [*keys, "_part"]))
    out = [F.col(f"a.`{c}`").alias(c) for c in df.columns] + [(F.col("a._at") + F.col("b._before")).alias(pos)]
    return met.select(*out, *([F.col(f"b.{total}")] if total else []))


def in_blocks(df: DataFrame, keys: list[str], at: str, rows: int | None = None) -> DataFrame:
    """df with _block, in the order of at: so many even widths of a key's range as its rows make blocks."""
    df, rows = df.drop("_block"), rows or BLOCK
    ends = df.groupBy(*quoted(keys)).agg(F.min(at).alias("_lo"), ((F.max(at) - F.min(at) + 1) / F.ceil(F.count(F.lit(1)) / rows)).alias("_width"))
    met = df.alias("a").join(ends.alias("b"), same("a", "b", keys))
    return met.select(*[F.col(f"a.`{c}`").alias(c) for c in df.columns], F.floor((F.col(f"a.`{at}`") - F.col("b._lo")) / F.col("b._width")).alias("_block"))


def with_carry(df: DataFrame, keys: list[str], block: DataFrame, carries: dict[str, Column]) -> DataFrame:
    """df, which has _block, with columns made from the rows (one a block) of the blocks before each. carries: aggregates over those, by name."""
    before = Window.partitionBy(*quoted(keys)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = block.select(*quoted(keys), "_block", *[c.over(before).alias(n) for n, c in carries.items()])
    met = df.alias("a").join(carry.alias("b"), same("a", "b", [*keys, "_block"]))
    return met.select(*[F.col(f"a.`{c}`").alias(c) for c in df.columns], *[F.col(f"b.`{n}`") for n in carries])


def running_max(df: DataFrame, keys: list[str], at: str, then: Column, value: Column, name: str) -> DataFrame:
    """df, which has _block by at, with the maximum of value over all rows of the key up to each in the order of at, then; rows that tie see each other."""
    df = df.withColumn("_v", value).withColumn("_then", then)
    block = df.groupBy(*quoted(keys), "_block").agg(F.max("_v").alias("_most"))
    here = Window.partitionBy(*quoted([*keys, "_block"])).orderBy(at, "_then")
    met = with_carry(df, keys, block, {"_carry": F.max("_most")})
    return met.withColumn(name, F.greatest("_carry", F.max("_v").over(here))).drop("_v", "_then", "_carry")


def islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """df with _island: where the island of overlapping or touching intervals begins that each row is part of."""
    df = in_blocks(df, keys, start)
    here = Window.partitionBy(*quoted([*keys, "_block"])).orderBy(start, end)
    block = df.groupBy(*quoted(keys), "_block").agg(F.max(end).alias("_most"))
    df = with_carry(df, keys, block, {"_reach": F.max("_most")})
    before = F.greatest("_reach", F.max(end).over(here.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_head", F.when(before.isNull() | (F.col(start) > before), F.col(start))).drop("_reach")
    block = df.groupBy(*quoted(keys), "_block").agg(F.max("_head").alias("_most"))
    df = with_carry(df, keys, block, {"_from": F.max("_most")})
    # rows that tie see each other, as any of them may be the head
    return df.withColumn("_island", F.greatest("_from", F.max("_head").over(here))).drop("_head", "_from", "_block")


def largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest key."""
    return df.groupBy(*quoted(keys)).count().agg(F.max("count")).first()[0] or 0
