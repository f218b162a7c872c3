"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star. Minima are combined before the shuffle, so a hub costs no more than a leaf."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    met = large.join(low, "a")
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between long ids -> (node, root): root is the least id reachable; ids without links have no row.

    Nulls link nothing. Rounds grow with the logarithm of a component's size, and go on
    until one changes nothing; each is written to the shared folder and the one before
    deleted. The result is such a saved table, which drop_saved() deletes.
    """
    cur = save(edges.filter("a <> b").select("a", "b"), "edges")
    mark, was = _mark(cur), None
    while mark[0] and mark != was:
        new = save(_stars(cur), "edges")
        was, mark = mark, _mark(new)
        drop_saved(cur)
        cur = new
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._saved = cur._saved
    return out
