"""Signals in and results out. A signal table is (signal_id, ts, dim, value); ts is in epoch seconds."""

from __future__ import annotations

import ast
import json
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import numbered

CSV_SCHEMA = "timestamp BIGINT, value DOUBLE"
CANONICAL = ["timestamp", "value"]


def read_csv_signal(spark: SparkSession, path: str, schema: str = CSV_SCHEMA) -> DataFrame:
    """One CSV with a header, read with a fixed schema (no inference pass)."""
    return spark.read.schema(schema).csv(path, header=True)


def canonicalise(df: DataFrame, timestamp_column=None, value_column=None) -> DataFrame:
    """Pick columns by name or position and call them timestamp and value."""
    at = lambda c, default: df.columns[c] if isinstance(c, int) else c or default
    if timestamp_column is None and value_column is None and set(CANONICAL) <= set(df.columns):
        return df.select(*CANONICAL)
    return df.select(F.col(at(timestamp_column, df.columns[0])).alias("timestamp"), F.col(at(value_column, df.columns[-1])).alias("value"))


def index_rows(df: DataFrame, order: str = "timestamp", keys: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Dense row positions from 0, by key, and its number of rows if asked for. Without keys the frame is one signal. In two passes, so a signal may have any length."""
    return numbered(df, keys or [], [order], "idx", total, "positions")


def slice_positional(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows start..end-1."""
    return df.filter((F.col("idx") >= start) & (F.col("idx") < end))


def slice_timestamp(df: DataFrame, start=None, end=None, column: str = "timestamp") -> DataFrame:
    """Both ends belong; an end that is None is open (0 is an end like any other)."""
    for bound, keep in ((start, lambda c: c >= F.lit(start)), (end, lambda c: c <= F.lit(end))):
        if bound is not None:
            df = df.filter(keep(F.col(column)))
    return df


class SignalStore:
    """Named normal signals under roots that any Hadoop file system serves; the first hit wins.

    What is found under a later root is copied to the first, the cache, if there is
    one to write to (cache=True), and comes from there the next time. A file system
    that isn't installed counts as a miss; any other failure (no permission, no
    answer) is an error.
    """

    def __init__(self, spark: SparkSession, *roots: str, cache: bool = False):
        self.spark, self.roots, self.cache = spark, roots, cache

    def resolve(self, name: str) -> str:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        tries = [(None, name)] if "/" in name else [(r, f"{r.rstrip('/')}/{name}{tail}.csv") for r in self.roots for tail in ("_normal", "")]
        for root, path in tries:
            p = jvm.org.apache.hadoop.fs.Path(path)
            try:
                fs = p.getFileSystem(conf)
            except Py4JJavaError as e:
                if "UnsupportedFileSystem" in str(e.java_exception) or "No FileSystem for scheme" in str(e.java_exception):
                    continue
                raise
            if fs.exists(p):
                if not self.cache or root in (None, self.roots[0]):
                    return path
                kept = jvm.org.apache.hadoop.fs.Path(f"{self.roots[0].rstrip('/')}/{p.getName()}")
                jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, kept.getFileSystem(conf), kept, False, conf)
                return kept.toString()
        raise FileNotFoundError(f"no signal {name!r} under {self.roots or 'any root'}")

    def load(self, name: str, timestamp_column=None, value_column=None, start=None, end=None) -> DataFrame:
        """S3: read, canonicalise, slice: by position if both ends are positions of the frame, else by timestamp."""
        path = self.resolve(name)
        df = canonicalise(self.spark.read.csv(path, header=True, inferSchema=True) if timestamp_column or value_column else read_csv_signal(self.spark, path), timestamp_column, value_column)
        return load_slice(df, start, end)


def load_slice(df: DataFrame, start=None, end=None) -> DataFrame:
    if start is None and end is None:
        return df
    if all(x is None or isinstance(x, int) for x in (start, end)):
        n = df.count()
        if all(x is None or 0 <= x < n for x in (start, end)):
            return slice_positional(index_rows(df), start or 0, n if end is None else end).drop("idx")
    return slice_timestamp(df, start, end)


def train_test_split(df: DataFrame, fraction: float = 0.3, keys: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """Adds split: the last fraction of each signal's rows by time is test."""
    return index_rows(df, "ts", list(keys), "_n").withColumn("split", F.when(F.col("idx") < F.floor(F.col("_n") * (1 - fraction)), "train").otherwise("test")).drop("_n")


def load_anomalies(spark: SparkSession, path: str) -> DataFrame:
    """Known intervals (signal_id, start, end)."""
    return spark.read.parquet(path).select("signal_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def read_catalog(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """A small dataset,signals CSV with list literals, read when asked for."""
    return {r["dataset"]: list(ast.literal_eval(r["signals"])) for r in spark.read.csv(path, header=True, escape='"').select("dataset", "signals").toLocalIterator()}


def read_templates(path: str) -> dict:
    """Prompt texts kept as JSON beside the caller's configuration."""
    return json.loads(Path(path).read_text())


def synthetic_multivariate(spark: SparkSession, n: int = 25, start: int = 1_577_836_800) -> DataFrame:
    """An hourly signal of three dimensions: a rising ramp, a 0/1 alternation and a falling ramp."""
    i = F.col("id")
    return spark.range(n).select((F.lit(start) + i * 3600).alias("timestamp"), ((10 + i) / 100.0).alias("x1"), (i % 2).cast("double").alias("x2"), ((n + 40 - i) / 100.0).alias("x3"))


def melt(df: DataFrame, signal_id: str, timestamp: str = "timestamp") -> DataFrame:
    """Wide columns to (signal_id, ts, dim, value), dims in column order."""
    names = [c for c in df.columns if c != timestamp]
    pairs = F.array(*[F.struct(F.lit(k).alias("dim"), F.col(c).cast("double").alias("value")) for k, c in enumerate(names)])
    return df.select(F.lit(signal_id).alias("signal_id"), F.col(timestamp).alias("ts"), F.explode(pairs).alias("p")).select("signal_id", "ts", "p.dim", "p.value")


EPOCH = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as signals: one for each event type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("signal_id"), F.expr(EPOCH.format("ts")).alias("ts"), F.lit(0).alias("dim"), "value")


def event_multivariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal, one dimension for each event type in order of name."""
    types = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.sort_array(F.collect_set("event_type")).alias("types"))
    dims = types.select(F.posexplode("types").alias("dim", "event_type"))
    # the id hangs on a column: joins on a literal would fold to cross joins
    name = F.concat(F.lit("all"), F.substring("signal_id", 1, 0)).alias("signal_id")
    return event_signals(spark, sf_dir).drop("dim").join(dims.withColumnRenamed("event_type", "signal_id"), "signal_id").select(name, "ts", "dim", "value")


def write_scores(df: DataFrame, path: str) -> None:
    """K1: score rows, partitioned by what a resumed run looks up."""
    df.write.mode("append").partitionBy("pipeline", "dataset").parquet(path)


def write_anomalies(df: DataFrame, path: str) -> None:
    """K2: intervals, a folder for each signal."""
    df.write.mode("overwrite").partitionBy("signal_id").csv(path, header=True)


def write_leaderboard(df: DataFrame, path: str) -> None:
    """K3: one small CSV (a row for each pipeline)."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
