"""What the operators share: saved tables in the cluster's shared folder, row keys, Arrow batches, words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import drop_saved, new_path, release, remove, save, saved_count, shared_dir

__all__ = ["MOST_BITS", "WORD", "batch", "documents", "drop_saved", "lower_ascii", "map_arrow", "map_bits", "may_hold", "new_path", "pieces", "release", "remove", "save", "saved_count", "shared_dir", "text_key", "words"]

#: Words of the contracts: runs of anything but a blank and the five ASCII controls of white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


#: Bits of the map that keys are looked up in: so many a key, up to a bound (its words are broadcast: 64 bits and their place each).
KEY_BITS, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 26


def map_bits(keys: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * keys - 1).bit_length())) if keys else LEAST_BITS


def may_hold(df: DataFrame, key: Column, some: DataFrame, name: str, bits: int | None = None) -> DataFrame:
    """df with name added: false for rows whose key (a long) is certainly not in some (one long column).

    The keys set bits of a map by hash: one in 32 to 64 is a false hit, up to 2 million
    keys; of more keys the map of MOST_BITS holds back fewer rows. Its words, bits / 64
    at most, are broadcast, so wide rows needn't be shuffled to learn that they meet
    nothing. The map is saved.
    """
    (k,) = some.columns
    if bits is None:
        some = save(some, "keys")
        bits = map_bits(some.count())
    at = F.pmod(F.xxhash64(F.col(f"`{k}`")), F.lit(bits))
    words_ = save(some.select(at.alias("b")).groupBy(F.floor(F.col("b") / 64).alias(f"{name}_w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 AS int)))").alias(f"{name}_m")), "map")
    pos = F.pmod(F.xxhash64(key), F.lit(bits))
    met = df.join(F.broadcast(words_), F.floor(pos / 64) == F.col(f"{name}_w"), "left")
    return met.withColumn(name, F.coalesce(F.col(f"{name}_m").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (pos % 64).cast("int"))) != 0, F.lit(False))).drop(f"{name}_w", f"{name}_m")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: str = "text") -> Column:
    """With doc_id, what tells a row's text apart without carrying it."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    return df.mapInArrow(f, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def pieces(b: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that what Python holds beside Arrow stays small."""
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def words(text: str) -> list[str]:
    return WORD_RE.findall(text)


def lower_ascii(text: str) -> str:
    """A-Z only."""
    return text.lower() if text.isascii() else text.encode().lower().decode()
