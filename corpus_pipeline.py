"""documents to packed training sequences, in five stages; each returns what the next one reads.

All stages keep rows of any doc_id (null or repeated too), texts of any length and
columns of any name, with their values; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, privacy, quality, simhash
from tidemark.llm.common import drop_saved, release, save, saved_count

#: Pieces of documents in a sequence at most: so many segments the attention mask of a trainer has room for.
PIECES = 64

#: Columns of documents; what else a table has is carried along.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def carried(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with the columns of docs. Others than those of documents go through under names of their own, so that none can clash with what a stage adds, or needs quoting."""
    names = docs.columns
    inner = [n if n in OWN else f"_other{k}" for k, n in enumerate(names)]
    return stage(docs.toDF(*inner)).select(*inner).toDF(*names)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go. A null or empty text has no words and goes; repeated rows share their fate. Without labels of both classes only the base rules decide."""
    model = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return carried(docs, lambda d: quality.judge(d, model).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id, a null id counting as the greatest, ties by the text's key. Texts without words are copies of each other."""
    return carried(docs, simhash.deduplicate)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, secrets, and terms that give them away go out of the texts; n_chars follows. A null text stays null; no row goes."""
    return carried(docs, privacy.sanitise)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents, as often as its target asks for; a null source is one, the last. Documents without words come once for each complete epoch; equal rows are taken alike."""
    return carried(docs, mixing.mixed_documents)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place, no more than PIECES in a sequence; a null or empty text is its end id."""
    return packing.pack_documents(docs.select(*(c for c in OWN if c in docs.columns)), most=PIECES)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("pii", pii), ("mix_sources", mix_sources), ("best_fit_packing", pack_sequences)]

#: Min-hashes, trained weights and tokenizers have no SQL form; tests/llm holds each stage, and run(), against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again as the next one's docs; what a stage saved on the way is deleted as soon as its result stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, had = saved_count(), docs
        docs = save(stage(spark, docs, sf_dir), name)
        release(before, docs)
        drop_saved(had)
    return STAGES[-1][1](spark, docs, sf_dir)
