"""The opN queries: each operator over its whole table, reduced to the digest columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, divergence, langid, mixing, packing, privacy, quality, shards, simhash, spans, tokens, winnow, wrappers
from .common import documents, new_path


def op1_pii(spark: SparkSession, d: str) -> DataFrame:
    return privacy.find_spans(documents(spark, d)).drop("_key", "terms")


def op2_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    return quality.judge(docs, model).drop("text")


def op3_language(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)))
    return langid.predict(docs, langid.learn(docs.filter("NOT held_out")), ("doc_id", "held_out"))


def op4_simhash(spark: SparkSession, d: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, d), size=4, bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_winnowing(spark: SparkSession, d: str) -> DataFrame:
    out = winnow.compare_with_next(documents(spark, d))
    return out.select("doc_id", "n_chars", "edited_sha256", winnow.digest(F.col("fp"), F.col("fp_at")).alias("fingerprint"), winnow.digest(F.col("edited_fp"), F.col("edited_fp_at")).alias("edited_fingerprint"), "near_edited", "near_next")


def op6_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(documents(spark, d).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(documents(spark, d))


def op8_token_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokens.write_ids(documents(spark, d), path)
    return tokens.decoded(spark, path)


#: Arrivals into which the table is dealt by hash of doc_id.
ARRIVALS = 8


def op9_sharding(spark: SparkSession, d: str) -> DataFrame:
    docs, store = documents(spark, d), shards.ShardStore(spark, new_path(spark, "shards"))
    for k in range(ARRIVALS):
        store.append(docs.filter(F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(ARRIVALS)) == k))
        store.compact()
        store.vacuum()
    if not store.manifest()[1]:
        return docs.select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_substrings(spark: SparkSession, d: str) -> DataFrame:
    return spans.remove_repeats(documents(spark, d))


def op11_divergence(spark: SparkSession, d: str) -> DataFrame:
    return divergence.divergence(documents(spark, d))


def op12_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(documents(spark, d))


def op13_html(spark: SparkSession, d: str) -> DataFrame:
    return wrappers.main_text(spark.read.parquet(f"{d}/pages.parquet"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality, op3_language, op4_simhash, op5_winnowing, op6_mixing, op7_packing, op8_token_file, op9_sharding, op10_substrings, op11_divergence, op12_collocations, op13_html)}
SQL = {"op9_sharding": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents", "op11_divergence": divergence.SQL, "op12_collocations": collocations.SQL}
