"""Substring deduplication by sliding spans of sentences.

A span is a run of three sentences or more, of any length, or of two with WORDS words
at least: two short sentences in a row recur by chance in unrelated texts. Only runs of
exactly three, and such pairs, are hashed: two texts that share a longer run share all
the runs of three in it, and these cover it, so what goes is the same as with a hash of
every run.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, drop_saved, map_arrow, may_hold, pieces, save, text_key

#: A sentence ends after . ! or ? before white space, or at a newline.
CUT = re.compile(r"(?<=[.!?])\s+|\n\s*")
#: Sentences of a run; words of a run of two.
SENTENCES, WORDS = 3, 25
B1, B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def sentences(text: str) -> list[tuple[int, int]]:
    """Character ranges of sentences without the white space between them."""
    out, at = [], 0
    for m in CUT.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


def _rolling(h: np.ndarray, base: np.uint64, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Polynomial hashes (mod 2^64) of h[i:j]: prefix sums over the inverse powers, so that equal runs agree wherever they stand."""
    n = len(h)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(inverse, n)[:n])])
    return (prefix[j] - prefix[i]) * _powers(base, n)[i]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def span_hashes(text: str, run: int = SENTENCES, least: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, first and last (exclusive) sentence of every span. Case and white space don't count."""
    none = (np.zeros(0, np.int64),) * 4
    cuts = sentences(text)
    split = [text[a:b].lower().split() for a, b in cuts]
    size = np.array([len(s) for s in split], np.int64)
    if len(cuts) < 2:
        return none
    h = np.array([xxhash.xxh3_64_intdigest(" ".join(s)) for s in split], np.uint64)
    upto = np.concatenate([[0], np.cumsum(size)])
    n = len(cuts)
    i = np.arange(n - 1)
    pairs = i[upto[2:] - upto[:-2] >= least] if run > 2 else i[:0]
    longer = np.arange(max(0, n - run + 1))
    first = np.concatenate([pairs, longer])
    last = np.concatenate([pairs + 2, longer + run])
    order = np.lexsort((last, first))
    first, last = first[order], last[order]
    one, two = (mixed(_rolling(mixed(h + s), base, first, last) + (last - first).astype(np.uint64)) for base, s in ((B1, np.uint64(1)), (B2, np.uint64(2))))
    return one.view(np.int64), (two >> np.uint64(33)).astype(np.int64), first, last


SPANS = "h1 long, h2 int, doc_id long, _key long, first int, last int, again boolean"


def repeats(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which spans, in order of their first sentence, stand earlier in the same text."""
    if not len(h1):
        return np.zeros(0, bool)
    order = np.lexsort((np.arange(len(h1)), h2, h1))
    out = np.zeros(len(h1), bool)
    out[order[1:]] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    return out


def all_spans(docs: DataFrame, run: int = SENTENCES, least: int = WORDS) -> DataFrame:
    """Every span of every text; again says that the text holds it earlier."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("doc_id", pa.int64()), ("_key", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("again", pa.bool_())])

    def rows(batches):
        for b in batches:
            for part in pieces(b):
                got = [[] for _ in range(7)]
                for d, key, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "_key", "text")), strict=True):
                    h1, h2, first, last = span_hashes(text, run, least) if text else (np.zeros(0, np.int64),) * 4
                    for col, v in zip(got, (h1, h2, pa.array([d] * len(h1), pa.int64()), np.full(len(h1), key), first, last, repeats(h1, h2)), strict=True):
                        col.append(v)
                cols = [np.concatenate(c).astype(t) for c, t in ((got[0], np.int64), (got[1], np.int32))] + [pa.concat_arrays(got[2])] + [np.concatenate(got[k]).astype(t) for k, t in ((3, np.int64), (4, np.int32), (5, np.int32), (6, bool))]
                yield batch(schema, *cols)

    return map_arrow(docs.select("doc_id", text_key().alias("_key"), "text"), rows, SPANS)


def repeated(docs: DataFrame, run: int = SENTENCES, least: int = WORDS) -> DataFrame:
    """doc_id, _key, covered: ranges of sentences that lie in a span which is not the first of its kind.

    The first is the earliest in the document with the least doc_id (null ids count
    as the greatest), then the least key of the text; rows that agree in both are one
    document. A span's count and first document are combined before the shuffle, so
    one passage in a third of all documents is a row from each task; only spans that
    repeat are joined back, and the skew join splits a hot one.
    """
    spans = save(all_spans(docs, run, least), "spans")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("_key").alias("key"))
    seen = save(spans.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("least")).filter("c > 1").select("h1", "h2", "least"), "repeated")
    later = spans.join(seen, ["h1", "h2"]).filter((place > F.col("least")) | F.col("again"))
    out = save(later.select("doc_id", "_key", "first", "last").distinct().groupBy("doc_id", "_key").agg(F.collect_list(F.struct("first", "last")).alias("covered")), "covered")
    drop_saved(spans, seen)
    return out


def without(text: str, covered: list[tuple[int, int]]) -> tuple[str, int, int]:
    """Text without the covered sentences (each goes with the white space after it), sentences, removed."""
    cuts = sentences(text)
    mark = np.zeros(len(cuts) + 1, np.int64)
    for a, b in covered:
        mark[a] += 1
        mark[b] -= 1
    gone = np.cumsum(mark[:-1]) > 0
    out, at = [], 0
    for k, (a, _) in enumerate(cuts):
        if gone[k]:
            out.append(text[at:a])
            at = cuts[k + 1][0] if k + 1 < len(cuts) else len(text)
    out.append(text[at:])
    return "".join(out), len(cuts), int(gone.sum())


def remove_repeats(docs: DataFrame, sentences: int = SENTENCES, least: int = WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed, text for every row. A null text stays null and has no sentences; rows that agree in doc_id and text count as one document. sentences: of a run, 2 at least; least: words of a run of two where runs are longer. Only texts that may lose sentences are shuffled."""
    cover = repeated(docs, sentences, least).withColumnsRenamed({"doc_id": "_d", "_key": "_k"})
    asked = may_hold(docs.select("doc_id", "text", text_key().alias("_key")), F.col("_key"), cover.select("_k"), "_may")
    met = asked.filter("_may").join(cover, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    clean = asked.filter("NOT _may").select("doc_id", "text", F.lit(None).cast("array<struct<first:int,last:int>>").alias("covered"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            for part in pieces(b):
                rows = []
                for d, text, c in zip(*(part.column(x).to_pylist() for x in ("doc_id", "text", "covered")), strict=True):
                    new, n, gone = without(text, [(s["first"], s["last"]) for s in c or ()]) if text else (text, 0, 0)
                    rows.append((d, n, gone, new))
                yield batch(schema, *zip(*rows, strict=True))

    return map_arrow(met.select("doc_id", "text", "covered").unionByName(clean), run, "doc_id long, n_sentences long, n_removed long, text string")
