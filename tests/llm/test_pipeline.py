"""Stages of the pipeline one after another, each against a plain version on its own input."""

from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F
from test_operators import WORD, plain_disclosing, plain_groups, plain_quality, plain_spans, plain_taken, plain_targets, re

from tidemark.llm import common, mixing, privacy, quality, tokens

D = "/root/testdata/sf0.001"


def plain_probability(model, text):
    """By definition: the mean weight of each family's buckets, then Platt's sigmoid."""
    ws = re.findall(WORD, text)
    h = [quality.zlib.crc32(w.encode()) for w in ws]
    bucket = lambda x: (x * 0x9E3779B97F4A7C15 % 2**64) >> (64 - quality.BITS)
    mult = [int(m) for m in quality.MULT]
    grams = [sum(ord(c) * m for c, m in zip(text[i : i + quality.CHARS], mult)) % 2**64 for i in range(len(text) - quality.CHARS + 1)]
    families = [h, [(a * 31 + b) % 2**64 for a, b in zip(h, h[1:])], grams]
    z = model.bias + sum(np.mean([float(model.weights[bucket(x) + (k << quality.BITS)]) for x in f]) for k, f in enumerate(families) if f)
    return 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -30, 30)))


def plain_sanitised(texts):
    """Every text with its entities and the words that are disclosing terms in the whole corpus put out."""
    found = plain_disclosing([t for t in texts if t])
    best = {}
    for (term, kind, value), likely in found.items():
        best.setdefault(term, []).append((likely, kind, value != 0))
    shown = {t: "" if max(x)[0] >= 0.9 else f"[{max(x)[1].upper()} TERM]" if all(v for *_, v in x) else "[TERM]" for t, x in best.items()}
    out = []
    for t in texts:
        spans = privacy.entity_spans(t)
        assert [s for s in spans if s[0] != "secret"] == plain_spans(t)
        marks, at, parts = [(a, privacy.ORDER.index(k), b, f"[{k.upper()}]") for k, a, b in spans], 0, []
        lo = 0
        for a, b in [*((a, b) for _, a, b in spans), (len(t), len(t))]:
            if a > lo:
                for m in re.finditer(WORD, t[lo:a]):
                    term = privacy.norm(m[0])
                    if term in shown:
                        s = lo + m.start() + m[0].lower().find(term)
                        marks.append((s, 9, s + len(term), shown[term]))
            lo = max(lo, b)
        for a, _, b, x in sorted(marks):
            if a >= at:
                parts += [t[at:a], x]
            at = max(at, b)
        out.append("".join([*parts, t[at:]]))
    return out


@pytest.fixture(scope="module")
def seen(spark):
    """name -> (rows before, rows after)"""
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, D)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == columns
        before, docs = docs.collect(), common.save(df, name)
        out[name] = before, docs.collect()
    return out


def test_quality_rules(spark, seen):
    before, after = seen["quality_rules"]
    model = quality.fit(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"))
    want = {r.doc_id for r in before if r.text and not plain_quality(r.text)[-1] and plain_probability(model, r.text) >= quality.KEEP}
    assert {r.doc_id for r in after} == want and 0.6 * len(before) < len(after) < len(before)


def test_near_dedup(seen):
    before, after = seen["simhash_near_dedup"]
    rows = sorted(before, key=lambda r: r.doc_id)
    assert {r.doc_id for r in after} == {rows[i].doc_id for i in plain_groups([r.text for r in rows])} and len(after) < len(before)
    assert set(after) <= set(before)


def test_pii(seen):
    before, after = ({r.doc_id: r for r in rows} for rows in seen["pii"])
    ids = sorted(before)
    want = plain_sanitised([before[i].text for i in ids])
    assert [after[i].text for i in ids] == want and all(after[i].n_chars == len(after[i].text) for i in ids if after[i].text != before[i].text)
    assert any("[SECRET]" in t for t in want) or not any("token = " in before[i].text for i in ids)


def test_mix_sources(spark, seen):
    before, after = seen["mix_sources"]
    key = mixing.exponential_key(mixing.quality_weight(F.col("text")), "doc_id", mixing.text_key())
    rows = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long").select("*", key.alias("key"), mixing.text_key().alias("t"), mixing.size_of(F.col("text")).alias("size")).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    targets, times = plain_targets(sizes), Counter()
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        taken = plain_taken(mine, targets[s])
        for r in mine:
            if n := round(taken[(r.key, r.doc_id is not None, r.doc_id, r.t)] / r["size"]):
                times[r.doc_id] = n
    assert Counter(r.doc_id for r in after) == times


def plain_pieces(rows, vocabulary):
    """(doc_id, piece, start, length, crc) by the library itself."""
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(vocabulary), []
    for r in rows:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        lo = 0
        for k, hi in enumerate(range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)):
            out.append((r.doc_id, k, lo, hi - lo, quality.zlib.crc32(ids[lo:hi].tobytes())))
            lo = hi
    return sorted(out)


def test_best_fit_packing(seen):
    before, after = seen["best_fit_packing"]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == plain_pieces(before, tokens.default_vocabulary())
    by = {}
    for r in after:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = [0]
        for a, n in sorted(places):
            assert a == ends[-1]
            ends.append(a + n)
        assert ends[-1] <= 2048 and len(places) <= corpus_pipeline.PIECES
    assert len(by) <= -(-sum(r.length for r in after) // 2048) + 2


def test_run(spark, seen):
    mark = common.saved_count()
    got = Counter(map(tuple, corpus_pipeline.run(spark, D).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert got == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in seen["best_fit_packing"][1])
    # the mix and its pieces are all that still stands
    assert common.saved_count() <= mark + 2
    common.release(mark)
    assert common.saved_count() == mark


def test_without_rows(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        assert out.count() == 0


def test_columns_of_any_name_keep_their_values(spark, tmp_path):
    """Names that stages use themselves, differ from them by case only, or need quoting."""
    names = {"kept": "cast(doc_id % 7 as boolean)", "N_Words": "concat('w', doc_id)", "a.b": "doc_id * 2", "row": "array(doc_id)", "terms": "named_struct('x.y', doc_id)", "Text ": "upper(source)", "_key": "-doc_id", "taken": "null"}
    docs = spark.read.parquet(f"{D}/documents.parquet")
    docs.select("*", *(F.expr(e).cast("string" if e == "null" else docs.selectExpr(e).schema[0].dataType).alias(n) for n, e in names.items())).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{D}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    own = {r.doc_id: tuple(r)[5:] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        had = docs.columns
        docs = common.save(stage(spark, docs, str(tmp_path)), "named")
        assert docs.columns == had
        rows = docs.collect()
        assert rows and all(tuple(r)[5:] == own[r.doc_id] for r in rows)
    plain = corpus_pipeline.run(spark, D).select("doc_id", "piece", "start", "length").collect()
    assert Counter(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length").collect()) == Counter(plain)
