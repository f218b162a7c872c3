"""One long signal: what blocks and carries give is what one pass over the whole signal gives, and more than one task is at work."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import sources as S
from tidemark import tables
from tidemark.operators import blocks, evaluate, forecast, prep, quantiles, votes, windows


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)


def tasks(spark, df):
    """Tasks that hold rows of df, as planned, where small files aren't read together."""
    small = {"spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "4000"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        return df.select(F.spark_partition_id()).distinct().count()
    finally:
        for k in small:
            spark.conf.unset(k)


def series(n, seed, missing=0.0, signals=("a",)):
    r = random.Random(seed)
    return [(s, 7 * i + 3, None if r.random() < missing else float("nan") if r.random() < missing else abs(r.gauss(0, 1)) + (9 if r.random() < 0.03 else 0)) for s in signals for i in range(n)]


ERRORS = "signal_id string, ts long, error double"


def test_positions_of_one_signal(spark):
    rows = [("a", t, t % 5) for t in random.Random(1).sample(range(9_000), 3_000)] + [(None, 4, 1), (None, 2, 1), ("b", 1, 0)]
    df = spark.createDataFrame(rows, "signal_id string, ts long, `v.x` long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = blocks.numbered(df, ["signal_id"], ["ts"], "idx", "n")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {s: sorted(t for x, t, _ in rows if x == s) for s in (None, "a", "b")}
    assert sorted(((r.signal_id or "", r.idx, r.ts, r.n) for r in got.collect())) == sorted((s or "", i, t, len(ts)) for s, ts in want.items() for i, t in enumerate(ts))
    assert got.columns == ["signal_id", "ts", "v.x", "idx", "n"]
    assert tasks(spark, got.filter("signal_id = 'a'")) > 1
    assert [r.idx for r in S.index_rows(df.filter("signal_id = 'a'"), "ts").orderBy("ts").collect()] == list(range(3_000))
    assert blocks.numbered(df.filter("false"), ["signal_id"], ["ts"]).count() == 0


def test_positions_are_found_in_no_window_over_rows(spark):
    df = spark.range(1000).select(F.lit("a").alias("signal_id"), F.col("id").alias("ts"))
    plan = blocks.numbered(df, ["signal_id"], ["ts"])._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and plan.count("Window [") == 1 and "_rows" in plan.split("Window [")[1][:200]


@pytest.mark.parametrize(("n", "share"), [(200, 0.01), (200, 0.012), (200, 0.05), (900, 0.5), (900, 5.0), (3000, 0.001), (40, 0.0)])
def test_smoothing_is_the_pandas_one(spark, small, n, share):
    for missing in (0.0, 0.2):
        rows = series(n, n, missing, ("a", "b"))
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ERRORS + ", n int").repartition(3)
        got = {(r.signal_id, r.ts): r.error for r in forecast.ewma(df, share).collect()}
        for s in "ab":
            v = pd.Series([np.nan if e is None else e for x, _, e in rows if x == s], dtype=float)
            want = v.ewm(span=max(1, int(share * n))).mean()
            mine = [got[s, 7 * i + 3] for i in range(n)]
            assert all((g is None and math.isnan(w)) or (g is not None and abs(g - w) <= 1e-9 * max(1, abs(w))) for g, w in zip(mine, want, strict=True)), (share, missing)


def test_smoothing_of_one_signal_is_many_tasks(spark, small):
    df = spark.createDataFrame(series(800, 4), ERRORS)
    assert tasks(spark, forecast.ewma(df, 0.1)) > 1


def test_carries_reach_over_blocks_without_errors(spark, small):
    rows = [("a", i, 3.0 if i in (0, 1) else None if i < 150 else 1.0) for i in range(200)]
    got = [r.error for r in forecast.ewma(spark.createDataFrame(rows, ERRORS), 0.05).orderBy("ts").collect()]
    want = pd.Series([np.nan if e is None else e for *_, e in rows], dtype=float).ewm(span=10).mean()
    assert np.allclose(got, want)


@pytest.mark.parametrize("seed", range(3))
def test_islands_are_those_of_one_pass(spark, small, monkeypatch, seed):
    r = random.Random(seed)
    rows = [("a", a, a + r.randint(0, r.choice([3, 3, 80]))) for a in (r.randint(0, 3_000) for _ in range(600))] + [("a", 5, 5)] * 40 + [("b", 1, 9), ("c", -7, 4_000), ("c", 3_999, 4_001)]
    df = spark.createDataFrame(rows, "signal_id string, start long, end long").withColumn("x", F.col("end") - F.col("start"))
    got = sorted(map(tuple, votes.merge_intervals(df, "x").collect()))
    want = []
    for s in "abc":
        at = None
        for a, b in sorted((a, b) for x, a, b in rows if x == s):
            if at and a <= at[2]:
                at[2], at[3] = max(at[2], b), max(at[3], b - a)
            else:
                want.append(at := [s, a, b, b - a])
    assert got == sorted(map(tuple, want))
    monkeypatch.setattr(blocks, "BLOCK", 10**6)
    assert sorted(map(tuple, votes.merge_intervals(df, "x").collect())) == got
    monkeypatch.setattr(blocks, "BLOCK", 16)
    assert tasks(spark, blocks.islands(df.filter("signal_id = 'a'"), ["signal_id"], "start", "end")) > 1


def test_confusion_in_blocks_is_that_of_all_pairs(spark, small):
    r = np.random.default_rng(8)
    side = lambda n: [("s", int(a), int(a + r.integers(0, 30))) for a in r.integers(0, 4_000, n)]
    t, p = side(150), side(120)
    df = lambda x: spark.createDataFrame(x, "signal_id string, start long, end long")
    meets = lambda a, b: a[1] <= b[2] and b[1] <= a[2]
    tp = sum(any(meets(a, b) for b in p) for a in t)
    got = evaluate.contextual_confusion(df(t), df(p)).first()
    assert (got.tp, got.fp, got.fn) == (tp, sum(not any(meets(a, b) for a in t) for b in p), len(t) - tp)


@pytest.mark.parametrize("span", [(5, 0), (5, 2), (40, 1)])
def test_windows_over_block_edges(spark, small, span):
    size, target = span
    rows = spark.range(700).select(F.lit("a").alias("signal_id"), F.col("id").alias("idx"), (F.col("id") * 10).alias("ts"), F.array(F.col("id")).alias("row"))
    got = windows.rolling_window_sequences(rows, size, 1, target)
    assert tasks(spark, got) > 1
    found = got.orderBy("win").collect()
    assert [r.win for r in found] == list(range(700 - size - target + 1))
    assert all([x[0] for x in r.x] == list(range(r.win, r.win + size)) for r in found)
    if target:
        assert all(r.y == list(range(r.win + size, r.win + size + target)) and r.target_ts == 10 * (r.win + size) for r in found)


# --- the dynamic threshold -----------------------------------------------------------------------

def sequences(flag, padding):
    at = np.flatnonzero(flag)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * padding + 1)
    return list(zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]], strict=True))


def plain_dynamic(values, portion, step, padding, zs, least):
    """Every window, threshold and run of one signal by itself."""
    n = len(values)
    size, by = max(1, math.ceil(n * portion)), max(1, math.ceil(n * step))
    found = []
    for w in range(max(0, math.ceil((n - size) / by)) + 1):
        at = [i for i in range(w * by, min(n, w * by + size)) if not math.isnan(values[i])]
        v = np.array([values[i] for i in at])
        if not len(v) or v.std() <= 1e-9 * abs(v.mean()):
            continue
        mean, std, best = v.mean(), v.std(), (-np.inf, -1)
        for k, z in enumerate(zs):
            thr = mean + z * std
            rest, above = v[v <= thr], v > thr
            gain = -np.inf
            if above.any() and len(rest) and mean:
                gain = round(((mean - rest.mean()) / mean + (std - rest.std()) / std) / (above.sum() + len(sequences(above, 0)) ** 2), 12)
            best = max(best, (gain, k))
        thr = mean + zs[best[1]] * std
        flag = np.zeros(n, bool)
        flag[[i for i, x in zip(at, v, strict=True) if x > thr]] = True
        runs = sequences(flag, padding)
        if not runs:
            continue
        peak = lambda r: max(values[i] for i in range(r[0], r[1] + 1) if flag[i])
        runs.sort(key=lambda r: (-peak(r), r[0]))
        ladder = [*map(peak, runs), v[v <= thr].max() if (v <= thr).any() else 0.0]
        falls = [k for k in range(len(runs)) if (ladder[k] - ladder[k + 1]) / max(ladder[k], 1e-12) > least]
        for r in runs[: falls[-1] + 1] if falls else []:
            found.append([max(r[0] - padding, 0), min(r[1] + padding, n - 1), (peak(r) - thr) / (mean + std)])
    merged = []
    for a, b, s in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1], merged[-1][2] = max(merged[-1][1], b), max(merged[-1][2], s)
        else:
            merged.append([a, b, s])
    return merged


@pytest.mark.parametrize(("n", "missing", "padding"), [(120, 0.0, 1), (300, 0.1, 2), (300, 0.0, 0), (17, 0.0, 3)])
def test_dynamic_thresholds_are_the_plain_ones(spark, small, n, missing, padding):
    rows = series(n, n + padding, missing, ("a", "b", "c")) + [("flat", 7 * i + 3, 2.5) for i in range(n)] + [("none", 3, None)]
    got = {}
    for r in forecast.find_anomalies(spark.createDataFrame(rows, ERRORS).repartition(3), 0.33, 0.1, False, padding, z_range=(0.5, 5.0, 0.5)).collect():
        got.setdefault(r.signal_id, []).append((r.start, r.end, round(r.severity, 9)))
    for s in ("a", "b", "c", "flat", "none"):
        v = [float("nan") if e is None else e for x, _, e in rows if x == s]
        want = [(7 * a + 3, 7 * b + 3, round(x, 9)) for a, b, x in plain_dynamic(v, 0.33, 0.1, padding, list(np.arange(0.5, 5.0, 0.5)), 0.1)]
        assert sorted(got.get(s, [])) == want
    assert got["a"] and "flat" not in got


def test_dynamic_thresholds_need_no_python(spark):
    df = spark.createDataFrame(series(60, 1), ERRORS)
    w = forecast._Windows(df, 0.33, 0.1)
    plan = forecast.best_thresholds(w, w.stats(), [2.0, 3.0])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- quantiles, clusters, tables -----------------------------------------------------------------

@pytest.mark.parametrize("held", [5, 100_000])
def test_quantiles_by_narrowing_are_exact(spark, monkeypatch, held):
    monkeypatch.setattr(quantiles, "HELD", held)
    monkeypatch.setattr(quantiles, "BINS", 4)
    r = random.Random(2)
    values = {"normal": [r.gauss(0, 1) for _ in range(333)], "ties": [float(r.choice([1, 1, 1, 2])) for _ in range(200)], "wide": [10.0 ** r.uniform(-300, 300) for _ in range(101)], "one": [4.5], "two": [1.0, 2.0], "huge": [-1.7e308, 1.7e308, 0.0] * 5, "same": [7.0] * 50}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {x.k: x["_q"] for x in quantiles.exact_quantiles(df, ["k"], "v", shares).collect()}
    want = {x.k: x.q for x in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12, atol=0) for k in got)


def test_outliers_and_medians_by_narrowing(spark, monkeypatch):
    df = spark.createDataFrame([("s", 0, t, float((t * 37) % 101)) for t in range(400)], "signal_id string, dim int, ts long, value double")
    plain = prep.time_segments_aggregate(df, 50, ["median", "max"]).orderBy("idx").collect()
    pred = df.select("signal_id", F.lit(0).alias("win"), F.lit(0).alias("sample"), F.col("ts").alias("step"), F.when(F.col("ts") % 90 == 0, 900.0).otherwise(F.col("value")).alias("y_hat"))
    flags = lambda: [math.isnan(r.y_hat) for r in forecast.outliers(pred).orderBy("step").collect()]
    before = flags()
    monkeypatch.setattr(quantiles, "HELD", 10)
    assert prep.time_segments_aggregate(df, 50, ["median", "max"]).orderBy("idx").collect() == plain
    assert [r.value for r in prep.time_segments_aggregate(df, 50, "median").orderBy("idx").collect()] == [r.median for r in plain]
    assert flags() == before and sum(before) == 5


def test_clusters_on_a_line_are_the_best_ones():
    r = np.random.default_rng(4)
    for _ in range(40):
        v, k = np.unique(r.integers(0, 40, r.integers(2, 10)).astype(float)), int(r.integers(1, 5))
        n = r.integers(1, 6, len(v))
        cost = lambda c: float((n * np.min((v[:, None] - np.array(c)[None]) ** 2, axis=1)).sum())
        runs = [[0, *cuts, len(v)] for cuts in itertools.combinations(range(1, len(v)), min(k, len(v)) - 1)]
        least = min(cost([np.average(v[a:b], weights=n[a:b]) for a, b in zip(x, x[1:])]) for x in runs)
        got = prep.kmeans_1d(v[::-1], k, n[::-1])
        assert abs(cost(got) - least) < 1e-9 and len(got) == min(k, len(v)) and list(got) == sorted(got)


def test_many_values_are_clustered_by_cells(spark, monkeypatch):
    monkeypatch.setattr(prep, "CELLS", 60)
    v = [round(random.Random(i).gauss([0, 50, 90][i % 3], 2), 3) for i in range(900)]
    df = spark.createDataFrame([("s", 0, i, x) for i, x in enumerate(v)], "signal_id string, dim int, idx long, value double")
    got = prep.fit_cluster(df, 3).first()["centroids"]
    assert np.allclose(got, prep.kmeans_1d(np.array(v), 3), atol=0.5)


def test_what_a_scope_saves_goes_with_it(spark):
    before = tables.saved_count()
    kept = tables.save(spark.range(3))
    with tables.scope():
        inner = tables.save(spark.range(5))
        assert inner.count() == 5 and tables.saved_count() == before + 2
    assert tables.saved_count() == before + 1 and kept.count() == 3
    tables.drop_saved(kept)
    with pytest.raises(ZeroDivisionError), tables.scope():
        tables.save(spark.range(2))
        1 / 0  # noqa: B018
    assert tables.saved_count() == before
