"""Vectors of preparation, windows, votes, forecasts and evaluation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import sources as S
from tidemark.operators import evaluate, forecast, prep, votes, windows


def signal(spark, values, dim=0):
    return spark.createDataFrame([("s", dim, i, 10 * i, None if v is None else float(v)) for i, v in enumerate(values)], "signal_id string, dim int, idx long, ts long, value double")


def xs(df):
    return [r.x for r in df.orderBy("idx").collect()]


@pytest.mark.parametrize(("values", "kw", "fit", "want"), [
    ([1.05, 2, 3.1, 4.8342, 5, 0], {}, None, [105, 200, 310, 483, 500, 0]),
    ([1.05, 2, 3.1, 4.8342, 5, 0], {"decimal": 0}, None, [1, 2, 3, 4, 5, 0]),
    ([1.05, 2, 3.1, 4.8342, 5], {}, None, [0, 95, 205, 378, 395]),
    ([1.05, 2, 3.1, 4.8342, 5], {"rescale": False}, None, [105, 200, 310, 483, 500]),
    ([1.05, 2, 3.1, 4.8342, 5, -2], {}, None, [305, 400, 510, 683, 700, 0]),
    ([1.05, 2, 3.1, 4.8342, 5], {}, [7, 3, 0.5], [55, 150, 260, 433, 450]),
])
def test_float_to_scalar(spark, values, kw, fit, want):
    fitted = prep.fit_scalar(signal(spark, fit)) if fit else None
    assert xs(prep.float_to_scalar(signal(spark, values), fitted, **kw)) == want


def test_scalar_to_float(spark):
    got = spark.createDataFrame([(v,) for v in [105, 200, 310, 483, 500, 0]], "x long").select(prep.scalar_to_float(F.col("x"), F.lit(-1.0)).alias("v")).collect()
    assert np.allclose([r.v for r in got], [0.05, 1, 2.1, 3.83, 4, -1])


def test_clusters(spark):
    df = signal(spark, [1, 2, 3])
    fitted = prep.fit_cluster(df, 10)
    assert fitted.first()["centroids"] == [1, 2, 3] and xs(prep.float_to_cluster(df, fitted)) == [0, 1, 2]
    got = spark.createDataFrame([(v,) for v in [0, 1, 5, -1]], "x int").select(prep.cluster_to_float(F.col("x"), F.array(F.lit(0.0), F.lit(1.0))).alias("v")).collect()
    assert [r.v for r in got] == [0, 1, 1, 0]


def test_nearest_ties_go_down(spark):
    assert spark.range(1).select(prep.nearest(F.lit(1.5), F.array(F.lit(1.0), F.lit(2.0))).alias("v")).first()["v"] == 0


def test_kmeans_and_fit_fraction(spark):
    values = [1, 1.1, 5, 5.2, 9, 9.1, 100, 200]
    c = prep.fit_cluster(signal(spark, values), 3, 0.75).first()["centroids"]
    assert np.allclose(c, [1.05, 5.1, 9.05])


def test_buckets_keep_gaps_and_impute(spark):
    df = spark.createDataFrame([("s", 0, t, v) for t, v in [(100, 1.0), (105, 3.0), (131, 5.0)]], "signal_id string, dim int, ts long, value double")
    b = prep.time_segments_aggregate(df, 10)
    assert [(r.idx, r.ts, r.value) for r in b.orderBy("idx").collect()] == [(0, 100, 2), (1, 110, None), (2, 120, None), (3, 130, 5)]
    assert [r.value for r in prep.impute(b).orderBy("idx").collect()] == [2, 3.5, 3.5, 5]
    assert [r.value for r in prep.impute(b, "constant", 7.0).orderBy("idx").collect()] == [2, 7, 7, 5]
    assert prep.time_segments_aggregate(df, 10, ["first", "last", "count"]).filter("idx = 0").first()[4:] == (1, 3, 2)
    with pytest.raises(ValueError, match="unknown"):
        prep.time_segments_aggregate(df, 10, "mode")


def test_windows(spark):
    rows = windows.rows_of_dims(signal(spark, range(7)).withColumn("x", F.col("value").cast("bigint")))
    for step in (1, 2):
        got = windows.rolling_window_sequences(rows, 3, step).orderBy("win").collect()
        assert [r.first_index for r in got] == list(range(0, 5, step))
        assert [[v[0] for v in r.x] for r in got] == [[i, i + 1, i + 2] for i in range(0, 5, step)]
    d = windows.rolling_window_sequences(rows, 3, 1, 2).orderBy("win").collect()
    assert [(r.y, r.target_ts) for r in d] == [([i + 3, i + 4], 10 * (i + 3)) for i in range(3)]


def test_two_dimensions(spark):
    both = signal(spark, range(4)).unionByName(signal(spark, range(10, 14), 1)).withColumn("x", F.col("value").cast("bigint"))
    got = windows.rolling_window_sequences(windows.rows_of_dims(both), 3, 1).orderBy("win").collect()
    assert [r.x for r in got] == [[[0, 10], [1, 11], [2, 12]], [[1, 11], [2, 12], [3, 13]]]


def votes_of(spark, per_window):
    rows = [("s", w, w, k, p) for w, samples in enumerate(per_window) for k, p in enumerate(samples)]
    return spark.createDataFrame(rows, "signal_id string, win long, first_index long, sample int, positions array<long>")


def test_vote_in_windows(spark):
    got = votes.vote_in_windows(votes_of(spark, [[[0, 3], [1], [1, 2]], [[0], [1, 4], [2, 3]], [[0, 2], [], [0, 1]]]), 0.5)
    assert {(r.win, r.idx) for r in got.collect()} == {(0, 1), (2, 0)}


def test_vote_across_windows(spark):
    rows = [("s", w, w, i) for w, idx in enumerate([[0], [1, 2], [0, 2], [1, 2], [1]]) for i in idx]
    found = spark.createDataFrame(rows, "signal_id string, win long, first_index long, idx long")
    assert sorted(r.idx for r in votes.vote_across_windows(found, 3, 1, 0.5).collect()) == [2, 4, 5]


def test_val2idx(spark):
    x = F.array(*[F.array(F.lit(v).cast("bigint")) for v in [0, 1, 0, 3]])
    got = spark.range(1).select(votes.val2idx(F.array(*[F.lit(v).cast("bigint") for v in (0, 3)]), x).alias("v")).first()["v"]
    assert got == [0, 2, 3]


def test_format_anomalies(spark):
    idx = spark.createDataFrame([("s", i) for i in [32, 545, 689, 1103, 1134, 5000]], "signal_id string, idx long")
    samples = spark.range(1200).select(F.lit("s").alias("signal_id"), F.col("id").alias("idx"), (1000 + 10 * F.col("id")).alias("ts"))
    got = sorted(tuple(r) for r in votes.format_anomalies(idx, samples).select("start", "end", "severity").collect())
    assert got == [(1000, 1820, 0), (5950, 6950, 0), (7390, 8390, 0), (11530, 12840, 0)]
    assert votes.format_anomalies(idx.limit(0), samples).count() == 0


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([("s", 1, 5), ("s", 5, 7), ("s", 9, 10), ("s", 2, 3)], "signal_id string, start long, end long")
    assert sorted((r.start, r.end) for r in votes.merge_intervals(df).collect()) == [(1, 7), (9, 10)]


def pred(spark, y):
    rows = [("s", w, k, t, v) for w, samples in enumerate(y) for k, s in enumerate(samples) for t, v in enumerate(s)]
    return spark.createDataFrame(rows, "signal_id string, win long, sample int, step int, y_hat double")


@pytest.mark.parametrize(("agg", "want"), [("median", [1, math.nan, 6]), ("nanmedian", [1, 3, 6]), ("max", [1, math.nan, 8]), ("nanmean", [1, 3, 6])])
def test_aggregate_propagates_nan(spark, agg, want):
    got = forecast.aggregate_rolling_window(pred(spark, [[[1.0, 3.0]], [[math.nan, 4.0]], [[8.0]]]), 1, agg).orderBy("position").collect()
    assert np.allclose([r.y_hat for r in got], want, equal_nan=True)


def test_outliers(spark):
    y = [[[1.0, 2.0, 3.0, 4.0, 100.0]]]
    assert [math.isnan(r.y_hat) for r in forecast.outliers(pred(spark, y)).orderBy("step").collect()] == [False] * 4 + [True]
    y[0][0][0] = math.nan
    assert not any(math.isnan(r.y_hat) for r in forecast.outliers(pred(spark, y)).filter("step > 0").collect())
    with pytest.raises(ValueError, match="unknown"):
        forecast.aggregate_rolling_window(pred(spark, y), 1, "mode")


def test_find_anomalies(spark):
    e = np.full(200, 0.1)
    e[90:93] = 5
    df = spark.createDataFrame([("s", 10 * i, float(v)) for i, v in enumerate(e)], "signal_id string, ts long, error double")
    for fixed in (True, False):
        got = forecast.find_anomalies(df, 0.33, 0.1, fixed, 5).collect()
        assert [(r.start, r.end) for r in got] == [(850, 970)] and got[0].severity > 0


def test_ewma(spark):
    df = spark.createDataFrame([("s", i, float(i % 2), 0.0) for i in range(10)], "signal_id string, ts long, y double, y_hat double")
    got = [r.error for r in forecast.regression_errors(df, True, 0.5).orderBy("ts").collect()]
    assert len(got) == 10 and max(got) < 1


def test_evaluation(spark):
    truth = spark.createDataFrame([("s", 1, 5), ("s", 20, 30), ("t", 1, 2)], "signal_id string, start long, end long")
    found = spark.createDataFrame([("s", 4, 8), ("s", 40, 50)], "signal_id string, start long, end long")
    got = {r.signal_id: (r.tp, r.fp, r.fn) for r in evaluate.contextual_confusion(truth, found).collect()}
    assert got == {"s": (1, 1, 1), "t": (0, 0, 1)}
    s = evaluate.scores(evaluate.contextual_confusion(truth, found), ["precision", "f1"]).filter("signal_id = 's'").first()
    assert (s.precision, s.f1) == (0.5, 0.5)
    with pytest.raises(ValueError, match="unknown metric"):
        evaluate.resolve_metrics(["luck"])


def test_sources(spark, tmp_path):
    (tmp_path / "a_normal.csv").write_text("timestamp,value\n" + "".join(f"{1000 + 10 * i},{i}\n" for i in range(10)))
    store = S.SignalStore(spark, str(tmp_path))
    assert store.load("a").count() == 10
    assert [r.value for r in store.load("a", start=2, end=5).orderBy("timestamp").collect()] == [2, 3, 4]
    assert store.load("a", start=1020, end=1050).count() == 4
    with pytest.raises(FileNotFoundError):
        store.load("b")
    (tmp_path / "c.csv").write_text('dataset,signals\nx,"[\'a\', \'b\']"\n')
    assert S.read_catalog(spark, str(tmp_path / "c.csv")) == {"x": ["a", "b"]}
    assert S.synthetic_multivariate(spark).count() == 25


def test_missing_errors_keep_their_positions(spark):
    rows = [("s", 10 * i, 100.0 if i == 30 else float("nan") if i < 10 else 1.0 + i % 2) for i in range(60)]
    got = forecast.find_anomalies(spark.createDataFrame(rows, "signal_id string, ts long, error double"), 1.0, 1.0, True, 2, 4.0).collect()
    assert [(r.start, r.end) for r in got] == [(280, 320)]


def test_confusion_matches_every_pair(spark):
    r = np.random.default_rng(5)
    side = lambda n: [(f"s{r.integers(3)}", int(a), int(a + r.integers(0, 9))) for a in r.integers(0, 120, n)]
    t, p = side(40), side(30)
    df = lambda x: spark.createDataFrame(x, "signal_id string, start long, end long")
    meets = lambda a, b: a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]
    got = {x.signal_id: (x.tp, x.fp, x.fn) for x in evaluate.contextual_confusion(df(t), df(p)).collect()}
    for s in got:
        mine, theirs = [x for x in t if x[0] == s], [x for x in p if x[0] == s]
        tp = sum(any(meets(a, b) for b in theirs) for a in mine)
        assert got[s] == (tp, sum(not any(meets(a, b) for a in mine) for b in theirs), len(mine) - tp)


def test_kmeans_weighs_values_by_their_counts():
    v, n = np.array([0.0, 1.0, 10.0, 11.0, 30.0]), np.array([1, 9, 5, 5, 1])
    whole = prep.kmeans_1d(np.repeat(v, n), 3)
    assert np.allclose(prep.kmeans_1d(v, 3, counts=n), whole) and np.allclose(whole, [0.9, 10.5, 30])


def test_a_signal_is_copied_to_the_cache(spark, tmp_path):
    (tmp_path / "far").mkdir()
    (tmp_path / "far" / "x_normal.csv").write_text("timestamp,value\n1,2\n3,4\n")
    store = S.SignalStore(spark, str(tmp_path / "near"), str(tmp_path / "far"), cache=True)
    assert store.load("x").count() == 2 and (tmp_path / "near" / "x_normal.csv").exists()
    (tmp_path / "far" / "x_normal.csv").unlink()
    assert store.load("x").count() == 2
    assert S.SignalStore(spark, "nosuchscheme://a/b", str(tmp_path / "near")).load("x").count() == 2
    with pytest.raises(FileNotFoundError):
        store.resolve("y")
