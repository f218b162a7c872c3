"""Table functions against the operators they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import sql
from tidemark.operators import evaluate, forecast, prep, votes, windows


@pytest.fixture(scope="module")
def signals(spark):
    r = random.Random(7)
    rows = [(s, 1000 + 10 * i + r.randint(0, 3), d, 20 + (i % 7) + 5 * d + (40 if i in (50, 51) else 0) + r.random()) for s in "ab" for i in range(120) if i not in (30, 31) for d in (0, 1)]
    return spark.createDataFrame(rows, "signal_id string, ts long, dim int, value double")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_each_function_is_its_operator(spark, signals):
    assert sql.register(spark, signals) == ["td_samples", "td_scaled", "td_windows", "td_errors", "td_anomalies"]
    samples = prep.time_segments_aggregate(signals, 10)
    assert rows(spark.sql("SELECT * FROM td_samples(every => 10)"), "signal_id", "dim", "idx", "ts", "value") != []
    got = {(r.signal_id, r.dim, r.idx): (r.ts, r.value) for r in spark.sql("SELECT * FROM td_samples(10)").collect()}
    assert got == {(r.signal_id, r.dim, r.idx): (r.ts, r.value) for r in samples.collect()} and any(v is None for _, v in got.values())
    scaled = prep.float_to_scalar(prep.impute(samples), decimal=1)
    assert rows(spark.sql("SELECT * FROM td_scaled(decimals => 1, every => 10)"), "signal_id", "dim", "idx", "x") == rows(scaled, "signal_id", "dim", "idx", "x")
    w = windows.rolling_window_sequences(windows.rows_of_dims(scaled), 20, 7).withColumn("x", F.flatten("x"))
    assert rows(spark.sql("SELECT * FROM td_windows(every => 10, decimals => 1, size => 20, step => 7)"), "signal_id", "win", "first_index", "x") == rows(w, "signal_id", "win", "first_index", "x")
    errors = spark.sql("SELECT signal_id, ts, error FROM td_errors(every => 10, skip => 5)")
    found = forecast.find_anomalies(errors, 0.5, 0.2, True, 3, 3.0)
    mine = spark.sql("SELECT * FROM td_anomalies(every => 10, skip => 5, portion => 0.5, stride => 0.2, k => 3, padding => 3)")
    look = lambda df: [(s, a, b, round(x, 9)) for s, a, b, x in rows(df, "signal_id", "start", "end", "severity")]
    assert look(mine) == look(found) != []


def test_intervals_and_scores(spark):
    r = random.Random(1)
    side = lambda n: spark.createDataFrame([(r.choice("ab"), a, a + r.randint(0, 9)) for a in (r.randint(0, 300) for _ in range(n))], "signal_id string, start long, end long")
    truth, found = side(60), side(40)
    assert sql.register(spark, intervals=truth, truth=truth, found=found) == ["td_merged", "td_scores"]
    assert rows(spark.sql("SELECT * FROM td_merged()"), "signal_id", "start", "end") == rows(votes.merge_intervals(truth), "signal_id", "start", "end")
    wide = votes.merge_intervals(truth.withColumn("end", F.col("end") + 4)).withColumn("end", F.col("end") - 4)
    assert rows(spark.sql("SELECT * FROM td_merged(gap => 4)"), "signal_id", "start", "end") == rows(wide, "signal_id", "start", "end")
    want = evaluate.scores(evaluate.contextual_confusion(truth, found), ["precision", "recall", "f1"])
    names = ("signal_id", "tp", "fp", "fn", "precision", "recall", "f1")
    assert rows(spark.sql("SELECT * FROM td_scores()"), *names) == rows(want, *names)
    both = spark.sql("SELECT m.signal_id, count(*) AS n FROM td_merged() m JOIN td_scores() s ON m.signal_id = s.signal_id WHERE s.tp > 0 GROUP BY m.signal_id")
    assert both.count() == 2


def test_functions_without_rows(spark, signals):
    sql.register(spark, signals.filter("false"), *[spark.createDataFrame([], "signal_id string, start long, end long")] * 3)
    for name in sql.FUNCTIONS:
        assert spark.sql(f"SELECT * FROM {name}()").count() == 0
