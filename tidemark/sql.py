"""Operators as SQL table functions with named arguments.

register() puts frames into views of the session and functions over these beside them.
The functions are SQL themselves and take part in joins like tables do, so a query over
them is one plan, optimised as a whole, with its arguments folded in:

    register(spark, signals=df)
    spark.sql("SELECT * FROM td_anomalies(every => 21600, k => 3) WHERE severity > 0.1")

Arguments are named or positional and have defaults. A signal is one window here; the
DataFrame operators go through very long ones in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class TableFunction:
    """needs: the views it reads, directly or through other functions."""

    needs: tuple[str, ...]
    arguments: str
    columns: str
    body: str


INTERVALS = "signal_id STRING, start BIGINT, end BIGINT"

#: In the order in which they build on each other.
FUNCTIONS = {
    # A row for each interval, empty ones NULL
    "td_samples": TableFunction(
        ("signals",),
        "every BIGINT DEFAULT 21600",
        "signal_id STRING, dim INT, idx BIGINT, ts BIGINT, value DOUBLE",
        """WITH ends AS (SELECT signal_id, min(ts) AS t0, max(ts) AS t1 FROM td_signals GROUP BY signal_id),
placed AS (SELECT s.signal_id, s.dim, CAST(floor((s.ts - e.t0) / every) AS BIGINT) AS idx, s.value FROM td_signals s JOIN ends e ON s.signal_id = e.signal_id),
cells AS (SELECT signal_id, dim, idx, avg(value) AS value FROM placed GROUP BY signal_id, dim, idx),
dims AS (SELECT DISTINCT signal_id, dim FROM td_signals),
spine AS (SELECT d.signal_id, d.dim, e.t0, explode(sequence(0L, CAST(floor((e.t1 - e.t0) / every) AS BIGINT))) AS idx FROM dims d JOIN ends e ON d.signal_id = e.signal_id)
SELECT p.signal_id, p.dim, p.idx, p.t0 + p.idx * every, round(c.value, 6) FROM spine p LEFT JOIN cells c ON p.signal_id = c.signal_id AND p.dim = c.dim AND p.idx = c.idx""",
    ),
    # P2, P3, P4
    "td_scaled": TableFunction(
        ("signals",),
        "every BIGINT DEFAULT 21600, decimals INT DEFAULT 2",
        "signal_id STRING, dim INT, idx BIGINT, ts BIGINT, value DOUBLE, minimum DOUBLE, x BIGINT",
        """WITH filled AS (SELECT signal_id, dim, idx, ts, coalesce(value, round(avg(value) OVER (PARTITION BY signal_id, dim), 6)) AS value FROM td_samples(every => every)),
low AS (SELECT *, min(value) OVER (PARTITION BY signal_id) AS minimum FROM filled),
points AS (SELECT *, (value - minimum) * power(10, decimals) AS p FROM low)
SELECT signal_id, dim, idx, ts, value, minimum, CAST(CASE WHEN abs(p - rint(p)) < 1e-8 THEN rint(p) ELSE floor(p) END AS BIGINT) FROM points""",
    ),
    # W1, F1
    "td_windows": TableFunction(
        ("signals",),
        "every BIGINT DEFAULT 21600, decimals INT DEFAULT 2, size INT DEFAULT 200, step INT DEFAULT 40",
        "signal_id STRING, win BIGINT, first_index BIGINT, x ARRAY<BIGINT>, text STRING",
        """WITH at AS (SELECT signal_id, dim, idx, x, greatest(0L, CAST(ceil((idx - size + 1) / step) AS BIGINT)) AS first, CAST(floor(idx / step) AS BIGINT) AS last FROM td_scaled(every => every, decimals => decimals)),
spread AS (SELECT signal_id, dim, idx, x, explode(sequence(first, last)) AS win FROM at WHERE first <= last),
whole AS (SELECT signal_id, win, count(DISTINCT idx) AS n, transform(array_sort(collect_list(struct(idx, dim, x))), s -> s.x) AS x FROM spread GROUP BY signal_id, win)
SELECT signal_id, win, win * step, x, array_join(transform(x, v -> CAST(v AS STRING)), ',') FROM whole WHERE n = size""",
    ),
    # X2 of the value before, from the position after the first skipped ones
    "td_errors": TableFunction(
        ("signals",),
        "every BIGINT DEFAULT 21600, decimals INT DEFAULT 2, skip INT DEFAULT 20",
        "signal_id STRING, idx BIGINT, ts BIGINT, error DOUBLE",
        """WITH steps AS (SELECT signal_id, idx, ts, value, lag(x * power(10, -decimals) + minimum) OVER (PARTITION BY signal_id ORDER BY idx) AS y_hat FROM td_scaled(every => every, decimals => decimals) WHERE dim = 0)
SELECT signal_id, idx - skip, ts, abs(value - y_hat) FROM steps WHERE idx >= skip""",
    ),
    # X3 with a fixed threshold, I4
    "td_anomalies": TableFunction(
        ("signals",),
        "every BIGINT DEFAULT 21600, decimals INT DEFAULT 2, skip INT DEFAULT 20, portion DOUBLE DEFAULT 0.33, stride DOUBLE DEFAULT 0.1, k DOUBLE DEFAULT 4, padding INT DEFAULT 50",
        INTERVALS + ", severity DOUBLE",
        """WITH errors AS (SELECT *, count(*) OVER (PARTITION BY signal_id) AS n FROM td_errors(every => every, decimals => decimals, skip => skip)),
sized AS (SELECT *, greatest(1L, CAST(ceil(n * portion) AS BIGINT)) AS size, greatest(1L, CAST(ceil(n * stride) AS BIGINT)) AS by FROM errors),
placed AS (SELECT *, greatest(0L, CAST(ceil((idx - size + 1) / by) AS BIGINT)) AS first, least(CAST(floor(idx / by) AS BIGINT), CAST(ceil((n - size) / by) AS BIGINT)) AS last FROM sized),
spread AS (SELECT signal_id, idx, n, error, explode(sequence(first, last)) AS win FROM placed WHERE first <= last),
stats AS (SELECT signal_id, win, avg(error) AS mean, stddev_pop(error) AS sd FROM spread GROUP BY signal_id, win),
flagged AS (SELECT s.signal_id, s.win, s.idx, s.n, s.error, t.mean, t.sd, t.mean + k * t.sd AS thr, CASE WHEN s.idx - lag(s.idx) OVER (PARTITION BY s.signal_id, s.win ORDER BY s.idx) <= 2 * padding + 1 THEN 0 ELSE 1 END AS new
  FROM spread s JOIN stats t ON s.signal_id = t.signal_id AND s.win = t.win WHERE s.error > t.mean + k * t.sd AND s.error - t.mean > 1e-9 * abs(t.mean)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY signal_id, win ORDER BY idx) AS run FROM flagged),
runs AS (SELECT signal_id, greatest(min(idx) - padding, 0) AS a, least(max(idx) + padding, max(n) - 1) AS b, (max(error) - max(thr)) / (max(mean) + max(sd)) AS severity FROM numbered GROUP BY signal_id, win, run),
heads AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY signal_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN NULL ELSE a END AS head FROM runs),
islands AS (SELECT *, max(head) OVER (PARTITION BY signal_id ORDER BY a, b) AS island FROM heads),
merged AS (SELECT signal_id, min(a) AS a, max(b) AS b, max(severity) AS severity FROM islands GROUP BY signal_id, island)
SELECT m.signal_id, s.ts, e.ts, m.severity FROM merged m JOIN errors s ON m.signal_id = s.signal_id AND m.a = s.idx JOIN errors e ON m.signal_id = e.signal_id AND m.b = e.idx""",
    ),
    # I4; gap: seconds between two intervals that still are one
    "td_merged": TableFunction(
        ("intervals",),
        "gap BIGINT DEFAULT 0",
        INTERVALS,
        """WITH heads AS (SELECT *, CASE WHEN start - gap <= max(end) OVER (PARTITION BY signal_id ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN NULL ELSE start END AS head FROM td_intervals),
islands AS (SELECT *, max(head) OVER (PARTITION BY signal_id ORDER BY start, end) AS island FROM heads)
SELECT signal_id, min(start), max(end) FROM islands GROUP BY signal_id, island""",
    ),
    # E3, E5; slack: seconds by which a finding may miss
    "td_scores": TableFunction(
        ("truth", "found"),
        "slack BIGINT DEFAULT 0",
        "signal_id STRING, tp BIGINT, fp BIGINT, fn BIGINT, precision DOUBLE, recall DOUBLE, f1 DOUBLE",
        """WITH sides AS (SELECT signal_id, start, end, TRUE AS t FROM td_truth UNION ALL SELECT signal_id, start - slack, end + slack, FALSE FROM td_found),
seen AS (SELECT *, max(CASE WHEN NOT t THEN end END) OVER (PARTITION BY signal_id ORDER BY CASE WHEN t THEN end ELSE start END, CASE WHEN t THEN 1 ELSE 0 END) AS of_found,
  max(CASE WHEN t THEN end END) OVER (PARTITION BY signal_id ORDER BY CASE WHEN t THEN start ELSE end END, CASE WHEN t THEN 0 ELSE 1 END) AS of_truth FROM sides),
met AS (SELECT signal_id, t, coalesce(CASE WHEN t THEN of_found ELSE of_truth END >= start, FALSE) AS met FROM seen),
counts AS (SELECT signal_id, count_if(t AND met) AS tp, count_if(NOT t AND NOT met) AS fp, count_if(t AND NOT met) AS fn FROM met GROUP BY signal_id)
SELECT signal_id, tp, fp, fn, if(tp + fp = 0, 0D, tp / (tp + fp)), if(tp + fn = 0, 0D, tp / (tp + fn)), if(2 * tp + fp + fn = 0, 0D, 2 * tp / (2 * tp + fp + fn)) FROM counts""",
    ),
}


def register(spark: SparkSession, signals: DataFrame | None = None, intervals: DataFrame | None = None, truth: DataFrame | None = None, found: DataFrame | None = None) -> list[str]:
    """Views td_signals (signal_id, ts, dim, value), td_intervals, td_truth and td_found (signal_id, start, end) of what is given, and the functions over these; their names. A frame is read when a query over a function is."""
    given = {"signals": signals, "intervals": intervals, "truth": truth, "found": found}
    for name, df in given.items():
        if df is not None:
            df.select("signal_id", *(("ts", "dim", "value") if name == "signals" else ("start", "end"))).createOrReplaceTempView(f"td_{name}")
    made = []
    for name, f in FUNCTIONS.items():
        if all(given[x] is not None for x in f.needs):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({f.arguments}) RETURNS TABLE({f.columns}) RETURN {f.body}")
            made.append(name)
    return made
