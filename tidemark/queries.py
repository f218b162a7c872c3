"""Registered queries of the library's own operators over the supplied tables, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources as S
from . import sql
from .functions import encode as E
from .functions import parse as R
from .operators import evaluate, forecast, prep, votes, windows
from .plans import harness, models
from .plans.pipeline import Pipeline
from .tables import save

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SIX, HOUR = 21600, 3600


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- shared inputs -----------------------------------------------------------------------------

def joined(arr, sep: str = ",") -> F.Column:
    return F.array_join(F.transform(arr, lambda v: v.cast("string")), sep, "null")


def sampled(spark, d, interval=SIX, multi=False):
    return prep.impute(prep.time_segments_aggregate((S.event_multivariate if multi else S.event_signals)(spark, d), interval))


def scaled(spark, d, interval=SIX, multi=False, **kw):
    return prep.float_to_scalar(save(sampled(spark, d, interval, multi), "samples"), **kw)


def windowed(spark, d, ws=40, step=10, multi=False, **kw):
    return windows.rolling_window_sequences(windows.rows_of_dims(scaled(spark, d, multi=multi)), ws, step, **kw)


SIG = "sig AS (SELECT event_type AS signal_id, epoch_us(ts) // 1000000 AS ts, 0 AS dim, value FROM events)"
SIGM = "sig AS (SELECT 'all' AS signal_id, epoch_us(ts) // 1000000 AS ts, dense_rank() OVER (ORDER BY event_type) - 1 AS dim, value FROM events)"


def buckets(interval=SIX, sig=SIG, agg="round(avg(value), 6)"):
    return f"""{sig},
e AS (SELECT signal_id, min(ts) AS t0, max(ts) AS t1 FROM sig GROUP BY 1),
cells AS (SELECT s.signal_id, s.dim, (s.ts - e.t0) // {interval} AS idx, {agg} AS value FROM sig s JOIN e ON s.signal_id = e.signal_id GROUP BY 1, 2, 3),
spine AS (SELECT d.signal_id, d.dim, e.t0, unnest(range(0, (e.t1 - e.t0) // {interval} + 1)) AS idx FROM (SELECT DISTINCT signal_id, dim FROM sig) d JOIN e ON d.signal_id = e.signal_id),
b AS (SELECT p.signal_id, p.dim, p.idx, p.t0 + p.idx * {interval} AS ts, c.value FROM spine p LEFT JOIN cells c ON p.signal_id = c.signal_id AND p.dim = c.dim AND p.idx = c.idx)"""


IMPUTED = "m AS (SELECT signal_id, dim, idx, ts, coalesce(value, round(avg(value) OVER (PARTITION BY signal_id, dim), 6)) AS value FROM b)"


def quantised(interval=SIX, sig=SIG, rescale=True, decimal=2):
    v = "value - minimum" if rescale else "value"
    return f"""{buckets(interval, sig)}, {IMPUTED},
low AS (SELECT signal_id, min(value) AS minimum FROM m GROUP BY 1),
p AS (SELECT m.*, low.minimum, ({v}) * 1e{decimal} AS p FROM m JOIN low ON m.signal_id = low.signal_id),
sc AS (SELECT signal_id, dim, idx, ts, value, minimum, CAST(CASE WHEN abs(p - round_even(p, 0)) < 1e-8 THEN round_even(p, 0) ELSE floor(p) END AS BIGINT) AS x FROM p)"""


def win_sql(ws=40, step=10, **kw):
    return f"""{quantised(**kw)},
win AS (SELECT signal_id, k // {step} AS win, k AS first_index, list(x ORDER BY idx, dim) AS x, string_agg(CAST(x AS VARCHAR), ',' ORDER BY idx, dim) AS text
  FROM sc JOIN (SELECT unnest(range(0, 200000, {step})) AS k) ON idx >= k AND idx < k + {ws} GROUP BY 1, 2, 3 HAVING count(DISTINCT idx) = {ws})"""


# --- sources -----------------------------------------------------------------------------------

@query(f"WITH {SIG} SELECT signal_id, ts, value FROM sig")
def scan_signals(spark, d):
    return S.event_signals(spark, d).select("signal_id", "ts", "value")


@query(f"WITH {SIG}, i AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY ts, value) - 1 AS idx FROM sig) SELECT signal_id, idx, ts FROM i WHERE idx >= 20 AND idx < 50")
def slice_positional(spark, d):
    return S.slice_positional(S.index_rows(S.event_signals(spark, d), "ts", ["signal_id"]), 20, 50).select("signal_id", "idx", "ts")


@query(f"WITH {SIG} SELECT signal_id, ts, value FROM sig WHERE ts BETWEEN 1704240000 AND 1704672000")
def slice_timestamp(spark, d):
    return S.slice_timestamp(S.event_signals(spark, d), 1704240000, 1704672000, "ts").select("signal_id", "ts", "value")


@query(f"WITH {buckets()}, i AS (SELECT *, count(*) OVER (PARTITION BY signal_id) AS n FROM b) SELECT signal_id, idx, ts, CASE WHEN idx < floor(n * (1 - 0.3)) THEN 'train' ELSE 'test' END AS split FROM i")
def train_test_split(spark, d):
    return S.train_test_split(prep.time_segments_aggregate(S.event_signals(spark, d), SIX).drop("idx")).select("signal_id", "idx", "ts", "split")


@query("SELECT 1577836800 + i * 3600 AS timestamp, (10 + i) / 100 AS x1, CAST(i % 2 AS DOUBLE) AS x2, (65 - i) / 100 AS x3 FROM (SELECT unnest(range(0, 25)) AS i)")
def synth_multivariate(spark, d):
    return S.synthetic_multivariate(spark)


# --- preparation -------------------------------------------------------------------------------

@query(f"WITH {buckets()} SELECT signal_id, idx, ts, value FROM b")
def bucket_mean(spark, d):
    return prep.time_segments_aggregate(S.event_signals(spark, d), SIX).select("signal_id", "idx", "ts", "value")


@query(f"""WITH {SIG}, e AS (SELECT signal_id, min(ts) AS t0 FROM sig GROUP BY 1)
SELECT s.signal_id, (s.ts - e.t0) // {SIX} AS idx, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, round(sum(value), 6) AS sum, CAST(count(value) AS DOUBLE) AS count
FROM sig s JOIN e ON s.signal_id = e.signal_id GROUP BY 1, 2""")
def bucket_multi_agg(spark, d):
    return prep.time_segments_aggregate(S.event_signals(spark, d), SIX, ["mean", "median", "min", "max", "sum", "count"]).filter("count IS NOT NULL").drop("dim", "ts")


@query(f"WITH {buckets(HOUR)} SELECT signal_id, count(*) AS n, count(*) - count(value) AS gaps FROM b GROUP BY 1")
def bucket_spine_gaps(spark, d):
    return prep.time_segments_aggregate(S.event_signals(spark, d), HOUR).groupBy("signal_id").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count("value")).alias("gaps"))


@query(f"WITH {buckets(HOUR)}, {IMPUTED} SELECT signal_id, idx, ts, value FROM m")
def impute_mean(spark, d):
    return sampled(spark, d, HOUR).select("signal_id", "idx", "ts", "value")


@query(f"WITH {buckets()}, {IMPUTED} SELECT signal_id, min(value) AS minimum FROM m GROUP BY 1")
def scaler_fit(spark, d):
    return prep.fit_scalar(sampled(spark, d))


@query(f"WITH {quantised()} SELECT signal_id, idx, x, minimum FROM sc")
def float2scalar(spark, d):
    return scaled(spark, d).select("signal_id", "idx", "x", "minimum")


@query(f"WITH {quantised(rescale=False)} SELECT signal_id, idx, x FROM sc")
def float2scalar_norescale(spark, d):
    return scaled(spark, d, rescale=False).select("signal_id", "idx", "x")


@query(f"WITH {quantised()} SELECT signal_id, idx, round(x * 0.01 + minimum, 6) AS value FROM sc")
def scalar2float(spark, d):
    return scaled(spark, d).select("signal_id", "idx", F.round(prep.scalar_to_float(F.col("x"), F.col("minimum")), 6).alias("value"))


@query(f"WITH {quantised()} SELECT signal_id, bool_and(abs(x * 0.01 + minimum - value) <= 0.01) AS close FROM sc GROUP BY 1")
def scalar_roundtrip(spark, d):
    return scaled(spark, d).groupBy("signal_id").agg(F.bool_and(F.abs(prep.scalar_to_float(F.col("x"), F.col("minimum")) - F.col("value")) <= 0.01).alias("close"))


def _rounded(spark, d):
    return sampled(spark, d).withColumn("value", F.round("value", 0))


ROUNDED = f"{buckets()}, {IMPUTED}, q AS (SELECT signal_id, dim, idx, round(value, 0) AS value FROM m), cen AS (SELECT signal_id, list(DISTINCT value ORDER BY value) AS c FROM q GROUP BY 1)"


@query(f"WITH {ROUNDED} SELECT signal_id, unnest(c) AS centroid FROM cen")
def cluster_distinct_centroids(spark, d):
    return prep.fit_cluster(_rounded(spark, d), 10_000).select("signal_id", F.explode("centroids").alias("centroid"))


CENTRES = [10.0, 20.0, 30.0, 45.0, 46.0, 60.0]
_LIT = "[" + ", ".join(f"{c}::DOUBLE" for c in CENTRES) + "]"
LABELS = f"{buckets()}, {IMPUTED}, l AS (SELECT signal_id, idx, value, {_LIT} AS c FROM m), k AS (SELECT signal_id, idx, c, list_position([abs(value - y) FOR y IN c], list_min([abs(value - y) FOR y IN c])) - 1 AS label FROM l)"


@query(f"WITH {LABELS} SELECT signal_id, idx, CAST(label AS BIGINT) AS label FROM k")
def cluster_assign(spark, d):
    return sampled(spark, d).select("signal_id", "idx", prep.nearest(F.col("value"), F.array(*map(F.lit, CENTRES))).alias("label"))


@query(f"WITH {LABELS} SELECT signal_id, idx, c[least(greatest(label * 2 - 2, 0), 5) + 1] AS value FROM k")
def cluster2float(spark, d):
    c = F.array(*map(F.lit, CENTRES))
    return sampled(spark, d).select("signal_id", "idx", prep.cluster_to_float(prep.nearest(F.col("value"), c) * 2 - 2, c).alias("value"))


def clustered(k: int, source: str = "m") -> str:
    """The best k clusters of each signal's distinct values by recursion over runs of them: path holds where the runs end."""
    return f"""dv AS (SELECT signal_id, value, n, row_number() OVER (PARTITION BY signal_id ORDER BY value) AS i FROM (SELECT signal_id, value, count(*)::DOUBLE AS n FROM {source} WHERE dim = 0 GROUP BY 1, 2)),
mid AS (SELECT signal_id, sum(n * value) / sum(n) AS c, least({k}, count(*)) AS k, count(*) AS size FROM dv GROUP BY 1),
pre AS (SELECT signal_id, 0 AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS s, 0.0::DOUBLE AS q FROM mid UNION ALL SELECT dv.signal_id, i, sum(n) OVER o, sum(n * (value - c)) OVER o, sum(n * (value - c) * (value - c)) OVER o FROM dv JOIN mid USING (signal_id) WINDOW o AS (PARTITION BY dv.signal_id ORDER BY i)),
runs AS (SELECT a.signal_id, a.i AS i, b.i AS j, greatest(b.q - a.q - (b.s - a.s) * (b.s - a.s) / (b.w - a.w), 0) AS cost FROM pre a JOIN pre b ON a.signal_id = b.signal_id AND a.i < b.i),
dp AS (SELECT signal_id, 1 AS m, j, cost, [j] AS path FROM runs WHERE i = 0
  UNION ALL SELECT r.signal_id, any_value(m) + 1, r.j, min(dp.cost + r.cost), arg_min(list_append(path, r.j), dp.cost + r.cost) FROM dp JOIN runs r ON r.signal_id = dp.signal_id AND r.i = dp.j WHERE m < {k} GROUP BY r.signal_id, r.j),
best AS (SELECT dp.signal_id, path FROM dp JOIN mid ON mid.signal_id = dp.signal_id AND dp.m = mid.k AND dp.j = mid.size),
cl AS (SELECT b.signal_id, u.x, c + (h.s - l.s) / (h.w - l.w) AS centre FROM best b, LATERAL (SELECT unnest(range(0, len(path))) AS x) u JOIN mid ON mid.signal_id = b.signal_id JOIN pre h ON h.signal_id = b.signal_id AND h.i = b.path[u.x + 1] JOIN pre l ON l.signal_id = b.signal_id AND l.i = CASE WHEN u.x = 0 THEN 0 ELSE b.path[u.x] END),
near AS (SELECT s.*, cl.x, cl.centre FROM {source} s JOIN cl ON cl.signal_id = s.signal_id WHERE dim = 0 QUALIFY row_number() OVER (PARTITION BY s.signal_id, s.idx ORDER BY abs(s.value - centre), cl.x) = 1)"""


@query(f"WITH RECURSIVE {buckets()}, {IMPUTED}, {clustered(20)} SELECT signal_id, idx, x, round(centre, 4) AS value FROM near")
def kmeans_binning(spark, d):
    df = save(sampled(spark, d), "samples")
    return prep.float_to_cluster(df, prep.fit_cluster(df, 20)).select("signal_id", "idx", "x", F.round(prep.cluster_to_float(F.col("x"), F.col("centroids")), 4).alias("value"))


@query(f"WITH {buckets(sig=SIGM)}, {IMPUTED} SELECT dim, idx, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z FROM m WINDOW w AS (PARTITION BY dim)")
def zscore_normalize(spark, d):
    return prep.normalize(sampled(spark, d, multi=True)).select(F.col("dim").cast("bigint").alias("dim"), "idx", F.round("value", 6).alias("z"))


# --- windows and encodings -----------------------------------------------------------------------

@query(f"WITH {win_sql()} SELECT signal_id, win, first_index, text AS x FROM win")
def windows_prompter(spark, d):
    return windowed(spark, d).select("signal_id", "win", "first_index", joined(F.flatten("x")).alias("x"))


@query(f"WITH {win_sql(21, 1)} SELECT w.signal_id, w.win, array_to_string(w.x[1:20], ',') AS x, w.x[21] AS y, s.ts AS target_ts FROM win w JOIN sc s ON s.signal_id = w.signal_id AND s.idx = w.first_index + 20")
def windows_detector(spark, d):
    return windowed(spark, d, 20, 1, target_size=1).select("signal_id", "win", joined(F.flatten("x")).alias("x"), F.get("y", F.lit(0)).alias("y"), "target_ts")


@query(f"WITH {win_sql()} SELECT signal_id, win, text FROM win")
def fmt_string(spark, d):
    return windowed(spark, d).select("signal_id", "win", E.format_as_string(F.col("x")).alias("text"))


@query(f"WITH {win_sql()} SELECT signal_id, win, rtrim(regexp_replace(text, '(.)', '\\1 ', 'g')) AS text FROM win")
def fmt_string_spaced(spark, d):
    return windowed(spark, d).select("signal_id", "win", E.format_as_string(F.col("x"), ",", True).alias("text"))


@query(f"WITH {quantised()} SELECT signal_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY idx) AS text FROM sc GROUP BY 1")
def fmt_string_single(spark, d):
    rows = windows.rows_of_dims(scaled(spark, d)).groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "row"))), lambda s: s["row"]).alias("x"))
    return rows.select("signal_id", E.format_as_string(F.col("x")).alias("text"))


M_WIN = dict(ws=10, step=5, multi=True)
M_ROWS = f"""{quantised(sig=SIGM)},
k AS (SELECT unnest(range(0, 200000, 5)) AS k), n AS (SELECT max(idx) AS last FROM sc),
cell AS (SELECT k // 5 AS win, idx, dim, x FROM sc JOIN k ON idx >= k AND idx < k + 10, n WHERE k + 9 <= last),
w AS (SELECT greatest(3, max(length(CAST(abs(x) AS VARCHAR)))) AS w FROM sc),
z AS (SELECT cell.*, w, lpad(CAST(x AS VARCHAR), CAST(w AS INT), '0') AS z FROM cell, w)"""


def multi_windows(spark, d):
    w = windowed(spark, d, **M_WIN)
    return w.join(w.groupBy("signal_id").agg(F.greatest(F.lit(3), F.max(E.digits_needed(F.col("x")))).alias("width")), "signal_id")


def fmt_query(name: str, sql: str, **kw):
    def run(spark, d):
        return multi_windows(spark, d).select("win", E.ENCODERS[name](F.col("x"), F.col("width"), **kw).alias("text"))

    run.__name__ = {"value_concatenation": "fmt_value_concat", "json_format": "fmt_json", "univariate_control": "fmt_univariate", "persistence_control": "fmt_persistence"}.get(name, f"fmt_{name}")
    query(f"WITH {M_ROWS} {sql}")(run)


fmt_query("value_concatenation", "SELECT win, string_agg(CAST(x AS VARCHAR), ',' ORDER BY idx, dim) AS text FROM cell GROUP BY 1")
fmt_query("json_format", "SELECT win, string_agg('d' || dim || ':' || x, ',' ORDER BY idx, dim) AS text FROM cell GROUP BY 1")
fmt_query("univariate_control", "SELECT win, string_agg(CAST(x AS VARCHAR), ',' ORDER BY idx) AS text FROM cell WHERE dim = 1 GROUP BY 1", target_column=1)
fmt_query("persistence_control", "SELECT win, string_agg(CAST(x AS VARCHAR), ',' ORDER BY idx) AS text FROM cell WHERE dim = 0 GROUP BY 1")
V_TEXT = ", r AS (SELECT win, idx, string_agg(z, '' ORDER BY dim) AS r FROM z GROUP BY 1, 2), t AS (SELECT win, string_agg(r, ',' ORDER BY idx) || ',' AS text FROM r GROUP BY 1) "
D_TEXT = ", r AS (SELECT win, idx, string_agg(substr(z, p, 1), '' ORDER BY p, dim) AS r FROM z JOIN (SELECT unnest(range(1, 30)) AS p) ON p <= w GROUP BY 1, 2), t AS (SELECT win, string_agg(r, ',' ORDER BY idx) || ',' AS text FROM r GROUP BY 1) "
fmt_query("value_interleave", V_TEXT.strip() + " SELECT win, text FROM t")
fmt_query("digit_interleave", D_TEXT.strip() + " SELECT win, text FROM t")
for _n in ("fmt_value_interleave", "fmt_digit_interleave"):  # the CTEs go on after those of M_ROWS
    SQL[_n] = SQL[_n].replace(") , r AS", "), r AS")

SYSTEM, USER = "You find unusual values.", "Name them in this series:"


@query(f"WITH {win_sql()} SELECT signal_id, win, '{SYSTEM}' || '  ' || '{USER}' || ' ' || text || ' [RESPONSE]' AS prompt FROM win")
def prompt_zero_shot(spark, d):
    return windowed(spark, d).select("signal_id", "win", E.prompt(E.format_as_string(F.col("x")), SYSTEM, USER).alias("prompt"))


@query(f"WITH {win_sql()}, f AS (SELECT signal_id, text AS normal FROM win WHERE win = 0) SELECT win.signal_id, win.win, '{SYSTEM}' || ' Normal: ' || normal || chr(10) || chr(10) || ' {USER} ' || text || ' [RESPONSE]' AS prompt FROM win JOIN f ON win.signal_id = f.signal_id")
def prompt_one_shot(spark, d):
    w = windowed(spark, d).select("signal_id", "win", E.format_as_string(F.col("x")).alias("text"))
    return w.join(w.filter("win = 0").select("signal_id", F.col("text").alias("normal")), "signal_id").select("signal_id", "win", E.prompt(F.col("text"), SYSTEM, USER, "Normal: ", F.col("normal")).alias("prompt"))


TUPLES = f"WITH {M_ROWS}, r AS (SELECT win, idx, '(' || string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim) || ')' AS r FROM cell GROUP BY 1, 2), t AS (SELECT win, string_agg(r, ',' ORDER BY idx) AS text, list(r ORDER BY idx)[1:3] AS ex FROM r GROUP BY 1) "


@query(TUPLES + f"SELECT win, '{SYSTEM}  Rows like ' || array_to_string(ex, ', ') || ' follow. ' || text || ' [RESPONSE]' AS prompt FROM t")
def prompt_multivariate(spark, d):
    return multi_windows(spark, d).select("win", E.multivariate_prompt(E.tuples(F.col("x")), SYSTEM, "Rows like {examples} follow.").alias("prompt"))


@query(TUPLES + "SELECT win, replace(replace(array_to_string(ex, ';'), '(', ''), ')', '') AS examples FROM t")
def get_examples(spark, d):
    return multi_windows(spark, d).select("win", F.array_join(E.get_examples(E.tuples(F.col("x"))), ";").alias("examples"))


# --- parsing ---------------------------------------------------------------------------------------

NOISY = f"""{win_sql(20, 20)},
piece AS (SELECT signal_id, win, i, CASE WHEN i % 5 = 0 THEN x[i + 1] || '!e ' WHEN i % 7 = 3 THEN ' ' ELSE ' ' || x[i + 1] END AS p FROM win, (SELECT unnest(range(0, 20)) AS i)),
resp AS (SELECT signal_id, win, string_agg(p, ' ,' ORDER BY i) AS response FROM piece GROUP BY 1, 2),
tok AS (SELECT signal_id, win, [t FOR t IN string_split(regexp_replace(response, '\\s+', '', 'g'), ',') IF t <> ''] AS t FROM resp)"""


def noisy(spark, d):
    def piece(v, i):
        return F.when(i % 5 == 0, F.concat(v.cast("string"), F.lit("!e "))).when(i % 7 == 3, F.lit(" ")).otherwise(F.concat(F.lit(" "), v.cast("string")))

    return windowed(spark, d, 20, 20).select("signal_id", "win", F.array_join(F.transform(F.flatten("x"), piece), " ,").alias("response"))


def parse_query(how: str, sql: str):
    def run(spark, d):
        return noisy(spark, d).select("signal_id", "win", F.array_join(F.transform(R.string_to_numbers(F.col("response"), errors=how), lambda v: F.when(F.isnan(v), F.lit("NaN")).otherwise(v.cast("bigint").cast("string"))), ",").alias("values"))

    run.__name__ = f"parse_int_{how}"
    query(f"WITH {NOISY} SELECT signal_id, win, array_to_string({sql}, ',') AS values FROM tok")(run)


parse_query("ignore", "[u FOR u IN t IF NOT regexp_matches(u, '[^0-9]')]")
parse_query("filter", "[regexp_replace(u, '[^0-9]', '', 'g') FOR u IN t]")
parse_query("coerce", "[CASE WHEN regexp_matches(u, '[^0-9]') THEN 'NaN' ELSE u END FOR u IN t]")


@query(f"WITH {NOISY} SELECT signal_id, win, CAST(step AS INT) AS step, CAST(v AS DOUBLE) AS y_hat FROM (SELECT signal_id, win, unnest(range(0, 4)) AS step, unnest([u FOR u IN t IF NOT regexp_matches(u, '[^0-9]')][1:4]) AS v FROM tok)")
def format_as_integer(spark, d):
    return noisy(spark, d).select("signal_id", "win", F.posexplode(R.string_to_numbers(F.col("response"), trunc=4)).alias("step", "y_hat"))


TARGET2 = f"WITH {M_ROWS} SELECT win, string_agg(CAST(x AS VARCHAR), ',' ORDER BY idx) AS values FROM cell WHERE dim = 2 GROUP BY 1"


@query(TARGET2)
def parse_value_concat(spark, d):
    return multi_windows(spark, d).select("win", joined(R.value_concatenation(E.format_as_string(F.col("x")), 5, 2)).alias("values"))


@query(TARGET2)
def parse_value_interleave(spark, d):
    return multi_windows(spark, d).select("win", joined(R.value_interleave(E.value_interleave(F.col("x"), F.col("width")), F.col("width"), 2)).alias("values"))


@query(TARGET2)
def parse_digit_interleave(spark, d):
    return multi_windows(spark, d).select("win", joined(R.digit_interleave(E.digit_interleave(F.col("x"), F.col("width")), F.col("width"), 2)).alias("values"))


@query(f"WITH {M_ROWS} SELECT win, string_agg(CAST(x AS VARCHAR), ',' ORDER BY idx) || ',null,null' AS values FROM cell WHERE dim = 2 GROUP BY 1")
def parse_json_trunc(spark, d):
    return multi_windows(spark, d).select("win", joined(R.json_format(E.json_format(F.col("x")), 2, 12)).alias("values"))


@query(f"WITH {M_ROWS}, l AS (SELECT win, list(x ORDER BY idx) AS l FROM cell WHERE dim = 2 GROUP BY 1) SELECT win, l[1] AS s1, l[5] AS s5, l[11] AS s11 FROM l")
def parse_json_steps(spark, d):
    m = multi_windows(spark, d).select("win", R.json_steps(E.json_format(F.col("x")), [1, 5, 11], 2).alias("m"))
    return m.select("win", *[F.col("m")[s].alias(f"s{s}") for s in (1, 5, 11)])


@query(f"WITH {win_sql()} SELECT signal_id, win, x[-1] AS value FROM win")
def parse_persistence(spark, d):
    return windowed(spark, d).select("signal_id", "win", R.last_value(F.concat(E.persistence_control(F.col("x")), F.lit(","))).alias("value"))


@query(f"WITH {win_sql()} SELECT signal_id, win, array_to_string(x, ',') AS values FROM win")
def parse_univariate(spark, d):
    return windowed(spark, d).select("signal_id", "win", joined(R.whole(E.univariate_control(F.col("x")))).alias("values"))


ANSWERS = """a AS (SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN '  No anomalies here' WHEN 1 THEN 'Answer: [' || user_id || ', ' || user_id % 50 || ',, 7]' WHEN 2 THEN '[[3, 9], [' || user_id % 20 || ', ' || (user_id % 20 + event_id % 8) || ']]' WHEN 3 THEN '[9, 2] [4]' WHEN 4 THEN 'NO ANOMALY' ELSE 'x [1,2,3] and [4, 6] ' END AS t FROM events)"""
CLEAN = ANSWERS + r""", c AS (SELECT event_id, t, CASE WHEN c LIKE '%no anomalies%' OR c LIKE '%no anomaly%' THEN '' ELSE c END AS c FROM (SELECT event_id, t, regexp_replace(lower(trim(t)), ',+', ',', 'g') AS c FROM a))"""


def answers(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "CASE CAST(event_id % 6 AS INT) WHEN 0 THEN '  No anomalies here' WHEN 1 THEN concat('Answer: [', user_id, ', ', user_id % 50, ',, 7]') WHEN 2 THEN concat('[[3, 9], [', user_id % 20, ', ', user_id % 20 + event_id % 8, ']]') WHEN 3 THEN '[9, 2] [4]' WHEN 4 THEN 'NO ANOMALY' ELSE 'x [1,2,3] and [4, 6] ' END AS t")


@query(f"WITH {CLEAN} SELECT event_id, c FROM c")
def clean_response(spark, d):
    return answers(spark, d).select("event_id", R.clean_response(F.col("t")).alias("c"))


@query(rf"WITH {CLEAN} SELECT event_id, array_to_string([trim(u) FOR u IN string_split(regexp_extract(c, '\[([\d\s,]+)\]', 1), ',') IF trim(u) <> ''], ',') AS v FROM c")
def parse_list(spark, d):
    return answers(spark, d).select("event_id", R.parse_anomaly_response(F.col("t")).alias("v"))


@query(rf"WITH {CLEAN}, g AS (SELECT event_id, [[CAST(trim(u) AS BIGINT) FOR u IN string_split(h, ',') IF trim(u) <> ''] FOR h IN regexp_extract_all(c, '\[([\d\s,]+)\]', 1)] AS g FROM c) SELECT event_id, array_to_string(flatten([range(p[1], p[2] + 1) FOR p IN g IF len(p) = 2]), ',') AS v FROM g")
def parse_intervals(spark, d):
    return answers(spark, d).select("event_id", joined(R.parse_anomaly_response(F.col("t"), True)).alias("v"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE ' ' || user_id END AS response FROM events")
def extract_response(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("prompt only")).otherwise(F.concat(F.lit("prompt [RESPONSE] "), F.col("user_id").cast("string")))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", R.extract_response(raw).alias("response"))


# --- votes and intervals ---------------------------------------------------------------------------

VW, VS, NS = 40, 10, 5
RULED = f"""{win_sql(VW, VS)},
rule AS (SELECT signal_id, win, first_index, s AS sample, x, CASE WHEN list_max(x) > list_min(x) THEN 'Answer: [' || array_to_string(list_sort(list_distinct([t FOR t IN x IF t >= list_max(x) - ((list_max(x) - list_min(x)) * (s + 1)) // 20])), ', ') || ']' ELSE 'no anomalies' END AS response FROM win, (SELECT unnest(range(0, {NS})) AS s)),
named AS (SELECT signal_id, win, first_index, sample, x, [CAST(v AS BIGINT) FOR v IN regexp_extract_all(response, '\\d+')] AS v FROM rule),
vote AS (SELECT signal_id, win, first_index, sample, [i - 1 FOR i IN range(1, len(x) + 1) IF list_contains(v, x[i])] AS positions FROM named)"""
WITHIN = RULED + f", f1 AS (SELECT signal_id, win, first_index, unnest(positions) AS idx FROM vote), found AS (SELECT signal_id, win, first_index, idx FROM f1 GROUP BY 1, 2, 3, 4 HAVING count(*) >= ceil(0.6 * {NS}))"
ACROSS = WITHIN + f", hits AS (SELECT signal_id, first_index + idx AS idx FROM found GROUP BY 1, 2 HAVING count(*) >= ceil(0.5 * {VW} / {VS}))"
MERGE = "n{0} AS (SELECT *, CASE WHEN start <= max(\"end\") OVER (PARTITION BY signal_id ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {1}), i{0} AS (SELECT *, sum(new) OVER (PARTITION BY signal_id ORDER BY start, \"end\") AS island FROM n{0}), {2} AS (SELECT signal_id, min(start) AS start, max(\"end\") AS \"end\", {3} AS severity FROM i{0} GROUP BY signal_id, island)"
PADDED = f"ends AS (SELECT signal_id, min(ts) AS lo, max(ts) AS hi FROM sc GROUP BY 1), pad AS (SELECT h.signal_id, greatest(ts - 2 * {SIX}, lo) AS start, least(ts + 2 * {SIX}, hi) AS \"end\" FROM hits h JOIN sc ON sc.signal_id = h.signal_id AND sc.idx = h.idx JOIN ends ON ends.signal_id = h.signal_id)"
PROMPTER = f"{ACROSS}, {PADDED}, {MERGE.format('p', 'pad', 'anomalies', '0.0::DOUBLE')}"


def ruled(spark, d):
    w = windowed(spark, d, VW, VS)
    return w.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(NS - 1)))).withColumn("response", models.rule_responses(F.col("x"), F.col("sample")))


def voted(spark, d):
    return ruled(spark, d).select("signal_id", "win", "first_index", "sample", votes.val2idx(R.whole(R.parse_anomaly_response(F.col("response"))), F.col("x")).alias("positions"))


@query(f"WITH {RULED} SELECT signal_id, win, sample, array_to_string(positions, ',') AS positions FROM vote")
def val2idx(spark, d):
    return voted(spark, d).select("signal_id", "win", F.col("sample").cast("bigint").alias("sample"), joined(F.col("positions")).alias("positions"))


@query(f"WITH {WITHIN} SELECT signal_id, win, idx FROM found")
def vote_window(spark, d):
    return votes.vote_in_windows(voted(spark, d), 0.6).select("signal_id", "win", "idx")


@query(f"WITH {ACROSS} SELECT signal_id, idx FROM hits")
def vote_merge(spark, d):
    return votes.vote_across_windows(votes.vote_in_windows(voted(spark, d), 0.6), VW, VS, 0.5)


@query(f'WITH {PROMPTER} SELECT signal_id, start, "end", severity FROM anomalies')
def format_anomalies(spark, d):
    return votes.format_anomalies(vote_merge(spark, d), scaled(spark, d), 2)


SPANS = "span AS (SELECT event_type AS signal_id, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + user_id % 900 AS \"end\" FROM events)"


@query(f'WITH {SPANS}, {MERGE.format("sp", "span", "o", "0.0::DOUBLE")} SELECT signal_id, start, "end" FROM o')
def interval_merge(spark, d):
    s = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("signal_id"), F.expr(S.EPOCH.format("ts")).alias("start"), F.col("user_id"))
    return votes.merge_intervals(s.select("signal_id", "start", (F.col("start") + F.col("user_id") % 900).alias("end"))).drop("severity")


# --- forecasts ---------------------------------------------------------------------------------------

FW = 20
PREDS = f"{win_sql(FW, 1)}, pred AS (SELECT signal_id, win, s AS sample, t AS step, CASE WHEN (win + s + t) % 37 = 0 THEN 'NaN'::DOUBLE ELSE x[{FW}] * (1 + s)::DOUBLE / (1 + t) END AS y_hat FROM win, (SELECT unnest(range(0, 2)) AS s), (SELECT unnest(range(0, 3)) AS t))"


def preds(spark, d, holes=True):
    """Persistence forecasts in two samples and three steps, scaled apart, some of them NaN."""
    w = windowed(spark, d, FW, 1).select("signal_id", "win", R.last_value(E.persistence_control(F.col("x"))).alias("v"))
    df = w.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(2))))
    y = F.col("v") * (1 + F.col("sample")).cast("double") / (1 + F.col("step"))
    return df.withColumn("y_hat", F.when((F.col("win") + F.col("sample") + F.col("step")) % 37 == 0, F.lit(float("nan"))).otherwise(y) if holes else y).drop("v")


TEXT_NAN = "CASE WHEN isnan(y_hat) THEN 'NaN' ELSE CAST(CAST(round(y_hat * 1000, 0) AS BIGINT) AS VARCHAR) END"


def _nan_text(c="y_hat", scale=1000.0):
    return F.when(F.isnan(c), F.lit("NaN")).otherwise(F.round(F.col(c) * scale, 0).cast("bigint").cast("string"))


@query(f"WITH {PREDS.replace('% 37 = 0', '< 0')}, q AS (SELECT signal_id, quantile_cont(y_hat, 0.25) AS a, quantile_cont(y_hat, 0.75) AS b FROM pred GROUP BY 1) SELECT p.signal_id, win, sample, step, y_hat < a - 1.5 * (b - a) OR y_hat > b + 1.5 * (b - a) AS removed FROM pred p JOIN q ON p.signal_id = q.signal_id")
def outliers_iqr(spark, d):
    return forecast.outliers(preds(spark, d, False)).select("signal_id", "win", F.col("sample").cast("bigint").alias("sample"), F.col("step").cast("bigint").alias("step"), F.isnan("y_hat").alias("removed"))


def agg_query(agg: str, sql: str, scale: str = "1000"):
    def run(spark, d):
        out = forecast.aggregate_rolling_window(preds(spark, d), 1, agg)
        return out.select("signal_id", "position", _nan_text(scale=float(scale)).alias("y_hat"))

    run.__name__ = f"agg_rolling_{agg}"
    query(f"WITH {PREDS}, g AS (SELECT signal_id, win + step AS position, {sql} AS y_hat FROM pred GROUP BY 1, 2) SELECT signal_id, position, {TEXT_NAN.replace('1000', scale)} AS y_hat FROM g WHERE y_hat IS NOT NULL")(run)


POISON = "CASE WHEN bool_or(isnan(y_hat)) THEN 'NaN'::DOUBLE ELSE {}(y_hat) END"
for _a, _s in (("median", "median"), ("mean", "avg"), ("min", "min"), ("max", "max"), ("sum", "sum"), ("std", "stddev_pop"), ("var", "var_pop")):
    agg_query(_a, POISON.format(_s), "0.01" if _a == "var" else "1000")
for _a, _s in (("nanmedian", "median"), ("nanmean", "avg"), ("nanmin", "min"), ("nanmax", "max")):
    agg_query(_a, f"{_s}(y_hat) FILTER (NOT isnan(y_hat))")


@query(f"WITH {PREDS}, g AS (SELECT signal_id, win, step, median(y_hat) FILTER (NOT isnan(y_hat)) AS y_hat FROM pred GROUP BY 1, 2, 3) SELECT g.signal_id, g.win, g.step, round(g.y_hat - sc.x, 6) AS error FROM g JOIN sc ON sc.signal_id = g.signal_id AND sc.idx = g.win + g.step + {FW}")
def multistep_errors(spark, d):
    t = scaled(spark, d).select("signal_id", F.col("idx"), F.col("x").cast("double").alias("y")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("win", F.col("idx") - F.col("step") - FW)
    return forecast.multistep_errors(preds(spark, d), t).select("signal_id", "win", F.col("step").cast("bigint").alias("step"), F.round("error", 6).alias("error"))


PERSIST = f"{quantised()}, err AS (SELECT a.signal_id, a.idx, a.ts, a.value AS y, b.x * 0.01 + b.minimum AS y_hat, abs(a.value - (b.x * 0.01 + b.minimum)) AS error FROM sc a JOIN sc b ON a.signal_id = b.signal_id AND b.idx = a.idx - 1 WHERE a.idx >= {FW})"


def thresholded(portion=0.3, step=0.1, k=2.0, pad=2):
    return f"""o AS (SELECT signal_id, ts, error, row_number() OVER (PARTITION BY signal_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY signal_id) AS n FROM err),
z AS (SELECT *, CAST(ceil(n * {portion}::DOUBLE) AS BIGINT) AS ws, CAST(ceil(n * {step}::DOUBLE) AS BIGINT) AS st FROM o),
ew AS (SELECT z.*, w FROM z JOIN (SELECT unnest(range(0, 200)) AS w) ON w <= ceil((n - ws) / st) AND i >= w * st AND i < w * st + ws),
th AS (SELECT *, avg(error) OVER (PARTITION BY signal_id, w) AS mean, stddev_pop(error) OVER (PARTITION BY signal_id, w) AS sd FROM ew),
fl AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY signal_id, w ORDER BY i) <= {2 * pad + 1} THEN 0 ELSE 1 END AS g FROM th WHERE error > mean + {k} * sd),
ru AS (SELECT *, sum(g) OVER (PARTITION BY signal_id, w ORDER BY i) AS run FROM fl),
sq AS (SELECT signal_id, greatest(min(i) - {pad}, 0) AS start, least(max(i) + {pad}, max(n) - 1) AS "end", (max(error) - max(mean + {k} * sd)) / (max(mean) + max(sd)) AS severity FROM ru GROUP BY signal_id, w, run),
{MERGE.format('q', 'sq', 'mg', 'max(severity)')},
anomalies AS (SELECT m.signal_id, a.ts AS start, b.ts AS "end", round(m.severity, 6) AS severity FROM mg m JOIN o a ON a.signal_id = m.signal_id AND a.i = m.start JOIN o b ON b.signal_id = m.signal_id AND b.i = m."end")"""


def swept(portion=0.3, step=0.1, pad=2, zs=(1.0, 0.5, 10), least=0.1):
    """Every threshold against every window's rows."""
    lo, by, n = zs
    return f"""o AS (SELECT signal_id, ts, error, row_number() OVER (PARTITION BY signal_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY signal_id) AS n FROM err),
z AS (SELECT *, CAST(ceil(n * {portion}::DOUBLE) AS BIGINT) AS ws, CAST(ceil(n * {step}::DOUBLE) AS BIGINT) AS st FROM o),
ew AS (SELECT z.*, w FROM z JOIN (SELECT unnest(range(0, 200)) AS w) ON w <= ceil((n - ws) / st) AND i >= w * st AND i < w * st + ws),
th AS (SELECT *, avg(error) OVER per AS mean, stddev_pop(error) OVER per AS sd, lag(error) OVER (PARTITION BY signal_id, w ORDER BY i) AS prev FROM ew WINDOW per AS (PARTITION BY signal_id, w)),
tz AS (SELECT th.*, k, mean + ({lo} + k * {by}) * sd AS thr FROM th, (SELECT unnest(range(0, {n})) AS k) WHERE sd > 1e-9 * abs(mean)),
sw AS (SELECT signal_id, w, k, thr, mean, sd, count(*) FILTER (error > thr) AS above, count(*) FILTER (error > thr AND (prev IS NULL OR prev <= thr)) AS runs, avg(error) FILTER (error <= thr) AS rm, stddev_pop(error) FILTER (error <= thr) AS rs, max(error) FILTER (error <= thr) AS below FROM tz GROUP BY 1, 2, 3, 4, 5, 6),
ch AS (SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY signal_id, w ORDER BY round(CASE WHEN above > 0 AND rm IS NOT NULL AND mean <> 0 THEN ((mean - rm) / mean + (sd - rs) / sd) / (above + runs * runs) END, 12) DESC NULLS LAST, k DESC) = 1),
fl AS (SELECT th.*, thr, below, CASE WHEN i - lag(i) OVER (PARTITION BY th.signal_id, th.w ORDER BY i) <= {2 * pad + 1} THEN 0 ELSE 1 END AS g FROM th JOIN ch ON ch.signal_id = th.signal_id AND ch.w = th.w WHERE error > thr),
ru AS (SELECT *, sum(g) OVER (PARTITION BY signal_id, w ORDER BY i) AS run FROM fl),
pk AS (SELECT signal_id, w, min(i) AS a, max(i) AS b, max(error) AS peak, max(thr) AS thr, max(below) AS below, max(mean) AS mean, max(sd) AS sd, max(n) AS n FROM ru GROUP BY signal_id, w, run),
rk AS (SELECT *, row_number() OVER down AS r, (peak - coalesce(lead(peak) OVER down, below, 0)) / greatest(peak, 1e-12) > {least} AS falls FROM pk WINDOW down AS (PARTITION BY signal_id, w ORDER BY peak DESC, a)),
sq AS (SELECT signal_id, greatest(a - {pad}, 0) AS start, least(b + {pad}, n - 1) AS "end", (peak - thr) / (mean + sd) AS severity FROM (SELECT *, max(CASE WHEN falls THEN r END) OVER (PARTITION BY signal_id, w) AS upto FROM rk) WHERE r <= upto),
{MERGE.format('q', 'sq', 'mg', 'max(severity)')},
anomalies AS (SELECT m.signal_id, a.ts AS start, b.ts AS "end", round(m.severity, 6) AS severity FROM mg m JOIN o a ON a.signal_id = m.signal_id AND a.i = m.start JOIN o b ON b.signal_id = m.signal_id AND b.i = m."end")"""


DETECT = {"rolling_window_sequences": {"window_size": FW}, "find_anomalies": {"k": 2.0, "anomaly_padding": 2}}


def _detect(spark, d, spec="mistral_detector", multi=False, **more):
    return Pipeline.load(spec, DETECT | more).run(signals=(S.event_multivariate if multi else S.event_signals)(spark, d))


@query(f"WITH {PERSIST} SELECT signal_id, idx - {FW} AS position, ts, round(error, 6) AS error FROM err")
def regression_errors(spark, d):
    return _detect(spark, d)["errors"].select("signal_id", "position", "ts", F.round("error", 6).alias("error"))


@query(f"""WITH {PERSIST}, ord AS (SELECT signal_id, ts, error, row_number() OVER (PARTITION BY signal_id ORDER BY ts) AS i, 1 - 2.0::DOUBLE / (greatest(1, floor(0.05::DOUBLE * count(*) OVER (PARTITION BY signal_id))) + 1) AS keep FROM err)
SELECT a.signal_id, a.ts, round(sum(b.error * pow(a.keep, a.i - b.i)) / sum(pow(a.keep, a.i - b.i)), 6) AS error FROM ord a JOIN ord b ON a.signal_id = b.signal_id AND b.i <= a.i GROUP BY a.signal_id, a.ts""")
def ewma_errors(spark, d):
    return forecast.regression_errors(_detect(spark, d)["errors"].drop("error"), True, 0.05).select("signal_id", "ts", F.round("error", 6).alias("error"))


@query(f'WITH {PERSIST}, {thresholded()} SELECT signal_id, start, "end", severity FROM anomalies')
def find_anomalies_fixed(spark, d):
    """Over persistence errors without a model stage: the whole plan stays in the JVM."""
    sc = scaled(spark, d)
    y_hat = windowed(spark, d, FW, 1, target_size=1).select("signal_id", "target_ts", R.last_value(E.persistence_control(F.col("x"))).alias("v"))
    rows = y_hat.join(sc.select("signal_id", F.col("ts").alias("target_ts"), F.col("value").alias("y"), "minimum"), ["signal_id", "target_ts"])
    errors = forecast.regression_errors(rows.select("signal_id", F.col("target_ts").alias("ts"), "y", prep.scalar_to_float(F.col("v"), F.col("minimum")).alias("y_hat")))
    return forecast.find_anomalies(errors.select("signal_id", "ts", "error"), 0.3, 0.1, True, 2, 2.0).withColumn("severity", F.round("severity", 6))


@query(f'WITH {PERSIST}, {swept()} SELECT signal_id, start, "end", severity FROM anomalies')
def find_anomalies_dynamic(spark, d):
    return forecast.find_anomalies(_detect(spark, d)["errors"].select("signal_id", "ts", "error"), 0.3, 0.1, False, 2, z_range=(1.0, 6.0, 0.5)).withColumn("severity", F.round("severity", 6))


@query(f'WITH {PERSIST}, {thresholded()} SELECT signal_id, start, "end", severity FROM anomalies')
def pipeline_detector_persistence(spark, d):
    return _detect(spark, d)["anomalies"].select("signal_id", "start", "end", F.round("severity", 6).alias("severity"))


WITHIN_IQR = PERSIST.replace("err AS", "all_err AS") + ", q4 AS (SELECT signal_id, quantile_cont(y_hat, 0.25) AS a, quantile_cont(y_hat, 0.75) AS b FROM all_err GROUP BY 1), err AS (SELECT w.signal_id, w.ts, CASE WHEN y_hat BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN error END AS error FROM all_err w JOIN q4 ON w.signal_id = q4.signal_id)"


@query(f'WITH {WITHIN_IQR}, {thresholded()} SELECT signal_id, start, "end", severity FROM anomalies')
def pipeline_detector_gpt(spark, d):
    return _detect(spark, d, "gpt_detector")["anomalies"].select("signal_id", "start", "end", F.round("severity", 6).alias("severity"))


@query(f'WITH RECURSIVE {buckets()}, {IMPUTED}, {clustered(30)}, err AS (SELECT a.signal_id, a.ts, abs(a.centre - b.centre) AS error FROM near a JOIN near b ON a.signal_id = b.signal_id AND b.idx = a.idx - 1 WHERE a.idx >= {FW}), {thresholded()} SELECT signal_id, start, "end", severity FROM anomalies')
def pipeline_detector_kmeans(spark, d):
    return _detect(spark, d, "mistral_detector_kmeans", float2cluster={"n_clusters": 30})["anomalies"].withColumn("severity", F.round("severity", 6))


FIRST_DIM = PERSIST.replace(quantised(), quantised(sig=SIGM)).replace(f"WHERE a.idx >= {FW}", f"WHERE a.idx >= {FW} AND a.dim = 0 AND b.dim = 0")


@query(f'WITH {FIRST_DIM}, {thresholded()} SELECT signal_id, start, "end", severity FROM anomalies')
def pipeline_detector_multivariate(spark, d):
    return _detect(spark, d, "multivariate_mistral_detector_jsonformat", True, forecast_model={"num_dims": 5})["anomalies"].select("signal_id", "start", "end", F.round("severity", 6).alias("severity"))


@query(f"WITH {PERSIST} SELECT signal_id, idx - {FW} AS position, ts, round(y, 6) AS y, round(y_hat, 6) AS y_hat, round(y - y_hat, 6) AS error FROM err")
def formatter_harness(spark, d):
    return harness.run_pipeline(S.event_signals(spark, d), "persistence_control", window_size=FW).select("signal_id", "position", "ts", *[F.round(c, 6).alias(c) for c in ("y", "y_hat", "error")])


@query(f"""WITH {quantised()}, w AS (SELECT signal_id, idx // 5 AS win, idx + {FW} AS at, x, minimum FROM sc WHERE idx % 5 = 0 AND idx + {FW} + 2 < (SELECT max(idx) + 1 FROM sc m WHERE m.signal_id = sc.signal_id)),
l AS (SELECT w.*, (SELECT x FROM sc b WHERE b.signal_id = w.signal_id AND b.idx = w.at - 1) AS last FROM w)
SELECT l.signal_id, l.win, step, round(last * 0.01 + l.minimum - sc.value, 6) AS error FROM l JOIN (SELECT unnest([1, 3]) AS step) ON true JOIN sc ON sc.signal_id = l.signal_id AND sc.idx = l.at + step - 1""")
def formatter_steps_ahead(spark, d):
    return harness.run_pipeline(S.event_signals(spark, d), "persistence_control", window_size=FW, steps_ahead=[1, 3], stride=5).select("signal_id", "win", "step", F.round("error", 6).alias("error"))


VOTE = {"rolling_window_sequences": {"window_size": VW, "step_size": VS}, "detect_model": {"samples": NS}, "find_anomalies_in_windows": {"alpha": 0.6}, "format_anomalies": {"padding_size": 2}}


def _prompter(spec: str, sql: str | None, normal=False, samples=NS, **more):
    def run(spark, d):
        sig = S.event_signals(spark, d)
        extra = {"normal": S.slice_timestamp(sig, None, 1704672000, "ts")} if normal else {}
        c = Pipeline.load(spec, VOTE | {"detect_model": {"samples": samples}} | more).run(signals=sig, **extra)
        return c["anomalies"].select("signal_id", "start", "end", "severity")

    run.__name__ = {"mistral_prompter": "pipeline_prompter", "gpt_prompter": "pipeline_prompter_gpt"}.get(spec, spec.replace("mistral_", "pipeline_"))
    query(sql)(run)


P_SQL = f'WITH {PROMPTER} SELECT signal_id, start, "end", severity FROM anomalies'
_prompter("mistral_prompter", P_SQL)
_prompter("gpt_prompter", P_SQL)
P1_SQL = P_SQL.replace(f"range(0, {NS})", "range(0, 1)").replace(f"ceil(0.6 * {NS})", "1")
_prompter("mistral_prompter_0shot", P1_SQL, samples=1)
_prompter("mistral_prompter_1shot", P1_SQL, normal=True, samples=1)


SPAN_SQL = f"""{win_sql(VW, VS, sig=SIGM)}, tgt AS (SELECT signal_id, win, first_index, [x[5 * i + 1] FOR i IN range(0, {VW})] AS v FROM win),
hit AS (SELECT signal_id, first_index, [i FOR i IN range(0, {VW}) IF v[i + 1] >= list_max(v) - (list_max(v) - list_min(v)) // 20] AS h FROM tgt),
each AS (SELECT signal_id, first_index + unnest(range(h[1], h[-1] + 1)) AS idx FROM hit),
hits AS (SELECT signal_id, idx FROM each GROUP BY 1, 2 HAVING count(*) >= ceil(0.5 * {VW} / {VS})), {PADDED}, {MERGE.format('p', 'pad', 'anomalies', '0.0::DOUBLE')}"""


@query(f'WITH {SPAN_SQL} SELECT signal_id, start, "end", severity FROM anomalies')
def pipeline_prompter_multivariate(spark, d):
    p = Pipeline.load("mistral_prompter_multivariate_0shot", VOTE | {"detect_model": {"samples": 1, "client": models.RuleClient(num_dims=5)}})
    return p.run(signals=S.event_multivariate(spark, d))["anomalies"].select("signal_id", "start", "end", "severity")


# --- evaluation --------------------------------------------------------------------------------------

TRUTH = f"""tr0 AS (SELECT sc.signal_id, ts AS start, ts + {SIX} AS "end" FROM sc JOIN (SELECT signal_id, max(x) AS top, min(x) AS low FROM sc GROUP BY 1) q ON sc.signal_id = q.signal_id WHERE x >= top - (top - low) // 3), {MERGE.format('t', 'tr0', 'truth', '0')}"""


def truths(spark, d):
    sc = scaled(spark, d)
    q = sc.groupBy("signal_id").agg(F.max("x").alias("top"), F.min("x").alias("low"))
    return votes.merge_intervals(sc.join(q, "signal_id").filter(F.col("x") >= F.col("top") - F.floor((F.col("top") - F.col("low")) / 3)).select("signal_id", F.col("ts").alias("start"), (F.col("ts") + SIX).alias("end"))).drop("severity")


CONF = f"""{PROMPTER}, {TRUTH}, who AS (SELECT signal_id FROM truth UNION SELECT signal_id FROM anomalies),
conf AS (SELECT w.signal_id, (SELECT count(*) FROM truth t WHERE t.signal_id = w.signal_id AND EXISTS (SELECT 1 FROM anomalies p WHERE p.signal_id = t.signal_id AND t.start <= p."end" AND p.start <= t."end")) AS tp,
 (SELECT count(*) FROM anomalies p WHERE p.signal_id = w.signal_id AND NOT EXISTS (SELECT 1 FROM truth t WHERE p.signal_id = t.signal_id AND t.start <= p."end" AND p.start <= t."end")) AS fp,
 (SELECT count(*) FROM truth t WHERE t.signal_id = w.signal_id AND NOT EXISTS (SELECT 1 FROM anomalies p WHERE p.signal_id = t.signal_id AND t.start <= p."end" AND p.start <= t."end")) AS fn FROM who w)"""


def confusion(spark, d):
    return evaluate.contextual_confusion(truths(spark, d), format_anomalies(spark, d))


@query(f"WITH {CONF} SELECT signal_id, tp, fp, fn FROM conf")
def contextual_confusion(spark, d):
    return confusion(spark, d).drop("tn")


@query(f"WITH {CONF} SELECT signal_id, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM conf")
def contextual_scores(spark, d):
    return evaluate.scores(confusion(spark, d), ["precision", "recall", "f1"]).select("signal_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


JOBS = "jobs AS (SELECT 'p' || user_id % 4 AS pipeline, 'd' || event_id % 3 AS dataset, event_type AS signal, event_id % 2 AS iteration, event_id % 5 AS tp, user_id % 3 AS fp, event_id % 7 AS fn FROM events)"


def jobs(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").selectExpr("concat('p', user_id % 4) AS pipeline", "concat('d', event_id % 3) AS dataset", "event_type AS signal", "event_id % 2 AS iteration", "event_id % 5 AS tp", "user_id % 3 AS fp", "event_id % 7 AS fn")


@query(f"WITH {JOBS}, g AS (SELECT pipeline, dataset, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM jobs GROUP BY 1, 2), f AS (SELECT pipeline, dataset, 2 * tp / (2 * tp + fp + fn) AS f1 FROM g) SELECT pipeline, round(max(f1) FILTER (dataset = 'd0'), 6) AS d0, round(max(f1) FILTER (dataset = 'd1'), 6) AS d1, round(max(f1) FILTER (dataset = 'd2'), 6) AS d2 FROM f GROUP BY 1")
def paper_f1_pivot(spark, d):
    return evaluate.paper_table(jobs(spark, d), ["d0", "d1", "d2"]).select("pipeline", *[F.round(c, 6).alias(c) for c in ("d0", "d1", "d2")])


@query(f"WITH {JOBS}, f AS (SELECT pipeline, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM jobs), g AS (SELECT pipeline, avg(f1) AS f1 FROM f GROUP BY 1) SELECT pipeline, round(f1, 6) AS f1, dense_rank() OVER (ORDER BY f1 DESC) AS rank FROM g")
def leaderboard(spark, d):
    return evaluate.leaderboard(evaluate.scores(jobs(spark, d), ["f1"]), ["f1"]).withColumn("f1", F.round("f1", 6))


@query(f"WITH {JOBS}, k AS (SELECT DISTINCT pipeline, dataset, signal, iteration FROM jobs) SELECT * FROM k WHERE NOT (pipeline = 'p1' OR dataset = 'd2')")
def resume_antijoin(spark, d):
    k = jobs(spark, d).select("pipeline", "dataset", "signal", "iteration").distinct()
    return evaluate.pending(k, k.filter("pipeline = 'p1' OR dataset = 'd2'"))


# --- SQL front -----------------------------------------------------------------------------------------

@query(f"WITH {win_sql()} SELECT signal_id, win, first_index, text FROM win")
def sql_windows(spark, d):
    sql.register(spark, S.event_signals(spark, d))
    return spark.sql("SELECT signal_id, win, first_index, text FROM td_windows(every => 21600, size => 40, step => 10)")


@query(f'WITH {PERSIST}, {thresholded()} SELECT signal_id, start, "end", severity FROM anomalies')
def sql_anomalies(spark, d):
    sql.register(spark, S.event_signals(spark, d))
    return spark.sql(f"SELECT signal_id, start, end, round(severity, 6) AS severity FROM td_anomalies(k => 2, padding => 2, portion => 0.3, skip => {FW})")


@query(f'WITH {SPANS}, {MERGE.format("sp", "span", "o", "0.0::DOUBLE")} SELECT signal_id, count(*) AS n, sum("end" - start) AS covered FROM o GROUP BY signal_id')
def sql_merged(spark, d):
    """A function in a query of the caller's."""
    s = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("signal_id"), F.expr(S.EPOCH.format("ts")).alias("start"), F.col("user_id"))
    sql.register(spark, intervals=s.select("signal_id", "start", (F.col("start") + F.col("user_id") % 900).alias("end")))
    return spark.sql("SELECT signal_id, count(*) AS n, sum(end - start) AS covered FROM td_merged() GROUP BY signal_id")


@query(f"WITH {CONF} SELECT signal_id, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM conf")
def sql_scores(spark, d):
    sql.register(spark, truth=truths(spark, d), found=format_anomalies(spark, d))
    return spark.sql("SELECT signal_id, tp, fp, fn, round(f1, 6) AS f1 FROM td_scores(slack => 0)")
