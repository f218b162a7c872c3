"""Pipelines, the front, the model stage, the benchmark and streams."""

import datetime
import json
import random
import sys
import time
import uuid
import zlib
from dataclasses import dataclass
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators import votes
from tidemark.plans import benchmark as B
from tidemark.plans import harness, models
from tidemark.plans.detector import Detector
from tidemark.plans.pipeline import SPECS, Pipeline, resolve
from tidemark.streaming import windows as stream


# workers can't import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def wave(spark):
    v = F.when(F.col("id").between(100, 103), 60.0).otherwise(10 + 5 * F.sin(F.col("id") / 3))
    return spark.range(160).select(F.lit("s").alias("signal_id"), (F.col("id") * 21600).alias("ts"), F.lit(0).alias("dim"), v.alias("value"))


def test_nine_pipelines():
    assert len(SPECS) == 9
    with pytest.raises(ValueError, match="unknown pipeline"):
        resolve("none")


def test_detector_finds_the_bump(spark, wave):
    got = Detector("mistral_detector", window_size=20, hyperparameters={"find_anomalies#1": {"anomaly_padding": 2, "window_size_portion": 1.0}}).detect(wave).collect()
    assert got and all(r.start <= 103 * 21600 and r.end >= 100 * 21600 for r in got)


def test_prompter_finds_the_bump(spark, wave):
    got = Detector("mistral_prompter", window_size=40, hyperparameters={"rolling_window_sequences#1": {"step_size": 10}, "format_anomalies#1": {"padding_size": 1}}).detect(wave).collect()
    assert any(r.start <= 100 * 21600 <= r.end for r in got)


def test_partial_runs_and_zero_decimal(spark, wave):
    d = Detector("mistral_detector", decimal=0)
    assert d.hyperparameters["float2scalar#1"] == {"decimal": 0}
    p = Pipeline.load(d.spec, d.hyperparameters)
    c = p.run(0, 2, signals=wave)
    assert "scaled" in c and "windows" not in c
    assert c["scaled"].agg(F.max("x")).first()[0] == 54  # the wave stays above 5
    assert "windows" in p.run(3, 3)


def test_timestamp_value_frames(spark):
    df = spark.createDataFrame([(21600 * i, float(i)) for i in range(30)], "timestamp long, value double")
    out, c = Detector("mistral_detector", window_size=5).detect(df, visualization=True)
    assert out.columns == ["signal_id", "start", "end", "severity"] and c["errors"].count() == 25


def test_answers_are_asked_once(spark, tmp_path):
    prompts = spark.createDataFrame([("s", 0, "1,2"), ("s", 1, "3,4")], "signal_id string, win long, text string")
    store = str(tmp_path / "answers")
    first = models.ask(prompts.limit(1), models.PersistenceClient(), store, sampling=models.Sampling(samples=2))
    assert first.count() == 2
    again = models.ask(prompts, models.ReplayClient({"3,4": ["9", "8"]}), store, sampling=models.Sampling(samples=2))
    assert sorted(r.response for r in again.collect()) == ["2", "2", "8", "9"]


def test_budgets_and_requests():
    assert models.forecast_budget(9, 5, 3) == 6 and models.detect_budget(10, 0.5) == 5
    c = models.HttpChatClient("http://x", "m", system="S", user="U")
    assert c.request("p", 7, models.Sampling(samples=2, seed=1))["n"] == 2
    assert [m["content"] for m in c.request("p", 7, models.Sampling())["messages"]] == ["S", "U p ,"]
    plain = models.HttpChatClient.for_values("http://x", "m", lambda t: [ord(x) for x in t], chat=False)
    body = plain.request("1,2", 7, models.Sampling())
    assert body["prompt"] == "1,2 ," and set(body["logit_bias"]) == {str(ord(x)) for x in "0123456789,"} and set(body["logit_bias"].values()) == {30}
    assert models.ForecastBudget(5)(plain, "10,20,30") == 15 and models.DetectBudget(0.5)(plain, "10,20,30") == 4
    assert models.ForecastBudget(5, padding=2)(plain, "10,20,30") == 25 and models.ForecastBudget(2)(models.PersistenceClient(), "1" * 40) == 82


class Counting(models.HttpChatClient):
    """Answers with its budget, so that what the stages pass on can be seen."""

    def send(self, body):
        text = body["messages"][1]["content"]
        return {"choices": [{"message": {"content": f"{body['max_tokens']}"}, "logprobs": {"of": text}} for _ in range(body["n"])]}


def test_stages_pass_budgets_and_keep_logprobs(spark, wave):
    given = {"rolling_window_sequences#1": {"window_size": 20}, "forecast_model#1": {"client": Counting("u", "m"), "logprobs": True, "top_logprobs": 2, "samples": 2}}
    c = Pipeline.load("mistral_detector", given).run(0, 5, signals=wave)
    w = {r.win: r.text for r in c["windows"].collect()}
    for r in c["responses"].collect():
        count = len(w[r.win])
        assert int(r.response) == (count + 1) // 20 * 5 and json.loads(r.logprobs)["of"] == f"{w[r.win]} ,"
    c = Pipeline.load("gpt_prompter", {"rolling_window_sequences#1": {"window_size": 20}, "detect_model#1": {"client": Counting("u", "m"), "samples": 1, "anomalous_percent": 0.25}}).run(0, 5, signals=wave)
    w = {r.win: r.text for r in c["windows"].collect()}
    assert all(int(r.response) == len(w[r.win]) // 4 and r.logprobs is None for r in c["responses"].collect())


class Echo(models.RuleClient):
    """Repeats the prompt before its answer, as a local model does."""

    def complete(self, prompts, budgets, sampling):
        assert all(p.endswith("[RESPONSE]") for p in prompts)
        return [[f"{p} [9]" for _ in range(sampling.samples)] for p in prompts]


def test_the_model_sees_the_prompt(spark, wave):
    given = {"rolling_window_sequences#1": {"window_size": 20}, "detect_model#1": {"client": Echo()}}
    c = Pipeline.load("mistral_prompter_0shot", given).run(0, 7, signals=wave)
    assert {r.response for r in c["responses"].collect()} == {"9"}
    # the built-in client looks at the prompt as well
    c = Pipeline.load("mistral_prompter_0shot", {"rolling_window_sequences#1": {"window_size": 20}}).run(0, 7, signals=wave)
    assert c["responses"].filter("response <> ''").count() > 0


#: What the nine pipelines set, stage by stage (fixed values).
SHIPPED = {
    "gpt_detector": {"window_size": 140, "target_size": 1, "space": True, "steps": 5, "remove_outliers": True},
    "mistral_detector": {"window_size": 140, "target_size": 1, "steps": 5},
    "mistral_detector_kmeans": {"n_clusters": 100, "window_size": 140, "target_size": 1, "steps": 5},
    "multivariate_mistral_detector_jsonformat": {"window_size": 140, "target_size": 1, "steps": 5, "encoder": "json_format", "multivariate_allowed_symbols": ["d", ":", ","]},
    "gpt_prompter": {"window_size": 200, "step_size": 40, "space": True, "samples": 10},
    "mistral_prompter": {"window_size": 200, "step_size": 40, "samples": 10, "restrict_tokens": True},
    "mistral_prompter_0shot": {"window_size": 100, "step_size": 40, "samples": 1, "temperature": 0.01},
    "mistral_prompter_1shot": {"window_size": 200, "step_size": 40, "samples": 1, "temperature": 0.01},
    "mistral_prompter_multivariate_0shot": {"window_size": 100, "step_size": 40, "samples": 1, "temperature": 0.01, "multivariate": True, "interval": True},
}
FORECASTS = {"trunc": 1, "errors": "coerce", "window_size_portion": 0.3, "window_step_size_portion": 0.1, "fixed_threshold": True}


@pytest.mark.parametrize("name", SHIPPED)
def test_shipped_parameters(name):
    got = {k: v for params in SPECS[name]["params"].values() for k, v in params.items()}
    assert got == SHIPPED[name] | (FORECASTS if "detector" in name else {"alpha": 0.4, "beta": 0.5})


def test_rule_client_matches_its_column(spark):
    x = F.array(*[F.array(F.lit(v).cast("bigint")) for v in (1, 100, 97, 5)])
    got = [spark.range(1).select(models.rule_responses(x, F.lit(s)).alias("r")).first()["r"] for s in (0, 1)]
    assert got == models.RuleClient().complete(["1,100,97,5"], [0], models.Sampling(samples=2))[0]


def test_harness(spark, wave):
    assert harness.run_pipeline(wave, "persistence_control", window_size=20).count() == 140
    with pytest.raises(ValueError, match="binning"):
        harness.run_pipeline(wave, "json_format", "binning")
    with pytest.raises(ValueError, match="strategy"):
        harness.run_pipeline(wave, "json_format", "luck")


@dataclass
class Ramp:
    """Answers with values of the first dimension that rise by one each step."""

    def complete(self, prompts, budgets, sampling):
        last = [int(p.rsplit("d0:", 1)[1].split(",")[0]) for p in prompts]
        return [[",".join(f"d0:{v + s + k}" for s in range(1, 4)) for k in range(sampling.samples)] for v in last]


def test_harness_for_several_steps(spark):
    sig = spark.range(40).select(F.lit("s").alias("signal_id"), (F.col("id") * 21600).alias("ts"), F.lit(0).alias("dim"), (F.col("id") * 0.01 + 5).alias("value"))
    got = harness.run_pipeline(sig, "json_format", window_size=10, steps_ahead=[1, 3, 4], stride=5, client=Ramp(), samples=3).collect()
    # three samples, 0, 0.01 and 0.02 too high: the median is one too high; the fourth step has no answer
    assert {(r.step, r.error) for r in got if r.step < 4} == {(1, 0.01), (3, 0.01)} and {r.win for r in got} == set(range(6))
    assert all(r.error is None or r.error != r.error for r in got if r.step == 4)
    z = harness.run_pipeline(sig, "persistence_control", window_size=10, normalize=True)
    assert abs(z.agg(F.avg("error")).first()[0] - 1 / 11.69) < 0.01
    with pytest.raises(ValueError, match="several steps"):
        harness.run_pipeline(sig, "value_interleave", steps_ahead=[1])


def test_hyperparameters(tmp_path):
    assert B.hyperparameters({"d": {"p": {"a": 1}}}, "d", "p") == {"a": 1}
    (tmp_path / "f.json").write_text(json.dumps({"b": 2}))
    assert B.hyperparameters(str(tmp_path / "f.json"), "d", "p") == {"b": 2}
    assert B.hyperparameters(None, "d", "p", str(tmp_path)) == {}
    k = "time_segments_aggregate"
    assert B.few_shot({f"{k}#1": 1, f"{k}#3": 3}) == {f"{k}#1": 1, f"{k}#2": 1, f"{k}#3": 3, f"{k}#4": 3}
    assert B.few_shot(None) == {}


def test_benchmark_resumes_and_keeps_errors(spark, wave, tmp_path):
    truth = spark.createDataFrame([("s", 100 * 21600, 103 * 21600)], "signal_id string, start long, end long")
    given = {"rolling_window_sequences#1": {"window_size": 20}, "find_anomalies#1": {"window_size_portion": 1.0, "anomaly_padding": 2}}
    cache = str(tmp_path / "scores")
    board = B.benchmark(spark, {"d": (wave, truth)}, ["mistral_detector", "nonsense"], given, cache_dir=cache)
    rows = {r.pipeline: r for r in board.collect()}
    assert rows["mistral_detector"].f1 == 1 and rows["mistral_detector"]["rank"] == 1 and rows["nonsense"].f1 == 0
    n = spark.read.parquet(cache).count()
    B.benchmark(spark, {"d": (wave, truth)}, ["mistral_detector"], given, cache_dir=cache, resume=True)
    assert spark.read.parquet(cache).count() == n


class Picky(models.PersistenceClient):
    """Fails at a prompt that begins with a large value."""

    def complete(self, prompts, budgets, sampling):
        if any(int(p.split(",")[0]) > 9000 for p in prompts):
            raise RuntimeError("a bad prompt")
        return super().complete(prompts, budgets, sampling)


def test_one_bad_signal_spares_the_others_and_is_run_again(spark, wave, tmp_path):
    bad = wave.withColumn("signal_id", F.lit("bad")).withColumn("value", F.when(F.col("ts") == 0, 104.0).otherwise(F.col("value")))
    four = wave.unionByName(bad)
    for k in range(2):
        four = four.unionByName(wave.withColumn("signal_id", F.lit(f"s{k}")))
    truth = spark.createDataFrame([(s, 100 * 21600, 103 * 21600) for s in ("s", "s0", "s1", "bad")], "signal_id string, start long, end long")
    given = {"rolling_window_sequences#1": {"window_size": 20}, "find_anomalies#1": {"window_size_portion": 1.0, "anomaly_padding": 2}}
    cache, found = str(tmp_path / "scores"), str(tmp_path / "found")
    run = lambda sig, client, **kw: B.benchmark(spark, {"d": (sig, truth)}, ["mistral_detector"], given, cache_dir=cache, anomaly_dir=found, resume=True, forecast_model=client, **kw)
    run(four, Picky())
    rows = {r.signal: r for r in spark.read.parquet(cache).collect()}
    assert {s for s, r in rows.items() if r.status == "OK" and r.f1 == 1} == {"s", "s0", "s1"} and rows["bad"].status == "ERROR" and rows["bad"].f1 == 0
    assert spark.read.csv(f"{found}/mistral_detector_d_0", header=True).select("signal_id").distinct().count() == 3
    # resumed with a client that can: the bad signal and a new one are run, the others aren't
    run(four.unionByName(wave.withColumn("signal_id", F.lit("new"))), models.PersistenceClient(), workers=2)
    again = spark.read.parquet(cache).groupBy("signal").count().collect()
    assert {r.signal: r["count"] for r in again} == {"s": 1, "s0": 1, "s1": 1, "bad": 2, "new": 1}
    assert run(four, Picky()).first().f1 > 0.7
    assert B.benchmark(spark, {}, []).count() == 0


def test_bad_signals_cost_no_run_and_are_logged(spark, wave, tmp_path, caplog, monkeypatch):
    """3 of 12 signals fail: one plan, each one's exception in the log, times by signal."""
    many = None
    for k in range(12):
        one = wave.withColumn("signal_id", F.lit(f"s{k:02}"))
        one = one.withColumn("value", F.when(F.col("ts") == 0, 104.0).otherwise(F.col("value"))) if k % 4 == 1 else one
        many = one if many is None else many.unionByName(one)
    truth = spark.createDataFrame([(f"s{k:02}", 100 * 21600, 103 * 21600) for k in range(12)], "signal_id string, start long, end long")
    given = {"rolling_window_sequences#1": {"window_size": 20}, "find_anomalies#1": {"window_size_portion": 1.0, "anomaly_padding": 2}, "forecast_model#1": {"retry": models.Retry(1)}}
    runs = []
    detect = B.Detector.detect
    monkeypatch.setattr(B.Detector, "detect", lambda self, *a, **b: runs.append(1) or detect(self, *a, **b))
    rows = {r.signal: r for r in B.evaluate_dataset("mistral_detector", "d", many, truth, given, 0, "r", forecast_model=Picky()).collect()}
    assert len(runs) == 1 and len(rows) == 12
    bad = {s for s, r in rows.items() if r.status == "ERROR"}
    assert bad == {"s01", "s05", "s09"} and all(rows[s].f1 == 0 for s in bad) and all(rows[s].status == "OK" and rows[s].f1 == 1 for s in rows.keys() - bad)
    assert all(any(s in r.getMessage() and "RuntimeError: a bad prompt" in r.getMessage() for r in caplog.records) for s in bad)
    assert all(r.elapsed > 0 for r in rows.values()) and len({r.elapsed for r in rows.values()}) > 1


class Flaky(models.HttpChatClient):
    """Every tenth request fails; those that were answered are noted in a folder."""

    def send(self, body):
        folder = Path(self.url)
        n = len(list(folder.iterdir()))
        name = zlib.crc32(body["messages"][1]["content"].encode())
        if not (folder / f"try-{name}").exists() and name % 10 < 2 or (folder / "off").exists() and name % 3 == 0:
            (folder / f"try-{name}").touch()
            raise OSError("the line is down")
        (folder / f"ok-{name}-{n}-{uuid.uuid4()}").touch()
        return {"choices": [{"message": {"content": "1"}}] * body["n"]}


def test_a_failing_prompt_costs_no_other_its_answer(spark, tmp_path):
    folder, store = tmp_path / "asked", str(tmp_path / "store")
    folder.mkdir()
    (folder / "off").touch()
    prompts = spark.range(60).select(F.col("id").alias("win"), F.concat(F.lit("p"), "id").alias("text")).repartition(3)
    client, once = Flaky(str(folder), "m"), models.Retry(2, 0.01, 4)
    # some prompts fail all tries: they are named, all others are in the store
    with pytest.raises(models.ModelError, match="the line is down"):
        models.ask(prompts, client, store, chunk=25, retry=once)
    had = {r.win for r in spark.read.parquet(store).collect()}
    assert 20 < len(had) < 60 and len(list(Path(store).glob("*.parquet"))) >= 3
    kept = models.ask(prompts, client, store, "keep", chunk=25, retry=once).collect()
    assert {r.win for r in kept if r.error} == set(range(60)) - had and all(r.response is None for r in kept if r.error)
    # the line is up again: only what has no answer is asked
    (folder / "off").unlink()
    assert {(r.win, r.response) for r in models.ask(prompts, client, store, chunk=25, retry=once).collect()} == {(i, "1") for i in range(60)}
    asked = [f.name.split("-")[1] for f in folder.iterdir() if f.name.startswith("ok-")]
    assert len(asked) == len(set(asked)) == 60
    assert len(models.ask(prompts, client, store, retry=once).collect()) == 60
    assert sum(f.name.startswith("ok-") for f in folder.iterdir()) == 60


def test_a_batch_that_fails_is_asked_prompt_by_prompt(spark):
    prompts = spark.createDataFrame([(1, "9500,1"), (2, "5,6"), (3, "7,8")], "win long, text string").coalesce(1)
    got = {r.win: r for r in models.ask(prompts, Picky(), on_error="keep", retry=models.Retry(2, 0.0)).collect()}
    assert got[1].error == "RuntimeError: a bad prompt" and (got[2].response, got[3].response) == ("6", "8") and got[2].error is None
    with pytest.raises(models.ModelError):
        models.ask(prompts, Picky(), retry=models.Retry(1))
    with pytest.raises(ValueError, match="on_error"):
        models.ask(prompts, Picky(), on_error="ignore")


class _Ids(dict):
    def to(self, device):
        return self


class FakeTokenizer:
    """A token a character, its code point; 0 pads."""

    pad_token, eos_token, eos_token_id, padding_side = None, "<e>", 1, "right"

    def __call__(self, prompts, return_tensors=None, padding=False):
        import numpy as np

        assert self.padding_side == "left" and self.pad_token == "<e>"
        width = max(map(len, prompts))
        return _Ids(input_ids=np.array([[0] * (width - len(p)) + [ord(c) for c in p] for p in prompts]))

    def batch_decode(self, rows, skip_special_tokens=True, clean_up_tokenization_spaces=True):
        return ["".join(chr(x) for x in r if x > 1) for r in rows]


class FakeModel:
    device, calls = "cpu", 0

    def generate(self, input_ids, max_new_tokens, num_return_sequences, **kw):
        import numpy as np

        FakeModel.calls += 1
        assert kw["renormalize_logits"] and kw["bad_words_ids"] == [[7]]
        new = np.array([[ord(str(s)) for _ in range(max_new_tokens)] for _ in range(len(input_ids)) for s in range(num_return_sequences)])
        return np.hstack([np.repeat(input_ids, num_return_sequences, axis=0), new])


def test_a_local_model_takes_prompts_together_and_gives_its_tokens():
    client = models.LocalCausalClient("m", at_once=2)
    client._loaded = FakeTokenizer(), FakeModel(), [[7]]
    got = client.complete_raw(["1,2", "3", "45"], [2, 3, 1], models.Sampling(samples=2))
    assert [[t for t, _ in row] for row in got] == [["00", "11"], ["000", "111"], ["0", "1"]] and FakeModel.calls == 2
    assert got[1][1][1] == [0, 0, ord("3"), 49, 49, 49] and got[2][0][1] == [ord("4"), ord("5"), 48]
    assert client.complete(["9"], [1], models.Sampling()) == [["0"]]
    client.restrict_tokens = False
    assert client.complete(["9"], [2], models.Sampling()) == [["900"]]


class RawClient(models.PersistenceClient):
    def complete_raw(self, prompts, budgets, sampling):
        return [[(a, [1, 2]) for a in row] for row in self.complete(prompts, budgets, sampling)]


def test_stages_take_raw(spark, wave):
    for raw in (True, False):
        c = Pipeline.load("mistral_detector", {"rolling_window_sequences#1": {"window_size": 20}, "forecast_model#1": {"client": RawClient(), "raw": raw}}).run(0, 5, signals=wave)
        assert {r.raw for r in c["responses"].collect()} == ({"[1, 2]"} if raw else {None})


def test_an_answer_that_is_no_number_takes_its_signal_out(spark, wave):
    class Words(models.PersistenceClient):
        def complete(self, prompts, budgets, sampling):
            return [["what?" if "9500" in p.split(",")[0] else a[0]] for p, a in zip(prompts, super().complete(prompts, budgets, sampling), strict=True)]

    two = wave.unionByName(wave.withColumn("signal_id", F.lit("t")).withColumn("value", F.when(F.col("ts") == 0, 100.0).otherwise(F.col("value"))))
    given = {"rolling_window_sequences#1": {"window_size": 20}, "format_as_integer#1": {"errors": "raise"}}
    found, failed, _, _ = B.detected("mistral_detector", given, two, None, {"forecast_model": Words()})
    first = Pipeline.load("mistral_detector", given).run(0, 4, signals=two)["windows"].filter("win = 0").collect()
    wrong = {r.signal_id for r in first if "9500" in r.text.split(",")[0]}
    assert {r.signal_id for r in failed.collect()} == wrong and not any(r.signal_id in wrong for r in found.collect())


def test_command_line(spark, wave, tmp_path):
    wave.write.parquet(str(tmp_path / "w_signals.parquet"))
    spark.createDataFrame([("s", 100 * 21600, 103 * 21600)], "signal_id string, start long, end long").write.parquet(str(tmp_path / "w_truth.parquet"))
    out = B.main(["--data", str(tmp_path), "-p", "mistral_detector", "-w", "2", "-o", str(tmp_path / "o"), "-c", str(tmp_path / "c"), "-ad", str(tmp_path / "a")])
    assert out.count() == 1 and spark.read.parquet(str(tmp_path / "c")).count() == 1 and (tmp_path / "a" / "mistral_detector_w_0").exists()


def test_streams(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("s", k * 4 + i, float(k * 4 + i)) for i in range(4)], "signal_id string, idx long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    timed = spark.readStream.schema("signal_id string, idx long, value double").parquet(str(tmp_path / "in")).withColumn("time", F.timestamp_seconds(F.col("idx") * 3600))
    q = stream.stream_buckets(timed, "6 hours").writeStream.format("memory").queryName("b").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.sql("select * from b").collect()) == [2.5, 8.5]


def test_a_shuffled_stream_gives_the_windows_of_the_table(spark, tmp_path):
    rows = [("ab"[k % 2], datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k), float(k)) for k in range(240)]
    # shuffled within 30 minutes, dealt over files, and a row far ahead that moves the watermark past all
    parts = [rows[k : k + 30] for k in range(0, 240, 30)]
    for k, p in enumerate(parts):
        random.Random(k).shuffle(p)
    ordered = [r for p in parts for r in p]
    end = [(s, datetime.datetime(2024, 1, 3), -1.0) for s in "ab"] + [(s, datetime.datetime(2024, 1, 5), -2.0) for s in "ab"]
    schema, folder = "signal_id string, time timestamp, value double", tmp_path
    for p in [ordered[j : j + 30] for j in range(0, 240, 30)] + [end[:2], end[2:]]:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        time.sleep(1.1)  # files are read by age
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = stream.stream_windows(src, 7, 3, "1 hour").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(folder / "cp")).option("path", str(folder / "out")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.signal_id, r.first_index, r.x) for r in spark.read.parquet(str(folder / "out")).collect())
    want = []
    for s in "ab":
        v = [x for n, _, x in rows if n == s] + [-1.0]
        want += [(s, i, v[i : i + 7]) for i in range(0, len(v) - 6, 3)]
    assert got == sorted(want)


def test_a_shuffled_stream_gives_the_intervals_of_the_table(spark, tmp_path):
    r = random.Random(3)
    base = 1_704_067_200
    rows = [("ab"[r.randrange(2)], base + 60 * k, base + 60 * k + r.randint(0, 200)) for k in range(300)]
    table = spark.createDataFrame(rows, "signal_id string, start long, end long")
    want = sorted((x.signal_id, x.start, x.end) for x in votes.merge_intervals(table).collect())
    last = [(s, base + 10**6, base + 10**6) for s in "ab"] + [(s, base + 2 * 10**6, base + 2 * 10**6) for s in "ab"]
    schema = "signal_id string, start long, end long"
    for p in [sorted(rows[j : j + 50], key=lambda _: r.random()) for j in range(0, 300, 50)] + [last[:2], last[2:]]:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("time", F.timestamp_seconds("start"))
    q = stream.stream_intervals(src, "2 hours").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((x.signal_id, x.start, x.end) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [x for x in got if x[1] < base + 10**6] == want
