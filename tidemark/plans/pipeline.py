"""Pipelines: ordered stages over a context of named DataFrames, with hyperparameters keyed stage#k."""

from __future__ import annotations

import copy
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encode, parse
from ..operators import forecast, prep, votes, windows
from ..tables import save
from . import models

STAGES: dict[str, Callable] = {}


def stage(f: Callable) -> Callable:
    """Registers f(context, **params) -> {name: DataFrame or value} under its name; a plan may name any registered stage."""
    STAGES[f.__name__] = f
    return f


#: Frames that several later stages read: run() writes each once.
SHARED = ("samples", "scaled", "windows", "errors")


@stage
def time_segments_aggregate(c, interval=21600, method="mean", source="signals", out="samples"):
    return {out: prep.time_segments_aggregate(c[source], interval, method)}


@stage
def impute(c, strategy="mean", source="samples", out="samples"):
    return {out: prep.impute(c[source], strategy)}


@stage
def float2scalar(c, decimal=2, rescale=True, source="samples", out="scaled"):
    df = prep.float_to_scalar(c[source], None, decimal, rescale)
    return {out: df if rescale else df.withColumn("minimum", F.lit(0.0)), "decimal": decimal}


@stage
def float2cluster(c, n_clusters=100, fit_fraction=1.0, source="samples", out="scaled"):
    return {out: prep.float_to_cluster(c[source], prep.fit_cluster(c[source], n_clusters, fit_fraction))}


@stage
def rolling_window_sequences(c, window_size=140, step_size=1, target_size=0, target_column=0):
    return {"windows": windows.rolling_window_sequences(windows.rows_of_dims(c["scaled"]), window_size, step_size, target_size, target_column), "window_size": window_size, "step_size": step_size, "target_column": target_column}


@stage
def format_as_string(c, sep=",", space=False, encoder="plain", target_column=0, digits_per_timestamp=3):
    w, width = c["windows"], None
    if encoder in ("value_interleave", "digit_interleave"):
        w = w.join(w.groupBy("signal_id").agg(F.greatest(F.lit(digits_per_timestamp), F.max(encode.digits_needed(F.col("x")))).alias("width")), "signal_id")
        width = F.col("width")
    text = encode.format_as_string(F.col("x"), sep, space) if encoder == "plain" else encode.ENCODERS[encoder](F.col("x"), width, target_column, sep)
    return {"windows": w.withColumn("text", text), "encoder": encoder, "sep": sep}


@stage
def normal_as_string(c, interval=21600, decimal=2, sep=",", space=False):
    """The one-shot branch: the normal signal scaled by its own minimum, as one text."""
    own = prep.float_to_scalar(prep.impute(prep.time_segments_aggregate(c["normal"], interval)), None, decimal)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "dim", "x"))), lambda s: s["x"].cast("string")), sep)
    return {"normal_text": own.groupBy("signal_id").agg((encode.spaced(line) if space else line).alias("normal"))}


@stage
def prompt(c, system="", user="", one_shot="", marker="[RESPONSE]", multivariate=False):
    w = c["windows"]
    if multivariate:
        return {"windows": w.withColumn("prompt", encode.multivariate_prompt(F.col("text"), system, user, marker)), "marker": marker}
    if "normal_text" in c:
        w = w.join(c["normal_text"], "signal_id", "left")
    return {"windows": w.withColumn("prompt", encode.prompt(F.col("text"), system, user, one_shot, F.col("normal") if "normal_text" in c else None, marker)), "marker": marker}


@stage
def normalize(c, source="samples", out="samples"):
    return {out: prep.normalize(c[source])}


def _put(c: dict, asked: DataFrame, client, store, retry, sampling, budget) -> dict:
    """The model's answers. With on_error of keep, signals with a prompt that has none go, and failed says why; seconds is the model's time by signal."""
    keep, began = c.get("on_error") == "keep", time.perf_counter()
    got = models.ask(asked, client, store, "keep" if keep else "raise", sampling=sampling, budget=budget, **({} if retry is None else {"retry": retry}))
    if not keep:
        return {"responses": got}
    took = got.groupBy("signal_id").agg(F.sum(F.when(F.col("sample") == 0, F.col("seconds"))).alias("seconds"))
    return _without(c, got, got.filter("error IS NOT NULL").select("signal_id", "error")) | {"seconds": took, "model_wall": time.perf_counter() - began}


def _without(c: dict, responses: DataFrame, bad: DataFrame) -> dict:
    """Responses without the signals of bad, which join what has failed before."""
    bad = bad.groupBy("signal_id").agg(F.min("error").alias("error"))
    return {"responses": responses.join(bad, "signal_id", "left_anti"), "failed": c["failed"].unionByName(bad) if "failed" in c else bad}


@stage
def forecast_model(c, client=None, samples=1, steps=1, num_dims=1, store=None, padding=None, multivariate_allowed_symbols=(), retry=None, **sampling):
    """M1, M2. The budget of an answer follows from the prompt's tokens, its values and steps."""
    client = client or models.PersistenceClient(c["sep"], steps, num_dims)
    if multivariate_allowed_symbols and hasattr(client, "allowed_symbols"):
        client = replace(client, allowed_symbols=tuple(multivariate_allowed_symbols))
    asked = c["windows"].select("signal_id", "win", "first_index", "text")
    return _put(c, asked, client, store, retry, models.Sampling(samples=samples, **sampling), models.ForecastBudget(steps, c["sep"], padding))


@stage
def detect_model(c, client=None, samples=1, store=None, anomalous_percent=0.5, restrict_tokens=None, retry=None, **sampling):
    """M3, M4. The model sees the prompt where the pipeline makes one, else the text; of an answer that repeats the prompt, what follows the marker counts."""
    w, client = c["windows"], client or models.RuleClient()
    if restrict_tokens is not None and hasattr(client, "restrict_tokens"):
        client = replace(client, restrict_tokens=restrict_tokens)
    asked = w.select("signal_id", "win", "first_index", F.col("prompt" if "prompt" in w.columns else "text").alias("text"))
    put = _put(c, asked, client, store, retry, models.Sampling(samples=samples, **sampling), models.DetectBudget(anomalous_percent))
    got = put["responses"]
    if "prompt" in w.columns:
        marker = c.get("marker", "[RESPONSE]")
        got = got.withColumn("response", F.when(F.col("response").contains(marker), parse.extract_response(F.col("response"), marker)).otherwise(F.col("response")))
    return put | {"responses": got}


@stage
def format_as_integer(c, sep=",", trunc=1, errors="coerce", num_dims=1, target_column=0):
    r, kind, more = c["responses"], c.get("encoder", "plain"), {}
    if errors == "raise" and kind == "plain" and c.get("on_error") == "keep":
        wrong = F.exists(parse.string_to_numbers(F.col("response"), sep, None, "coerce"), F.isnan)
        more, errors = _without(c, r, r.filter(wrong).select("signal_id", F.concat(F.lit("not numbers: "), "response").alias("error"))), "coerce"
        r = more["responses"]
    if kind in ("value_interleave", "digit_interleave"):
        r = r.join(c["windows"].select("signal_id", "width").distinct(), "signal_id")
        v = getattr(parse, kind)(F.col("response"), F.col("width"), target_column, trunc, sep)
    elif kind == "json_format":
        v = parse.json_format(F.col("response"), target_column, trunc)
    elif kind == "value_concatenation":
        v = parse.value_concatenation(F.col("response"), num_dims, target_column, trunc, sep)
    elif kind == "persistence_control":
        v = F.array(parse.last_value(F.col("response"), sep))
    else:
        v = parse.string_to_numbers(F.col("response"), sep, trunc, errors)
    return more | {"predictions": r.select("signal_id", "win", "sample", F.posexplode(v).alias("step", "y_hat")).withColumn("y_hat", F.col("y_hat").cast("double"))}


@stage
def scalar2float(c):
    low = c["scaled"].select("signal_id", "minimum").distinct()
    return {"predictions": c["predictions"].join(low, "signal_id").withColumn("y_hat", prep.scalar_to_float(F.col("y_hat"), F.col("minimum"), c["decimal"])).drop("minimum")}


@stage
def cluster2float(c):
    centres = c["scaled"].filter(F.col("dim") == c.get("target_column", 0)).select("signal_id", "centroids").distinct()
    return {"predictions": c["predictions"].join(centres, "signal_id").withColumn("y_hat", F.when(~F.isnan("y_hat"), prep.cluster_to_float(F.col("y_hat").cast("int"), F.col("centroids"))).otherwise(F.col("y_hat"))).drop("centroids")}


@stage
def aggregate_rolling_window(c, agg="median", remove_outliers=False):
    return {"forecasts": forecast.aggregate_rolling_window(c["predictions"], 1, agg, remove_outliers)}


@stage
def regression_errors(c, smooth=False):
    """Position p of the forecasts is sample window_size + p; errors are in the units of the signal."""
    actual = c["scaled"].filter(F.col("dim") == c.get("target_column", 0))
    y = F.col("value") if "minimum" in actual.columns else prep.cluster_to_float(F.col("x"), F.col("centroids"))
    truth = actual.select("signal_id", (F.col("idx") - c["window_size"]).alias("position"), "ts", y.alias("y"))
    return {"errors": forecast.regression_errors(c["forecasts"].join(truth, ["signal_id", "position"]), smooth)}


@stage
def find_anomalies(c, **params):
    return {"anomalies": forecast.find_anomalies(c["errors"].select("signal_id", "ts", "error"), **params)}


@stage
def parse_anomaly_response(c, interval=False):
    return {"responses": c["responses"].withColumn("response", parse.parse_anomaly_response(F.col("response"))) if not interval else c["responses"], "interval": interval}


@stage
def positions(c, sep=","):
    """R2 and I1, or the positions that the responses name themselves."""
    r = c["responses"]
    if c.get("interval"):
        return {"votes": r.select("signal_id", "win", "first_index", "sample", parse.parse_anomaly_response(F.col("response"), True, c["window_size"] - 1).alias("positions"))}
    x = c["windows"].select("signal_id", "win", "x")
    return {"votes": r.join(x, ["signal_id", "win"]).select("signal_id", "win", "first_index", "sample", votes.val2idx(parse.whole(F.col("response"), sep), F.col("x")).alias("positions"))}


@stage
def find_anomalies_in_windows(c, alpha=0.5):
    return {"found": votes.vote_in_windows(c["votes"], alpha)}


@stage
def merge_anomalous_sequences(c, beta=0.5):
    return {"idx": votes.vote_across_windows(c["found"], c["window_size"], c["step_size"], beta)}


@stage
def format_anomalies(c, padding_size=50):
    return {"anomalies": votes.format_anomalies(c["idx"], c["scaled"], padding_size)}


#: Stages that read a shared frame once and put another in its place, or write it themselves.
REPLACES = {"samples": ("impute", "normalize"), "windows": ("format_as_string", "prompt"), "errors": ("find_anomalies",)}

HEAD = ["time_segments_aggregate", "impute"]
FORECAST_TAIL = ["aggregate_rolling_window", "regression_errors", "find_anomalies"]
VOTE_TAIL = ["positions", "find_anomalies_in_windows", "merge_anomalous_sequences", "format_anomalies"]
DETECT = {"rolling_window_sequences#1": {"window_size": 140, "target_size": 1}, "forecast_model#1": {"steps": 5}, "format_as_integer#1": {"trunc": 1, "errors": "coerce"}, "find_anomalies#1": {"window_size_portion": 0.3, "window_step_size_portion": 0.1, "fixed_threshold": True}}
VOTE = {"rolling_window_sequences#1": {"window_size": 200, "step_size": 40}, "detect_model#1": {"samples": 10}, "find_anomalies_in_windows#1": {"alpha": 0.4}, "merge_anomalous_sequences#1": {"beta": 0.5}}


def _spec(middle: list[str], tail: list[str], params: dict, **more: dict) -> dict:
    merged = copy.deepcopy(params)
    for k, v in more.items():
        merged.setdefault(f"{k}#1", {}).update(v)
    return {"stages": [*HEAD, *middle, *tail], "params": merged}


_SCALED = ["float2scalar", "rolling_window_sequences", "format_as_string", "forecast_model", "format_as_integer", "scalar2float"]
_VOTED = ["float2scalar", "rolling_window_sequences", "format_as_string", "detect_model", "parse_anomaly_response"]
_PROMPTED = ["float2scalar", "rolling_window_sequences", "format_as_string", "prompt", "detect_model", "parse_anomaly_response"]

#: The nine shipped pipelines: four that forecast and five that name anomalies.
SPECS = {
    "gpt_detector": _spec(_SCALED, FORECAST_TAIL, DETECT, format_as_string={"space": True}, aggregate_rolling_window={"remove_outliers": True}),
    "mistral_detector": _spec(_SCALED, FORECAST_TAIL, DETECT),
    "mistral_detector_kmeans": _spec(["float2cluster", *_SCALED[1:-1], "cluster2float"], FORECAST_TAIL, DETECT, float2cluster={"n_clusters": 100}),
    "multivariate_mistral_detector_jsonformat": _spec(_SCALED, FORECAST_TAIL, DETECT, format_as_string={"encoder": "json_format"}, forecast_model={"multivariate_allowed_symbols": ["d", ":", ","]}),
    "gpt_prompter": _spec(_VOTED, VOTE_TAIL, VOTE, format_as_string={"space": True}),
    "mistral_prompter": _spec(_PROMPTED, VOTE_TAIL, VOTE, detect_model={"restrict_tokens": True}),
    "mistral_prompter_0shot": _spec(_PROMPTED, VOTE_TAIL, VOTE, rolling_window_sequences={"window_size": 100}, detect_model={"samples": 1, "temperature": 0.01}),
    "mistral_prompter_1shot": _spec(["float2scalar", "normal_as_string", *_PROMPTED[1:]], VOTE_TAIL, VOTE, detect_model={"samples": 1, "temperature": 0.01}),
    "mistral_prompter_multivariate_0shot": _spec(_PROMPTED, VOTE_TAIL, VOTE, rolling_window_sequences={"window_size": 100}, prompt={"multivariate": True}, parse_anomaly_response={"interval": True}, detect_model={"samples": 1, "temperature": 0.01}),
}


def resolve(spec: str | dict) -> dict:
    """A dict, the name of a shipped pipeline, or a JSON file."""
    if isinstance(spec, dict):
        return copy.deepcopy(spec)
    if spec in SPECS:
        return copy.deepcopy(SPECS[spec])
    if Path(spec).exists():
        return json.loads(Path(spec).read_text())
    raise ValueError(f"unknown pipeline {spec!r}")


@dataclass
class Pipeline:
    spec: dict
    context: dict = field(default_factory=dict)

    @classmethod
    def load(cls, spec: str | dict, hyperparameters: dict | None = None) -> Pipeline:
        s = resolve(spec)
        for k, v in (hyperparameters or {}).items():
            name = k if "#" in k else f"{k}#1"
            s["params"].setdefault(name, {}).update(v)
        return cls(s)

    def run(self, start: int = 0, stop: int | None = None, **inputs: DataFrame) -> dict:
        """Stages start..stop (all by default) over the context kept from earlier calls and the inputs. Frames that several stages read are written once (tables.release() deletes them)."""
        self.context |= inputs
        seen: dict[str, int] = {}
        for i, name in enumerate(self.spec["stages"]):
            seen[name] = seen.get(name, 0) + 1
            if i < start or (stop is not None and i > stop):
                continue
            made = STAGES[name](self.context, **self.spec["params"].get(f"{name}#{seen[name]}", {}))
            last = i + 1 == len(self.spec["stages"]) or i == stop
            later = [] if last else self.spec["stages"][i + 1 :]
            # a frame that the next stage replaces isn't worth a table, nor are windows that only the model reads
            worth = [k for k in made if k in SHARED and later and later[0] not in REPLACES.get(k, ()) and (k != "windows" or "positions" in later)]
            self.context |= {k: save(v, k) if k in worth else v for k, v in made.items()}
        return self.context
