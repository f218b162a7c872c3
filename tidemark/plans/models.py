"""The model stage (M1 to M7): a pluggable client behind one mapInPandas, its answers written once and read back.

Sampling isn't repeatable and calls cost money, so a plan never goes on from the
stage itself but from the table that it wrote (see ask()). A client counts tokens by
count(), where it can, and budgets come from that.
"""

from __future__ import annotations

import json
import operator
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop_saved, release, save, saved_count

#: Tokens of an answer without a budget; the bias of tokens that a value may have.
TOKENS, BIAS = 256, 30


@dataclass
class Sampling:
    """M7."""

    samples: int = 1
    temperature: float = 1.0
    top_p: float = 1.0
    seed: int | None = None
    logprobs: bool = False
    top_logprobs: int | None = None
    raw: bool = False


class ModelClient(Protocol):
    def complete(self, prompts: list[str], budgets: list[int], sampling: Sampling) -> list[list[str]]:
        """So many texts for each prompt as sampling.samples says."""


@dataclass
class PersistenceClient:
    """M6: repeats the prompt's last value, or its last row of num_dims values; needs no model."""

    sep: str = ","
    steps: int = 1
    num_dims: int = 1

    def complete(self, prompts, budgets, sampling):
        last = [self.sep.join([t.strip() for t in p.strip().split(self.sep) if t.strip()][-self.num_dims :]) for p in prompts]
        return [[self.sep.join([v] * self.steps)] * sampling.samples for v in last]


@dataclass
class RuleClient:
    """Names the values in the top tenths of a window's range; sample s takes s + 1 twentieths. An example before an empty line isn't part of the window.

    With num_dims, the prompt is what follows its user part, and the answer is a
    range: the positions between the first dimension's highest values.
    """

    sep: str = ","
    num_dims: int = 0

    def complete(self, prompts, budgets, sampling):
        out = []
        for p in prompts:
            if self.num_dims:
                v = [int(x) for x in re.findall(r"\d+", p)][:: self.num_dims]
                cuts = [max(v) - (max(v) - min(v)) * (s + 1) // 20 for s in range(sampling.samples)] if v else []
                hits = [[i for i, x in enumerate(v) if x >= cut] for cut in cuts]
                out.append([f"[[{h[0]}, {h[-1]}]]" for h in hits] or ["no anomalies"] * sampling.samples)
                continue
            v = [int(x) for x in re.findall(r"-?\d+", p.rsplit("\n\n", 1)[-1].replace(" ", ""))]
            top, low = max(v, default=0), min(v, default=0)
            named = [sorted({x for x in v if x >= top - (top - low) * (s + 1) // 20}) if top > low else [] for s in range(sampling.samples)]
            out.append([f"Answer: [{', '.join(map(str, n))}]" if n else "no anomalies" for n in named])
        return out


@dataclass
class ReplayClient:
    """Answers kept from an earlier run, by prompt."""

    answers: dict[str, list[str]]

    def complete(self, prompts, budgets, sampling):
        return [self.answers.get(p, [""] * sampling.samples) for p in prompts]


@dataclass
class HttpChatClient:
    """M1, M3: a chat or completion endpoint that speaks the common JSON protocol.

    user and system are the templates of a request: the user's part, the text and the
    separator stand side by side with blanks between. Without chat the text and the
    separator are all of it, and logit_bias favours the tokens that a value may have.
    encode counts tokens; without one, each character is taken as a token, so that no answer is cut.
    """

    url: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)
    system: str = ""
    user: str = ""
    chat: bool = True
    sep: str = ","
    logit_bias: dict[str, float] = field(default_factory=dict)
    encode: Callable[[str], list[int]] | None = None
    timeout: float = 120
    padding: float = 0
    #: Prompts are requests of their own: one that fails costs no other its answer.
    singly = True

    def count(self, text: str) -> int:
        return len(self.encode(text)) if self.encode else len(text)

    @classmethod
    def for_values(cls, url: str, model: str, encode: Callable[[str], list[int]], sep: str = ",", bias: float = BIAS, **more) -> HttpChatClient:
        """With the bias on the tokens of digits and the separator."""
        return cls(url, model, sep=sep, encode=encode, logit_bias={str(t): bias for x in [*"0123456789", sep] for t in encode(x)}, **more)

    def request(self, prompt: str, budget: int, sampling: Sampling) -> dict:
        body = {"model": self.model, "max_tokens": budget, "n": sampling.samples, "temperature": sampling.temperature, "top_p": sampling.top_p}
        if sampling.seed is not None:
            body["seed"] = sampling.seed
        if self.chat:
            body["messages"] = [{"role": "system", "content": self.system}, {"role": "user", "content": " ".join(x for x in (self.user, prompt, self.sep) if x)}]
            if sampling.logprobs:
                body |= {"logprobs": True, "top_logprobs": sampling.top_logprobs}
        else:
            body |= {"prompt": " ".join([prompt, self.sep]), "logit_bias": self.logit_bias} | ({"logprobs": sampling.top_logprobs} if sampling.logprobs else {})
        return body

    def send(self, body: dict) -> dict:
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"} | self.headers), timeout=self.timeout) as r:
            return json.load(r)

    def complete_with_logprobs(self, prompts, budgets, sampling) -> list[list[tuple[str, str | None]]]:
        """Texts, each with its log-probabilities as JSON (None if they weren't asked for)."""
        out = []
        for prompt, budget in zip(prompts, budgets, strict=True):
            choices = self.send(self.request(prompt, budget, sampling))["choices"]
            out.append([(c["message"]["content"] if self.chat else c["text"], json.dumps(c["logprobs"]) if c.get("logprobs") is not None else None) for c in choices])
        return out

    def complete(self, prompts, budgets, sampling):
        return [[text for text, _ in row] for row in self.complete_with_logprobs(prompts, budgets, sampling)]


@dataclass
class LocalCausalClient:
    """M2, M4: a local causal model, loaded once for each worker; only digits, the separator and allowed symbols may be generated when restricted.

    Prompts go through the model at_once at a time, padded on the left; of what it
    generates, each prompt takes no more tokens than its budget.
    """

    name: str
    sep: str = ","
    allowed_symbols: tuple[str, ...] = ()
    restrict_tokens: bool = True
    padding: float = 0
    at_once: int = 8
    _loaded: tuple | None = None

    def _model(self):
        if self._loaded is None:
            try:
                from transformers import AutoModelForCausalLM, AutoTokenizer
            except ImportError as e:
                raise RuntimeError("LocalCausalClient needs the optional transformers package") from e
            tokenizer = AutoTokenizer.from_pretrained(self.name)
            self._loaded = tokenizer, AutoModelForCausalLM.from_pretrained(self.name, device_map="auto", torch_dtype="float16"), self.banned(tokenizer) if self.restrict_tokens else None
        return self._loaded

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}  # a model is loaded where it is used

    def count(self, text: str) -> int:
        return len(self._model()[0](text)["input_ids"])

    def banned(self, tokenizer) -> list[list[int]]:
        fine = set("0123456789") | {self.sep, *self.allowed_symbols}
        return [[i] for t, i in tokenizer.get_vocab().items() if not set(tokenizer.convert_tokens_to_string([t])) <= fine and i != tokenizer.eos_token_id]

    def complete_raw(self, prompts, budgets, sampling) -> list[list[tuple[str, list[int]]]]:
        """Texts, each with the token ids that the model returned for it, its prompt's (and their padding) first."""
        tokenizer, model, banned = self._model()
        tokenizer.padding_side, out = "left", []
        if tokenizer.pad_token is None:
            tokenizer.pad_token = tokenizer.eos_token
        extra = {"bad_words_ids": banned} if banned else {}
        for k in range(0, len(prompts), self.at_once):
            most = budgets[k : k + self.at_once]
            ids = tokenizer(prompts[k : k + self.at_once], return_tensors="pt", padding=True).to(model.device)
            got = model.generate(**ids, do_sample=True, max_new_tokens=max(most), temperature=sampling.temperature, top_p=sampling.top_p, num_return_sequences=sampling.samples, renormalize_logits=True, **extra)
            width = ids["input_ids"].shape[1]
            for i, budget in enumerate(most):
                rows = [row[: width + budget] for row in got[i * sampling.samples : (i + 1) * sampling.samples].tolist()]
                texts = tokenizer.batch_decode([row[width:] if self.restrict_tokens else row for row in rows], skip_special_tokens=True, clean_up_tokenization_spaces=False)
                out.append(list(zip(texts, rows, strict=True)))
        return out

    def complete(self, prompts, budgets, sampling):
        return [[text for text, _ in row] for row in self.complete_raw(prompts, budgets, sampling)]


def forecast_budget(tokens: int, values: int, steps: int, padding: float = 0) -> int:
    """Tokens for the next steps values: tokens a value, rounded down after one is added, by steps."""
    return int((tokens + 1) // max(values, 1) * steps + padding * steps)


def detect_budget(tokens: int, anomalous_percent: float) -> int:
    return int(tokens * anomalous_percent)


def count_tokens(client: ModelClient, text: str) -> int:
    return client.count(text) if hasattr(client, "count") else len(text)


@dataclass
class ForecastBudget:
    """M1, M2: as many tokens for an answer as the prompt has for a value, and the client's padding, times steps."""

    steps: int = 1
    sep: str = ","
    padding: float | None = None

    def __call__(self, client: ModelClient, text: str) -> int:
        padding = getattr(client, "padding", 0) if self.padding is None else self.padding
        return max(1, forecast_budget(count_tokens(client, text), len(text.split(self.sep)), self.steps, padding))


@dataclass
class DetectBudget:
    """M3, M4: the share of a window's tokens that may be anomalous."""

    anomalous_percent: float = 0.5

    def __call__(self, client: ModelClient, text: str) -> int:
        return max(1, detect_budget(count_tokens(client, text), self.anomalous_percent))


ANSWERS = "sample int, response string, logprobs string, raw string, error string, seconds double"
#: Prompts whose answers are committed to a store together.
CHUNK = 10_000


class ModelError(RuntimeError):
    """Prompts without an answer; all others' answers have been kept."""


@dataclass
class Retry:
    """How often a prompt is tried, seconds before the second try (doubled before each more), and prompts that one task asks at once of a client that takes them singly."""

    tries: int = 3
    wait: float = 1.0
    at_once: int = 8


def _asked(client: ModelClient, texts: list[str], budgets: list[int], sampling: Sampling, retry: Retry) -> list[tuple[list, str | None, float]]:
    """Answers, error and seconds of each prompt. An exception is its prompt's error and no one else's."""

    def call(texts, budgets):
        if sampling.logprobs and hasattr(client, "complete_with_logprobs"):
            return [[(a, p, None) for a, p in row] for row in client.complete_with_logprobs(texts, budgets, sampling)]
        if sampling.raw and hasattr(client, "complete_raw"):
            return [[(a, None, json.dumps(ids)) for a, ids in row] for row in client.complete_raw(texts, budgets, sampling)]
        return [[(a, None, None) for a in row] for row in client.complete(texts, budgets, sampling)]

    def one(text, budget):
        began, why = time.perf_counter(), ""
        for k in range(max(1, retry.tries)):
            if k:
                time.sleep(retry.wait * 2 ** (k - 1))
            try:
                return call([text], [budget])[0], None, time.perf_counter() - began
            except Exception as e:
                why = f"{type(e).__name__}: {e}"
        return [], why, time.perf_counter() - began

    if getattr(client, "singly", False):
        with ThreadPoolExecutor(max(1, retry.at_once)) as pool:
            return list(pool.map(one, texts, budgets))
    began = time.perf_counter()
    try:
        rows = call(texts, budgets)
    except Exception:  # which prompt it was shows when they are asked one by one
        return [one(t, b) for t, b in zip(texts, budgets, strict=True)]
    return [(row, None, (time.perf_counter() - began) / len(texts)) for row in rows]


def infer(prompts: DataFrame, client: ModelClient, sampling: Sampling | None = None, budget: Callable[[ModelClient, str], int] | None = None, text: str = "text", retry: Retry | None = None) -> DataFrame:
    """One row in, sampling.samples rows out; the client is unpickled once a task.

    Batches go to the client as one call, or, of a client that takes prompts singly,
    prompt by prompt, several at once. A prompt that fails all tries is one row, with
    its error and no response. logprobs and raw are the model's report and its token
    ids as JSON, if they were asked for and the client gives them, else NULL; seconds is a prompt's time, on each of its rows.
    """
    sampling, retry = sampling or Sampling(), retry or Retry()
    keys = [c for c in prompts.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema if f.name != text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            texts = pdf[text].fillna("").tolist()
            got = _asked(client, texts, [budget(client, t) if budget else TOKENS for t in texts], sampling, retry)
            rows = [[(k, *a, None, s) for k, a in enumerate(answers)] if why is None else [(0, None, None, None, why, s)] for answers, why, s in got]
            at = [i for i, r in enumerate(rows) for _ in (r or [0])]
            flat = [x for r in rows for x in (r or [(0, None, None, None, None, 0.0)])]
            out = pdf[keys].iloc[at].reset_index(drop=True)
            for k, (name, kind) in enumerate((("sample", "int32"), ("response", object), ("logprobs", object), ("raw", object), ("error", object), ("seconds", float))):
                out[name] = pd.Series([x[k] for x in flat], dtype=kind)
            yield out

    return prompts.mapInPandas(run, f"{schema}, {ANSWERS}")


def _failed(answers: DataFrame, asked: int | None = None) -> None:
    """Raises what failed, if anything did."""
    worst = answers.filter("error IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("first")).first()
    if worst["n"]:
        raise ModelError(f"{worst['n']} prompts have no answer; the first: {worst['first']}")


def ask(prompts: DataFrame, client: ModelClient, store: str | None = None, on_error: str = "raise", chunk: int = CHUNK, **kw) -> DataFrame:
    """infer(), once: answers already in the store are kept, new ones appended, and the plan goes on from the store, with the answers to these prompts only.

    Prompts are asked a chunk at a time and a chunk's answers committed before the next,
    so what has been paid for outlives a lost job; only answers are kept, so what failed
    is asked again the next time, and nothing else is. on_error: raise, once all chunks
    are done, or keep, which returns failed prompts with their error and no response.
    Without a store of the caller's, the answers are written to a table of this session
    (tables.release() deletes it).
    """
    if on_error not in ("raise", "keep"):
        raise ValueError(f"unknown on_error {on_error!r}")
    if store is None:
        out = save(infer(prompts, client, **kw), "answers")
        if on_error == "raise":
            _failed(out)
        return out
    spark, text = prompts.sparkSession, kw.get("text", "text")
    keys = [c for c in prompts.columns if c != text]
    p = spark._jvm.org.apache.hadoop.fs.Path(store)
    prompts, mark = save(prompts, "prompts"), saved_count()

    def same(have):
        return reduce(operator.and_, [F.col(f"`{k}`").eqNullSafe(have[f"_{k}"]) for k in keys])

    new, schema = prompts, infer(prompts.limit(0), client, **kw).schema
    there = lambda: spark.read.schema(schema).parquet(store)  # noqa: E731  a store of an older version has no times
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        have = there().select(*[F.col(f"`{k}`").alias(f"_{k}") for k in keys]).distinct()
        new = prompts.join(have, same(have), "left_anti")
    new, errors = save(new, "new"), []
    parts = -(-new.count() // chunk) or 1
    for k in range(parts):
        got = save(infer(new.filter(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in prompts.columns]), F.lit(parts)) == k), client, **kw), "chunk")
        got.filter("error IS NULL").write.mode("append").parquet(store)
        if got.filter("error IS NOT NULL").limit(1).count():
            errors.append(got.filter("error IS NOT NULL"))
        else:
            drop_saved(got)
    failed = reduce(DataFrame.unionByName, errors) if errors else None
    if failed is not None and on_error == "raise":
        try:
            _failed(failed)
        finally:
            release(mark - 1)
    asked = prompts.select(*[F.col(f"`{k}`").alias(f"_{k}") for k in keys]).distinct()
    out = there().join(asked, same(asked), "left_semi")
    return out if failed is None else out.unionByName(failed)


def rule_responses(x, sample) -> F.Column:
    """RuleClient as a column, for one dimension."""
    v = F.flatten(x)
    top, low = F.array_max(v), F.array_min(v)
    cut = top - F.floor((top - low) * (sample + 1) / 20)
    named = F.array_sort(F.array_distinct(F.filter(v, lambda t: t >= cut)))
    return F.when(top > low, F.concat(F.lit("Answer: ["), F.array_join(F.transform(named, lambda t: t.cast("string")), ", "), F.lit("]"))).otherwise(F.lit("no anomalies"))
