"""Quality rules, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, map_arrow, pieces, text_key

#: Rows that a fit takes at most (those with the least hash of doc_id), and one in how many is kept back for calibration.
SAMPLE, HELD = 2000, 4
BITS = 15
MASK = (1 << BITS) - 1
FAMILIES = 3
DIMS = FAMILIES << BITS
CHARS = 4
#: Kept from so high a probability of good quality.
KEEP = 0.5
SYMBOLS = "#*$%&|<>"
MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], np.uint64)


def split_words(text: str) -> list[bytes]:
    """bytes.split() cuts at exactly the white space of the contract."""
    return text.encode().split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, ws), np.uint64, len(ws))


def repeated_words(ws: list[bytes], h: np.ndarray, size: int = 8) -> int:
    """Words in windows of size words that the text holds twice or more. Windows with equal hashes are compared word by word."""
    n = len(ws) - size + 1
    if n < 2:
        return 0
    mixed = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for j in range(size):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : j + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    dup = np.zeros(n, bool)
    dup[order[1:][same]] = dup[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    at = np.flatnonzero(dup).tolist()
    for i in at:
        w = tuple(ws[i : i + size])
        seen[w] = seen.get(w, 0) + 1
    mark = np.zeros(len(ws) + 1, np.int64)
    for i in at:
        if seen[tuple(ws[i : i + size])] > 1:
            mark[i] += 1
            mark[i + size] -= 1
    return int((np.cumsum(mark) > 0).sum())


def base_features(text: str | None, ws: list[bytes], h: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    if not text:
        return 0, 0, 0, 0, 0, True
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [s for s in text.split("\n") if s.strip(" \t\n\v\f\r")]
    rep = repeated_words(ws, h)
    return len(ws), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), rep, len(ws) < 20 or 100 * rep > 30 * len(ws)


def hashed(text: str, h: np.ndarray) -> list[np.ndarray]:
    """Buckets of the three families: words, word pairs, character n-grams; whole texts."""
    fold = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    pair = h[:-1] * np.uint64(31) + h[1:]
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(c) - CHARS + 1
    grams = np.zeros(0, np.uint64)
    if n > 0:
        grams = c[:n] * MULT[0]
        for j in range(1, CHARS):
            grams += c[j : j + n] * MULT[j]
    return [fold(h), fold(pair) + (1 << BITS), fold(grams) + (2 << BITS)]


def sparse(text: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets, each with its share of its family."""
    idx, val = [], []
    for f in hashed(text, h):
        if len(f):
            i, n = np.unique(f, return_counts=True)
            idx.append(i)
            val.append(n / len(f))
    return (np.concatenate(idx), np.concatenate(val)) if idx else (np.zeros(0, np.int64), np.zeros(0))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def margin(self, text: str, h: np.ndarray) -> float:
        return self.bias + sum(float(self.weights[f].mean()) for f in hashed(text, h) if len(f))

    def probability(self, text: str, h: np.ndarray) -> float:
        z = self.scale * self.margin(text, h) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int, bool]], rounds: int = 120, rate: float = 2.0, ridge: float = 1e-6) -> Model | None:
    """rows: buckets, values, label, kept for calibration. Adam over all rows at once, then Platt's sigmoid on the rows kept back."""
    fit = [r for r in rows if not r[3]] or rows
    cal = [r for r in rows if r[3]] or rows
    if len({r[2] for r in fit}) < 2:
        return None
    y = np.array([r[2] for r in fit], float)
    # both classes weigh the same in the fit; calibration brings their true shares back
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    idx, val = np.concatenate([r[0] for r in fit]), np.concatenate([r[1] for r in fit])
    row = np.repeat(np.arange(len(fit)), [len(r[0]) for r in fit])
    w, b = np.zeros(DIMS), 0.0
    m, v, mb, vb = np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[idx] * val, len(fit)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw, gb = np.bincount(idx, g[row] * val, DIMS) + ridge * w, float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        k = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= k * m / (np.sqrt(v) + 1e-8) * (np.abs(gw) > 0)
        b -= 0.05 * k * mb / (np.sqrt(vb) + 1e-8)
    z = np.array([b + float(w[r[0]] @ r[1]) for r in cal])
    spread = float(z.std()) or 1.0
    yc = np.array([r[2] for r in cal], float)
    good, bad = yc.sum(), len(yc) - yc.sum()
    target = np.where(yc == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, c, u = 1.0, 0.0, z / spread
    for _ in range(50):  # Newton on two parameters
        p = 1 / (1 + np.exp(-np.clip(a * u + c, -30, 30)))
        g = np.array([((p - target) * u).sum() + 1e-3 * a, (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * u * u).sum() + 1e-3, (q * u).sum()], [(q * u).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, c = a - float(np.clip(step[0], -2, 2)), c - float(np.clip(step[1], -2, 2))
    return Model(w.astype(np.float32), b, a / spread, c)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, _key, text, quality, _h) of the rows that a fit may learn from: those with one of sample labelled ids, the ones with the least hash.

    An id whose labels differ has none. Rows of one id that agree in text are one row to fit().
    """
    h = F.xxhash64("doc_id")
    one = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"), F.max("quality").cast("long").alias("_most")).filter("quality = _most")
    chosen = one.select(F.col("doc_id").alias("_d"), "quality", h.alias("_h")).orderBy("_h", "_d").limit(sample)
    return docs.filter("text IS NOT NULL").select("doc_id", text_key().alias("_key"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_d")).drop("_d")  # at most sample rows


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """None if a class is missing.

    Features are made on all executors; one task there fits on sample sparse rows at
    most (rows of one id with different texts count each, those with the least hash
    are taken), so only the weights come to the driver.
    """
    row = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), ("h", pa.int64()), ("quality", pa.int64()), ("idx", pa.list_(pa.int32())), ("val", pa.list_(pa.float32()))])
    done = pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("scale", pa.float64()), ("shift", pa.float64())])

    def features(batches):
        for b in batches:
            for d, key, text, q, h in zip(*(b.column(c).to_pylist() for c in ("doc_id", "_key", "text", "quality", "_h")), strict=True):
                i, v = sparse(text, word_hashes(split_words(text)))
                yield batch(row, [d], [key], [h], [q], [i.astype(np.int32)], [v.astype(np.float32)])

    def learn(batches):
        rows = []
        for b in batches:
            idx, val = b.column("idx"), b.column("val")
            rows += [(idx[i].values.to_numpy(), val[i].values.to_numpy(), q, h % HELD == 0) for i, (q, h) in enumerate(zip(b.column("quality").to_pylist(), b.column("h").to_pylist(), strict=True))]
        if rows and (m := train(rows)):
            yield batch(done, [m.weights.tobytes()], [m.bias], [m.scale], [m.shift])

    made = map_arrow(labelled(docs, labels, sample), features, "doc_id long, _key long, h long, quality long, idx array<int>, val array<float>")
    apart = made.groupBy("doc_id", "_key").agg(*[F.first(c).alias(c) for c in ("h", "quality", "idx", "val")])
    bounded = apart.orderBy("h", "doc_id", "_key").limit(sample).coalesce(1).sortWithinPartitions("h", "doc_id", "_key")
    got = map_arrow(bounded.select("h", "quality", "idx", "val"), learn, "weights binary, bias double, scale double, shift double").first()
    return got and Model(np.frombuffer(bytes(got["weights"]), np.float32), got["bias"], got["scale"], got["shift"])


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """docs (all its columns) with the base columns, base_failed, p_good and kept added.

    A null or empty text has no words and fails. Without a model p_good is null and
    only the base rules decide. Clashing columns of docs are replaced.
    """
    added = [T.StructField(n, T.LongType()) for n in NAMES] + [T.StructField("base_failed", T.BooleanType()), T.StructField("p_good", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    fresh = {f.name for f in added}
    own = [f for f in docs.schema.fields if f.name not in fresh]
    schema, names = T.StructType(own + added), [f.name for f in own]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            for part in pieces(b):
                out = []
                for text in part.column("text").to_pylist():
                    ws = split_words(text or "")
                    h = word_hashes(ws)
                    base = base_features(text, ws, h)
                    p = m.probability(text, h) if m and text else None
                    out.append((*base, p, not base[-1] and (p is None or p >= keep)))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]], names=[*names, *[f.name for f in added]])

    return map_arrow(docs.select(*names), run, schema)
