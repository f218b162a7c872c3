"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow, pieces, save

#: Dimensions of a vector, letters of an n-gram, seed of the letter vectors.
DIMS, N, SEED = 1024, 3, 20240
#: About so many documents of a language are bundled into its prototype, chosen by hash of doc_id.
SAMPLE = 2000
#: Steepness of the confidence over cosines.
SHARP = 40.0
#: Characters that a block of documents may hold before its n-gram vectors are made.
BLOCK = 400_000
UND = "und"


class Letters:
    """Random bipolar vectors, one for each code point, made from the code point and the seed when first met; the cache is dropped when it is full."""

    def __init__(self, dims: int = DIMS, seed: int = SEED, most: int = 20_000):
        self.dims, self.seed, self.most, self.rows, self.at = dims, seed, most, [], {}

    def table(self, points: np.ndarray) -> np.ndarray:
        if len(self.at) > self.most:
            self.rows, self.at = [], {}
        for c in points.tolist():
            if c not in self.at:
                bits = np.random.Generator(np.random.PCG64([self.seed, c])).integers(0, 2, self.dims, dtype=np.int8)
                self.at[c] = len(self.rows)
                self.rows.append(bits * 2 - 1)
        return np.stack([self.rows[self.at[c]] for c in points.tolist()])


def ngrams(text: str, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Codes (three code points in 63 bits) of the different letter n-grams and their counts; every run of other characters is one blank, as are both ends. Long texts are read in chunks."""
    codes, counts, tail = [], [], np.array([32], np.int64)
    for lo in range(0, len(text) + 1, chunk):
        part = text[lo : lo + chunk].lower()
        c = np.frombuffer((part if lo + chunk <= len(text) else part + " ").encode("utf-32-le", "replace"), np.uint32)
        c = np.concatenate([tail, np.where(_letters(c), c, 32)])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]  # the first of a run of blanks
        i, n = np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)
        codes.append(i)
        counts.append(n)
        tail = c[-2:]
    if len(codes) == 1:
        return codes[0], counts[0]
    i, at = np.unique(np.concatenate(codes), return_inverse=True)
    return i, np.bincount(at, np.concatenate(counts), len(i)).astype(np.int64)


_IS = np.zeros(0x110000 // 8 + 1, np.uint8)
_KNOWN = np.zeros(0x110000 >> 8, bool)


def _letters(c: np.ndarray) -> np.ndarray:
    """isalpha() by code point, read off a table that is filled by pages."""
    for page in np.unique(c >> 8).tolist():
        if not _KNOWN[page]:
            _IS[page * 32 : page * 32 + 32] = np.packbits([chr(x).isalpha() for x in range(page << 8, (page + 1) << 8)], bitorder="little")
            _KNOWN[page] = True
    return (_IS[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1


def gram_vectors(codes: np.ndarray, letters: Letters) -> np.ndarray:
    """Bind: the first letter's vector permuted twice (rolled), the second's once, the third's not, multiplied."""
    parts = [(codes >> s) & 0x1FFFFF for s in (42, 21, 0)]
    points, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    table = letters.table(points)
    a, b, c = np.split(inverse, 3)
    return np.roll(table, 2, 1)[a] * np.roll(table, 1, 1)[b] * table[c]


def blocks(texts: list[str | None]):
    """Positions, and what bundle() takes, for documents of about BLOCK characters at a time (or one that is longer)."""
    at, size = [], 0
    for i, t in enumerate(texts):
        at.append(i)
        size += len(t or "")
        if size > BLOCK or len(at) >= 256 or i == len(texts) - 1:
            grams = [ngrams(texts[j] or "") for j in at]
            row = np.repeat(np.arange(len(at)), [len(g) for g, _ in grams])
            yield at, (len(at), row, np.concatenate([g for g, _ in grams]), np.concatenate([n for _, n in grams]))
            at, size = [], 0


#: Different n-grams whose vectors are made at a time.
SLICE = 4096


def bundle(docs: tuple[int, np.ndarray, np.ndarray, np.ndarray], letters: Letters) -> np.ndarray:
    """Unit document vectors: the sum of n-gram vectors by count. docs: their number, and document, code and count of each entry.

    Only a slice of n-grams at a time has a column for each of the block's documents,
    so memory goes by the entries, however many n-grams differ.
    """
    size, row, code, count = docs
    out = np.zeros((size, letters.dims), np.float32)
    codes, at = np.unique(code, return_inverse=True)
    order = np.argsort(at, kind="stable")
    row, at, count = row[order], at[order], count[order]
    for lo in range(0, len(codes), SLICE):
        a, b = np.searchsorted(at, [lo, lo + SLICE])
        part = codes[lo : lo + SLICE]
        dense = np.zeros((size, len(part)), np.float32)
        dense[row[a:b], at[a:b] - lo] = count[a:b]
        out += dense @ gram_vectors(part, letters).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Prototypes: unit vectors by language, from rows with a lang and a text.

    Each language gives about sample documents (all, if it has fewer). Sums are made
    in each task; a row for each task and language goes on, and one for each language
    comes to the driver.
    """
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    # a row for each language; saved, its size is known before the join, so the texts needn't be shuffled to meet it
    share = save(rows.groupBy("lang").count().select(F.col("lang").alias("_l"), F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")).alias("_share")), "shares")
    chosen = rows.select("lang", "text", "doc_id").join(share, F.col("lang") == F.col("_l")).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("_share") * 1_000_003)
    schema = pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))])

    def run(batches):
        letters, sums = Letters(), {}
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for at, entries in blocks(texts):
                for i, v in zip(at, bundle(entries, letters), strict=True):
                    sums.setdefault(langs[i], np.zeros(DIMS))
                    sums[langs[i]] += v
        for lang, v in sums.items():
            yield batch(schema, [lang], [v])

    parts = map_arrow(chosen.select("lang", "text"), run, "lang string, v array<double>")
    flat = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    got = flat.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).orderBy("lang").toArrow()
    out = {}
    for lang, v in zip(got["lang"].to_pylist(), got["v"].to_pylist(), strict=True):
        n = np.linalg.norm(v)
        if n > 0:
            out[lang] = np.asarray(v, np.float32) / np.float32(n)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, lang_pred, score: the language with the greatest cosine, ties to the first by name, and its softmax share.

    und with a score of 0 for a null text, a text without letters, or no prototypes.
    """
    langs = sorted(prototypes)
    shared = docs.sparkSession.sparkContext.broadcast(np.stack([prototypes[k] for k in langs]) if langs else None)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema) + ", lang_pred string, score double"

    def run(batches):
        letters, p = Letters(), shared.value
        for b in batches:
            for part in pieces(b):
                texts = part.column("text").to_pylist()
                pred, score = [UND] * len(texts), [0.0] * len(texts)
                for at, entries in blocks(texts) if p is not None else ():
                    cos = bundle(entries, letters) @ p.T
                    e = np.exp(SHARP * (cos - cos.max(1, keepdims=True)))
                    e /= e.sum(1, keepdims=True)
                    best = cos.argmax(1)
                    for j, i in enumerate(at):
                        if has_letter(texts[i]):
                            pred[i], score[i] = langs[best[j]], min(1.0, float(e[j, best[j]]))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(pred), pa.array(score)], names=[*keys, "lang_pred", "score"])

    return map_arrow(docs.select(*keys, "text"), run, schema)
