"""PII: patterns for personal data, and terms whose co-occurrence with it in the corpus gives it away.

Protected entities are the four kinds of the patterns, secrets (strings of so much
information that only a key or token has it) and, pooled, any of them; of the five
kinds each single value, too. A term discloses an entity if who reads the term can
infer the entity, likelier than not, as estimated from the contexts (sentences) of
the whole corpus. Disclosing terms are marked in every text: generalised or removed.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, batch, drop_saved, map_arrow, pieces, save, text_key

KINDS = ("email", "ip", "card", "phone")
SECRET, TERM, ANY = "secret", "term", "any"
#: Order of spans that begin at one place.
ORDER = (*KINDS, SECRET, TERM)
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
KEY = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
EDGE = string.punctuation

#: A secret holds so many bits (its length by the entropy of its characters) and changes so often between digits and other characters.
BITS, CHANGES = 80.0, 6
#: A context is a sentence, or so many words of a longer one.
CONTEXT = 40
#: A term is generalised if it makes an entity likelier than not, removed if it all but names it.
GENERALISE, REMOVE = 0.5, 0.9
#: It must have been met so in so many different contexts: copies of one sentence count once.
CONTEXTS = 3
#: Terms that chance alone may pass over the whole corpus: sets how much evidence a term needs.
CHANCE = 0.01
#: Terms that a task holds in a set; beyond, occurrences and terms are joined.
HELD = 200_000
#: Bits of the map by which a task knows words that can't be disclosing terms.
MAP_BITS = 1 << 23
#: Entries of a task's counts that are kept before they go out.
FLUSH = 150_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: linear, whatever long runs a text holds."""
    low = 0  # no address begins before: the end of the last one, or the @ before
    at = text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        low = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            low = m.end()
            yield start, low
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches, non-overlapping within a kind, by start and then kind."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def show(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def norm(word: str) -> str:
    """What counts as one term: no punctuation around it, lower case."""
    return word.strip(EDGE).lower()


def information(s: str) -> float:
    """Bits: length by the entropy of the characters."""
    return sum(n * math.log2(len(s) / n) for n in Counter(s).values())


def entity_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans, and secrets that touch none of them, in order."""
    base = base_spans(text)
    if not DIGIT.search(text):
        return base
    found, i, reach = [], 0, 0  # reach: the furthest end of the base spans that begin before
    for m in KEY.finditer(text):
        a, b = m.span()
        while i < len(base) and base[i][1] < b:
            reach, i = max(reach, base[i][2]), i + 1
        if reach <= a:
            digit = [c.isdigit() for c in m[0]]
            if sum(x != y for x, y in zip(digit, digit[1:], strict=False)) >= CHANGES and information(m[0]) >= BITS:
                found.append((SECRET, a, b))
    return sorted(base + found, key=lambda s: (s[1], ORDER.index(s[0]))) if found else base


def show(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def norm(word: str) -> str:
    """What counts as one term: no punctuation around it, lower case."""
    return word.strip(EDGE).lower()


def contexts(text: str, spans) -> Iterator[tuple[list[str], set[tuple[str, str]], str]]:
    """(terms, (kind, value) of the entities, the context itself) of each context that holds an entity; words that touch an entity are no terms. One pass over words and spans."""
    terms, found, first, count, i = [], set(), 0, 0, 0
    live: list[tuple[str, int, int]] = []  # spans that reach beyond the word before
    at = 0
    for m in WORD_RE.finditer(text):
        a, b = m.span()
        if count and (count == CONTEXT or "\n" in text[at:a] or text[at - 1] in ".!?"):
            if found:
                yield terms, found, text[first:at]
            terms, found, count = [], set(), 0
        if not count:
            first = a
        live = [s for s in live if s[2] > a]
        while i < len(spans) and spans[i][1] < b:
            if spans[i][2] > a:
                live.append(spans[i])
            i += 1
        if live:
            found.update((k, text[x:y]) for k, x, y in live)
        elif t := norm(m[0]):
            terms.append(t)
        count, at = count + 1, b
    if found:
        yield terms, found, text[first:at]


def number(s: str) -> int:
    """64 bits, signed."""
    x = xxhash.xxh3_64_intdigest(s)
    return x - (1 << 64) if x >> 63 else x


STATS = "term string, kind string, value long, context long, n long"


def statistics(docs: DataFrame) -> DataFrame:
    """(term, kind, value, context, n): occurrences of each term in the corpus (kind ''), and in each different context with a kind (value 0) or one value of it.

    Counted in each task and sent out whenever FLUSH entries are held; Spark adds them up.
    """
    schema = pa.schema([("term", pa.string()), ("kind", pa.string()), ("value", pa.int64()), ("context", pa.int64()), ("n", pa.int64())])

    def run(batches):
        everywhere: Counter = Counter()
        near: Counter = Counter()

        def flush():
            terms: Counter = Counter()
            for w, n in everywhere.items():
                if t := norm(w.decode()):
                    terms[t] += n
            keys = [(t, "", 0, 0, n) for t, n in terms.items()] + [(*k, n) for k, n in near.items()]
            everywhere.clear()
            near.clear()
            return batch(schema, *(zip(*keys, strict=True) if keys else [[]] * 5))

        for b in batches:
            for part in pieces(b):
                for text in part.column("text").to_pylist():
                    if text:
                        everywhere.update(text.encode().split())  # bytes are cut at exactly the white space of the contracts
                        if spans := entity_spans(text):
                            for terms, found, whole in contexts(text, spans):
                                of = {(ANY, 0), *((k, 0) for k, _ in found), *((k, number(v)) for k, v in found)}
                                c = number(whole)
                                near.update((t, k, v, c) for t in terms for k, v in of)
                                if len(near) > FLUSH:
                                    yield flush()
                if len(everywhere) + len(near) > FLUSH:
                    yield flush()
        yield flush()

    return map_arrow(docs.select("text"), run, STATS).groupBy("term", "kind", "value", "context").agg(F.sum("n").alias("n"))


def posterior(share, p, n):
    """Chance of the entity given the term: the share of the term's occurrences with it, drawn towards the entity's own chance as by one more context."""
    return (n * share + p) / (n + 1)


def evidence(share, p, n):
    """Nats by which n contexts with the entity, in that share of the term's, speak against chance."""
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(F.lit(0.0))
    return n / share * (share * F.log(share / p) + other)


def disclosing_terms(stats: DataFrame, generalise: float = GENERALISE, least: int = CONTEXTS) -> DataFrame:
    """(term, kind, value, likely, disclosure) of the terms that disclose a kind (value 0) or a value.

    likely is the posterior(); it must reach generalise. In terms of information, disclosure
    is the pointwise mutual information of term and entity over the entity's own
    information, so the threshold is 1 + log(generalise) / information: the rarer an
    entity, the nearer to 1. The evidence must pass what is needed to pick one of all
    terms and entities by chance no more than CHANCE times in the corpus. p of an
    entity is the share of the corpus's words that stand in a context with it.
    """
    kinds = (ANY, *KINDS, SECRET)
    words, terms, *beside = stats.agg(F.sum(F.when(F.col("kind") == "", F.col("n"))), F.count(F.when(F.col("kind") == "", 1)), *[F.sum(F.when((F.col("kind") == k) & (F.col("value") == 0), F.col("n"))) for k in kinds]).first()  # eight numbers
    near = stats.filter("kind <> ''")
    n = stats.filter("kind = ''").select("term", F.col("n").alias("n_term"))
    met = near.groupBy("term", "kind", "value").agg(F.sum("n").alias("n_near"), F.countDistinct("context").alias("n_contexts")).filter(F.col("n_contexts") >= least)
    p_kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(x / words)) for k, x in zip(kinds, beside, strict=True) if x], F.lit(None).cast("double"))
    p_value = near.filter("value <> 0").groupBy("kind", "value").agg((F.sum("n") / F.lit(float(words or 1))).alias("p"))
    scored = met.filter("value = 0").withColumn("p", p_kind).unionByName(met.filter("value <> 0").join(p_value, ["kind", "value"]))
    share, p, c = F.least(F.lit(1.0), F.col("n_near") / F.col("n_term")), F.col("p"), F.col("n_contexts").cast("double")
    found = scored.filter("p < 1").join(n, "term").withColumn("likely", posterior(share, p, c)).filter(F.col("likely") >= generalise)
    needed = math.log(max(terms, 1) * (len(kinds) + 1) / CHANCE)
    return found.filter(share > p).filter(evidence(share, p, c) >= needed).select("term", "kind", "value", "likely", (F.log(F.col("likely") / p) / -F.log(p)).alias("disclosure"))


def actions(found: DataFrame, remove: float = REMOVE) -> DataFrame:
    """(term, action, label): what becomes of each term.

    A removed term leaves nothing. A generalised one becomes a broader term: one that
    points to a single value becomes '<KIND> TERM', which stands for every term that
    points to any value of the kind; one that points to the kind itself becomes 'TERM'.
    """
    most = found.groupBy("term").agg(F.max("likely").alias("likely"), F.min((F.col("value") != 0).cast("int")).alias("single"), F.max_by("kind", F.struct("likely", "kind")).alias("kind"))
    return most.select("term", F.when(F.col("likely") >= remove, F.lit("remove")).otherwise(F.lit("generalise")).alias("action"), F.when(F.col("single") == 1, F.concat(F.upper("kind"), F.lit(" TERM"))).otherwise(F.lit("TERM")).alias("label"))


def learned(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, least: int = CONTEXTS) -> DataFrame:
    """actions() of the corpus, saved."""
    stats = save(statistics(docs), "stats")  # read several times
    terms = save(actions(disclosing_terms(stats, generalise, least), remove), "terms")
    drop_saved(stats)
    return terms


# --- marks of a text ----------------------------------------------------------------------------------

def gaps(text: str, spans) -> Iterator[tuple[int, int]]:
    """What lies between the spans."""
    at = 0
    for _, a, b in spans:
        if a > at:
            yield at, a
        at = max(at, b)
    yield at, len(text)


class Held(dict):
    """bytes of a word -> whether it is one of the terms; dropped when it is full."""

    def __init__(self, is_term):
        self.is_term = is_term
        super().__init__()

    def __missing__(self, w: bytes) -> bool:
        if len(self) > FLUSH:
            self.clear()
        t = norm(w.decode())
        self[w] = out = bool(t) and self.is_term(t)
        return out


def words_among(text: str, spans, held: Held) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words outside the spans that held knows; where a span cuts a word, each rest of it counts as a word."""
    if not spans and not any(map(held.__getitem__, set(text.encode().split()))):
        return
    for lo, hi in gaps(text, spans):
        for m in WORD_RE.finditer(text, lo, hi):
            if held[(w := m[0]).encode()]:
                yield norm(w), m.start() + len(w) - len(w.lstrip(EDGE)), m.start() + len(w.rstrip(EDGE))


MARKS = "struct<start:bigint,end:bigint,action:string,label:string>"
FOUND = f"doc_id long, _key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, terms array<{MARKS}>, spans string, n_spans long"
_MARK = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("action", pa.string()), ("label", pa.string())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("terms", pa.list_(_MARK)), ("spans", pa.string()), ("n_spans", pa.int64())])


def row_of(spans, terms) -> tuple:
    """The columns of FOUND after the first two: spans are the entities, terms (start, end, action, label)."""
    c, line = Counter(k for k, _, _ in spans), show([s for s in spans if s[0] in KINDS])
    every = sorted([*spans, *[(TERM, t[0], t[1]) for t in terms]], key=lambda s: (s[1], ORDER.index(s[0])))
    return *[c[k] for k in KINDS], hashlib.sha256(line.encode()).hexdigest(), [dict(zip(("start", "end", "action", "label"), t, strict=True)) for t in terms], show(every), len(every)


def in_set(terms: DataFrame) -> dict[str, tuple[str, str]] | None:
    """term -> action, label; None if there are more than HELD."""
    got = terms.limit(HELD + 1).toArrow()
    return dict(zip(got["term"].to_pylist(), zip(got["action"].to_pylist(), got["label"].to_pylist(), strict=True), strict=True)) if got.num_rows <= HELD else None


def marked(text: str | None, of: dict[str, tuple[str, str]], held: Held) -> tuple[list, list]:
    """Entities and terms of one text."""
    spans = entity_spans(text) if text else []
    return spans, [(a, b, *of[t]) for t, a, b in words_among(text, spans, held)] if text and of else []


def find_spans(docs: DataFrame, **params) -> DataFrame:
    """One row for each row of docs: doc_id, _key, the counts, base_sha256, terms (start, end, action, label), spans, n_spans.

    A null text is empty. Rows that agree in doc_id and text get the same result, a
    null doc_id included. A disclosing term is marked wherever it stands, in documents
    without personal data too. Columns besides doc_id and text aren't read.
    """
    terms = learned(docs, **params)
    of = in_set(terms)
    if of is None:
        return _joined(docs, terms)
    drop_saved(terms)
    shared = docs.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        held = Held(shared.value.__contains__)
        for b in batches:
            for part in pieces(b):
                rows = [row_of(*marked(text, shared.value, held)) for text in part.column("text").to_pylist()]
                yield batch(_FOUND, part.column("doc_id"), part.column("_key"), *map(list, zip(*rows, strict=True)))

    return map_arrow(docs.select("doc_id", text_key().alias("_key"), "text"), run, FOUND)


# --- more terms than a task holds ---------------------------------------------------------------------

def bit_map(terms: DataFrame) -> np.ndarray:
    """A bit for the CRC of each term, 1 MB whatever their number: a word whose bit is unset isn't among them."""
    bit = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(MAP_BITS))
    rows = terms.select(bit.alias("b")).groupBy(F.floor(F.col("b") / 8).alias("i")).agg(F.expr("bit_or(shiftleft(1, cast(b % 8 AS int)))").alias("m")).toArrow()
    out = np.zeros(MAP_BITS // 8, np.uint8)
    out[rows.column("i").to_numpy()] = rows.column("m").to_numpy()
    return out


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, _key, term, start, end) of all words outside entities that may be among the terms; a join decides."""
    bits = bit_map(terms)
    schema = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def may(t: str) -> bool:
        at = zlib.crc32(t.encode()) % MAP_BITS
        return bool(bits[at >> 3] >> (at & 7) & 1)

    def run(batches):
        held = Held(may)
        for b in batches:
            for part in pieces(b):
                out = [(d, key, *w) for d, key, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "_key", "text")), strict=True) if text for w in words_among(text, entity_spans(text), held)]
                if out:
                    yield batch(schema, *zip(*out, strict=True))

    return map_arrow(docs.select("doc_id", text_key().alias("_key"), "text"), run, "doc_id long, _key long, term string, start long, end long")


def _joined(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """find_spans() for any number of terms: occurrences meet the terms, and documents what was found in them."""
    hits = occurrences(docs, terms).distinct().join(terms, "term").groupBy("doc_id", "_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action", "label"))).alias("terms"))
    met = docs.select("doc_id", text_key().alias("_key"), "text").join(hits.withColumnsRenamed({"doc_id": "_d", "_key": "_k"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")

    def run(batches):
        for b in batches:
            for part in pieces(b):
                texts, terms_ = part.column("text").to_pylist(), part.column("terms").to_pylist()
                rows = [row_of(entity_spans(t) if t else [], [tuple(x.values()) for x in g or ()]) for t, g in zip(texts, terms_, strict=True)]
                yield batch(_FOUND, part.column("doc_id"), part.column("_key"), *map(list, zip(*rows, strict=True)))

    return map_arrow(met.select("doc_id", "_key", "text", "terms"), run, FOUND)


# --- texts without them -------------------------------------------------------------------------------

def redact(text: str, spans, terms) -> str:
    """Entities become their kind in brackets, generalised terms their label, removed terms go. Where spans overlap, the first wins and reaches to the end of the last."""
    every = sorted([(a, ORDER.index(k), b, f"[{k.upper()}]") for k, a, b in spans] + [(a, len(ORDER), b, "" if act == "remove" else f"[{label}]") for a, b, act, label in terms])
    out, at = [], 0
    for a, _, b, shown in every:
        if a >= at:
            out += [text[at:a], shown]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **params) -> DataFrame:
    """docs with what find_spans() finds put out of every text; n_chars follows where there is such a column. Columns of any name are kept as they are.

    Texts aren't shuffled: a task holds the terms, and finds and replaces at once.
    With more than HELD terms, texts meet what was found in them by a join.
    """
    terms = learned(docs, **params)
    of = in_set(terms)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if of is None:
        hits = _joined(docs, terms).filter("n_spans > 0").select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "terms").distinct()
        met = row.join(hits, F.col("row.doc_id").eqNullSafe(F.col("_d")) & (text_key("row.text") == F.col("_k")), "left").select("row", "terms")
    else:
        drop_saved(terms)
        met = row.withColumn("terms", F.lit(None).cast(f"array<{MARKS}>"))
    shared = docs.sparkSession.sparkContext.broadcast(of)
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        of = shared.value
        held = Held((of or {}).__contains__)
        for b in batches:
            for part in pieces(b):
                cols, terms_ = part.column("row").flatten(), part.column("terms").to_pylist()
                new, changed = [], []
                for text, given in zip(cols[text_at].to_pylist(), terms_, strict=True):
                    spans, found = marked(text, of or {}, held)
                    found += [tuple(x.values()) for x in given or ()]
                    new.append(redact(text, spans, found) if spans or found else text)
                    changed.append(bool(spans or found))
                cols[text_at] = pa.array(new, cols[text_at].type)
                if chars_at is not None:
                    cols[chars_at] = pa.array([len(t) if c else n for n, t, c in zip(cols[chars_at].to_pylist(), new, changed, strict=True)], pa.int64()).cast(cols[chars_at].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(met, run, docs.schema)
