"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are runs without white space, cut after TOKEN characters so that scripts
without blanks have tokens too. Hashes of K tokens roll over the text; each window of
WINDOW hashes gives its least, the rightmost of equals, with its position. Any run of
WINDOW + K - 1 equal tokens in two texts leaves an equal hash in both.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, text_key

K, WINDOW, TOKEN = 5, 8, 16
#: Low bits of a packed number that hold the position, counted down so that the least is the rightmost: as many as an array can have places. The hash's high bits stand above them.
PLACE = 31
#: Rows that a range of ids holds, about, and ranges at most.
RANGE, RANGES = 2000, 16_384


def tokens(text: Column, longest: int = TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{longest}}}"), F.lit(0))


def _shifted(a: Column, b: Column, by: int, f) -> Column:
    """f(a[i], b[i + by]) for every i that has both. a and b are columns, so nothing is worked out twice."""
    n = F.size(b) - by
    return F.when(n > 0, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(by + 1), n), f)).otherwise(F.array().cast("array<bigint>"))


def _join(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def with_rolled(df: DataFrame, tokens_: str, name: str, k: int = K) -> DataFrame:
    """Adds name: hashes of k tokens, by joining runs whose lengths are powers of two."""
    have, done, length, temps = tokens_, 0, 1, []
    df = df.withColumn(name, F.lit(None).cast("array<bigint>"))
    while k:
        if k & 1:
            df = df.withColumn(name, _shifted(F.col(name), F.col(have), done, _join) if done else F.col(have))
            done += length
        k >>= 1
        if k:
            temps.append(f"{name}_{length}")
            df = df.withColumn(temps[-1], _shifted(F.col(have), F.col(have), length, _join))
            have, length = temps[-1], length * 2
    return df.drop(*temps)


_LOW = (1 << PLACE) - 1


def packed(hashes: Column) -> Column:
    """High bits of the hash over the position counted down."""
    return F.transform(hashes, lambda h, i: F.shiftleft(F.shiftright(h, PLACE), PLACE).bitwiseOR(F.lit(_LOW).cast("long") - i.cast("long")))


def with_minima(df: DataFrame, packed_: str, name: str, window: int = WINDOW) -> DataFrame:
    """Adds name: the least of each window (of all, if they are fewer), each chosen place once; windows double until they are wide enough."""
    have, length, temps, lower = packed_, 1, [], lambda a, b: F.least(a, b)
    while length < window:
        by = min(length, window - length)
        temps.append(f"{name}_{length}")
        df = df.withColumn(temps[-1], _shifted(F.col(have), F.col(have), by, lower))
        have, length = temps[-1], length + by
    p = F.col(packed_)
    return df.withColumn(name, F.when(F.size(p) >= window, F.array_distinct(F.col(have))).when(F.size(p) > 0, F.array(F.array_min(p))).otherwise(F.array().cast("array<bigint>"))).drop(*temps)


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds name, array<bigint> of the chosen hashes in order, and name_at, their token positions. A text of fewer than k tokens is hashed whole; one without tokens has none.

    Each step is a column of its own, so that none is worked out twice.
    """
    t, r, h, g, m = (f"_{name}_{x}" for x in "trhgm")
    df = df.withColumn(t, F.transform(tokens(F.col(text)), lambda w: F.xxhash64(w)))
    df = with_rolled(df, t, r, k)
    df = df.withColumn(h, F.when(F.size(t) >= k, F.col(r)).when(F.size(t) > 0, F.array(F.xxhash64(t))).otherwise(F.array().cast("array<bigint>")))
    df = with_minima(df.withColumn(g, packed(F.col(h))), g, m, window)
    df = df.withColumn(f"{name}_at", F.transform(m, lambda p: (F.lit(_LOW).cast("long") - p.bitwiseAND(F.lit(_LOW).cast("long"))).cast("int")))
    return df.withColumn(name, F.transform(f"{name}_at", lambda p: F.get(F.col(h), p))).drop(t, r, h, g, m)


def digest(hashes: Column, positions: Column) -> Column:
    """A short name of a fingerprint, hashes and positions."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.xxhash64(F.lit(s), hashes, positions)), 16, "0")) for s in (0, 1)])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of the hashes; two without any are alike."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(x) + F.size(y) - both))


def fingerprint(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """docs with hashes and positions added (columns so called are replaced, all others kept). A null text is empty."""
    kept = [c for c in docs.columns if c not in ("hashes", "positions")]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    out = with_fingerprint(row.withColumn("text", F.coalesce("row.text", F.lit(""))), "text", "fp", k, window)
    return out.select("row.*", F.col("fp").alias("hashes"), F.col("fp_at").alias("positions"))


def _count_below(bounds: list[tuple[int, int]], k: Column, t: Column) -> Column:
    """How many of the sorted pairs are less than (k, t), in two steps of a square root each."""
    if not bounds:
        return F.lit(0)
    side = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    number = lambda b: f"{b}L" if b > -(2**63) else "cast('-9223372036854775808' as bigint)"
    array = lambda v: F.expr("array(" + ",".join(f"struct({number(x)} AS k, {number(y)} AS t)" for x, y in v) + ")")
    here = F.struct(k.alias("k"), t.alias("t"))
    block = F.size(F.filter(array([r[-1] for r in rows]), lambda b: b < here))  # whole rows below
    within = F.get(F.array(*[array(r) for r in rows]), block)
    return block * side + F.coalesce(F.size(F.filter(within, lambda b: b < here)), F.lit(0))


def bounds_of(cuts: list[int]) -> list[tuple[int, int]]:
    """Quantiles of ids as pairs (id, text key). An id that is several of the quantiles holds as many ranges' rows: it is divided evenly by the key of the text, which is a hash."""
    out, times = [], Counter(cuts)
    for k in sorted(times):
        n = times[k]
        out += [(k, -(2**63) + j * (2**64 // n)) for j in range(1, n)] + [(k, 2**63 - 1)]
    return out


def seat(df: DataFrame, range_rows: int | None = None) -> DataFrame:
    """Rows by ranges of descending doc_id (_k, _t, _range), each range with a guest: the first row of the range below it.

    Null ids come last; rows of one id are ordered by their text's key; the first row
    of all is the guest of the lowest range. Ranges are cut at quantiles of all ids, and
    an id with many rows by the text's key, too; one shuffle brings a range together,
    so no task holds more than a few of them, but for one text under one id.
    """
    seated = df.withColumn("_k", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("_t", text_key())
    n = df.count()
    parts = min(RANGES, max(1, n // (range_rows or RANGE)))
    cuts = seated.agg(F.percentile_approx("_k", [i / parts for i in range(1, parts)] or [1.0], max(10_000, parts * 20))).first()[0] or [] if parts > 1 else []
    seated = seated.withColumn("_range", _count_below(bounds_of(cuts), F.col("_k"), F.col("_t")).cast("int"))
    first = seated.groupBy("_range").agg(F.max(F.struct("_k", "_t")).alias("x"))
    everywhere = Window.orderBy("_range")  # RANGES rows, and one, at most
    above = F.coalesce(F.lead("_range").over(everywhere), F.first("_range").over(everywhere))
    guests = save(first.select(F.col("x._k").alias("_gk"), F.col("x._t").alias("_gt"), above.alias("_guest_of")), "guests")
    met = seated.join(F.broadcast(guests), (F.col("_k") == F.col("_gk")) & (F.col("_t") == F.col("_gt")), "left").drop("_gk", "_gt")
    seats = F.filter(F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("_guest_of").alias("range"), F.lit(1).alias("guest"))), lambda s: s["range"].isNotNull())
    return met.withColumn("_s", F.explode(seats)).withColumn("_range", F.col("_s.range")).withColumn("_guest", F.col("_s.guest")).drop("_s", "_guest_of").repartition("_range")


def follow(seated: DataFrame, payload: list[str]) -> DataFrame:
    """Adds next: a struct of the payload of the row that follows."""
    w = Window.partitionBy("_range").orderBy("_guest", F.col("_k").desc(), F.col("_t").desc())
    return seated.withColumn("next", F.lead(F.struct(*payload)).over(w)).filter("_guest = 0").drop("_k", "_t", "_range", "_guest")


def half_edit(text: Column, n: Column, other: Column) -> Column:
    """The last floor(n / 2) characters of text replaced by the first as many, or all, of other."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(other, F.lit(1), half))


def compare_with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, fp_at, edited_fp, edited_fp_at (hashes and positions), near_edited, near_next, for every row.

    The text is shuffled once; fingerprints are made after the shuffle.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    met = follow(with_fingerprint(seat(base), "text", "fp", k, window), ["text", "fp"])
    met = met.withColumn("n_chars", F.length("text").cast("long"))
    met = met.withColumn("edited", half_edit(F.col("text"), F.col("n_chars").cast("int"), F.col("next.text")))
    met = with_fingerprint(met, "edited", "edited_fp", k, window)
    return met.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "fp_at", "edited_fp", "edited_fp_at", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next.fp")).alias("near_next"))
