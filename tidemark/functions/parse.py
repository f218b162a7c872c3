"""Text to numbers (R1 to R13, M4 extraction), as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STRATEGIES = ("ignore", "filter", "coerce", "raise")


def _quoted(sep: str) -> str:
    return re.escape(sep)


def tokens(text, sep: str = ",") -> Column:
    """White space goes first (it may stand inside numbers), then empty tokens."""
    return F.filter(F.split(F.regexp_replace(text, r"\s+", ""), _quoted(sep)), lambda t: t != "")


def string_to_numbers(text, sep: str = ",", trunc: int | None = None, errors: str = "ignore") -> Column:
    """array<double>. A token with anything but digits is dropped, stripped, NaN or an error, by strategy."""
    if errors not in STRATEGIES:
        raise KeyError(f"unknown strategy {errors!r}")
    t, bad = tokens(text, sep), lambda v: v.rlike(f"[^0-9|{_quoted(sep)}]")
    number = lambda v: v.try_cast("double")
    out = {
        "ignore": lambda: F.transform(F.filter(t, lambda v: ~bad(v)), number),
        "filter": lambda: F.transform(F.transform(t, lambda v: F.regexp_replace(v, f"[^0-9|{_quoted(sep)}]", "")), number),
        "coerce": lambda: F.transform(t, lambda v: F.when(bad(v), F.lit(float("nan"))).otherwise(number(v))),
        "raise": lambda: F.transform(t, lambda v: F.when(bad(v), F.raise_error(F.concat(F.lit("not a number: "), v)).cast("double")).otherwise(number(v))),
    }[errors]()
    return F.slice(out, 1, trunc) if trunc else out


def whole(text, sep: str = ",", trunc: int | None = None, errors: str = "ignore") -> Column:
    """The same as whole numbers."""
    return F.transform(string_to_numbers(text, sep, trunc, errors), lambda v: v.cast("bigint"))


def value_concatenation(text, num_dims: int, target_column: int = 0, trunc: int | None = None, sep: str = ",", errors: str = "ignore") -> Column:
    """Every num_dims-th value from the target's."""
    if not num_dims:
        raise ValueError("num_dims must be known")
    out = F.filter(whole(text, sep, None, errors), lambda v, i: i % num_dims == target_column)
    return F.slice(out, 1, trunc) if trunc else out


def strip_seps(text, sep: str = ",") -> Column:
    q = "[" + re.escape(sep) + "]+"
    return F.regexp_replace(text, f"^{q}|{q}$", "")


def _digits(s) -> Column:
    return s.try_cast("bigint")


def value_interleave(text, width, target_column: int = 0, trunc: int | None = None, sep: str = ",") -> Column:
    """The target's chunk of width places in each token, NULL if it is short of one."""
    parts = F.filter(F.split(strip_seps(text, sep), _quoted(sep)), lambda t: t != "")
    parts = F.slice(parts, 1, trunc) if trunc else parts
    return F.transform(parts, lambda t: _digits(F.nullif(F.substr(t, F.lit(target_column) * width + 1, width), F.lit(""))))


def digit_interleave(text, width, target_column: int = 0, trunc: int | None = None, sep: str = ",") -> Column:
    """The digits at p * nv + target, nv = length / width values in a token; NULL beyond them."""
    parts = F.split(strip_seps(text, sep), _quoted(sep))
    parts = F.filter(F.slice(parts, 1, trunc) if trunc else parts, lambda t: t != "")

    def pick(t):
        nv = F.floor(F.length(t) / width).cast("int")
        got = F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda p: F.substr(t, (p * nv + target_column + 1).cast("int"), F.lit(1))), "")
        return F.when(nv > target_column, _digits(got))

    return F.transform(parts, pick)


def json_values(text, target_column: int = 0) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rf"d{int(target_column)}:(\d+)"), F.lit(1)), lambda v: v.cast("bigint"))


def json_format(text, target_column: int = 0, trunc: int | None = None) -> Column:
    """The target's values; with trunc exactly so many, NULL where there are none."""
    got = json_values(text, target_column)
    return F.transform(F.sequence(F.lit(0), F.lit(trunc - 1)), lambda i: F.get(got, i)) if trunc else got


def json_steps(text, steps: list[int], target_column: int = 0) -> Column:
    """Step -> the value so many steps ahead, or NULL."""
    got = json_values(text, target_column)
    return F.map_from_arrays(F.array(*map(F.lit, steps)), F.array(*[F.get(got, F.lit(s - 1)) for s in steps]))


def last_value(text, sep: str = ",") -> Column:
    """The last value of a text."""
    return _digits(F.try_element_at(F.split(strip_seps(text, sep), _quoted(sep)), F.lit(-1)))


def clean_response(text) -> Column:
    """Trimmed, lower case, one comma for several; a denial is an empty answer."""
    c = F.regexp_replace(F.lower(F.trim(text)), ",+", ",")
    return F.when(c.contains("no anomalies") | c.contains("no anomaly"), F.lit("")).otherwise(c)


GROUP = r"\[([\d\s,]+)\]"


def list_response(clean) -> Column:
    """The first bracketed list, blanks dropped."""
    return F.array_join(F.filter(F.transform(F.split(F.regexp_extract(clean, GROUP, 1), ","), lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")), lambda v: v != ""), ",")


def interval_response(clean, least=0, most=None) -> Column:
    """Every bracketed pair as the positions it spans; reversed pairs give none. Spans are clipped to the window when its size is known."""
    pairs = F.transform(F.regexp_extract_all(clean, F.lit(GROUP), F.lit(1)), lambda g: F.transform(F.filter(F.split(g, ","), lambda v: F.trim(v) != ""), lambda v: F.regexp_replace(v, r"\s", "").cast("bigint")))
    low = lambda a: F.greatest(a[0], F.lit(least))
    high = lambda a: a[1] if most is None else F.least(a[1], F.lit(most))
    return F.flatten(F.transform(F.filter(pairs, lambda a: F.size(a) == 2), lambda a: F.when(low(a) <= high(a), F.sequence(low(a), high(a))).otherwise(F.array().cast("array<bigint>"))))


def parse_anomaly_response(text, interval: bool = False, most=None) -> Column:
    """A list text, or positions."""
    return interval_response(clean_response(text), most=most) if interval else list_response(clean_response(text))


def extract_response(text, marker: str = "[RESPONSE]") -> Column:
    """M4: what follows the marker, or nothing."""
    return F.coalesce(F.get(F.split(text, re.escape(marker)), F.lit(1)), F.lit(""))
