"""Windows to text (F1 to F7) and prompt assembly (M4a, M5), as columns over x: array<array<bigint>>, positions by dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of(v) -> Column:
    return v.cast("string")


def spaced(s) -> Column:
    """A blank between all characters."""
    return F.rtrim(F.regexp_replace(s, "(.)", "$1 "))


def format_as_string(x, sep: str = ",", space: bool = False) -> Column:
    """row-major values joined by sep."""
    s = F.array_join(F.transform(F.flatten(x), text_of), sep)
    return spaced(s) if space else s


def zero_fill(v, width) -> Column:
    """Zeros after the sign up to width; never cuts."""
    digits = text_of(F.abs(v))
    fill = lambda w: F.lpad(digits, F.greatest(w, F.length(digits)), F.lit("0"))
    return F.when(v < 0, F.concat(F.lit("-"), fill(width - 1))).otherwise(fill(width))


def digits_needed(x) -> Column:
    """The most digits of any value of a window, signs left out."""
    return F.array_max(F.transform(F.flatten(x), lambda v: F.length(text_of(F.abs(v)))))


def value_interleave(x, width, sep: str = ",") -> Column:
    """every value in width places (cut to them), dimensions side by side; ends with sep."""
    return F.concat(F.array_join(F.transform(x, lambda r: F.array_join(F.transform(r, lambda v: F.substr(zero_fill(v, width), F.lit(1), width)), "")), sep), F.lit(sep))


def digit_interleave(x, width, sep: str = ",") -> Column:
    """first digits of all dimensions, then second digits, and so on; ends with sep."""
    one = lambda r: F.array_join(F.transform(F.sequence(F.lit(1), width), lambda p: F.array_join(F.transform(r, lambda v: F.substr(zero_fill(v, width), p, F.lit(1))), "")), "")
    return F.concat(F.array_join(F.transform(x, one), sep), F.lit(sep))


def json_format(x, separator: str = ",") -> Column:
    """d<dim>:<value> pairs; always joined by commas, whatever the separator."""
    return F.array_join(F.flatten(F.transform(x, lambda r: F.transform(r, lambda v, i: F.concat(F.lit("d"), text_of(i), F.lit(":"), text_of(v))))), ",")


def univariate_control(x, target_column: int = 0, sep: str = ",") -> Column:
    """one dimension only."""
    return F.array_join(F.transform(x, lambda r: text_of(r[target_column])), sep)


persistence_control = univariate_control


def tuples(x) -> Column:
    """Rows as (a,b,...), which get_examples() can read back."""
    return F.array_join(F.transform(x, lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, text_of), ","), F.lit(")"))), ",")


def get_examples(text, k: int = 3) -> Column:
    """M5: the first k parenthesised groups."""
    return F.slice(F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), F.lit(1)), 1, k)


def prompt(text, system: str, user: str, one_shot: str = "", normal=None, marker: str = "[RESPONSE]") -> Column:
    """Parts joined by single blanks; a one-shot part that is absent leaves its blank."""
    shot = F.lit("") if normal is None else F.concat(F.lit(one_shot), normal, F.lit("\n\n"))
    return F.concat_ws(" ", F.lit(system), shot, F.lit(user), text, F.lit(marker))


def multivariate_prompt(text, system: str, user: str, marker: str = "[RESPONSE]", k: int = 3) -> Column:
    """M4a for several dimensions: the user part shows the first examples in place of {examples}."""
    shown = F.array_join(F.transform(get_examples(text, k), lambda e: F.concat(F.lit("("), e, F.lit(")"))), ", ")
    head, _, tail = user.partition("{examples}")
    return F.concat_ws(" ", F.lit(system), F.lit(""), F.concat(F.lit(head), shown, F.lit(tail)), text, F.lit(marker))


#: F8: an encoder by name; width is used by the interleaved ones.
ENCODERS = {
    "value_concatenation": lambda x, width=None, target_column=0, sep=",": format_as_string(x, sep),
    "value_interleave": lambda x, width=None, target_column=0, sep=",": value_interleave(x, width, sep),
    "digit_interleave": lambda x, width=None, target_column=0, sep=",": digit_interleave(x, width, sep),
    "json_format": lambda x, width=None, target_column=0, sep=",": json_format(x, sep),
    "univariate_control": lambda x, width=None, target_column=0, sep=",": univariate_control(x, target_column, sep),
    "persistence_control": lambda x, width=None, target_column=0, sep=",": persistence_control(x, target_column, sep),
}
