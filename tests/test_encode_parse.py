"""Vectors of encoders and parsers."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import encode as E
from tidemark.functions import parse as R


def x_of(rows):
    return F.array(*[F.array(*[F.lit(v).cast("bigint") for v in r]) for r in rows])


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


ONE = [[1], [2], [3], [4], [5]]


@pytest.mark.parametrize(("kw", "want"), [({}, "1,2,3,4,5"), ({"space": True}, "1 , 2 , 3 , 4 , 5"), ({"sep": "."}, "1.2.3.4.5")])
def test_format_as_string(spark, kw, want):
    assert value(spark, E.format_as_string(x_of(ONE), **kw)) == want


def test_space_goes_between_all_characters(spark):
    assert value(spark, E.format_as_string(x_of([[12], [3]]), space=True)) == "1 2 , 3"


W2 = [[[1234, 500], [101, 500]], [[30, 10], [32, 14]]]


def test_interleaved(spark):
    four = F.lit(4)
    assert [value(spark, E.value_interleave(x_of(w), four)) for w in W2] == ["12340500,01010500,", "00300010,00320014,"]
    assert [value(spark, E.digit_interleave(x_of(w), four)) for w in W2] == ["10253040,00150010,", "00003100,00003124,"]


def test_width_ignores_signs(spark):
    assert value(spark, E.digits_needed(x_of([[-1234, 5]]))) == 4


def test_json_concat_and_controls(spark):
    assert value(spark, E.json_format(x_of([[1, 2], [3, 4]]), ";")) == "d0:1,d1:2,d0:3,d1:4"
    assert value(spark, E.ENCODERS["value_concatenation"](x_of([[100, 200], [300, 400]]))) == "100,200,300,400"
    assert value(spark, E.univariate_control(x_of([[1, 10], [2, 20]]), 1)) == "10,20"


def test_prompt_keeps_the_blank_of_an_absent_shot(spark):
    assert value(spark, E.prompt(F.lit("1,2"), "S", "U")) == "S  U 1,2 [RESPONSE]"
    assert value(spark, E.prompt(F.lit("1,2"), "S", "U", "N: ", F.lit("9"))) == "S N: 9\n\n U 1,2 [RESPONSE]"


def test_examples(spark):
    assert value(spark, E.get_examples(F.lit("(1,2),(3,4),(5,6),(7,8)"))) == ["1,2", "3,4", "5,6"]


NOISE = "1 , 2!e , 3,4,5"


@pytest.mark.parametrize(("errors", "want"), [("ignore", [1, 3, 4, 5]), ("filter", [1, 2, 3, 4, 5]), ("coerce", [1, None, 3, 4, 5])])
def test_error_strategies(spark, errors, want):
    got = value(spark, R.string_to_numbers(F.lit(NOISE), errors=errors))
    assert [None if math.isnan(v) else v for v in got] == want


def test_trunc_raise_and_unknown(spark):
    assert value(spark, R.string_to_numbers(F.lit("134,252,3,412,51"), trunc=2)) == [134, 252]
    assert value(spark, R.string_to_numbers(F.lit(""))) == []
    with pytest.raises(KeyError):
        R.string_to_numbers(F.lit("1"), errors="never")
    with pytest.raises(Exception, match="not a number"):
        value(spark, R.string_to_numbers(F.lit(NOISE), errors="raise"))


def test_whitespace_glues_numbers(spark):
    assert value(spark, R.whole(F.lit("1 2,3"))) == [12, 3]


def test_multivariate_parsers(spark):
    three = F.lit(3)
    assert value(spark, R.value_concatenation(F.lit("10,20,30,40"), 2, 1)) == [20, 40]
    assert value(spark, R.value_interleave(F.lit("001023,045006,"), three, 1)) == [23, 6]
    assert value(spark, R.value_interleave(F.lit("001023,045,"), three, 1)) == [23, None]
    assert value(spark, R.digit_interleave(F.lit("000012,000034,"), three, 0)) == [1, 3]
    assert value(spark, R.digit_interleave(F.lit("000012,000034,"), three, 1)) == [2, 4]
    assert value(spark, R.digit_interleave(F.lit("000012,"), three, 2)) == [None]
    assert value(spark, R.json_format(F.lit("d0:7,d1:8,d0:9"), 0, 5)) == [7, 9, None, None, None]
    assert value(spark, R.json_steps(F.lit("d0:10,d1:11,d0:20"), [1, 2, 5])) == {1: 10, 2: 20, 5: None}
    with pytest.raises(ValueError, match="num_dims"):
        R.value_concatenation(F.lit("1"), 0)


@pytest.mark.parametrize(("text", "want"), [("1,2,3", 3), ("4,5", 5), ("99", 99), ("7,8,", 8), ("", None)])
def test_last_value(spark, text, want):
    assert value(spark, R.last_value(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("No anomaly detected", ""), ("Answer: no anomalies", ""), ("Answer: [123, 456]", "123,456"), ("[1,2,3,]", "1,2,3"), ("[1,,2,3]", "1,2,3"), ("[1, 2, 3], [5]", "1,2,3"), ("nothing", "")])
def test_lists(spark, text, want):
    assert value(spark, R.parse_anomaly_response(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("[[1, 3], [5, 7]]", [1, 2, 3, 5, 6, 7]), ("[[1,,3]]", [1, 2, 3]), ("[[1, 2], [3]]", [1, 2]), ("[[1, 2]] and [[1, 2]]", [1, 2, 1, 2]), ("[9, 7]", []), ("no anomalies", [])])
def test_intervals(spark, text, want):
    assert value(spark, R.parse_anomaly_response(F.lit(text), True)) == want


def test_interval_bombs_are_clipped(spark):
    assert value(spark, R.parse_anomaly_response(F.lit("[0, 999999999999]"), True, 4)) == [0, 1, 2, 3, 4]


def test_extract(spark):
    assert value(spark, R.extract_response(F.lit("p [RESPONSE] 1,2"))) == " 1,2"
    assert value(spark, R.extract_response(F.lit("p"))) == ""
