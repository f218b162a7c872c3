"""Registered queries against their SQL twins, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
import compare

import __spark_entry__ as entry
from tidemark import queries as base

D = "/root/testdata/sf0.001"
SOME = ["bucket_mean", "float2scalar", "windows_prompter", "fmt_digit_interleave", "parse_int_coerce", "parse_intervals", "format_anomalies", "agg_rolling_median", "find_anomalies_fixed", "pipeline_prompter", "contextual_scores", "leaderboard"]


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    assert ": same" in compare.compare(spark, compare.connect(D), name, D)


def test_entry(spark):
    assert entry.entry(spark).columns


def test_every_twin_has_a_query():
    assert set(base.SQL) <= set(base.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
