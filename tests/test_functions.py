from datetime import datetime

import pytest
from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.operators import staging as stg


def apply(spark, column, *values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_overlay_only_touches_eight_character_codes_of_the_axis(spark):
    codes = ["T1234015", " t1234015 ", "T1234035", "T123401", "T12340155", "M1234015", None, " T12 "]
    assert apply(spark, lambda c: fn.overlay_code(c, "T", "12"), *codes) == [
        "T12345", "t12345", "T1234035", "T123401", "T12340155", "M1234015", "", "T12",
    ]
    assert apply(spark, lambda c: fn.overlay_code(c, "M", "1234"), "M1234047", "M1234057") == ["M12347", "M1234057"]


def test_prefix_strip_and_identity(spark):
    assert apply(spark, fn.prefix_code, " T1234567 ", "T1", None) == ["T12345", "T1", None]
    assert apply(spark, fn.strip_code, " T-12-34 ", None) == ["T1234", None]
    assert apply(spark, lambda c: fn.identity_code(c, trimmed=False), " T ", None) == [" T ", None]


def test_axis_rules_test_the_raw_code_and_drop_null(spark):
    df = spark.createDataFrame([("T1",), ("t2",), (" T3",), ("M1",), ("X",), (None,)], "c string")

    def kept(rule):
        return [r.c for r in stg.split_axis(df, "c", rule).collect()]

    assert kept("t") == ["T1", "t2"]
    assert kept("not_t") == [" T3", "M1", "X"]
    assert kept("t_column") == ["T1", "t2", " T3", "X"]
    assert kept("m_column") == [" T3", "M1", "X"]


def test_sample_numbers(spark):
    assert apply(spark, fn.is_wanted_sample, "A1", "aX", "AN1", "an", "X1", "A", None) == [
        True, True, False, False, False, False, None,
    ]


def test_one_missing_year_makes_the_total_null(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], "a int, b int")
    assert [r.n for r in stg.sum_years(df, ["a", "b"], "n").collect()] == [3, None]


def test_open_end(spark):
    moments = [datetime(2017, 12, 29), datetime(2017, 12, 30), None]
    assert apply(spark, fn.open_end, *moments, schema="v timestamp_ntz") == [None, moments[1], None]


def test_mapper_label_skips_missing_parts(spark):
    df = spark.createDataFrame([("Last", "First", "Org"), ("Last", None, "Org")], "a string, b string, c string")
    labels = [r[0] for r in df.select(fn.mapper(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert labels == ["Last, F (Org)", "Last,  (Org)"]


@pytest.mark.parametrize(
    "term,expected",
    [
        ("Heart (body structure)", "Heart"),
        ("A (b) (c)", "A (b)"),
        ("(only)", "(only)"),
        ("none", "none"),
        ("x(y)", ""),
        ("", ""),
    ],
)
def test_semantic_tag_is_cut_one_character_early(spark, term, expected):
    assert apply(spark, fn.without_semantic_tag, term) == [expected]


def test_identifier_kind(spark):
    values = ["138875005", "73211017", "900", "12a04", "99", None]
    assert apply(spark, fn.identifier_kind, *values) == ["concept", "description", "concept", None, None, None]


def test_search_phrase(spark):
    assert apply(spark, fn.search_phrase, " Heart (A) (B) ", "ab", "abc") == ["heart a (b)".replace("(b)", "(b)"), None, "abc"]
    assert apply(spark, lambda c: fn.search_phrase(c, "regex"), " A(b) ") == ["A(b)"]


def test_event_type_needs_both_parts_missing(spark):
    df = spark.createDataFrame([(None, None), ("c", None), (None, "t")], "a string, b string")
    kinds = [r[0] for r in df.select(fn.request_event_type(F.col("a"), F.col("b"))).collect()]
    assert kinds == ["Incorrect concept", "User mapping", "User mapping"]
