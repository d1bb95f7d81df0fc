import math

import pytest
from pyspark.sql import functions as F
from tests.conftest import rows

from veilwright.functions.masks import mask_prefix, mask_tail
from veilwright.functions.text import number_text
from veilwright.functions.values import as_moment, as_number, wall_micros
from veilwright.operators import bins
from veilwright.operators.categories import category, map_values, typed
from veilwright.operators.generalize import generalize, generalize_auto
from veilwright.operators.hierarchy import hierarchy_table
from veilwright.operators.wildcard import sentinel_to_null
from veilwright.spec import parse_rules


def one(df, value):
    return [r[0] for r in df.select(value).collect()]


def test_number_text_reads_like_the_float_type(spark):
    numbers = [0.0, 1.0, -0.5, 25.5, 39848009.0, 12345678.125, 1e15, 123456789012345.6, 1e16, 1.5e16, 1e22, 2.5e100]
    numbers += [0.001, 0.00012345, 0.0001, 1e-5, 1.25e-10, -39848009.5, 9999999.5, 99999999.25]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert one(df, number_text(F.col("x"))) == [str(x) for x in numbers]


def test_ordering_first_layer_wins_and_rest_keeps_its_text(spark):
    rules = parse_rules({"x": {"method": "ordering", "layers": [{"min": 20, "max": 30}, {"min": 30, "max": 45}]}})
    values = [20.0, 30.0, 30.5, 45.0, 46.25, None, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert one(generalize(df, rules), "x") == ["20.0-30.0", "20.0-30.0", "30.0-45.0", "30.0-45.0", "46.25", None, None]
    whole = spark.createDataFrame([(20,), (50,), (None,)], "x int")
    assert one(generalize(whole, rules), "x") == ["20.0-30.0", "50", None]
    text = spark.createDataFrame([(" 25 ",), ("abc",), ("",), ("50",), ("50.5",), ("30d",), ("1e2",)], "x string")
    assert one(generalize(text, rules), "x") == ["20.0-30.0", None, None, "50", "50.5", None, "100.0"]


def test_dates_bounds_included_bad_text_null(spark):
    layers = [{"min": "2000-01-01", "max": "2000-12-31"}, {"min": "2000-12-31", "max": "2001-06-30"}]
    rules = parse_rules({"d": {"method": "dates", "layers": layers}})
    values = ["2000-01-01", "2000-12-31", "2001/6/30", "2001-06-30 00:00:01", "1999-12-31", "31.12.1999", None]
    df = spark.createDataFrame([(v,) for v in values], "d string")
    first, second = "2000-01-01 - 2000-12-31", "2000-12-31 - 2001-06-30"
    assert one(generalize(df, rules), "d") == [
        first, first, second, "2001-06-30 00:00:01", "1999-12-31 00:00:00", None, None
    ]


def test_moments_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.25' AS d")
    plain = one(df, wall_micros(as_moment(df, "d")))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(df, wall_micros(as_moment(df, "d"))) == plain
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_mask_prefix(spark):
    df = spark.createDataFrame([("12345",), ("12",), ("1",), ("",), (None,)], "x string")
    assert one(df, mask_prefix(F.col("x"), "aa***")) == ["12***", "**", "*", "", "Masked"]
    assert one(df, mask_prefix(F.col("x"), "*")) == ["*", "*", "*", "", "Masked"]
    # the default pattern has six letters and no star
    assert one(df, mask_prefix(F.col("x"), "Masked")) == ["*****", "**", "*", "", "Masked"]


def test_mask_tail(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("Masked",), (None,)], "x string")
    assert one(df, mask_tail(F.col("x"))) == ["ab**", "Masked", "Masked", "Masked"]
    assert one(df, mask_tail(F.col("x"), short=None, null_as=None, marker_stays=False)) == ["ab**", "ab", "Mask**", None]


def test_category(spark):
    df = spark.createDataFrame([("a",), ("Masked",), (None,)], "x string")
    assert one(df, category(df, "x")) == ["a", "Unknown", None]
    numbers = spark.createDataFrame([(39848009.0,), (None,)], "x double")
    assert one(numbers, category(numbers, "x")) == ["39848009.0", None]


def test_typed_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b"), (5, None)], "id int, x string")
    assert rows(typed(df, "x", "id")) == [(1, "type1"), (2, None), (3, "type3"), (4, "type1"), (5, None)]
    assert rows(typed(df, "x", "id", null_as="Unknown"))[1] == (2, "Unknown")
    assert rows(typed(df, "x", "id", prefix="t", number_null=True))[1] == (2, "t2")


def test_typed_over_far_positions(spark):
    at = [5, 2**16 + 1, 2**40 + 7, 2**40 + 8, 2**55, -3]
    df = spark.createDataFrame([(p, f"v{i}") for i, p in enumerate(at)], "id bigint, x string")
    order = {p: i + 1 for i, p in enumerate(sorted(at))}
    assert dict(rows(typed(df, "x", "id"))) == {p: f"type{order[p]}" for p in at}


def test_typed_needs_an_order(spark):
    df = spark.createDataFrame([("a", 1.5)], "x string, o double")
    with pytest.raises(ValueError, match="whole numbers"):
        typed(df, "x", "o")
    with pytest.raises(ValueError, match="order_col"):
        generalize_auto(df, ["x"], parse_rules({"x": "category"}))


def test_map_values(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert one(map_values(df, "x", {"a": "A"}, keep_unmapped=True), "x") == ["A", "b", None]
    assert one(map_values(df, "x", {"a": "A"}, keep_unmapped=False), "x") == ["A", None, None]


def test_equal_width_edges(spark):
    def label(values, null_bin="null"):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        return one(df, bins.equal_width(df, "x", null_bin))

    assert label([0.0, 1.0, 2.0, 3.0]) == ["0-1", "1-2", "2-3", "2-3"]
    assert label([-9.9, 0.5, 9.9]) == ["-9-0", "0-9", "0-9"]
    assert label([1.0, 7.0]) == ["1-7", "1-7"]
    assert label([4.0, 4.0, None]) == ["4-4", "4-4", None]
    # NULL counts as a value in the older modes: two values and NULL give three edges
    assert label([0.0, 10.0, None], "first") == ["0-5", "5-10", "0-5"]
    assert label([0.0, 10.0, None], "last") == ["0-5", "5-10", "5-10"]
    assert label([None, None]) == [None, None]


def test_decade_edges(spark):
    df = spark.createDataFrame([(x,) for x in (20.0, 21.0, 30.0, 30.5, 41.0, None)], "x double")
    assert one(df, bins.decade(df, "x")) == ["20-30", "20-30", "20-30", "30-40", "40-50", None]
    same = spark.createDataFrame([(20.0,)], "x double")
    assert one(same, bins.decade(same, "x")) == ["20-30"]


def test_date_bins(spark):
    days = ["2000-01-01", "2000-01-02", "2000-01-06", None]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    assert one(df, bins.dates_equal(df, "d")) == [
        "2000-01-01 00:00:00 - 2000-01-02 00:00:00", "2000-01-02 00:00:00 - 2000-01-03 00:00:00", None, "Unknown"
    ]
    assert one(df, bins.dates_adaptive(df, "d")) == [
        "2000-01-01 - 2000-01-03", "2000-01-01 - 2000-01-03", "2000-01-03 - 2000-01-06", "2000-01-01 - 2000-01-03"
    ]
    assert one(df, bins.year(df, "d")) == ["2000", "2000", "2000", "2000"]
    assert one(df, bins.quarter(df, "d")) == ["Q1", "Q1", "Q1", "Unknown"]
    none = spark.createDataFrame([(None,), ("x",)], "d string")
    assert one(none, bins.dates_equal(none, "d")) == ["Unknown", "Unknown"]


def test_auto_defaults_and_unknown_rule(spark):
    df = spark.createDataFrame([(1.0, "u", "keep"), (4.0, "v", "keep")], "x double, y string, z string")
    assert rows(generalize_auto(df, ["x", "y"])) == [("1-4", "General Category", "keep")] * 2
    with pytest.raises(ValueError, match="unknown in style"):
        generalize_auto(df, ["x"], parse_rules({"x": "sorting"}))
    styled = generalize_auto(df, ["y"], parse_rules({"y": "masking"}), style="adaptive")
    assert one(styled, "y") == ["Masked", "Masked"]


def test_rules_beyond_the_table(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError, match="missing"):
        generalize(df, parse_rules({"missing": {"method": "category"}}))
    assert rows(generalize(df, parse_rules({"x": {"method": "else"}}))) == [(1,)]


def test_hierarchy_of_a_constant(spark):
    df = spark.createDataFrame([(7,), (None,)], "x int")
    assert rows(hierarchy_table(df, "x")) == [(7, 0, "7"), (7, 1, "7-7"), (7, 2, "7-7"), (7, 3, "7-7"), (7, 4, "*")]


def test_sentinel(spark):
    df = spark.createDataFrame([(-2147483648,), (3,), (None,)], "x int")
    assert one(sentinel_to_null(df, ["x"]), "x") == [None, 3, None]


def test_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "x string")
    assert one(df, as_number(df, "x")) == [1.5, None, None, None]


def test_look_up_tables_never_multiply_rows(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    twice = spark.createDataFrame([("a", "x"), ("a", "x")], "value string, label string")
    assert rows(map_values(df, "v", twice, keep_unmapped=True)) == sorted([("x",), ("b",), (None,)], key=str)
    unlike = spark.createDataFrame([("a", "x"), ("a", "y")], "value string, label string")
    with pytest.raises(Exception, match="different labels"):
        map_values(df, "v", unlike, keep_unmapped=True).collect()
    with pytest.raises(ValueError, match="more than one label"):
        map_values(df, "v", {1: "a", "1": "b"}, keep_unmapped=True)
