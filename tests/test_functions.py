"""Column expressions at the edges where null, rounding and bins differ between engines."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from creatorlens import functions as fn
from creatorlens.plans.cleaning import parse_columns, tier_label
from creatorlens.plans.reports import report_tier, sub_tier
from creatorlens.specs import DEFAULT_SPEC


def apply(spark, values, expr, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_removes_unicode_space(spark):
    assert apply(spark, [" a\t", " b ", " ", None], fn.strip) == ["a", "b", "", None]


def test_lenient_double(spark):
    texts = ["1", " 2.5 ", ".5", "5.", "1e3", "-3", "1.5d", "0x10", "1_000", "nan", "", "abc", None, "inf"]
    got = apply(spark, texts, fn.lenient_double)
    assert got == [1, 2.5, 0.5, 5, 1000, -3, None, None, None, None, None, None, None, math.inf]


def test_parse_count(spark):
    got = apply(
        spark, ["1,234,567", "0", "5.0", "5.5", "n/a", None, "1e3", "9007199254740993"], fn.parse_count
    )
    assert got == [1234567, 0, 5, None, None, None, 1000, 9007199254740993]


def test_parse_currency(spark):
    assert apply(spark, ["$1,234.50", "$ 12", "-$3", "junk", None], fn.parse_currency) == [
        1234.5, 12.0, -3.0, None, None]


def parsed(spark, values, column, parser):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {column} string")
    return [r[column] for r in parse_columns(df, {column: parser}).orderBy("i").collect()]


def test_parse_age(spark):
    got = parsed(
        spark,
        ["3 years", "18 months", "2.5 Yrs", "4.1", "-2 years", "n/a", "1.2.3", "7 Months", None],
        "channel_age_years", fn.age_years,
    )
    assert got == [3.0, 1.5, 2.5, 4.1, 2.0, None, None, 0.58, None]


def test_parse_rate(spark):
    assert apply(spark, ["6/month", "6", "about 2.5 a month", "-", ".", None], fn.parse_rate) == [
        6.0, 6.0, 2.5, None, None, None]


def test_parse_duration(spark):
    got = parsed(
        spark, ["14m 32s", "5m", "14.53", "32s", "1_0.5", "x", None, "12.345"],
        "video_length_mins", fn.duration_minutes,
    )
    assert got == [14.53, 5.0, 14.53, None, 10.5, None, None, round(12.345, 2)]


def test_parse_views_rounds_half_to_even(spark):
    assert apply(spark, ["45320.0", "2.5", "3.5", "x", None], fn.parse_views) == [
        45320, 2, 4, None, None]


def test_parse_date(spark):
    d = dt.date
    cases = {
        "2024-04-15": d(2024, 4, 15),
        "2024-04-15T23:30:00-05:00": d(2024, 4, 15),
        "2024-04-15 08:00:00": d(2024, 4, 15),
        "04/15/2024": d(2024, 4, 15),
        "4/5/2024": d(2024, 4, 5),
        "13/04/2024": d(2024, 4, 13),
        "20240415": d(2024, 4, 15),
        "Apr 15 2024": d(2024, 4, 15),
        "April 15, 2024": d(2024, 4, 15),
        "1711929600": d(2024, 4, 1),
        "99999999999": None,
        "2024-13-45": None,
        "soon": None,
        "": None,
        None: None,
    }
    assert apply(spark, list(cases), fn.parse_date) == list(cases.values())


def test_epoch_day_is_utc_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = apply(spark, ["1711929600", "2024-04-01", "04/01/2024"], fn.parse_date)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [dt.date(2024, 4, 1)] * 3


@pytest.mark.parametrize("digits", [1, 2])
def test_round_float_is_exact_half_even(spark, digits):
    values = [2.675, 0.125, 0.375, 1.005, -2.675, 2.5, 12.345, 14.535, 0.0, 1e17, 99.995, 0.25, 0.35]
    got = apply(spark, values, lambda c: fn.round_float(c, digits), "double")
    assert got == [round(v, digits) for v in values]


def test_round_scaled(spark):
    import numpy as np

    values = [2.675, 0.125, 1.005, -2.5, 12.345, 7.0]
    got = apply(spark, values, lambda c: fn.round_scaled(c, 2), "double")
    assert got == [float(np.round(v, 2)) for v in values]


def test_floor_zero_keeps_null(spark):
    assert apply(spark, [5.0, -1.0, 0.0, None], fn.floor_zero, "double") == [5.0, 0.0, 0.0, None]


def test_clip_keeps_null(spark):
    got = apply(spark, [5.0, -1.0, 101.0, None], lambda c: fn.clip(c, 0, 100), "double")
    assert got == [5.0, 0.0, 100.0, None]


def test_safe_div(spark):
    got = apply(spark, [2.0, 0.0, None], lambda c: fn.safe_div(F.lit(1), c), "double")
    assert got == [0.5, None, None]


EDGES = [None, -5, 0, 999, 1000, 1001, 9999, 10000, 10001, 100000, 100001, 500000, 500001]


def tiers(spark, expr):
    df = spark.createDataFrame(list(enumerate(EDGES)), "i int, subscriber_count bigint")
    return [r["t"] for r in df.select("i", expr.alias("t")).orderBy("i").collect()]


def test_stored_tier_is_right_closed(spark):
    m, s, d, la, g = (
        "Micro (<1K)", "Small (1K-10K)", "Mid (10K-100K)", "Large (100K-500K)", "Mega (500K+)")
    assert tiers(spark, tier_label()) == [None, None, None, m, m, s, s, s, d, d, la, la, g]


def test_report_tier_is_left_closed(spark):
    m, s, d, la, g = (
        "5. Micro (<1K)", "4. Small (1K–10K)", "3. Mid (10K–100K)", "2. Large (100K–500K)",
        "1. Mega (500K+)")
    assert tiers(spark, report_tier(DEFAULT_SPEC)) == [m, m, m, m, s, s, s, d, d, la, la, g, g]


def test_sub_tier_null_goes_to_the_top(spark):
    got = tiers(spark, sub_tier(DEFAULT_SPEC))
    assert got[0] == "E. 100K+" and got[7] == "B. 10K–25K" and got[6] == "A. Under 10K"


def test_labels():
    assert list(DEFAULT_SPEC.cadence_labels) == [
        "A. Very Low  (<2/mo)", "B. Low       (2–6/mo)", "C. Medium    (6–12/mo)",
        "D. High      (12–20/mo)", "E. Very High (20+/mo)"]
    assert list(DEFAULT_SPEC.video_retention_labels)[::-1] == [
        "A. High   (50%+)", "B. Medium (35–50%)", "C. Low    (20–35%)", "D. Very Low (<20%)"]
    assert DEFAULT_SPEC.sub_tier_labels() == [
        "A. Under 10K", "B. 10K–25K", "C. 25K–50K", "D. 50K–100K", "E. 100K+"]
    assert DEFAULT_SPEC.mid_label() == "Mid tier (10K–100K)"


def test_bucketize_rejects_bad_input():
    with pytest.raises(ValueError):
        fn.bucketize(None, [1], ["a"])
