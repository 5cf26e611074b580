import math
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.functions.scalars import ieee_divide, safe_divide
from tidemark.operators.analytics import (
    below_k_stddev, distinct_values, group_count, histogram, profile, trim_outliers, zscore,
)

VALUES = [1.0, 2.0, 2.5, 3.0, -4.0, 200.0, 0.0, 1.5, 2.25, 3.5, 1.0, 2.0, 2.0, 1.75]


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(VALUES + [None])], "id long, x double")


def test_zscore_and_trim(df):
    mean, dev = statistics.fmean(VALUES), statistics.pstdev(VALUES)
    scores = {r["id"]: r["zscore"] for r in zscore(df, "x").collect()}
    assert scores[len(VALUES)] is None
    for i, v in enumerate(VALUES):
        assert scores[i] == pytest.approx((v - mean) / dev)
    kept = {r["id"] for r in trim_outliers(df, "x").collect()}
    assert kept == {i for i, v in enumerate(VALUES) if abs((v - mean) / dev) < 3 and v > 0}
    assert df.where("x = 200").count() == 1 and VALUES.index(200.0) not in kept
    assert trim_outliers(df, "x", k=100, floor=None).count() == len(VALUES)


def test_zscore_of_a_constant_or_empty_column(spark, df):
    assert rows(zscore(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x")) == [(1.0, None), (1.0, None)]
    assert zscore(df.limit(0), "x").count() == 0


def test_nan_is_the_callers_to_filter(spark):
    with_nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "x double")
    assert trim_outliers(with_nan, "x").count() == 0
    assert trim_outliers(with_nan.where("not isnan(x)"), "x").count() == 2


def test_below_k_stddev(df):
    limit = 3 * statistics.pstdev(VALUES)
    assert {r["x"] for r in below_k_stddev(df, "x").collect()} == {v for v in VALUES if 0 < v < limit}


@pytest.mark.parametrize("bins", [1, 10, 22, 50])
def test_histogram_against_counting(df, bins):
    lo, hi = min(VALUES), max(VALUES)
    want = [0] * bins
    for v in VALUES:
        want[min(int((v - lo) / ((hi - lo) / bins)), bins - 1)] += 1
    got = histogram(df, "x", bins).orderBy("bin").collect()
    assert [r["count"] for r in got] == want
    assert got[0]["low"] == lo and got[-1]["high"] == pytest.approx(hi)


def test_histogram_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    odd = spark.createDataFrame([(1.0,), (nan,), (None,), (3.0,), (inf,), (-inf,)], "x double")
    assert [r["count"] for r in histogram(odd, "x", 2).orderBy("bin").collect()] == [1, 1]
    flat = spark.createDataFrame([(7,), (7,)], "x int")
    got = histogram(flat, "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in got] == [0, 0, 2, 0] and (got[0]["low"], got[3]["high"]) == (6.5, 7.5)
    assert [r["count"] for r in histogram(flat.limit(0), "x", 2).collect()] == [0, 0]
    with pytest.raises(ValueError):
        histogram(flat, "x", 0)


def test_counts_and_distinct(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "s string")
    assert rows(group_count(df, "s")) == [("a", 2), ("b", 1), (None, 1)]
    assert rows(distinct_values(df, "s")) == [("a",), ("b",), (None,)]


def test_profile(spark):
    df = spark.createDataFrame([(1, None, [1]), (2, "x", None)], "id int, `a.b` string, l array<int>")
    assert rows(profile(df)) == [(1, "id", "int", 2), (2, "a.b", "string", 1), (3, "l", "array<int>", 1)]


def test_divisions(spark):
    inf = math.inf
    cases = [(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (-1.0, -0.0), (None, 0.0), (1.0, None),
             (math.nan, 0.0), (inf, 0.0)]
    df = spark.createDataFrame(cases, "a double, b double").coalesce(1)
    got = df.select(safe_divide(F.col("a"), F.col("b")), ieee_divide(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [0.5, None, None, None, None, None, None, None, None, None]
    ieee = [r[1] for r in got]
    assert ieee[:3] == [0.5, inf, -inf] and math.isnan(ieee[3]) and ieee[4:6] == [-inf, inf]
    assert ieee[6:8] == [None, None] and math.isnan(ieee[8]) and ieee[9] == inf
