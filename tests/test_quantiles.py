import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lupa.operators import quantiles as qt

PROBS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


def expected(values):
    return [float(np.quantile(values, q)) for q in PROBS.values()]


def check(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"x": np.asarray(values, dtype=float)}))
    row = qt.quantiles(df, "x", PROBS).first()
    assert row["rows"] == len(values)
    assert np.allclose([row[k] for k in PROBS], expected(values), rtol=1e-12, atol=1e-9)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e12, 1e12, allow_subnormal=False) | st.sampled_from([0.0, 1.0, -1.0]), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    check(spark, values)


def test_hot_value_and_tiny_differences(spark):
    rng = np.random.default_rng(1)
    check(spark, [7.0] * 4000 + list(rng.lognormal(10, 3, 3000)) + list(-rng.random(500)))
    check(spark, list(0.5 + rng.random(5000) * 1e-9))


def test_a_single_coarse_bin_is_split_again(spark):
    values = np.random.default_rng(4).random(20_000) * 1e-6
    check(spark, values)
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = qt.box_summary(df.withColumn("k", F.lit("p")), "x", ["k"]).first()
    assert (got["rows"], got["median"]) == (20_000, pytest.approx(np.quantile(values, 0.5)))


def test_groups_and_nulls(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"k": rng.choice(["p", "q", "r"], 3000), "x": rng.integers(0, 900, 3000).astype(float)})
    df = spark.createDataFrame(frame).unionByName(
        spark.createDataFrame([(None, 5.0), ("p", None)], "k string, x double")
    )
    got = qt.quantiles(df, "x", PROBS, ["k"]).toPandas().set_index("k")
    for k, part in frame.groupby("k"):
        assert got.loc[k, "rows"] == len(part)
        assert np.allclose(got.loc[k, list(PROBS)].astype(float), expected(part["x"]))
    assert set(got.index) == {"p", "q", "r"}


def test_sketch_is_close(spark):
    frame = pd.DataFrame({"x": np.arange(10_001, dtype=float)})
    row = qt.quantiles(spark.createDataFrame(frame), "x", {"m": 0.5}, accuracy=10_000).first()
    assert abs(row["m"] - 5000) <= 2 and row["rows"] == 10_001


def test_fences_include_both_ends(spark, rows):
    df = spark.createDataFrame([(float(x),) for x in (-5, 0, 1, 2, 3, 4, 9, 10)], "x double")
    bounds = qt.iqr_fences(df, "x").first()
    q1, q3 = np.quantile([-5, 0, 1, 2, 3, 4, 9, 10], [0.25, 0.75])
    assert (bounds["q1"], bounds["q3"]) == (q1, q3)
    edge = spark.createDataFrame([(0.0,)] * 5 + [(2.0,)] * 5 + [(5.0,), (5.001,)], "x double")
    limit = qt.iqr_fences(edge, "x").first()["upper_bound"]
    assert limit == 5.0 and (5.0,) in rows(qt.within_fences(edge, "x")) and (5.001,) not in rows(qt.within_fences(edge, "x"))


def test_box_whiskers_lie_within_reach(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": rng.choice(["p", "q"], 2000), "x": rng.lognormal(8, 1, 2000)})
    got = qt.box_summary(spark.createDataFrame(frame), "x", ["k"]).toPandas().set_index("k")
    for k, part in frame.groupby("k"):
        q1, q3 = np.quantile(part["x"], [0.25, 0.75])
        inside = part["x"][(part["x"] >= q1 - 1.5 * (q3 - q1)) & (part["x"] <= q3 + 1.5 * (q3 - q1))]
        assert got.loc[k, "whisker_low"] == pytest.approx(inside.min())
        assert got.loc[k, "whisker_high"] == pytest.approx(inside.max())
        assert got.loc[k, "rows"] == len(part)


def test_nan_is_left_out(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "a double")
    for accuracy in (None, 1000):
        row = qt.quantiles(df, "a", {"m": 0.5}, accuracy=accuracy).first()
        assert (row["m"], row["rows"]) == (2.0, 3)


def test_more_groups_than_are_sent(spark, monkeypatch):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"k": np.where(rng.random(4000) < 0.4, 0, rng.integers(0, 300, 4000)), "x": rng.lognormal(8, 2, 4000)})
    df = spark.createDataFrame(frame)
    sent = qt.box_summary(df, "x", ["k"]).orderBy("k").collect()
    monkeypatch.setattr(qt, "MOST_SENT", 10)
    assert qt.box_summary(df, "x", ["k"]).orderBy("k").collect() == sent and len(sent) == frame["k"].nunique()


def test_infinite_values_have_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (float("-inf"), -1e308, 0.0, -0.0, 5e-324, 1e308, float("inf"), float("inf"))], "x double")
    row = qt.quantiles(df, "x", {"low": 0.0, "high": 1.0, "zero": 2 / 7, "small": 4 / 7}).first()
    assert (row["low"], row["high"], row["zero"], row["rows"]) == (float("-inf"), float("inf"), 0.0, 8)
    assert row["small"] == pytest.approx(5e-324)
