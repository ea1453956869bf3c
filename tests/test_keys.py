import datetime as dt

from pyspark.sql import functions as F

from lupa.functions import columns as c
from lupa.operators import keys

DAY = dt.date(2024, 5, 1)


def test_latest_with_ties_keeps_ties_and_drops_nulls(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "w"), (None, 9, "n")],
        "k string, o int, t string",
    )
    assert rows(keys.latest_with_ties(df, ["k"], F.col("o"))) == [("a", 2, "y"), ("a", 2, "z")]


def test_latest_with_ties_by_part_of_the_key(spark, rows):
    df = spark.createDataFrame(
        [("a", "1", 5), ("a", "1", 7), ("a", "2", 6), ("a", "2", 3)], "k string, dv string, o int"
    )
    got = keys.latest_with_ties(df, ["k", "dv"], F.col("o"), match=["k"])
    assert rows(got) == [("a", "1", 7), ("a", "2", 6)]


def test_latest_one_is_total(spark, rows):
    df = spark.createDataFrame([("a", 1, 4), ("a", 1, 9), ("a", 0, 99)], "k string, y int, t int")
    assert rows(keys.latest_one(df, ["k"], [F.desc("y"), F.desc("t")])) == [("a", 1, 9)]


def test_unique_keys(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), (None, 3)], "k string, x int")
    assert rows(keys.unique_keys(df, "k")) == [("a", 1)]


def test_with_prefix(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert keys.with_prefix(df, "p_").columns == ["p_a", "p_b"]


def skewed(spark):
    """Half of the rows share one key, some keys are null, many rows are exact copies."""
    return spark.range(6000).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 11 == 1, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k"),
        (F.col("id") % 3).alias("x"),
    )


def test_spread_left_join_equals_plain_join(spark, rows):
    left = skewed(spark)
    right = left.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).where("k <> 'k11'")
    right = right.withColumnRenamed("k", "rk").unionByName(
        spark.createDataFrame([("hot", 1), ("k13", 2), (None, 5)], "rk string, n long")
    )
    plain = left.join(right, F.col("k") == F.col("rk"), "left")
    assert rows(keys.spread_left_join(left, right, [("k", "rk")])) == rows(plain)


def test_spread_right_join_equals_plain_join(spark, rows):
    right = skewed(spark).select(F.col("k").alias("rk"), F.col("x").alias("y"))
    left = spark.createDataFrame([("hot", 1), ("hot", 1), ("k11", 2), ("none", 3), (None, 4)], "k string, z int")
    plain = left.join(right, F.col("k") == F.col("rk"), "left")
    got = keys.spread_right_join(left, right, [("k", "rk")])
    assert rows(got) == rows(plain) and got.count() > 6000


def test_semi_join_on_tied_hot_key(spark, rows):
    df = skewed(spark).repartition(5)
    got = keys.latest_with_ties(df, ["k"], F.col("x"))
    top = df.groupBy("k").agg(F.max("x").alias("m"))
    plain = df.join(top, "k").where("x = m").select("k", "x")
    assert rows(got) == rows(plain)


def test_unique_keys_on_small_and_skewed_data(spark, rows):
    df = skewed(spark).unionByName(spark.createDataFrame([("single", 7)], "k string, x long"))
    assert rows(keys.unique_keys(df, "k")) == [("single", 7)]


def test_hot_key_is_spread_over_tasks(spark):
    left = skewed(spark).repartition(8)
    right = spark.createDataFrame([("hot", 1)], "rk string, n int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = keys.spread_left_join(left, right, [("k", "rk")])
        sizes = joined.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes.sum() == 6000 and sizes.max() < 2600


def test_hot_keys_are_few(spark):
    hot = [r["k"] for r in keys.hot_keys(skewed(spark), ["k"], share=0.01).collect()]
    assert hot == ["hot"]


def test_hash01_is_free_of_partitioning_and_uniform(spark, rows):
    df = spark.range(4000).select("id", F.lit(None).cast("string").alias("n"))
    draw = c.hash01(["id", "n"], 42)
    a = rows(df.repartition(1).where(draw < 0.25))
    b = rows(df.repartition(13, "id").where(draw < 0.25))
    assert a == b and 900 < len(a) < 1100
    assert rows(df.where(c.hash01(["id", "n"], 43) < 0.25)) != a


def test_null_left_keys_are_spread_over_tasks(spark):
    left = spark.range(20000).selectExpr("CASE WHEN id % 10 = 0 THEN id END AS k", "id AS x")
    right = spark.range(0, 20000, 10).selectExpr("id AS j", "id * 2 AS y")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = keys.spread_right_join(left, right, [("k", "j")])
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20000 and max(sizes) < 2 * sum(sizes) / len(sizes)
