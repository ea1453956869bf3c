from pyspark.sql import functions as F

from lupa import monitor


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_tracking(spark, rows, tmp_path):
    scored = spark.createDataFrame([(1, "a", 0.5), (2, None, 0.25)], "dhdr_folio int, k string, score double")
    key = ["dhdr_folio", "k"]
    first = monitor.predict(scored, "r1", at("2024-01-01 10:00:00"), key)
    again = monitor.predict(scored.repartition(5), "r1", at("2024-01-01 10:00:00"), key)
    other = monitor.predict(scored, "r2", at("2024-01-01 11:00:00"), key)
    assert rows(first) == rows(again)
    assert first.join(other, "uuid", "left_semi").count() == 0
    log = first.unionByName(other)
    window = monitor.read(log, at("2024-01-01 10:00:00"), at("2024-01-01 10:30:00"))
    assert rows(window) == rows(first)
    truth = first.where("dhdr_folio = 1").select("uuid", F.lit(0.75).alias("actual_result"))
    tracked = monitor.with_truth(window, truth)
    assert rows(tracked, "dhdr_folio", "actual_result") == [(1, 0.75), (2, None)]
    error = monitor.mean_absolute_error(tracked)
    assert rows(error) == [(0.25, 1)]
    path = str(tmp_path / "metrics")
    value = monitor.metric(error, "mean_absolute_error", at("2024-01-01 10:00:00"), at("2024-01-01 10:30:00"), "m")
    for run in ("r1", "r2", "r1"):
        monitor.record(value, path, run)
    found = spark.read.parquet(path)
    assert rows(found, "run_id", "model", "metric", "value") == [(run, "m", "mean_absolute_error", 0.25) for run in ("r1", "r2")]


def test_ids_are_unique(spark, rows, monkeypatch):
    monkeypatch.setattr(monitor, "COPIES", 3)
    scored = spark.createDataFrame([(1, 0.5)] * 8 + [(1, 0.25), (None, 0.5), (None, None)], "k int, score double")
    first = monitor.predict(scored, "r1", at("2024-01-01 10:00:00"), ["k"])
    again = monitor.predict(scored.repartition(5), "r1", at("2024-01-01 10:00:00"), ["k"])
    assert first.count() == first.select("uuid").distinct().count() == scored.count()
    assert rows(first) == rows(again) and rows(first, "k", "prediction") == rows(scored)


def test_different_keys_have_different_ids(spark):
    rows = [("a:b", "c"), ("a", "b:c"), (None, "x"), ("", "x"), ("x", None), ("1:a", ""), ("1", ":a")]
    scored = spark.createDataFrame([(*r, 0.5) for r in rows], "k string, l string, score double")
    found = monitor.predict(scored, "r1", at("2024-01-01 10:00:00"), ["k", "l"])
    assert found.select("uuid").distinct().count() == len(rows)
