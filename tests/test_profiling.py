from pyspark.sql import functions as F

from lupa import vocab as v
from lupa.operators import outliers, profiling, quality


def docs(spark, data):
    """(segment, subsector, band, weekend, amount, issuer alert, receiver alert)."""
    df = spark.createDataFrame(
        data, "emis_INICIO_SEGMENTO string, emis_ACEC_DES_SUBRUBRO_PPAL string, bloque_horario string, "
        "es_fin_de_semana int, dhdr_mnt_total double, a int, b int",
    )
    flags = {name: F.lit(None).cast("int") for name in (*v.alert_columns(v.ISSUER), *v.alert_columns(v.RECEIVER))}
    flags["emis_Alerta_52"], flags["recep_Alerta_53"] = F.col("a"), F.col("b")
    return df.withColumns(flags)


def test_alert_types_treat_missing_flags_as_no_alert(spark, rows):
    df = docs(spark, [("S", "x", "Tarde", 0, 1.0, a, b) for a, b in ((1, 1), (1, 0), (None, 1), (None, None))])
    got = profiling.with_alert_type(profiling.with_alert_flags(df))
    assert rows(got, "alertas_combinadas", "tipo_alerta") == [
        (False, "Sin alerta"), (False, "Solo Emisor"), (False, "Solo Receptor"), (True, "Emisor y Receptor"),
    ]


def test_combined_alerts_drops_missing_segments(spark):
    df = docs(spark, [("S", "x", "Tarde", 0, 1.0, 1, 1), (None, "x", "Tarde", 0, 1.0, 1, 1), ("T", "x", "Tarde", 0, 1.0, 0, 1)])
    got = profiling.combined_alerts(profiling.with_alert_flags(df)).collect()
    assert [(r[0], r[2]) for r in got] == [("S", 1), ("T", 0)]


def test_top_has_a_total_order(spark):
    df = docs(spark, [("S", k, "Madrugada", 1, 5.0, 0, 0) for k in "cab"] + [("S", "z", "Tarde", 0, 99.0, 0, 0), ("S", None, "Madrugada", 1, 999.0, 0, 0)])
    dawn = profiling.at_weekend(profiling.at_dawn(df))
    best = profiling.top_mean(dawn, profiling.ISSUER_SUBSECTOR, n=2)
    assert [tuple(r) for r in best.collect()] == [("a", 5.0), ("b", 5.0)]
    assert profiling.keep_top(dawn, best, profiling.ISSUER_SUBSECTOR).count() == 2


def test_p90_is_strict_and_ignores_unknown_segments(spark, rows):
    df = docs(spark, [("SGME", "x", "Tarde", 0, float(i), i % 2, 0) for i in range(11)] + [("??", "x", "Tarde", 0, 1e9, 0, 0)])
    assert rows(outliers.segment_p90(df)) == [("SGME", 9.0, 1)]
    above = outliers.above_p90(df)
    assert rows(above, "dhdr_mnt_total", outliers.HAS_ALERT) == [(10.0, False)]


def test_rules_rank_totals_within_segment_and_alert(spark):
    data = [("SGME", f"s{i % 7}", "Tarde", i % 2, 1000.0 + i, i % 2, 0) for i in range(400)]
    data += [("SGME", "s0", "Tarde", 0, float(i % 900), 0, 0) for i in range(3600)]
    rules = outliers.by_subsector(outliers.above_p90(docs(spark, data))).toPandas()
    for _, part in rules.groupby(outliers.HAS_ALERT):
        ordered = part.sort_values("rank")
        assert list(ordered["rank"]) == [1, 2, 3, 4, 5] and ordered["total_monto"].is_monotonic_decreasing


def test_counts_are_ordered(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "k string")
    assert [tuple(r) for r in profiling.counts(df, "k").collect()][0] == ("c", 2)
    assert (None, 1) not in [tuple(r) for r in profiling.counts(df, "k", drop_null=True).collect()]


def test_quality(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2)], "k string, x int")
    assert rows(quality.uniqueness(df, "k")) == [(2, 1)]
    assert rows(quality.null_report(df, ["k", "x"])) == [("k", 1), ("x", 1)]
    assert rows(quality.null_comparison(df, df.na.fill(0), ["k", "x"])) == [("k", 1, 1), ("x", 1, 0)]
    assert quality.uniqueness(df, "k", relative_error=0.05).first()["distinct_keys"] == 1
