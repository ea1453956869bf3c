import datetime as dt

from pyspark.sql import functions as F

from lupa import schemas
from lupa import vocab as v
from lupa.functions import columns as c
from lupa.operators import taxpayers as t

D1, D2 = dt.date(2023, 1, 1), dt.date(2024, 6, 10)


def history(spark, data):
    return spark.createDataFrame(data, schemas.ATTRIBUTE_HISTORY)


def segment_inputs(spark, data):
    people = spark.createDataFrame([(r, "1") for r in "abcdef"] + [("g", "1"), ("g", "2")], schemas.TAXPAYER)
    attributes = spark.createDataFrame([(k, 1, k.lower()) for k in (*v.SEGMENT_RANK, "OTHER")], schemas.ATTRIBUTE)
    return people, history(spark, data), attributes


RECORDS = [
    ("a", "SGMI", D1, None, 1), ("a", "SGME", D2, None, 1),            # latest wins over older
    ("b", "SGPE", D2, None, 1), ("b", "SGGC", D2, None, 1),            # same day: higher rank
    ("c", "SGPM", D2, None, 1), ("c", "SGPM", D2, None, 1),            # same day and code: both stay
    ("d", "SGGC", D2, D2, 1), ("d", "SGGC", D2, None, 0),              # closed, not in force
    ("e", "SGGC", None, None, 1), ("f", "OTHER", D2, None, 1),         # no date, not a segment
    ("g", "SGMI", D2, None, 1), ("zz", "SGGC", D2, None, 1),           # two digits, unknown taxpayer
]


def test_segments(spark, rows):
    got = t.segments(*segment_inputs(spark, RECORDS))
    assert rows(got, v.RUT, v.DV, "INICIO_SEGMENTO", "FECHA_INICIO") == [
        ("a", "1", "SGME", 20240610), ("b", "1", "SGGC", 20240610), ("c", "1", "SGPM", 20240610),
        ("c", "1", "SGPM", 20240610), ("g", "1", "SGMI", 20240610), ("g", "2", "SGMI", 20240610),
    ]


def test_segment_per_taxpayer_is_the_distinct_form(spark, rows):
    inputs = segment_inputs(spark, RECORDS)
    columns = (v.RUT, v.DV, *v.SEGMENT_COLUMNS)
    assert rows(t.segment_per_taxpayer(*inputs), *columns) == rows(t.segments(*inputs).select(*columns).distinct())


def test_person_and_company_labels(spark, rows):
    df = spark.createDataFrame([("SGPE",), ("SGGC",), ("X",)], "code string")
    got = df.select("code", c.company_label(F.col("code")).alias("a"), c.person_flag(F.col("code")).alias("b"))
    assert rows(got) == [("SGGC", v.COMPANY_LABEL["SGGC"], None), ("SGPE", None, 1), ("X", None, None)]


def alert(code, off=None, rut="a"):
    return (rut, "1", code, f"text {code}", "10", D1, off)


def test_alerts(spark, rows):
    data = [alert("4001"), alert("4007"), alert("52"), alert("52"), alert("2046"), alert("53", D2), alert("1019", rut="b")]
    alerts = spark.createDataFrame(data, schemas.ALERT)
    assert rows(t.active_alerts(alerts), v.RUT, "ALER_COD_TIPO_ALERTA_VO", "ALER_DESC_TIPO_ALERTA_VO") == [
        ("a", "400X", "DELITO/QUERELLA"), ("a", "52", "text 52"), ("b", "1019", "text 1019"),
    ]
    flags = {r[v.RUT]: r.asDict() for r in t.alert_flags(alerts).collect()}
    assert [k for k in v.FLAG_COLUMNS if flags["a"][k]] == ["Alerta_400X", "Alerta_52"]
    assert flags["b"]["Alerta_1019"] == 1 and flags["b"]["Alerta_5301"] == 0
    assert t.alert_flags(alerts).columns == [v.RUT, v.DV, *v.FLAG_COLUMNS]


def test_effective_region(spark, rows):
    df = spark.createDataFrame(
        [("17000", None, 3), ("17999", "-9999", 3), ("18000", None, 3), ("5", "17500", 3), ("17500", "6", 3),
         ("abc", None, 3), ("5", "abc", 3), (None, None, 3)],
        "u string, g string, r int",
    )
    got = df.select("u", "g", c.effective_region(F.col("u"), F.col("g"), F.col("r")).alias("x"))
    assert {(r.u, r.g): r.x for r in got.collect()} == {
        ("17000", None): 17, ("17999", "-9999"): 17, ("18000", None): 3, ("5", "17500"): 17,
        ("17500", "6"): 3, ("abc", None): 3, ("5", "abc"): 3, (None, None): 3,
    }


def test_business_ties_and_unknown_units(spark, rows):
    row = lambda rut, day, unit, dv="1": (rut, dv, day, unit, None, "S", "N", "N", 4)
    business = spark.createDataFrame(
        [row("a", D1, "1"), row("a", D2, "1"), row("a", D2, "1"), row("b", D2, "1"), row("b", D2, "2"),
         row("c", D2, "9"), row("d", None, "1"), row("e", D1, "1", "1"), row("e", D2, "2", "2")],
        schemas.BUSINESS,
    )
    units = spark.createDataFrame([("1", 11), ("2", 12)], schemas.UNIT)
    assert rows(t.business_region(business, units), v.RUT, v.DV, "UNOP_COD_REGIONAL") == [
        ("a", "1", 11), ("b", "1", 11), ("b", "1", 12), ("e", "1", 11), ("e", "2", 12),
    ]


def test_latest_behaviour_does_not_depend_on_layout(source, rows):
    table = source["behaviour"]
    a = rows(t.latest_behaviour(table.repartition(1)))
    assert a == rows(t.latest_behaviour(table.repartition(7, "COCO_MTO_VENTAS")))
    assert len(a) == len({r[0] for r in a})


def test_principal_activity_needs_a_valid_link(spark, rows):
    fill = {f.name: None for f in schemas.BEHAVIOUR}
    behaviour = spark.createDataFrame(
        [tuple({**fill, "CONT_RUT": r, "CONT_DV": "1", "ACEC_COD_ACTECO_PRINCIPAL": code,
                "PERI_AGNO_TRIBUTARIO_RENTA": p}.values())
         for r, code, p in (("a", "1", 202300), ("a", "1", 202300), ("b", "1", 202200), ("c", "1", 202300), ("d", "2", 202300))],
        schemas.BEHAVIOUR,
    )
    links = spark.createDataFrame(
        [("a", "1", "1", "S"), ("a", "1", "1", "S"), ("b", "1", "1", "S"), ("c", "1", "1", "N"), ("d", "1", "1", "S")],
        schemas.ACTIVITY_LINK,
    )
    activities = spark.createDataFrame([("1", "t1", "r1", "s1"), ("2", "t2", "r2", "s2")], schemas.ACTIVITY)
    assert rows(t.principal_activity(behaviour, links, activities)) == [("a", "1", "t1", "r1", "s1")]


def test_profile_equals_merge_then_unique(source, rows):
    parts = t.profile_sources(source)
    merged = t.merge_profile(**parts)
    assert rows(t.build_profile(**parts)) == rows(t.unambiguous(merged))
    assert merged.columns == list(v.PROFILE_COLUMNS) and len(v.PROFILE_COLUMNS) == 53


def test_profile_drops_ambiguous_taxpayers(spark, source):
    parts = t.profile_sources(source)
    kept = lambda **changed: {r[v.RUT] for r in t.build_profile(**{**parts, **changed}).select(v.RUT).collect()}
    base = kept()
    rut = min(r[v.RUT] for r in parts["activity"].collect() if r[v.RUT] in base)
    one = parts["activity"].where(F.col(v.RUT) == rut)
    second = one.withColumn(v.DV, F.lit("other digit"))
    assert rut not in kept(activity=parts["activity"].unionByName(second))
    third = one.withColumn("ACEC_DES_ACTECO_PPAL", F.lit("another activity"))
    assert rut not in kept(activity=parts["activity"].unionByName(third))
    nameless = one.withColumn(v.DV, F.lit(None).cast("string"))
    assert kept(activity=parts["activity"].unionByName(nameless)) == base


def test_profile_can_keep_ambiguous_taxpayers(source):
    parts = t.profile_sources(source)
    largest = t.build_profile(**parts, ambiguous="largest")
    ruts = {r[v.RUT] for df in parts.values() for r in df.select(v.RUT).collect()}
    assert sorted(r[v.RUT] for r in largest.select(v.RUT).collect()) == sorted(ruts)


def test_taxpayer_class(spark, rows):
    df = spark.createDataFrame([("x", None), (None, 1), (None, None)], "e string, p int")
    got = df.select(c.taxpayer_class(F.col("e"), F.col("p")).alias("t"))
    assert rows(got) == [("Persona",), ("indefinido",), ("x",)]


def test_segments_before_1970(spark, rows):
    inputs = segment_inputs(spark, [("a", "SGGC", dt.date(1965, 3, 1), None, 1), ("a", "SGMI", dt.date(1960, 1, 1), None, 1)])
    columns = ["CONT_RUT", "INICIO_SEGMENTO"]
    assert rows(t.segment_per_taxpayer(*inputs), *columns) == rows(t.segments(*inputs), *columns) == [("a", "SGGC")]
