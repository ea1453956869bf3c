import datetime as dt

from pyspark.sql import functions as F

from lupa import schemas
from lupa import vocab as v
from lupa.functions import columns as c
from lupa.operators import documents as d
from lupa.operators import enrich, links
from lupa.operators import taxpayers as t
from lupa.sources import tables


def doc(folio=1, day=dt.date(2024, 5, 31), issuer="e", receiver="r", amount=10.0, signed=None, kind=33):
    return (folio, kind, day, issuer, "1", receiver, "1", amount, amount * 0.19, signed)


def frame(spark, *docs):
    return spark.createDataFrame(docs, schemas.DOCUMENT)


def test_window_bounds_are_inclusive_and_clamp_month_ends(spark, rows):
    days = [dt.date(2024, 5, 31), dt.date(2024, 2, 29), dt.date(2024, 2, 28), dt.date(2024, 5, 17), dt.date(2024, 5, 16)]
    docs = frame(spark, *(doc(i, day) for i, day in enumerate(days)))
    assert rows(d.recent(docs, months=3), "dhdr_folio") == [(0,), (1,), (3,), (4,)]
    assert rows(d.recent(docs, days=14), "dhdr_folio") == [(0,), (3,)]


def test_month_partition_gives_the_same_window(source, rows, tmp_path, spark):
    docs = tables.invoices(source["documents"])
    path = str(tmp_path / "docs")
    tables.overwrite(docs.withColumn("month", F.date_format(v.EMITTED, "yyyy-MM")), path, ["month"])
    stored = spark.read.parquet(path)
    for window in ({"months": 3}, {"days": 14}):
        got = d.recent(stored, month_partition="month", **window)
        assert rows(got, *v.DOCUMENT_COLUMNS) == rows(d.recent(docs, **window), *v.DOCUMENT_COLUMNS)


def test_time_features(spark):
    at = lambda h, day=10: dt.datetime(2024, 6, day, h, 59)
    docs = frame(spark, *(doc(h, signed=at(h)) for h in (0, 5, 6, 11, 12, 18, 19, 23)),
                 doc(100, signed=at(1, 8)), doc(101, signed=at(1, 9)), doc(102))
    got = {r["dhdr_folio"]: r for r in d.with_time_features(docs).collect()}
    bands = [got[h]["bloque_horario"] for h in (0, 5, 6, 11, 12, 18, 19, 23)]
    assert bands == ["Madrugada"] * 2 + ["Mañana"] * 2 + ["Tarde"] * 2 + ["Noche"] * 2
    assert [got[f]["es_fin_de_semana"] for f in (0, 100, 101)] == [0, 1, 1]
    assert [got[f]["dia_semana"] for f in (0, 100, 101)] == [2, 7, 1]
    assert abs(got[0]["semana_mes"] - (9 / 7 + 1)) < 1e-12
    whole = docs.select(c.week_of_month(F.col(v.SIGNED), whole=True).alias("w")).where("w is not null")
    assert {r["w"] for r in whole.collect()} == {2}
    empty = got[102]
    assert (empty["hora"], empty["bloque_horario"], empty["es_fin_de_semana"]) == (None, "Noche", 0)


def test_statistics_of_one_document_have_no_deviation(spark):
    docs = frame(spark, doc(1, amount=10.0), doc(2, amount=20.0), doc(3, issuer="solo", receiver=None))
    got = {r["dhdr_folio"]: r for r in d.with_party_statistics(docs).collect()}
    assert got[1]["avg_dhdr_mnt_total_emisor"] == 15.0
    assert abs(got[1]["stddev_dhdr_mnt_total_emisor"] - 50 ** 0.5) < 1e-9
    assert got[3]["avg_dhdr_mnt_total_emisor"] == 10.0 and got[3]["stddev_dhdr_mnt_total_emisor"] is None
    assert got[3]["avg_dhdr_mnt_total_receptor"] is None


def test_every_step_keeps_each_document_once(source):
    docs = tables.invoices(source["documents"])
    profile = t.profile(source).cache()
    n = docs.count()
    assert d.featured(docs).count() == n
    assert enrich.parties(docs, profile).count() == n


def test_fused_enrichment_equals_the_two_steps(source, rows):
    docs = tables.invoices(source["documents"])
    profile = t.profile(source).cache()
    columns = [c for c in v.ENRICHED_FULL if c in docs.columns or c.startswith(("emis_", "recep_", "avg", "std"))]
    rounded = lambda df: df.select(*(F.round(c, 6).alias(c) if c.startswith(("avg", "std")) else c for c in columns))
    two = enrich.parties(d.with_party_statistics(docs), profile)
    assert rows(rounded(enrich.parties_with_statistics(docs, profile))) == rows(rounded(two))


def test_documents_move_once_if_a_role_has_few_parties(source, rows, monkeypatch):
    """The other role is joined first, so that no party's columns travel with the documents."""
    docs = tables.invoices(source["documents"])
    profile = t.profile(source).cache()
    spread, join = [], enrich.spread_left_join
    monkeypatch.setattr(enrich, "spread_left_join", lambda left, *a, **k: spread.append(left.columns) or join(left, *a, **k))
    rounded = lambda df: df.select(*(F.round(c, 6).alias(c) if c.startswith(("avg", "std")) else c for c in df.columns))
    sent = rows(rounded(enrich.parties_with_statistics(docs, profile)))
    assert spread == [docs.columns]
    monkeypatch.setattr(enrich, "MOST_SENT", 0)
    assert rows(rounded(enrich.parties_with_statistics(docs, profile))) == sent
    assert len(spread) == 3


def test_enriched_column_sets(source):
    assert len(v.ENRICHED_SAMPLE) == 53 and len(v.ENRICHED_FULL) == 57
    assert len(v.NUMERIC) == 20 and len(v.CATEGORIES) == 28 and len(v.MODEL_ALERTS) == 20


def test_links(spark, rows):
    docs = frame(spark, doc(1), doc(1), doc(2), doc(3, issuer=None))
    cessions = spark.createDataFrame([(1, "e", "1", 71), (1, "e", "1", 72), (2, "x", "1", 73)], schemas.CESSION_DOCUMENT)
    linked = links.cession_link(docs, cessions)
    assert rows(linked, "dhdr_folio", "rdoc_codigo", "cedido") == [
        (1, 71, "Sí"), (1, 71, "Sí"), (1, 72, "Sí"), (1, 72, "Sí"), (2, None, "No"), (3, None, "No"),
    ]
    assert rows(links.times_ceded(docs, cessions), "dhdr_folio", "veces_cedido") == [(1, 4), (2, 0), (3, 0)]
    detail = links.cession_detail(linked, spark.createDataFrame([(71,), (71,)], schemas.CESSION))
    assert detail.groupBy("dhdr_folio").count().where("dhdr_folio = 1").first()["count"] == 6
    ledger = spark.createDataFrame([(2, "e", "r", "S", None, None, "c"), (2, "e", "r", "N", None, None, "d")], schemas.LEDGER)
    assert rows(links.ledger_match(docs, ledger), "dhdr_folio", "det_emisor_nota", "cruce_rcv") == [
        (1, None, "No"), (1, None, "No"), (2, "N", "Sí"), (2, "S", "Sí"), (3, None, "No"),
    ]
