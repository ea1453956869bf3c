"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from lupa import schemas
from lupa import session
from lupa import vocab as v
from lupa.ml import iforest
from lupa.operators import documents as d
from lupa.operators import links
from lupa.operators import keys
from lupa.operators import quantiles as qt
from lupa.plans import jobs
from lupa.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, source, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    tables.overwrite(source["documents"], path)
    return spark.read.parquet(path)


def test_invoice_scan_is_pushed_down_and_pruned(stored):
    text = plan(tables.invoices(stored).select("dhdr_folio", v.AMOUNT))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(dtdc_codigo,33\)", text)
    assert "ReadSchema: struct<dhdr_folio:bigint,dtdc_codigo:int,dhdr_mnt_total:double>" in text
    assert "Batched: true" in text


def test_window_bound_reaches_the_scan(stored):
    text = plan(d.recent(tables.invoices(stored), days=14))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(dhdr_fch_emis,ScalarSubquery", text)


def test_month_partitions_are_pruned(spark, source, tmp_path):
    path = str(tmp_path / "docs")
    months = tables.invoices(source["documents"]).withColumn("month", F.date_format(v.EMITTED, "yyyy-MM"))
    tables.overwrite(months, path, ["month"])
    window = d.recent(spark.read.parquet(path), days=14, month_partition="month")
    window.collect()
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ >= .*ubquery", plan(window))


def below(lines, i):
    """The lines of a plan's tree under line ``i``."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(lines[i])), len(lines))
    return lines[i + 1 : end]


def shuffles_rows_of(text, path):
    """Whether an exchange gets rows of the files at ``path`` that no aggregate has counted before."""
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange" in line and "ReusedExchange" not in line:
            tree = below(lines, i)
            scan = next((j for j, x in enumerate(tree) if "FileScan" in x and path in x), None)
            if scan is not None and not any("HashAggregate" in x for x in tree[:scan]):
                return True
    return False


def test_quantiles_shuffle_counts_and_no_values(spark, source, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    tables.overwrite(source["documents"], path)
    docs = spark.read.parquet(path).withColumnRenamed("dhdr_rut_emisor", "k")
    assert shuffles_rows_of(plan(docs.repartition(3)), path) and not shuffles_rows_of(plan(docs.groupBy("k").count()), path)
    seen, stage = [], qt.stage
    monkeypatch.setattr(qt, "stage", lambda df, name: seen.append(df) or stage(df, name))
    for keys in ([], ["k"]):
        seen.append(qt.quantiles(docs, v.AMOUNT, {"m": 0.5}, keys))
    seen.append(qt.box_summary(docs, v.AMOUNT, ["k"]))
    assert len(seen) > 6
    assert not any(shuffles_rows_of(plan(df), path) for df in seen)


def test_forest_samples_shuffle_digests_only(spark, source, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    tables.overwrite(source["documents"], path)
    docs = spark.read.parquet(path)
    seen, stage = [], iforest.stage
    monkeypatch.setattr(iforest, "stage", lambda df, name: seen.append(df) or stage(df, name))
    seen.append(iforest.row_samples(docs, [v.AMOUNT, v.VAT], ["dhdr_folio"], trees=3, psi=16, seed=1))
    for df in seen:
        lines = plan(df).splitlines()
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line:
                tree = below(lines, i)
                of_all = [x for x in tree if "FileScan" in x and path in x]
                chosen = any("BroadcastHashJoin" in x and "LeftSemi" in x for x in tree)
                assert not of_all or chosen or (v.AMOUNT not in tree[0] and "_d1" in tree[0])


def test_hot_keys_are_found_without_shuffling_keys(spark, source, tmp_path):
    path = str(tmp_path / "docs")
    tables.overwrite(source["documents"], path)
    found = keys.hot_keys(spark.read.parquet(path), ["dhdr_folio", "dhdr_rut_emisor"])
    for i, line in enumerate(lines := plan(found).splitlines()):
        if "Exchange hashpartitioning(dhdr_folio" in line:
            assert any("BroadcastHashJoin" in x for x in below(lines, i))


def test_no_python_and_no_cartesian_product_outside_the_model(spark, source):
    from checks.fixtures import Source

    skip = {name for name in QUERIES if name.startswith(("forest", "outlier", "surrogate", "tracked"))}
    for name, fn in QUERIES.items():
        if name in skip:
            continue
        text = plan(fn(Source(spark, source.directory)))
        for banned in ("EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
            assert banned not in text, f"{banned} in {name}"


def test_a_party_travels_as_one_struct(spark, source):
    from lupa.operators import enrich, taxpayers

    profile = session.stage(taxpayers.profile(source), "profile")
    joined = enrich.parties_with_statistics(tables.invoices(source["documents"]), profile, v.ENRICHED_PROFILE)
    assert set(v.ENRICHED_FULL) - set(v.TIME_COLUMNS) <= set(joined.columns)
    assert plan(joined).count("struct(statistics, ") == 2


def test_methods_too_large_to_compile_are_not_generated(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_joins_of_more_than_a_hundred_fields_are_compiled(spark):
    """As of scored invoices: beyond ``maxFields``, Spark would not compile an operator at all."""
    wide = spark.range(5).select("id", *(F.lit(i).alias(f"c{i}") for i in range(130)))
    found = wide.join(F.broadcast(spark.range(5).withColumnRenamed("id", "other")), F.col("id") == F.col("other"), "left")
    found.collect()
    assert re.search(r"\*\(\d+\) BroadcastHashJoin", plan(found))


def test_tracking_and_totals_store_key_and_score_only(spark, monkeypatch):
    from checks import queries
    from checks.fixtures import Source
    from conftest import SF

    seen, stage = {}, queries.stage
    monkeypatch.setattr(queries, "stage", lambda df, name, *a: seen.setdefault(name, df.columns) and stage(df, name, *a))
    small = Source(spark, f"{SF}/")  # a directory of its own, so that no other test has handed anything over
    tracked, total = QUERIES["tracked_scores"](small), QUERIES["outlier_total"](small).first()
    assert set(seen["scored"]) == {*queries.MODEL_KEY, "score"}
    labels = QUERIES["outlier_labels"](small)
    assert tracked.count() == labels.count() == total["rows"]
    assert labels.where("outliers = -1").count() == total["outliers"] > 0


def test_one_row_per_key_is_cut_before_the_shuffle(source):
    from lupa.operators import taxpayers

    text = plan(taxpayers.latest_behaviour(source["behaviour"]))
    assert text.count("WindowGroupLimit") == 2


def test_conform_checks_columns(spark):
    df = spark.createDataFrame([("1", 2)], "cont_rut string, extra int")
    with pytest.raises(ValueError, match="CONT_DV"):
        schemas.conform(df, schemas.TAXPAYER)
    good = schemas.conform(df.withColumn("CONT_DV", F.lit(3)), schemas.TAXPAYER)
    assert good.dtypes == [("CONT_RUT", "string"), ("CONT_DV", "string")]


class FakeSession:
    """Stands for a session with given settings and master."""

    def __init__(self, master, setting=None):
        self.conf = {"spark.checkpoint.dir": setting}
        self.sparkContext, self.master, self.folder = self, master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_staging_folder():
    assert session.staging_dir(FakeSession("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert session.staging_dir(FakeSession("local[2]", "/shared")) == "/shared"
    with pytest.raises(ValueError):
        session.staging_dir(FakeSession("yarn"))
    alone = FakeSession("local[2]")
    assert session.staging_dir(alone) == session.staging_dir(alone) == alone.folder


def test_stage_writes_to_that_folder(spark):
    back = session.stage(spark.range(5), "numbers")
    folder = session.staging_dir(spark).replace("file:", "")
    assert back.count() == 5 and folder in back.inputFiles()[0]


def test_jobs_hand_over_through_parquet(spark, source, tmp_path):
    store = jobs.Store(spark, str(tmp_path))
    profile = jobs.taxpayers_job(source, store)
    assert profile.columns == list(v.PROFILE_COLUMNS)
    jobs.sample_job(source, store)
    jobs.recent_job(source, store)
    sample, full = jobs.enrich_job(store)
    assert set(sample.columns) == set(v.ENRICHED_SAMPLE) and sample.count() == store.read(jobs.SAMPLE).count()
    assert set(full.columns) == set(v.ENRICHED_FULL) and full.count() == store.read(jobs.RECENT).count()
    jobs.links_job(source, store)
    jobs.profiling_job(store)
    assert store.read("analisis/limites_monto").count() == 1
    jobs.model_job(store, "run-1")
    assert store.read("modelo/anomalias").count() == sample.count()
    tracked = store.read("seguimiento/predicciones").where("run_id = 'run-1'")
    assert tracked.count() == tracked.select("uuid").distinct().count() == sample.count()


def test_jobs_read_only_the_months_they_need(spark, source, rows, tmp_path):
    path = str(tmp_path / "docs")
    months = source["documents"].withColumn("month", F.date_format(v.EMITTED, "yyyy-MM"))
    tables.overwrite(months, path, ["month"])
    warehouse = jobs.Warehouse(spark, month="month")
    warehouse["documents"] = spark.read.parquet(path)
    assert rows(jobs.recent_invoices(warehouse, months=3)) == rows(jobs.recent_invoices(source, months=3))


def test_type_and_month_partitions_reach_every_scan(spark, source, rows, tmp_path):
    path = str(tmp_path / "docs")
    months = source["documents"].withColumn("month", F.date_format(v.EMITTED, "yyyy-MM"))
    tables.overwrite(months, path, ["dtdc_codigo", "month"])
    warehouse = jobs.Warehouse(spark, month="month")
    warehouse["documents"] = spark.read.parquet(path)
    window = jobs.recent_invoices(warehouse, days=14)
    assert rows(window) == rows(jobs.recent_invoices(source, days=14))
    text = plan(window)
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", text)
    assert scans and all("dtdc_codigo" in scan for scan in scans)
    # the last month is looked up without reading a column, all else reads some months only
    wide = [s for s, schema in zip(scans, re.findall(r"ReadSchema: struct<([^\n]*)>", text)) if schema]
    assert wide and all("month" in scan for scan in wide)


def test_cession_documents_keep_their_columns(spark, source):
    extra = source["cession_documents"].withColumns({"monto": F.lit(5), "otro nombre": F.lit("x")})
    extra.createOrReplaceTempView("some_cessions")
    found = tables.table(spark, "cession_documents", "some_cessions")
    assert found.columns == extra.columns
    assert {"monto", "otro nombre"} < set(links.cession_link(tables.invoices(source["documents"]), found).columns)


def test_catalog_tables(spark, source):
    source["units"].createOrReplaceTempView("some_units")
    assert tables.table(spark, "units", "some_units").columns == ["UNOP_UNIDAD", "UNOP_COD_REGIONAL"]
