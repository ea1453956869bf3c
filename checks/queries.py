"""Registered queries: every operator on the whole test tables.

Each function takes the warehouse tables (``Source``) and returns a DataFrame. As in production,
the jobs hand over through Parquet: profile, enriched invoices and scored invoices are written once
per session and directory and then read by the queries that profile or model them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lupa import monitor
from lupa import vocab as v
from lupa.ml import evaluate, iforest, prep, surrogate
from lupa.operators import documents, enrich, links, outliers, profiling, quality, sampling, taxpayers
from lupa.operators import quantiles as qt
from lupa.session import application_dir, configure, stage
from lupa.sources import tables

from .fixtures import Source, handed_over, made
from .shown import DATES, DOUBLES

QUERIES: dict[str, Callable[[Source], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _shown(fn(Source(configure(spark), sf_dir)), fn.__name__)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        return run

    return {name: bind(fn) for name, fn in QUERIES.items()}


# -- helpers -----------------------------------------------------------------


def _shown(df: DataFrame, name: str) -> DataFrame:
    """Dates as timestamps and whole numbers that can be missing as doubles, see ``shown``."""
    casts = {c: F.col(c).cast("timestamp_ntz") for c in DATES.get(name, ())}
    casts |= {c: F.col(c).cast("double") for c in DOUBLES.get(name, ())}
    return df.withColumns(casts) if casts else df


def steady(column: str | Column, digits: int = 2) -> Column:
    """A double cut to ``digits`` decimals, for comparison between engines.

    Sums in another order differ in the last bits. The odd offset keeps exact halves, which are
    common in means of prices, away from the cutting points.
    """
    name = F.col(column) if isinstance(column, str) else column
    return F.floor(name * 10.0**digits + 0.381966) / 10.0**digits


def steadied(df: DataFrame, names, digits: int = 2) -> DataFrame:
    return df.withColumns({name: steady(name, digits) for name in names})


MODEL_KEY = ("dhdr_folio", f"{v.ISSUER}{v.RUT}", f"{v.RECEIVER}{v.RUT}", v.AMOUNT)
STATS = (*v.stat_columns(v.ISSUER), *v.stat_columns(v.RECEIVER))
TREE_DEPTH = 3
TREE_PLAIN = tuple(c for c in (*v.NUMERIC, *v.PASS_THROUGH) if c not in (v.AMOUNT, v.VAT, *STATS))
def invoices(src: Source) -> DataFrame:
    return tables.invoices(src["documents"])


def profile(src: Source) -> DataFrame:
    return handed_over(src, "profile", lambda: stage(taxpayers.profile(src), "profile"))


def enriched(src: Source) -> DataFrame:
    """All invoices with statistics, time features and both profiles."""

    def build():
        # time features come last, so that the joins move the signing time alone
        full = documents.with_time_features(enrich.parties_with_statistics(invoices(src), profile(src), v.ENRICHED_PROFILE))
        return stage(full.select(*v.ENRICHED_FULL), "enriched", "zstd")

    return handed_over(src, "enriched", build)


def recent_invoices(src: Source, **window) -> DataFrame:
    return documents.recent(invoices(src), **window)


# -- scans -------------------------------------------------------------------


@query
def invoice_scan(src):
    return invoices(src)


@query
def behaviour_scan(src):
    return tables.behaviour(src["behaviour"])


@query
def catalog_table_scan(src):
    src["business"].createOrReplaceTempView("lupa_business")
    return tables.table(src.spark, "business", "lupa_business")


@query
def parquet_hand_over(src):
    """Invoices written as Parquet, partitioned by month of emission, and read back by month."""
    month = F.date_format(v.EMITTED, "yyyy-MM")
    path = f"{staging(src)}/by-month"
    tables.overwrite(invoices(src).withColumn("month", month), path, ["month"])
    back = tables.parquet(src.spark, path)
    return back.groupBy(F.date_format(v.EMITTED, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("documents"), steady(F.sum(v.AMOUNT)).alias("amount")
    )


@query
def invoices_last_14_days_by_month(src):
    """The window of a table that is partitioned by month, as the jobs read it."""
    path = f"{staging(src)}/by-month"
    tables.overwrite(invoices(src).withColumn("month", F.date_format(v.EMITTED, "yyyy-MM")), path, ["month"])
    return documents.recent(tables.parquet(src.spark, path), days=14, month_partition="month").drop("month")


def staging(src: Source) -> str:
    return f"{application_dir(src.spark)}/{uuid.uuid4().hex}"


# -- taxpayers ---------------------------------------------------------------


def _history(src):
    return src["taxpayers"], src["attribute_history"], src["attributes"]


@query
def current_attributes(src):
    return taxpayers.current_attributes(*_history(src))


@query
def latest_attributes(src):
    return taxpayers.latest_attributes(taxpayers.current_attributes(*_history(src)))


@query
def current_segment(src):
    return taxpayers.segments(*_history(src))


@query
def segment_uniqueness(src):
    return quality.uniqueness(taxpayers.segments(*_history(src)), v.RUT)


@query
def segment_kind_counts(src):
    return profiling.counts(taxpayers.segments(*_history(src)), "ES_PERSONA", "ES_EMPRESA")


@query
def active_alerts(src):
    return taxpayers.active_alerts(src["alerts"])


@query
def alert_description_counts(src):
    return profiling.counts(taxpayers.active_alerts(src["alerts"]), "ALER_DESC_TIPO_ALERTA_VO")


@query
def alert_flags(src):
    return taxpayers.alert_flags(src["alerts"])


@query
def latest_business(src):
    return taxpayers.latest_business(src["business"])


@query
def business_region(src):
    return taxpayers.business_region(src["business"], src["units"])


@query
def latest_behaviour(src):
    return taxpayers.latest_behaviour(src["behaviour"])


@query
def principal_activity(src):
    return taxpayers.principal_activity(src["behaviour"], src["activity_links"], src["activities"])


@query
def profile_all_rows(src):
    return taxpayers.merge_profile(**taxpayers.profile_sources(src))


@query
def unambiguous_profile(src):
    """The profile from the merged rows, for those who keep these."""
    rows = stage(taxpayers.merge_profile(**taxpayers.profile_sources(src)), "merged")
    return taxpayers.unambiguous(rows)


@query
def taxpayer_profile(src):
    return taxpayers.profile(src)


@query
def taxpayer_class_counts(src):
    from lupa.functions.columns import taxpayer_class

    label = taxpayer_class(F.col("ES_EMPRESA"), F.col("ES_PERSONA"))
    return profiling.counts(profile(src).withColumn(sampling.CLASS, label), sampling.CLASS)


# -- documents ---------------------------------------------------------------


@query
def invoices_last_3_months(src):
    return recent_invoices(src, months=3)


@query
def invoices_last_14_days(src):
    return recent_invoices(src, days=14)


@query
def issuer_statistics(src):
    return steadied(documents.party_statistics(invoices(src), v.ISSUER), v.stat_columns(v.ISSUER))


@query
def receiver_statistics(src):
    return steadied(documents.party_statistics(invoices(src), v.RECEIVER), v.stat_columns(v.RECEIVER))


@query
def invoices_with_party_statistics(src):
    return steadied(documents.with_party_statistics(invoices(src)), STATS)


@query
def invoice_time_features(src):
    return documents.with_time_features(invoices(src))


@query
def featured_invoices_last_3_months(src):
    return steadied(documents.featured(recent_invoices(src, months=3)), STATS)


@query
def featured_invoices_last_14_days(src):
    return steadied(documents.featured(recent_invoices(src, days=14)), STATS)


# -- sampling ----------------------------------------------------------------


def _classed(src, role):
    return sampling.with_class(recent_invoices(src, months=3), profile(src), role)


@query
def issuer_class_sizes(src):
    return sampling.class_sizes(_classed(src, v.ISSUER))


@query
def receiver_class_sizes(src):
    return sampling.class_sizes(_classed(src, v.RECEIVER))


@query
def issuer_class_fractions(src):
    return steadied(sampling.fractions(sampling.class_sizes(_classed(src, v.ISSUER))), ["fraccion"], 9)


@query
def receiver_class_fractions(src):
    return steadied(sampling.fractions(sampling.class_sizes(_classed(src, v.RECEIVER))), ["fraccion"], 9)


@query
def issuer_stratified_sample(src):
    classed = _classed(src, v.ISSUER)
    return sampling.stratified(classed, sampling.fractions(sampling.class_sizes(classed)))


@query
def receiver_stratified_sample(src):
    classed = _classed(src, v.RECEIVER)
    return sampling.stratified(classed, sampling.fractions(sampling.class_sizes(classed)))


def _window(src):
    """Featured invoices of the last three months, as handed to sampling."""

    def build():
        featured = documents.featured(recent_invoices(src, months=3))
        return stage(featured.drop(v.SIGNED, v.EMITTED), "window")

    return handed_over(src, "window", build)


def _sample(src):
    def build():
        classed = stage(sampling.with_both_classes(_window(src), profile(src)), "classed")
        return stage(sampling.balanced_of(classed), "sample")

    return handed_over(src, "sample", build)


@query
def equalised_sample(src):
    """Both stratified samples, thinned to one size and merged."""

    def drawn(role):
        classed = stage(_classed(src, role), "classed")
        return stage(sampling.stratified(classed, sampling.fractions(sampling.class_sizes(classed))).select(*v.DOCUMENT_COLUMNS), "drawn")

    return sampling.union_distinct(*sampling.equalise(drawn(v.ISSUER), drawn(v.RECEIVER)))


@query
def balanced_sample(src):
    return steadied(_sample(src), STATS)


@query
def test_rows_of_split(src):
    return sampling.split(invoices(src))[1]


# -- enrichment and links ----------------------------------------------------


@query
def enriched_sample(src):
    return steadied(enrich.enriched_sample(_sample(src), profile(src)), STATS)


@query
def enriched_invoices(src):
    timed = documents.with_time_features(recent_invoices(src, days=14))
    full = enrich.parties_with_statistics(timed, profile(src), v.ENRICHED_PROFILE)
    return steadied(full.select(*v.ENRICHED_FULL), STATS)


@query
def enriched_invoices_by_parties(src):
    """The same from statistics and profiles that are joined one after the other."""
    featured = stage(documents.featured(recent_invoices(src, days=14)), "featured")
    return steadied(enrich.enriched_full(featured, profile(src)), STATS)


@query
def enriched_invoices_all_dates(src):
    return steadied(enriched(src), STATS)


@query
def cession_link(src):
    return links.cession_link(invoices(src), src["cession_documents"])


@query
def times_ceded(src):
    return links.times_ceded(invoices(src), src["cession_documents"])


@query
def cession_detail(src):
    linked = links.cession_link(invoices(src), src["cession_documents"])
    return links.cession_detail(linked, src["cessions"])


@query
def ledger_match(src):
    return links.ledger_match(invoices(src), src["ledger"])


# -- profiling and rules -----------------------------------------------------


@query
def segment_weekend_counts(src):
    return profiling.counts(enriched(src), profiling.ISSUER_SEGMENT, "es_fin_de_semana", drop_null=True)


@query
def segment_band_counts(src):
    return profiling.counts(enriched(src), profiling.ISSUER_SEGMENT, "bloque_horario", drop_null=True)


@query
def issuer_segment_levels(src):
    return enriched(src).select(profiling.ISSUER_SEGMENT).distinct()


@query
def amount_fences(src):
    return steadied(qt.iqr_fences(invoices(src), v.AMOUNT), ["q1", "q3", "iqr", "lower_bound", "upper_bound"])


@query
def invoices_within_fences(src):
    return qt.within_fences(invoices(src), v.AMOUNT)


@query
def subsector_fences(src):
    fences = qt.iqr_fences(enriched(src), v.AMOUNT, [profiling.ISSUER_SUBSECTOR])
    return steadied(fences, ["q1", "q3", "iqr", "lower_bound", "upper_bound"])


def _typed(src):
    return profiling.with_alert_type(profiling.with_alert_flags(enriched(src)))


def _box(df, *keys):
    return steadied(qt.box_summary(df, v.AMOUNT, keys), ["q1", "median", "q3", "whisker_low", "whisker_high"])


@query
def box_band_segment(src):
    return _box(qt.within_fences(enriched(src), v.AMOUNT), "bloque_horario", profiling.ISSUER_SEGMENT)


@query
def box_alert_type_segment(src):
    return _box(qt.within_fences(_typed(src), v.AMOUNT), "tipo_alerta", profiling.ISSUER_SEGMENT)


@query
def box_band_alert_type(src):
    return _box(qt.within_fences(_typed(src), v.AMOUNT), "bloque_horario", "tipo_alerta")


@query
def box_weekend_alert_type(src):
    return _box(qt.within_fences(_typed(src), v.AMOUNT), "es_fin_de_semana", "tipo_alerta")


def _box_top(src, key):
    dawn = profiling.at_dawn(enriched(src))
    return _box(profiling.keep_top(dawn, profiling.top_mean(dawn, key), key), key)


@query
def box_top_issuer_subsectors(src):
    return _box_top(src, profiling.ISSUER_SUBSECTOR)


@query
def box_top_receiver_subsectors(src):
    return _box_top(src, profiling.RECEIVER_SUBSECTOR)


@query
def party_alert_flags(src):
    flagged = profiling.with_alert_flags(enriched(src))
    return flagged.select("dhdr_folio", v.AMOUNT, "alertas_emisor", "alertas_receptor", "alertas_combinadas")


@query
def alert_type_counts(src):
    return profiling.counts(_typed(src), "tipo_alerta")


@query
def combined_alerts(src):
    return profiling.combined_alerts(profiling.with_alert_flags(enriched(src)))


@query
def top_issuer_subsectors_by_mean(src):
    return steadied(profiling.top_mean(profiling.at_dawn(enriched(src)), profiling.ISSUER_SUBSECTOR), ["measure"])


@query
def top_receiver_subsectors_by_mean(src):
    return steadied(profiling.top_mean(profiling.at_dawn(enriched(src)), profiling.RECEIVER_SUBSECTOR), ["measure"])


@query
def top_issuer_subsectors_by_sum(src):
    flagged = profiling.with_alert_flags(profiling.at_weekend(profiling.at_dawn(enriched(src))))
    both = flagged.where("alertas_combinadas")
    return steadied(profiling.top_sum(both, profiling.ISSUER_SUBSECTOR), ["measure"])


@query
def segment_p90(src):
    return steadied(outliers.segment_p90(enriched(src)), ["percentil_90"])


@query
def invoices_above_p90(src):
    above = outliers.above_p90(enriched(src))
    return steadied(above, ["percentil_90"]).select(
        "dhdr_folio", v.AMOUNT, profiling.ISSUER_SEGMENT, "percentil_90", outliers.HAS_ALERT
    )


@query
def rules_by_subsector(src):
    return steadied(outliers.by_subsector(outliers.above_p90(enriched(src))), ["total_monto"])


@query
def rules_by_time(src):
    return steadied(outliers.by_time(outliers.above_p90(enriched(src))), ["total_monto"])


# -- quality -----------------------------------------------------------------


@query
def null_counts(src):
    return quality.null_report(enriched(src), v.ENRICHED_FULL)


@query
def null_counts_before_and_after(src):
    docs = enriched(src)
    return quality.null_comparison(docs, prep.imputed(docs), (*v.NUMERIC, *v.CATEGORIES))


@query
def party_pair_totals(src):
    totals = quality.party_totals(invoices(src), "dhdr_rut_emisor", "dhdr_rut_recep")
    return steadied(totals, ["total_monto"])


@query
def issuer_totals(src):
    return steadied(quality.party_totals(invoices(src), "dhdr_rut_emisor"), ["total_monto"])


@query
def receiver_totals(src):
    return steadied(quality.party_totals(invoices(src), "dhdr_rut_recep"), ["total_monto"])


@query
def integrity_report(src):
    return quality.integrity_report(invoices(src), profile(src))


# -- features and models -----------------------------------------------------


@query
def imputed_invoices(src):
    return steadied(prep.imputed(enriched(src)).select(*v.NUMERIC, *v.CATEGORIES, "dhdr_folio"), STATS)


@query
def category_levels(src):
    return prep.levels(prep.imputed(enriched(src)))


def _encoded(src):
    """Imputed and encoded invoices, and the fitted encoder."""

    def build():
        docs = prep.imputed(enriched(src))
        encoder = prep.fit_encoder(docs)
        return encoder.transform(docs), encoder

    return handed_over(src, "encoded", build)


@query
def onehot_level_totals(src):
    return prep.level_totals(*_encoded(src))


@query
def numeric_moments(src):
    one_row = prep.moments(prep.imputed(enriched(src)))
    tall = one_row.unpivot([], one_row.columns, "moment", "amount")
    return tall.withColumn("amount", steady("amount"))


@query
def scaled_numeric(src):
    docs = prep.imputed(enriched(src))
    scaled = prep.fit_scaler(docs).transform(docs)
    return steadied(scaled.select("dhdr_folio", *v.NUMERIC), v.NUMERIC, 5)


@query
def assembled_features(src):
    encoded, encoder = _encoded(src)
    return prep.assemble(encoded, encoder).select(
        "dhdr_folio", F.expr("cast(features as string)").alias("features")
    )


@query
def feature_totals(src):
    """Sum of every slot of the assembled vector, by feature name."""
    encoded, encoder = _encoded(src)
    sums = prep.assemble(encoded, encoder).agg(Summarizer.sum(F.col("features")).alias("total"))
    names = F.array(*(F.lit(name) for name in prep.feature_names(encoder)))
    pairs = sums.select(F.explode(F.arrays_zip(names.alias("feature"), vector_to_array("total").alias("total"))))
    return pairs.select("col.feature", steady("col.total", 1).alias("total"))


def _forest(src):
    def build():
        _, encoder = _encoded(src)
        features = iforest.features([*v.NUMERIC, *v.PASS_THROUGH], encoder.slots)
        docs = prep.imputed(enriched(src)).select(*dict.fromkeys([*MODEL_KEY, *v.NUMERIC, *v.CATEGORIES]))
        return iforest.fit(docs, features, MODEL_KEY, prepare=encoder.transform)

    return handed_over(src, "forest", build)


def _scored(src, columns):
    """These columns of the imputed invoices, with score and outlier label."""
    encoded, _ = _encoded(src)
    scored = stage(iforest.score(encoded, _forest(src)).select(*columns, "score"), "scored", "zstd")
    return iforest.flag(scored, iforest.threshold(scored))


def _flagged(src):
    """Imputed invoices with score and outlier label."""
    return handed_over(src, "flagged", lambda: _scored(src, enriched(src).columns))


def _rated(src):
    """Key, score and outlier label of all invoices: no other columns are written, if the session has not done so before."""
    if made(src, "flagged"):
        return _flagged(src).select(*MODEL_KEY, "score", "outliers")
    return handed_over(src, "rated", lambda: _scored(src, MODEL_KEY))


@query
def forest_nodes(src):
    return _forest(src).nodes


@query
def outlier_labels(src):
    """Every invoice as it was, with score and label beside it."""
    return _flagged(src).select(*v.NUMERIC, *v.CATEGORIES, "dhdr_folio", "score", "outliers")


@query
def outlier_total(src):
    return iforest.outlier_total(_rated(src))


def _surrogate(src):
    """Surrogate tree on the training rows, with weighted training rows and predicted test rows."""

    def build():
        _, encoder = _encoded(src)
        rows = prep.entries(encoder.transform(_flagged(src)), encoder)
        train, test = sampling.split(rows, key=MODEL_KEY)
        model = surrogate.fit(train, lambda slots: prep.names_of(encoder, slots))
        weighted = surrogate.predict(surrogate.with_weights(train), model)
        return model, weighted, stage(surrogate.predict(test, model).drop("features"), "predicted")

    return handed_over(src, "surrogate", build)


@query
def surrogate_test_predictions(src):
    return _surrogate(src)[2].select("dhdr_folio", "outliers", "predicted", "outlier_probability", "leaf")


@query
def surrogate_report(src):
    return evaluate.report(_surrogate(src)[2], "outliers", "predicted")


@query
def surrogate_leaf_quality(src):
    return surrogate.leaf_quality(_surrogate(src)[2])


@query
def surrogate_leaf_distribution(src):
    return surrogate.leaf_distribution(_surrogate(src)[1])


@query
def surrogate_rules(src):
    return surrogate.rules(_surrogate(src)[0], src["documents"])


@query
def surrogate_best_leaf_path(src):
    model, _, predicted = _surrogate(src)
    best = surrogate.best_leaf(surrogate.leaf_quality(predicted)).first()["leaf"]
    return surrogate.path(surrogate.rules(model, src["documents"]), best)


@query
def flagged_predictions(src):
    """Threshold and labels on a score that SQL has as well."""
    scored = src["predictions"].select("uuid", F.col("prediction").alias("score"))
    return iforest.flag(scored, iforest.threshold(scored))


@query
def flagged_prediction_total(src):
    scored = src["predictions"].select("uuid", F.col("prediction").alias("score"))
    return iforest.outlier_total(iforest.flag(scored, iforest.threshold(scored)))


# the same evaluation operators on labels and predictions that SQL can derive too


@query
def label_class_weights(src):
    return steadied(surrogate.class_weights(src["predictions"], "label"), ["weight"], 9)


@query
def label_report(src):
    report = evaluate.report(src["predictions"], "label", "predicted")
    return steadied(report, ["precision", "recall", "f1", "accuracy"], 9)


@query
def label_leaf_quality(src):
    return surrogate.leaf_quality(src["predictions"], "label", "predicted")


@query
def label_best_leaf(src):
    return surrogate.best_leaf(surrogate.leaf_quality(src["predictions"], "label", "predicted"))


@query
def label_leaf_distribution(src):
    weighted = surrogate.with_weights(src["predictions"], "label")
    return steadied(surrogate.leaf_distribution(weighted, "label"), ["share_outlier", "share_normal"], 9)


# the tree itself on labels that SQL has too, so that SQL can grow it as well


def _tree(src):
    """Tree that tells invoices above the 90th percentile from everything but money, and its predictions."""

    def build():
        encoded, encoder = _encoded(src)
        limit = qt.quantiles(encoded, v.AMOUNT, {"p": 0.9}).select("p").scalar()
        label = F.when(F.col(v.AMOUNT) > limit, -1).otherwise(1).alias("outliers")
        rows = stage(prep.entries(encoded, encoder, plain=TREE_PLAIN).select("features", label), "labelled")
        model = surrogate.fit(rows, lambda slots: prep.names_of(encoder, slots, TREE_PLAIN), depth=TREE_DEPTH)
        return model, stage(surrogate.predict(rows, model).drop("features"), "predicted")

    return handed_over(src, "tree", build)


@query
def tree_node_table(src):
    nodes = surrogate.node_table(_tree(src)[0], src["documents"])
    return steadied(nodes.withColumns({c: F.col(c).cast("double") for c in ("slot", "leaf")}), ["threshold", "decrease"], 4)


@query
def tree_leaf_counts(src):
    predicted = _tree(src)[1].groupBy("leaf", "outliers", "predicted", "outlier_probability").agg(F.count("*").alias("rows"))
    return steadied(predicted, ["outlier_probability"], 9)


@query
def tree_rule_table(src):
    return steadied(surrogate.rules(_tree(src)[0], src["documents"]), ["share_outlier", "share_normal"], 9)


@query
def tree_best_leaf_path(src):
    model, predicted = _tree(src)
    best = surrogate.best_leaf(surrogate.leaf_quality(predicted)).first()["leaf"]
    return surrogate.path(surrogate.rules(model, src["documents"]), best)


# -- monitoring --------------------------------------------------------------

WINDOW = tuple(f"2024-01-{day} 00:00:00" for day in ("03", "17"))


def _tracked_window() -> tuple[Column, Column]:
    return tuple(F.lit(text).cast("timestamp_ntz") for text in WINDOW)


def _tracked(src):
    return src["predictions"].select("uuid", "predicted_at", "prediction")


@query
def predictions_in_window(src):
    return monitor.read(_tracked(src), *_tracked_window())


@query
def predictions_with_truth(src):
    return steadied(monitor.with_truth(_tracked(src), src["truth"]), ["actual_result"])


@query
def mean_absolute_error(src):
    tracked = monitor.with_truth(monitor.read(_tracked(src), *_tracked_window()), src["truth"])
    return steadied(monitor.mean_absolute_error(tracked), ["mean_absolute_error"], 6)


@query
def recorded_metrics(src):
    """The error of the window, added to the metrics table and read back."""
    start, end = _tracked_window()
    tracked = monitor.with_truth(monitor.read(_tracked(src), start, end), src["truth"])
    path = f"{staging(src)}/metrics"
    value = monitor.mean_absolute_error(tracked)
    monitor.record(monitor.metric(value, "mean_absolute_error", start, end, "demo"), path, "first-run")
    return steadied(tables.parquet(src.spark, path).drop("run_id"), ["value"], 6)


@query
def tracked_invoices(src):
    """Predictions with ids that SQL can derive too; the amount stands in for a score."""
    made_at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return monitor.predict(invoices(src), "first-run", made_at, prediction=v.AMOUNT)


@query
def tracked_scores(src):
    scored = _rated(src)
    made_at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return monitor.predict(scored, "first-run", made_at, MODEL_KEY)
