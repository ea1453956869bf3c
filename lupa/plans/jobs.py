"""The batch jobs, each from Parquet or catalog tables to Parquet.

Run one with ``python -m lupa.plans.jobs <job> --root <folder>``. Order: ``taxpayers``, then
``sample`` and ``recent``, then ``enrich``, then ``links``, ``profiling`` and ``model``.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import monitor, session
from .. import vocab as v
from ..ml import evaluate, iforest, prep, surrogate
from ..operators import documents, enrich, links, outliers, profiling, quality, sampling, taxpayers
from ..operators import quantiles as qt
from ..sources import tables


class Warehouse(dict):
    """Input tables by short name, read from the catalog when first used.

    ``month`` names the column by which the documents are partitioned by month, if they are.
    """

    def __init__(self, spark: SparkSession, month: str | None = None):
        super().__init__()
        self.spark, self.month = spark, month

    def __missing__(self, name: str) -> DataFrame:
        extra = [self.month] if self.month and name == "documents" else []
        self[name] = tables.table(self.spark, name, extra=extra)
        return self[name]


def recent_invoices(source: Mapping[str, DataFrame], **span: int) -> DataFrame:
    """Invoices of the last ``months`` or ``days``, reading only those months where that is possible.

    Documents partitioned by type and month are best: the last month is then found from the
    partitions alone. With the month only, the type has to be read in every month for that.
    """
    month = getattr(source, "month", None)
    pool = tables.invoices(source["documents"], extra=[month] if month else [])
    return documents.recent(pool, month_partition=month, **span).select(*v.DOCUMENT_COLUMNS)


@dataclass(frozen=True)
class Store:
    """Folder of the Parquet datasets the jobs hand to one another."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, name: str) -> DataFrame:
        return tables.parquet(self.spark, self.path(name))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        tables.overwrite(df, self.path(name))
        return self.read(name)


# Names of the hand-off datasets.
PROFILE = "data_contribuyentes"
SAMPLE, RECENT = "dtes_muestra_estratificada", "dtes_no_estratificado"
ENRICHED_SAMPLE, ENRICHED = "dataset_final_estratificado", "dataset_final_no_estratificado"


def taxpayers_job(source: Mapping[str, DataFrame], store: Store) -> DataFrame:
    """One row per unambiguous taxpayer."""
    return store.write(taxpayers.profile(source), PROFILE)


def recent_job(source: Mapping[str, DataFrame], store: Store, days: int = 14) -> DataFrame:
    """All invoices of the last days, with statistics and time features, and with both profiles.

    Statistics and profiles are joined together, so the documents move once per role.
    """
    window = session.stage(recent_invoices(source, days=days), "window")
    timed = documents.with_time_features(window)
    whole = session.stage(enrich.parties_with_statistics(timed, store.read(PROFILE), v.ENRICHED_PROFILE), "recent")
    store.write(whole.select(*v.ENRICHED_FULL), ENRICHED)
    stats = [name for role in (v.ISSUER, v.RECEIVER) for name in v.stat_columns(role)]
    return store.write(whole.select(*timed.columns, *stats), RECENT)


def sample_job(source: Mapping[str, DataFrame], store: Store, months: int = 3) -> DataFrame:
    """Class-balanced sample of the invoices of the last months.

    The window and its classes are written before sampling, which reads them several times.
    """
    window = session.stage(recent_invoices(source, months=months), "window")
    featured = documents.featured(window).drop(v.SIGNED, v.EMITTED)
    profile = store.read(PROFILE)
    classed = session.stage(sampling.with_both_classes(featured, profile), "classed")
    return store.write(sampling.balanced_of(classed), SAMPLE)


def enrich_job(store: Store) -> tuple[DataFrame, DataFrame]:
    """Profiles of both parties attached to the sample; ``recent_job`` did so for the recent invoices.

    The stored sample also keeps what tells a document apart, which its predictions are tracked by.
    """
    whole = enrich.parties(store.read(SAMPLE), store.read(PROFILE))
    sample = store.write(whole.select(*dict.fromkeys([*v.ENRICHED_SAMPLE, *v.MODEL_KEY])), ENRICHED_SAMPLE)
    return sample.select(*v.ENRICHED_SAMPLE), store.read(ENRICHED)


def links_job(source: Mapping[str, DataFrame], store: Store, days: int = 14) -> None:
    """Cession and ledger links of the recent invoices."""
    window = session.stage(recent_invoices(source, days=days), "window")
    linked = links.cession_link(window, source["cession_documents"])
    store.write(linked, "cesiones")
    store.write(links.times_ceded(window, source["cession_documents"]), "veces_cedido")
    store.write(links.cession_detail(linked, source["cessions"]), "detalle_cesion")
    store.write(links.ledger_match(window, source["ledger"]), "cruce_rcv")


def profiling_job(store: Store) -> None:
    """Counts, box summaries, ranked subsectors and rules of the recent invoices."""
    docs = store.read(ENRICHED)
    segment, band = profiling.ISSUER_SEGMENT, "bloque_horario"
    typed = profiling.with_alert_type(profiling.with_alert_flags(docs))
    # several results read these, so their bounds are found once
    inside = session.stage(qt.within_fences(typed, v.AMOUNT), "inside")
    dawn = profiling.at_dawn(typed)
    above = session.stage(outliers.above_p90(docs), "above")
    results = {
        "conteo_fin_de_semana": profiling.counts(docs, segment, "es_fin_de_semana", drop_null=True),
        "conteo_bloque": profiling.counts(docs, segment, band, drop_null=True),
        "limites_monto": qt.iqr_fences(docs, v.AMOUNT),
        "caja_bloque_segmento": qt.box_summary(inside, v.AMOUNT, [band, segment]),
        "caja_alerta_segmento": qt.box_summary(inside, v.AMOUNT, ["tipo_alerta", segment]),
        "caja_bloque_alerta": qt.box_summary(inside, v.AMOUNT, [band, "tipo_alerta"]),
        "caja_fin_de_semana_alerta": qt.box_summary(inside, v.AMOUNT, ["es_fin_de_semana", "tipo_alerta"]),
        "alertas_combinadas": profiling.combined_alerts(typed),
        "monto_alertas_madrugada": profiling.top_sum(
            profiling.at_weekend(dawn).where("alertas_combinadas"), profiling.ISSUER_SUBSECTOR
        ),
        "percentil_90": outliers.segment_p90(docs),
        "reglas_subrubro": outliers.by_subsector(above),
        "reglas_horario": outliers.by_time(above),
        "nulos": quality.null_report(docs, docs.columns),
    }
    for role, key in (("emisor", profiling.ISSUER_SUBSECTOR), ("receptor", profiling.RECEIVER_SUBSECTOR)):
        best = profiling.top_mean(dawn, key)
        results[f"subrubros_{role}"] = best
        results[f"caja_subrubros_{role}"] = qt.box_summary(
            profiling.keep_top(dawn, best, key), v.AMOUNT, [key]
        )
    for name, df in results.items():
        store.write(df, f"analisis/{name}")


def model_job(store: Store, run_id: str, contamination: float = 0.1, seed: int = 42) -> None:
    """Isolation forest on the enriched sample, explained by a shallow tree."""
    spark = store.spark
    docs = session.stage(prep.imputed(store.read(ENRICHED_SAMPLE)), "imputed")
    encoder = prep.fit_encoder(docs)
    encoded = encoder.transform(docs)
    key = list(v.MODEL_KEY)
    narrow = docs.select(*dict.fromkeys([*key, *v.NUMERIC, *v.CATEGORIES]))
    features = iforest.features([*v.NUMERIC, *v.PASS_THROUGH], encoder.slots)
    forest = iforest.fit(narrow, features, key, seed=seed, prepare=encoder.transform)
    scored = session.stage(iforest.score(encoded, forest).select(*docs.columns, "score"), "scored")
    limit = iforest.threshold(scored, contamination)
    flagged = store.write(iforest.flag(scored, limit), "modelo/anomalias")
    store.write(forest.nodes, "modelo/nodos")
    rows = prep.entries(encoder.transform(flagged), encoder)
    train, test = sampling.split(rows, seed=seed, key=key)
    tree = surrogate.fit(train, lambda slots: prep.names_of(encoder, slots))
    predicted = surrogate.predict(test, tree).select(*key, "outliers", "predicted", "outlier_probability", "leaf")
    predicted = store.write(predicted, "modelo/prediccion")
    store.write(surrogate.rules(tree, docs), "modelo/reglas")
    store.write(surrogate.leaf_quality(predicted), "modelo/hojas")
    store.write(evaluate.report(predicted, "outliers", "predicted"), "modelo/metricas")
    at = F.lit(spark.sql("SELECT current_timestamp()").first()[0])
    tracked = monitor.predict(flagged, run_id, at, key)
    monitor.record(tracked, store.path("seguimiento/predicciones"), run_id)


def main() -> None:
    jobs = {
        "taxpayers": lambda source, store: taxpayers_job(source, store),
        "sample": lambda source, store: sample_job(source, store),
        "recent": lambda source, store: recent_job(source, store),
        "enrich": lambda source, store: enrich_job(store),
        "links": lambda source, store: links_job(source, store),
        "profiling": lambda source, store: profiling_job(store),
        "model": lambda source, store: model_job(store, run_id=args.run_id),
    }
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=jobs)
    parser.add_argument("--root", required=True, help="folder of the hand-off datasets")
    parser.add_argument("--month", help="column by which the documents are partitioned by month")
    parser.add_argument("--run-id", help="id of a model run, kept with its predictions")
    args = parser.parse_args()
    if args.job == "model" and not args.run_id:
        parser.error("the model job takes a --run-id; a repeated run replaces its own predictions")
    spark = session.build(f"lupa-{args.job}")
    jobs[args.job](Warehouse(spark, args.month), Store(spark, args.root))


if __name__ == "__main__":
    main()
