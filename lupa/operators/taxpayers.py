"""Taxpayer columns: segment, alerts, business, behaviour, activity, and the merged profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions import columns as c
from ..sources import tables
from .keys import latest_one, latest_with_ties, unique_keys

KEY = [v.RUT, v.DV]
SOURCES = ("segment", "alerts", "business", "behaviour", "activity")


# -- segment -----------------------------------------------------------------


def open_segments(history: DataFrame, attributes: DataFrame) -> DataFrame:
    """Segment records that are open and in force, with the attribute's own columns."""
    current = history.where(
        F.col("ATRC_FECHA_TERMINO").isNull()
        & (F.col("ATRC_VIGENTE") == 1)
        & F.col("TATR_CODIGO").isin(*v.SEGMENT_RANK)
    ).select(v.RUT, "TATR_CODIGO", "ATRC_VIGENTE", "ATRC_FECHA_INICIO")
    described = attributes.select("TATR_CODIGO", "TATR_VIGENTE", "TATR_DESCRIPCION")
    return current.join(described, "TATR_CODIGO")


def current_attributes(
    taxpayers: DataFrame, history: DataFrame, attributes: DataFrame
) -> DataFrame:
    """Open segment records of known taxpayers with rank and packed start date."""
    start = F.col("ATRC_FECHA_INICIO")
    return (
        taxpayers.select(*KEY)
        .join(open_segments(history, attributes), v.RUT)
        .select(
            *KEY, "ATRC_VIGENTE", "TATR_VIGENTE", "TATR_CODIGO",
            c.segment_rank(F.col("TATR_CODIGO")).alias("SGM_NUM"), start.alias("ATRC_FECHA_INICIO"),
            c.packed_date(start).alias("DIA_AGNO"), "TATR_DESCRIPCION",
        )
    )


def latest_attributes(records: DataFrame) -> DataFrame:
    """Records that start on the taxpayer's latest start date."""
    return latest_with_ties(records, [v.RUT], F.col("ATRC_FECHA_INICIO"))


def _describe_segment(records: DataFrame) -> DataFrame:
    code = F.col("TATR_CODIGO")
    return records.select(
        *KEY, F.col("DIA_AGNO").alias("FECHA_INICIO"), code.alias("INICIO_SEGMENTO"),
        c.company_label(code).alias("ES_EMPRESA"), c.person_flag(code).alias("ES_PERSONA"),
    )


def _segment_order():
    """Start, then rank, as one value; null where either is missing."""
    day, rank = F.col("ATRC_FECHA_INICIO"), c.segment_rank(F.col("TATR_CODIGO"))
    return F.when(day.isNotNull() & rank.isNotNull(), F.struct(day.alias("day"), rank.alias("rank")))


def segments(taxpayers: DataFrame, history: DataFrame, attributes: DataFrame) -> DataFrame:
    """Current segment: the highest rank among the latest records, equal records kept.

    Latest date first, then rank, is one ordering, so the history is reduced in a single pass, and
    before it meets the taxpayer table.
    """
    records = open_segments(history, attributes)
    best = latest_with_ties(records, [v.RUT], _segment_order())
    dated = best.withColumn("DIA_AGNO", c.packed_date(F.col("ATRC_FECHA_INICIO")))
    return _describe_segment(taxpayers.select(*KEY).join(dated, v.RUT))


def segment_per_taxpayer(
    taxpayers: DataFrame, history: DataFrame, attributes: DataFrame
) -> DataFrame:
    """``segments`` without equal records: aggregation only, one row per taxpayer."""
    records = open_segments(history, attributes)
    best = records.groupBy(v.RUT).agg(F.max(_segment_order()).alias("best")).where("best IS NOT NULL")
    code = c.lookup(F.col("best.rank"), {r: name for name, r in v.SEGMENT_RANK.items()})
    coded = best.select(v.RUT, code.alias("INICIO_SEGMENTO"))
    labelled = coded.select(
        v.RUT, "INICIO_SEGMENTO", c.company_label(F.col("INICIO_SEGMENTO")).alias("ES_EMPRESA"),
        c.person_flag(F.col("INICIO_SEGMENTO")).alias("ES_PERSONA"),
    )
    return taxpayers.select(*KEY).distinct().join(labelled, v.RUT)


# -- alerts ------------------------------------------------------------------


def _watched_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(
        F.col("ALER_COD_TIPO_ALERTA_VO").isin(*v.ALERT_CODES_KEPT)
        & F.col("ALER_FECHA_DESACTIV_VO").isNull()
    )


def active_alerts(alerts: DataFrame) -> DataFrame:
    """Distinct alerts still active, with one code and description for the 400 family."""
    code = F.col("ALER_COD_TIPO_ALERTA_VO")
    text = c.alert_description(code, F.col("ALER_DESC_TIPO_ALERTA_VO"))
    return (
        _watched_alerts(alerts)
        .select(
            *KEY, text.alias("ALER_DESC_TIPO_ALERTA_VO"), "UNOP_UNIDAD_ACTIV", "ALER_FECHA_ACTIV_VO",
            c.alert_family_code(code).alias("ALER_COD_TIPO_ALERTA_VO"),
        )
        .distinct()
    )


def alert_flags(alerts: DataFrame) -> DataFrame:
    """One row per taxpayer with an active alert and a 0/1 column per code.

    The codes are a fixed list, so no job is needed to find them and the schema never varies.
    """
    code = c.alert_family_code(F.col("ALER_COD_TIPO_ALERTA_VO"))
    return (
        _watched_alerts(alerts)
        .groupBy(*KEY)
        .agg(*(F.max((code == k).cast("int")).alias(f"Alerta_{k}") for k in v.ALERT_FLAGS))
    )


# -- business ----------------------------------------------------------------


def latest_business(business: DataFrame) -> DataFrame:
    """Registrations valid from the taxpayer's latest date; ties stay.

    The latest date is taken per id and check digit but matched on the id alone.
    """
    return latest_with_ties(business, KEY, F.col("NEGO_FECHA_VIGENCIA"), match=[v.RUT])


def business_region(business: DataFrame, units: DataFrame) -> DataFrame:
    """Latest registrations with the region in charge; unknown units go, equal rows collapse."""
    unit = units.select("UNOP_UNIDAD", F.col("UNOP_COD_REGIONAL").alias("UNOP_COD_REGIONAL_I"))
    region = c.effective_region(
        F.col("UNOP_UNIDAD"), F.col("UNOP_UNIDAD_GRAN_CONT"), F.col("UNOP_COD_REGIONAL_I")
    )
    return (
        latest_business(business)
        .join(unit, "UNOP_UNIDAD")
        .select(
            *KEY, F.col("UNOP_UNIDAD").alias("UNOP_UNIDAD_I"), "UNOP_UNIDAD_GRAN_CONT", "UNOP_UNIDAD",
            "UNOP_COD_REGIONAL_I", region.alias("UNOP_COD_REGIONAL"), "NEGO_IND_EXPORTADOR_VO",
            "NEGO_IND_PRIMERA_EXP_VO", "NEGO_IND_VERIFICACION_VO", "NEGO_NRO_FACTURAS_6MESES_VO",
        )
        .distinct()
    )


# -- behaviour and activity --------------------------------------------------


def latest_behaviour(behaviour: DataFrame, tiebreak=("COCO_FECHA_CARGA_DW",)) -> DataFrame:
    """The behaviour row of the latest commercial year, one per taxpayer.

    Rows of the same year are ordered by load date, then by every remaining column, so the choice
    never depends on how the data is laid out.
    """
    unit = F.col("UNOP_UNIDAD_GRAN_CONT").alias(v.BEHAVIOUR_UNIT)
    wanted = tables.behaviour(behaviour).columns
    wide = behaviour.select(
        *(unit if name == v.BEHAVIOUR_UNIT else F.col(name) for name in wanted),
        *(F.col(name) for name in tiebreak if name not in wanted),
    )
    rest = [name for name in wanted if name not in (v.RUT, "COCO_AGNO_COMERCIAL")]
    order = [F.desc("COCO_AGNO_COMERCIAL"), *(F.desc(t) for t in tiebreak), *(F.desc(r) for r in rest)]
    known = wide.where(F.col(v.RUT).isNotNull())
    return latest_one(known, [v.RUT], order).select(*wanted)


def principal_activity(
    behaviour: DataFrame, links: DataFrame, activities: DataFrame, period: int = v.INCOME_TAX_PERIOD
) -> DataFrame:
    """Texts of the declared main activity, when the taxpayer is registered for it.

    Links only confirm a declaration, so they are a semi join. Both sides are made distinct on the
    join columns first, which costs no further shuffle and leaves no hot key.
    """
    declared = (
        behaviour.where(F.col("PERI_AGNO_TRIBUTARIO_RENTA") == period)
        .select(*KEY, F.col("ACEC_COD_ACTECO_PRINCIPAL").alias("ACTECO_COD_ACTECO"))
        .distinct()
    )
    valid = links.where(F.col("ACTECO_VIGENCIA") == "S").select(*KEY, "ACTECO_COD_ACTECO").distinct()
    described = activities.select(
        F.col("ACEC_COD_ACTECO").alias("ACTECO_COD_ACTECO"),
        F.col("ACEC_DES_ACTECO").alias("ACEC_DES_ACTECO_PPAL"),
        F.col("ACEC_DES_RUBRO").alias("ACEC_DES_RUBRO_PPAL"),
        F.col("ACEC_DES_SUBRUBRO").alias("ACEC_DES_SUBRUBRO_PPAL"),
    )
    return (
        declared.join(valid, [*KEY, "ACTECO_COD_ACTECO"], "left_semi")
        .join(described, "ACTECO_COD_ACTECO")
        .select(*KEY, *v.ACTIVITY_COLUMNS)
        .distinct()
    )


# -- profile -----------------------------------------------------------------


def _known(df: DataFrame) -> DataFrame:
    return df.where(F.col(v.RUT).isNotNull() & F.col(v.DV).isNotNull())


def merge_profile(
    segment: DataFrame, alerts: DataFrame, business: DataFrame, behaviour: DataFrame,
    activity: DataFrame,
) -> DataFrame:
    """All combinations of the five sources per taxpayer, equal rows collapsed.

    Same rows as a chain of full outer joins, for non-null keys: a spine of all keys is
    left-joined to each source, so keys are shuffled once instead of after every join.
    """
    parts = {
        "segment": (segment, v.SEGMENT_COLUMNS), "alerts": (alerts, v.FLAG_COLUMNS),
        "business": (business, v.BUSINESS_COLUMNS), "behaviour": (behaviour, v.BEHAVIOUR_COLUMNS),
        "activity": (activity, v.ACTIVITY_COLUMNS),
    }
    sides = [_known(df).select(*KEY, *cols).distinct() for df, cols in parts.values()]
    spine = reduce(DataFrame.unionByName, (side.select(*KEY) for side in sides)).distinct()
    merged = reduce(lambda acc, side: acc.join(side, KEY, "left"), sides, spine)
    return merged.select(*v.PROFILE_COLUMNS)


def unambiguous(profile: DataFrame) -> DataFrame:
    """Taxpayers with exactly one profile row."""
    return unique_keys(profile, v.RUT).select(*v.PROFILE_COLUMNS)


def build_profile(
    segment: DataFrame, alerts: DataFrame, business: DataFrame, behaviour: DataFrame,
    activity: DataFrame, ambiguous: str = "discard",
) -> DataFrame:
    """``unambiguous(merge_profile(...))`` without building the rows that would be thrown away.

    Every source row travels as one struct through a single aggregation by taxpayer. A taxpayer is
    unambiguous when it has one check digit and at most one distinct row in each source, which is
    when smallest and largest struct agree. Both are partial aggregates, so neither a taxpayer with
    very many rows nor the product of several such sources ever meets in one task.

    ``ambiguous="largest"`` keeps the other taxpayers too, with the largest check digit and the
    largest row of each source.
    """
    if ambiguous not in ("discard", "largest"):
        raise ValueError(f"ambiguous: {ambiguous!r}")
    parts = {
        "segment": (segment, v.SEGMENT_COLUMNS), "alerts": (alerts, v.FLAG_COLUMNS),
        "business": (business, v.BUSINESS_COLUMNS), "behaviour": (behaviour, v.BEHAVIOUR_COLUMNS),
        "activity": (activity, v.ACTIVITY_COLUMNS),
    }
    tagged = [
        _known(df).select(*KEY, F.struct(*cols).alias(name)) for name, (df, cols) in parts.items()
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    low = [F.min(name).alias(f"_{name}") for name in (v.DV, *SOURCES)]
    high = [F.max(name).alias(name) for name in (v.DV, *SOURCES)]
    kept = rows.groupBy(v.RUT).agg(*high, *low)
    if ambiguous == "discard":
        for name in (v.DV, *SOURCES):
            kept = kept.where(F.col(name).eqNullSafe(F.col(f"_{name}")))
    return kept.select(
        *KEY, *(F.col(f"{name}.{col}").alias(col) for name, (_, cols) in parts.items() for col in cols)
    ).select(*v.PROFILE_COLUMNS)


def profile_sources(source: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The five profile parts, from the warehouse tables by short name."""
    return {
        "segment": segment_per_taxpayer(
            source["taxpayers"], source["attribute_history"], source["attributes"]
        ),
        "alerts": alert_flags(source["alerts"]),
        "business": business_region(source["business"], source["units"]),
        "behaviour": latest_behaviour(source["behaviour"]),
        "activity": principal_activity(
            source["behaviour"], source["activity_links"], source["activities"]
        ),
    }


def profile(source: dict[str, DataFrame]) -> DataFrame:
    """One row per unambiguous taxpayer, from the warehouse tables."""
    return build_profile(**profile_sources(source))
