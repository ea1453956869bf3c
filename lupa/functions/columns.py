"""Column expressions: classifications, time features, alert folds, reproducible hashing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as v


def lookup(code: Column, mapping: dict) -> Column:
    """``mapping[code]``, null when the code is not listed."""
    result = None
    for key, value in mapping.items():
        hit = code == key
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result


def segment_rank(code: Column) -> Column:
    return lookup(code, v.SEGMENT_RANK)


def company_label(code: Column) -> Column:
    return lookup(code, v.COMPANY_LABEL)


def person_flag(code: Column) -> Column:
    return F.when(code == v.PERSON_CODE, 1)


def taxpayer_class(company: Column, person: Column) -> Column:
    """Company label, else ``Persona``, else ``indefinido``."""
    return F.coalesce(company, F.when(person.isNotNull(), F.lit(v.PERSON)), F.lit(v.UNDEFINED))


def packed_date(date: Column) -> Column:
    """2024-06-10 becomes 20240610."""
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)


def alert_family_code(code: Column) -> Column:
    """Codes starting with 400 count as one code. Codes are text, so this cannot fail under ANSI."""
    return F.when(code.startswith(v.ALERT_FAMILY_PREFIX), v.ALERT_FAMILY).otherwise(code)


def alert_description(code: Column, description: Column) -> Column:
    low, high = v.ALERT_FAMILY_RANGE
    in_family = code.try_cast("int").between(low, high)
    return F.when(in_family, v.ALERT_FAMILY_LABEL).otherwise(description)


def effective_region(unit: Column, large_unit: Column, region: Column) -> Column:
    """Region of a taxpayer; units 17000-17999 mean the large-taxpayer office.

    The large unit wins unless it is null or the "none" mark. A unit that is not a number keeps the
    region of its own unit.
    """
    number = F.coalesce(F.nullif(large_unit, F.lit(v.NO_UNIT)), unit).try_cast("double")
    is_large = (number >= v.LARGE_UNIT_FROM) & (number < v.LARGE_UNIT_BELOW)
    return F.when(is_large, v.LARGE_UNIT_REGION).otherwise(region)


def hour_band(hour: Column) -> Column:
    """Part of the day; a missing hour counts as night."""
    return (
        F.when((hour >= 0) & (hour < 6), v.DAWN)
        .when((hour >= 6) & (hour < 12), v.MORNING)
        .when((hour >= 12) & (hour < 19), v.AFTERNOON)
        .otherwise(v.NIGHT)
    )


def week_of_month(date: Column, whole: bool = False) -> Column:
    """Weeks since the first of the month plus one, with the days as a fraction unless ``whole``."""
    week = (F.dayofmonth(date) - 1) / 7 + 1
    return F.floor(week) if whole else week


def time_features(signed: Column, whole_weeks: bool = False) -> dict[str, Column]:
    """The eight time columns of a document. A missing time gives weekend 0 and band ``Noche``."""
    return {
        "anio": F.year(signed),
        "mes": F.month(signed),
        "dia": F.dayofmonth(signed),
        "hora": F.hour(signed),
        "es_fin_de_semana": F.when(F.dayofweek(signed).isin(1, 7), 1).otherwise(0),
        "bloque_horario": hour_band(F.hour(signed)),
        "dia_semana": F.dayofweek(signed),
        "semana_mes": week_of_month(signed, whole_weeks),
    }


def any_positive(names: Sequence[str]) -> Column:
    """True when any of the flags is set; null flags count as not set."""
    return reduce(Column.__or__, (F.coalesce(F.col(name), F.lit(0)) > 0 for name in names))


def alert_type(issuer: Column, receiver: Column) -> Column:
    return (
        F.when(issuer & receiver, v.ALERT_BOTH)
        .when(issuer, v.ALERT_ISSUER)
        .when(receiver, v.ALERT_RECEIVER)
        .otherwise(v.ALERT_NONE)
    )


def match_flag(key: Column) -> Column:
    return F.when(key.isNotNull(), v.YES).otherwise(v.NO)


def hash01(keys: Sequence[str], seed: int) -> Column:
    """Uniform number in [0, 1) that depends only on the key values and the seed.

    The same rows are therefore sampled whatever the partitioning, and any engine with md5 can
    reproduce the choice. Nulls hash as empty text.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    text = F.concat_ws(":", *parts, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)
