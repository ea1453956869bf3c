"""How some result columns are shown, so that both engines' clients print them alike.

Dates appear as timestamps and whole numbers that can be missing as doubles: clients disagree on
how to hold a missing integer.
"""

from __future__ import annotations

from lupa import vocab as v

_INVOICE_QUERIES = (
    "invoice_scan", "invoices_last_3_months", "invoices_last_14_days", "invoices_with_party_statistics",
    "invoice_time_features", "featured_invoices_last_3_months", "featured_invoices_last_14_days",
    "issuer_stratified_sample", "receiver_stratified_sample", "test_rows_of_split", "cession_link",
    "times_ceded", "ledger_match", "invoices_within_fences", "invoices_last_14_days_by_month", "equalised_sample",
)
DATES = {
    **{name: [v.EMITTED] for name in _INVOICE_QUERIES},
    "ledger_match": [v.EMITTED, "det_fch_doc", "det_fec_creacion"],
    "current_attributes": ["ATRC_FECHA_INICIO"], "latest_attributes": ["ATRC_FECHA_INICIO"],
    "active_alerts": ["ALER_FECHA_ACTIV_VO"],
    "latest_business": ["NEGO_FECHA_VIGENCIA"], "catalog_table_scan": ["NEGO_FECHA_VIGENCIA"],
}

_PROFILE = ["ES_PERSONA", *v.FLAG_COLUMNS, "UNOP_COD_REGIONAL", "NEGO_NRO_FACTURAS_6MESES_VO"]
_ENRICHED = [
    name
    for role in (v.ISSUER, v.RECEIVER)
    for name in (*v.alert_columns(role), f"{role}NEGO_NRO_FACTURAS_6MESES_VO")
]
DOUBLES = {
    "current_segment": ["ES_PERSONA"], "segment_kind_counts": ["ES_PERSONA"],
    "profile_all_rows": _PROFILE, "taxpayer_profile": _PROFILE, "unambiguous_profile": _PROFILE,
    "enriched_sample": _ENRICHED, "enriched_invoices": _ENRICHED,
    "enriched_invoices_by_parties": _ENRICHED,
    "enriched_invoices_all_dates": _ENRICHED, "cession_link": ["rdoc_folio", "rdoc_codigo"],
}
