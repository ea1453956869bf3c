"""Names, codes and labels shared by every module."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Codes, labels and column names of the tax data model.
# ---------------------------------------------------------------------------

RUT, DV = "CONT_RUT", "CONT_DV"

SEGMENT_RANK = {"SGGC": 5, "SGME": 4, "SGPM": 3, "SGMI": 2, "SGPE": 1}

COMPANY_LABEL = {
    "SGGC": "Segmento Grandes Empresas/Contribuyentes",
    "SGME": "Segmento Medianas Empresas",
    "SGPM": "Segmento Pequeñas Empresas",
    "SGMI": "Segmento Micro Empresas",
}
PERSON_CODE = "SGPE"
PERSON, UNDEFINED = "Persona", "indefinido"

ALERT_CODES_KEPT = (
    "4110", "4111", "4112", "4113", "52", "5201", "5203", "53", "5301", "2250", "1019",
    "4001", "4002", "4004", "4005", "4006", "4007",
)
ALERT_FAMILY_PREFIX, ALERT_FAMILY = "400", "400X"
ALERT_FAMILY_RANGE = (4001, 4007)
ALERT_FAMILY_LABEL = "DELITO/QUERELLA"
ALERT_FLAGS = (
    "1019", "2250", "400X", "4110", "4111", "4112", "4113", "52", "5201", "5203", "53", "5301",
)
# the two codes the model leaves out
ALERTS_NOT_MODELLED = ("5201", "5301")

NO_UNIT = "-9999"
LARGE_UNIT_FROM, LARGE_UNIT_BELOW, LARGE_UNIT_REGION = 17000, 18000, 17

INCOME_TAX_PERIOD = 202300
INVOICE = 33

DAWN, MORNING, AFTERNOON, NIGHT = "Madrugada", "Mañana", "Tarde", "Noche"

ALERT_BOTH, ALERT_ISSUER, ALERT_RECEIVER, ALERT_NONE = (
    "Emisor y Receptor", "Solo Emisor", "Solo Receptor", "Sin alerta",
)

YES, NO = "Sí", "No"
UNKNOWN = "Desconocido"

BUSINESS_COLUMNS = (
    "UNOP_UNIDAD_GRAN_CONT", "UNOP_COD_REGIONAL", "NEGO_IND_EXPORTADOR_VO",
    "NEGO_IND_PRIMERA_EXP_VO", "NEGO_IND_VERIFICACION_VO", "NEGO_NRO_FACTURAS_6MESES_VO",
)

BEHAVIOUR_MARKS = (
    "COCO_MCA_1_CATEGORIA", "COCO_MCA_2_CATEGORIA", "COCO_MCA_AFECTO_IMPTO_ADIC",
    "COCO_MCA_AFECTO_IMPTO_UNICO", "COCO_MCA_DOBLE_DECL_F22", "COCO_MCA_DONACIONES_CULTURALES",
    "COCO_MCA_DONACIONES_DEPORTIVAS", "COCO_MCA_DONACIONES_EDUCACIONALES",
    "COCO_MCA_DONACIONES_POLITICAS", "COCO_MCA_DONACIONES_UNIVERSIDAD", "COCO_MCA_ES_EMPRESA",
    "COCO_MCA_ES_GRAN_CONT", "COCO_MCA_ES_MINERA", "COCO_MCA_GLOBAL_COMPLE",
    "COCO_MCA_IMP_PPM_FONDO_MUTUO", "COCO_MCA_IMP_SOC_PROC", "COCO_MCA_SIN_CLAS_IMP",
    "COCO_MCA_TIPO_IMP",
)
BEHAVIOUR_UNIT = "UNIDAD_GRAN_CONTRIBUYENTE_COMPORTAMIENTO"
BEHAVIOUR_COLUMNS = (
    "COCO_IMP_VENTAS_IVA", "COCO_IMP_VENTAS_TRANSPORTE", *BEHAVIOUR_MARKS,
    "COCO_MTO_DEV_SOLICITADA_F22", "COCO_MTO_VENTAS", "TICO_SUB_TPO_CONTR", "TRRE_COD_TMO_RTA",
    "TRVE_COD_TMO_VTA", "COMU_COD_COMUNA_PRINCIPAL", BEHAVIOUR_UNIT,
)

ACTIVITY_COLUMNS = ("ACEC_DES_ACTECO_PPAL", "ACEC_DES_RUBRO_PPAL", "ACEC_DES_SUBRUBRO_PPAL")
SEGMENT_COLUMNS = ("INICIO_SEGMENTO", "ES_EMPRESA", "ES_PERSONA")

DOCUMENT_COLUMNS = (
    "dhdr_folio", "dtdc_codigo", "dhdr_fch_emis", "dhdr_rut_emisor", "dhdr_dv_emisor",
    "dhdr_rut_recep", "dhdr_dv_recep", "dhdr_mnt_total", "dhdr_iva", "dhdr_tmst_firma",
)
DOCUMENT_KEY = ("dhdr_folio", "dhdr_rut_emisor", "dhdr_dv_emisor")
AMOUNT, VAT, EMITTED, SIGNED = "dhdr_mnt_total", "dhdr_iva", "dhdr_fch_emis", "dhdr_tmst_firma"

TIME_COLUMNS = (
    "anio", "mes", "dia", "hora", "es_fin_de_semana", "bloque_horario", "dia_semana", "semana_mes",
)
LEDGER_COLUMNS = ("det_emisor_nota", "det_fch_doc", "det_fec_creacion", "tipo_transaccion")

# numeric profile columns that reach the model, for each party
PARTY_NUMERIC = (
    "COCO_IMP_VENTAS_IVA", "COCO_IMP_VENTAS_TRANSPORTE", "COCO_MTO_DEV_SOLICITADA_F22",
    "COCO_MTO_VENTAS", "NEGO_NRO_FACTURAS_6MESES_VO",
)

# ---------------------------------------------------------------------------
# Lists that follow from the above.
# ---------------------------------------------------------------------------

ISSUER, RECEIVER = "emis_", "recep_"
SEGMENT, SUBSECTOR = "INICIO_SEGMENTO", "ACEC_DES_SUBRUBRO_PPAL"
ROLE_KEY = {
    ISSUER: ("dhdr_rut_emisor", "dhdr_dv_emisor"),
    RECEIVER: ("dhdr_rut_recep", "dhdr_dv_recep"),
}
ROLE_SUFFIX = {ISSUER: "emisor", RECEIVER: "receptor"}

FLAG_COLUMNS = tuple(f"Alerta_{code}" for code in ALERT_FLAGS)
PROFILE_COLUMNS = (
    RUT, DV, *SEGMENT_COLUMNS, *FLAG_COLUMNS, *BUSINESS_COLUMNS, *BEHAVIOUR_COLUMNS, *ACTIVITY_COLUMNS,
)


def stat_columns(role: str) -> tuple[str, ...]:
    """The four amount statistics attached for a role."""
    return tuple(
        f"{fn}_{measure}_{ROLE_SUFFIX[role]}" for measure in (AMOUNT, VAT) for fn in ("avg", "stddev")
    )


def alert_columns(role: str, codes=ALERT_FLAGS) -> tuple[str, ...]:
    return tuple(f"{role}Alerta_{code}" for code in codes)


MODEL_CODES = tuple(code for code in ALERT_FLAGS if code not in ALERTS_NOT_MODELLED)

NUMERIC = (
    AMOUNT, VAT,
    *(f"{role}{name}" for role in (RECEIVER, ISSUER) for name in PARTY_NUMERIC),
    *stat_columns(ISSUER), *stat_columns(RECEIVER),
)
TEXT = ("bloque_horario", *(f"{r}{c}" for r in (ISSUER, RECEIVER) for c in (SEGMENT, SUBSECTOR)))
TIME_FEATURES = ("es_fin_de_semana", "bloque_horario", "dia_semana", "semana_mes")
IMPUTED_TEXT = tuple(name for name in TEXT if name != "bloque_horario")


def _categories(codes) -> tuple[str, ...]:
    party = (
        name
        for role in (ISSUER, RECEIVER)
        for name in (f"{role}{SEGMENT}", f"{role}{SUBSECTOR}", *alert_columns(role, codes))
    )
    return (*TIME_FEATURES, *party)


CATEGORIES_STORED = _categories(ALERT_FLAGS)
CATEGORIES = _categories(MODEL_CODES)
MODEL_ALERTS = (*alert_columns(ISSUER, MODEL_CODES), *alert_columns(RECEIVER, MODEL_CODES))
PASS_THROUGH = tuple(name for name in CATEGORIES if name not in TEXT)

ENRICHED_SAMPLE = (*NUMERIC, *CATEGORIES_STORED, "dhdr_folio")
ENRICHED_FULL = (*ENRICHED_SAMPLE, *(f"{role}{key}" for role in (ISSUER, RECEIVER) for key in (RUT, DV)))
# what the enriched columns take from a profile
ENRICHED_PROFILE = tuple(name for name in PROFILE_COLUMNS if {f"{role}{name}" for role in (ISSUER, RECEIVER)} & set(ENRICHED_FULL))
# folios are numbered by issuer and document type
MODEL_KEY = ("dtdc_codigo", *DOCUMENT_KEY, AMOUNT)
