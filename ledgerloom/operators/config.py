"""The dimension tables: fields, output layout, profiles, totals, rules and codes.

All are literals of fixed size, so joins with them may be broadcast. What is known of institutions can be
extended by tables (Config.with_tables) for the plans of one run.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import spaced

#: The first column is the person's number again; by name, `rut` is the fourth.
TAX_ID_AT = 3


@dataclass(frozen=True)
class Column:
    at: int
    header: str
    kind: str
    default: str | int

    @property
    def name(self) -> str:
        """A unique internal name: headers repeat and one is empty."""
        return f"c{self.at:03d}_{self.header.lower()}"


@dataclass(frozen=True)
class Total:
    """A declared total: kind is field, terms, count, any or note."""

    profile: str
    key: str
    kind: str
    plus: tuple[str, ...] = ()
    minus: tuple[str, ...] = ()
    where: str | None = None
    why: str | None = None
    prefix: bool = False

    @property
    def shown(self) -> str:
        """What the comparison is written down as."""
        if self.kind == "count":
            return f"(rut únicos con {self.where})" if self.where else "(rut únicos)"
        if self.kind == "any":
            return " | ".join(self.plus)
        return " ".join([" + ".join(self.plus), *(f"− {m}" for m in self.minus)])


# fixed values: the output layout, in its order: header, kind (N numeric, T text, = always the default), default
_LAYOUT = [
    ("rut", "T", ""),
    ("", "T", ""),
    ("Linea", "N", 0),
    ("rut", "T", ""),
    ("dv", "T", ""),
    ("ape_pat", "T", ""),
    ("ape_mat", "T", ""),
    ("nombres", "T", ""),
    ("sexo", "T", ""),
    ("nacion", "=", "0"),
    ("tipo_pago", "=", "1"),
    ("remu_desde", "T", ""),
    ("remu_hasta", "T", ""),
    ("reg_previ", "T", ""),
    ("tipo_trab", "T", ""),
    ("dias_trab", "N", 0),
    ("tipo_linea", "=", "00"),
    ("cod_mov", "T", ""),
    ("Fecha_Desde", "T", ""),
    ("Fecha_Hasta", "T", ""),
    ("Tramo_Fam", "T", ""),
    ("num_car_sim", "N", 0),
    ("num_car_mat", "N", 0),
    ("num_car_inv", "N", 0),
    ("asig_fam", "N", 0),
    ("asig_fam_ret", "N", 0),
    ("reint_cargas", "N", 0),
    ("sub_trab_jov", "=", "N"),
    ("nom_AFP", "N", 0),
    ("impo_afp", "N", 0),
    ("cot_obli_afp", "N", 0),
    ("aporte_sis", "N", 0),
    ("ahorro_afp", "N", 0),
    ("sust_afp", "N", 0),
    ("tasa_pac_afp", "N", 0),
    ("aporte_indem", "N", 0),
    ("num_per_sust", "N", 0),
    ("per_desde_sust", "T", ""),
    ("per_hasta_sust", "T", ""),
    ("trab_pesado", "T", ""),
    ("porc_trab_pesado", "N", 0),
    ("cot_trab_pesado", "N", 0),
    ("inst_apvi", "N", 0),
    ("num_contra_apvi", "T", ""),
    ("forma_pago_apvi", "N", 0),
    ("cotiza_apvi", "N", 0),
    ("cot_dep_conv", "N", 0),
    ("inst_apvc", "N", 0),
    ("num_contra_apvc", "T", ""),
    ("forma_pago_apvc", "N", 0),
    ("cotiza_apvc", "N", 0),
    ("cot_emp_apvc", "N", 0),
    ("rut_afi_volun", "N", 0),
    ("dv_afi_volun", "T", ""),
    ("ape_pat_volun", "T", ""),
    ("ape_mat_volun", "T", ""),
    ("nombre_volun", "T", ""),
    ("cod_mov_per_volun", "N", 0),
    ("fec_desde_volun", "T", ""),
    ("fec_hasta_volun", "T", ""),
    ("cod_afp_volun", "N", 0),
    ("monto_cap_volun", "N", 0),
    ("monto_aho_vol", "N", 0),
    ("num_per_cotiza", "N", 0),
    ("cod_ex_caja", "N", 0),
    ("tasa_ex_caja", "N", 0),
    ("renta_imp_fonasa", "N", 0),
    ("cot_INP", "N", 0),
    ("Renta_imp_des", "N", 0),
    ("cod_ex_caja_des", "=", "0000"),
    ("tasa_ex_caja_des", "N", 0),
    ("cot_desahucio", "N", 0),
    ("cotiza_fonasa", "N", 0),
    ("cot_acc_trab_inp", "N", 0),
    ("boni_ley", "N", 0),
    ("desc_cargas_fam_inp", "N", 0),
    ("seguro_compl_salud", "N", 0),
    ("cod_inst_salud", "N", 0),
    ("num_FUN_poliza", "T", ""),
    ("impo_isapre", "N", 0),
    ("moneda_plan", "=", "1"),
    ("cot_pactada", "N", 0),
    ("cot_obli_isa", "N", 0),
    ("cot_ad_vol", "N", 0),
    ("tipo_poliza", "N", 0),
    ("cod_CCAF", "N", 0),
    ("impo_ccaf", "N", 0),
    ("Cred_per_CCAF", "N", 0),
    ("Desc_Dental", "N", 0),
    ("desc_leassing", "N", 0),
    ("desc_seg_vida", "N", 0),
    ("otros_desc_ccaf", "N", 0),
    ("cot_CCAF", "N", 0),
    ("Desc_Car_fam", "N", 0),
    ("renta_imp_mes_ant", "N", 0),
    ("tipo_jornada", "=", "1"),
    ("expectativa_vida", "N", 0),
    ("rentabilidad_protegida", "N", 0),
    ("cod_mutual", "N", 0),
    ("impo_mutual", "N", 0),
    ("cotiza_mutual", "N", 0),
    ("sucur_mutual", "N", 0),
    ("Renta_impo_SC", "N", 0),
    ("Aporte_trab_SC", "N", 0),
    ("aporte_emp_SC", "N", 0),
    ("rut_pag_subs", "N", 0),
    ("dv_pag_subs", "T", ""),
    ("centro_costo", "N", 0),
]

# fixed values: canonical fields with their merge rule and output column
FIELDS: dict[str, tuple[str, str | None]] = {
    "rut": ("first", None),
    "nombre": ("longest", None),
    "dias": ("max", "dias_trab"),
    "codMov": ("first", "cod_mov"),
    "fechaDesde": ("earliest", "Fecha_Desde"),
    "fechaHasta": ("latest", "Fecha_Hasta"),
    "tramo": ("first", "Tramo_Fam"),
    "cargasSim": ("max", "num_car_sim"),
    "cargasMat": ("max", "num_car_mat"),
    "cargasInv": ("max", "num_car_inv"),
    "asigFam": ("sum", "asig_fam"),
    "asigFamRetro": ("sum", "asig_fam_ret"),
    "reintCargas": ("sum", "reint_cargas"),
    "rutSubs": ("first", None),
    "impCcaf": ("sum", "impo_ccaf"),
    "cotCcaf": ("sum", "cot_CCAF"),
    "credPersonal": ("sum", "Cred_per_CCAF"),
    "convDental": ("sum", "Desc_Dental"),
    "leasing": ("sum", "desc_leassing"),
    "seguroVida": ("sum", "desc_seg_vida"),
    "otrosCcaf": ("sum", "otros_desc_ccaf"),
    "descCargasCcaf": ("sum", "Desc_Car_fam"),
    "impAfp": ("sum", "impo_afp"),
    "cotObliAfp": ("sum", "cot_obli_afp"),
    "aporteSis": ("sum", "aporte_sis"),
    "ahorroAfp": ("sum", "ahorro_afp"),
    "cotTrabPesado": ("sum", "cot_trab_pesado"),
    "aporteIndem": ("sum", "aporte_indem"),
    "cotizaApvi": ("sum", "cotiza_apvi"),
    "cotizaApvc": ("sum", "cotiza_apvc"),
    "cotEmpApvc": ("sum", "cot_emp_apvc"),
    "cotDepConv": ("sum", "cot_dep_conv"),
    "numContraApvi": ("first", "num_contra_apvi"),
    "trabPesado": ("first", "trab_pesado"),
    "porcTrabPesado": ("max", "porc_trab_pesado"),
    "impTrabPesado": ("sum", None),
    "impFonasa": ("sum", "renta_imp_fonasa"),
    "cotFonasa": ("sum", "cotiza_fonasa"),
    "cotInp": ("sum", "cot_INP"),
    "cotDesahucio": ("sum", "cot_desahucio"),
    "impIsapre": ("sum", "impo_isapre"),
    "cotPactada": ("sum", "cot_pactada"),
    "cotObliIsapre": ("sum", "cot_obli_isa"),
    "cotAdicVol": ("sum", "cot_ad_vol"),
    "numFun": ("first", "num_FUN_poliza"),
    "impMutual": ("sum", "impo_mutual"),
    "cotMutual": ("sum", "cotiza_mutual"),
    "impSC": ("sum", "Renta_impo_SC"),
    "aporteTrabSC": ("sum", "Aporte_trab_SC"),
    "aporteEmpSC": ("sum", "aporte_emp_SC"),
}

# fixed values: printed headings, normalised, and their fields by section; the common ones hold in every section
_LABELS = [
    ("common", "rut", "rut"),
    ("common", "nombre afiliado", "nombre"),
    ("common", "nombre del afiliado", "nombre"),
    ("common", "nombre trabajador", "nombre"),
    ("common", "apellidos y nombres", "nombre"),
    ("common", "dias trab", "dias"),
    ("common", "dias trabajados", "dias"),
    ("common", "movimiento de personal cod", "codMov"),
    ("common", "movimiento de personal codigo", "codMov"),
    ("common", "fecha inicio", "fechaDesde"),
    ("common", "fecha desde", "fechaDesde"),
    ("common", "fecha termino", "fechaHasta"),
    ("common", "fecha hasta", "fechaHasta"),
    ("common", "cod tramo", "tramo"),
    ("common", "codigo tramo", "tramo"),
    ("common", "tramo asignacion familiar", "tramo"),
    ("common", "cantidad de cargas sim", "cargasSim"),
    ("common", "cantidad de cargas invl", "cargasInv"),
    ("common", "cantidad de cargas mat", "cargasMat"),
    ("common", "cargas simples", "cargasSim"),
    ("common", "cargas invalidas", "cargasInv"),
    ("common", "cargas maternales", "cargasMat"),
    ("common", "monto asig fam", "asigFam"),
    ("common", "asignacion familiar", "asigFam"),
    ("common", "pago a f retroactiva", "asigFamRetro"),
    ("common", "asignacion familiar retroactiva", "asigFamRetro"),
    ("common", "reintegro asig fam", "reintCargas"),
    ("common", "reintegro asignacion familiar", "reintCargas"),
    ("common", "rut ent pag subs", "rutSubs"),
    ("common", "rut entidad pagadora de subsidio", "rutSubs"),
    ("ccaf-cotizaciones", "afiliados a isapre", "impCcaf"),
    ("ccaf-cotizaciones", "no afiliados a isapre remuneracion", "impCcaf"),
    ("ccaf-cotizaciones", "no afiliados a isapre cotizacion 4 2", "cotCcaf"),
    ("ccaf-cotizaciones", "cotizacion 4 2", "cotCcaf"),
    ("ccaf-prestaciones", "creditos personales", "credPersonal"),
    ("ccaf-prestaciones", "convenios dentales", "convDental"),
    ("ccaf-prestaciones", "leasing", "leasing"),
    ("ccaf-prestaciones", "seguros de vida", "seguroVida"),
    ("ccaf-prestaciones", "otros", "otrosCcaf"),
    ("afp-cotizaciones", "identificacion del trabajador rut", "rut"),
    ("afp-cotizaciones", "identificacion del trabajador apellido paterno materno nombres", "nombre"),
    ("afp-cotizaciones", "apellido paterno materno nombres", "nombre"),
    ("afp-cotizaciones", "fondo de pensiones remuneracion imponible", "impAfp"),
    ("afp-cotizaciones", "fondo de pensiones cotizacion obligatoria", "cotObliAfp"),
    ("afp-cotizaciones", "fondo de pensiones sis", "aporteSis"),
    ("afp-cotizaciones", "fondo de pensiones cotizacion voluntaria apvi", "cotizaApvi"),
    ("afp-cotizaciones", "fondo de pensiones n contrato apvi", "numContraApvi"),
    ("afp-cotizaciones", "fondo de pensiones deposito convenido", "cotDepConv"),
    ("afp-cotizaciones", "fondo de pensiones dep en cta ahorro", "ahorroAfp"),
    ("afp-cotizaciones", "seguro cesantia remuneracion imponible", "impSC"),
    ("afp-cotizaciones", "seguro cesantia cotizacion afiliado", "aporteTrabSC"),
    ("afp-cotizaciones", "seguro cesantia cotizacion empleador", "aporteEmpSC"),
    ("afp-trabajos-pesados", "identificacion del trabajador rut", "rut"),
    ("afp-trabajos-pesados", "identificacion del trabajador apellido paterno materno nombres", "nombre"),
    ("afp-trabajos-pesados", "apellido paterno materno nombres", "nombre"),
    ("afp-trabajos-pesados", "fondo de pensiones remuneracion imponible", "impTrabPesado"),
    ("afp-trabajos-pesados", "fondo de pensiones puesto de trabajo", "trabPesado"),
    ("afp-trabajos-pesados", "fondo de pensiones cotiz", "porcTrabPesado"),
    ("afp-trabajos-pesados", "fondo de pensiones cotiz trab pesados", "cotTrabPesado"),
    ("fonasa-detalle", "renta imponible", "impFonasa"),
    ("fonasa-detalle", "remuneracion imponible", "impFonasa"),
    ("fonasa-detalle", "cotizacion salud", "cotFonasa"),
    ("fonasa-detalle", "cotizacion fonasa", "cotFonasa"),
    ("fonasa-detalle", "cotizacion 7", "cotFonasa"),
    ("fonasa-detalle", "cotizacion inp", "cotInp"),
    ("fonasa-detalle", "desahucio", "cotDesahucio"),
    ("isapre-detalle", "renta imponible", "impIsapre"),
    ("isapre-detalle", "remuneracion imponible", "impIsapre"),
    ("isapre-detalle", "cotizacion pactada", "cotPactada"),
    ("isapre-detalle", "cotizacion obligatoria", "cotObliIsapre"),
    ("isapre-detalle", "cotizacion legal", "cotObliIsapre"),
    ("isapre-detalle", "cotizacion adicional voluntaria", "cotAdicVol"),
    ("isapre-detalle", "n fun", "numFun"),
    ("isapre-detalle", "numero fun", "numFun"),
    ("isapre-detalle", "fun", "numFun"),
    ("mutual-detalle", "renta imponible", "impMutual"),
    ("mutual-detalle", "remuneracion imponible", "impMutual"),
    ("mutual-detalle", "cotizacion mutual", "cotMutual"),
    ("mutual-detalle", "cotizacion ley 16744", "cotMutual"),
    ("mutual-detalle", "cotizacion accidentes del trabajo", "cotMutual"),
    ("afc-detalle", "renta imponible", "impSC"),
    ("afc-detalle", "remuneracion imponible", "impSC"),
    ("afc-detalle", "aporte trabajador", "aporteTrabSC"),
    ("afc-detalle", "aporte empleador", "aporteEmpSC"),
    ("afc-detalle", "aporte del empleador", "aporteEmpSC"),
]

# fixed values: totals that covers declare, by profile: label, kind and fields; prefix: the label goes on;
# where: only persons with an amount of this field; why: the reason why nothing is compared
_TOTALS = [
    Total("ccaf", "cotizacion no afiliados a isapre", "field", plus=("cotCcaf",)),
    Total("ccaf", "asignacion familiar", "field", plus=("asigFam",)),
    Total("ccaf", "asignacion familiar retroactiva", "field", plus=("asigFamRetro",)),
    Total("ccaf", "reintegros de asignacion familiar", "field", plus=("reintCargas",)),
    Total("ccaf", "creditos personales", "field", plus=("credPersonal",)),
    Total("ccaf", "convenios dentales", "field", plus=("convDental",)),
    Total("ccaf", "leasing", "field", plus=("leasing",)),
    Total("ccaf", "seguros de vida", "field", plus=("seguroVida",)),
    Total("ccaf", "otros", "field", plus=("otrosCcaf",)),
    Total("ccaf", "cotizacion rebajas", "terms", plus=("cotCcaf",), minus=("asigFam", "asigFamRetro")),
    Total("ccaf", "total productos", "terms", plus=("credPersonal", "convDental", "leasing", "seguroVida", "otrosCcaf")),
    Total("ccaf", "total a pagar a la caja de compensacion", "terms", plus=("cotCcaf", "credPersonal", "convDental", "leasing", "seguroVida", "otrosCcaf"), minus=("asigFam", "asigFamRetro"), prefix=True),
    Total("ccaf", "n de afiliados informados", "count"),
    Total("afp", "renta imponible", "field", plus=("impAfp",)),
    Total("afp", "cotizacion obligatoria", "field", plus=("cotObliAfp",)),
    Total("afp", "seguro invalidez y sobrevivencia sis", "field", plus=("aporteSis",)),
    Total("afp", "cotizacion voluntaria apvi", "field", plus=("cotizaApvi",)),
    Total("afp", "deposito convenido", "field", plus=("cotDepConv",)),
    Total("afp", "deposito en cuenta de ahorro", "field", plus=("ahorroAfp",)),
    Total("afp", "aportes de indemnizacion sustitutiva", "field", plus=("aporteIndem",)),
    Total("afp", "cotizacion por trabajos pesados", "field", plus=("cotTrabPesado",)),
    Total("afp", "apv colectivo trabajador", "field", plus=("cotizaApvc",)),
    Total("afp", "apv colectivo empleador", "field", plus=("cotEmpApvc",)),
    Total("afp", "cotizacion afiliados", "field", plus=("aporteTrabSC",)),
    Total("afp", "cotizacion empleador", "field", plus=("aporteEmpSC",)),
    Total("afp", "total a pagar fondo de pensiones", "terms", plus=("cotObliAfp", "aporteSis", "cotizaApvi", "cotDepConv", "ahorroAfp", "aporteIndem", "cotTrabPesado"), prefix=True),
    Total("afp", "total a pagar al fondo de cesantia", "terms", plus=("aporteTrabSC", "aporteEmpSC")),
    Total("afp", "numero afiliados informados", "count"),
    Total("afp", "numero afiliados informados fdo cesantia", "count", where="impSC"),
    Total("afp", "total remuneraciones o gratificaciones", "any", plus=("impAfp", "impSC")),
    Total("afp", "monto capitalizacion voluntaria", "note", why="no hay columna de afiliado voluntario en el detalle"),
    Total("afp", "monto ahorro voluntario", "note", why="no hay columna de afiliado voluntario en el detalle"),
    Total("afp", "numero afiliados apvc", "note", why="no se informa por trabajador en el detalle"),
    Total("afp", "numero afiliados voluntarios", "note", why="no se informa por trabajador en el detalle"),
]

# fixed values: sections, their profile, title pattern, anchors and fields fed by several columns
_SECTIONS = (
    ("ccaf-cotizaciones", "ccaf", r"(?imu)^DETALLE DE PAGO DE COTIZACIONES PREVISIONALES$", ("RUT", "Nombre Afiliado"), ("impCcaf",)),
    ("ccaf-prestaciones", "ccaf", r"(?imu)^DETALLE DE PAGO DE OTRAS PRESTACIONES$", ("RUT", "Nombre Afiliado"), ()),
    ("afp-cotizaciones", "afp", r"(?imu)^DETALLE DE PAGO DE COTIZACIONES PREVISIONALES Y DEPOSITOS.*FONDO DE PENSIONES$", ("RUT",), ()),
    ("afp-trabajos-pesados", "afp", r"(?imu)^DETALLE DE PAGO DE COTIZACIONES PARA TRABAJOS PESADOS$", ("RUT",), ()),
    ("fonasa-detalle", "fonasa", r"(?imu)^DETALLE DE PAGO", ("RUT",), ()),
    ("isapre-detalle", "isapre", r"(?imu)^DETALLE DE PAGO", ("RUT",), ()),
    ("mutual-detalle", "mutual", r"(?imu)^DETALLE DE PAGO", ("RUT",), ()),
    ("afc-detalle", "afc", r"(?imu)^DETALLE DE PAGO", ("RUT",), ()),
)

# fixed values: profiles' names, pension regime, health institution code, fields that no cover can back
_PROFILES = {
    "ccaf": ("Caja de Compensación", None, None, ("impCcaf",)),
    "afp": ("AFP", "AFP", None, ("impTrabPesado",)),
    "fonasa": ("Fonasa", None, 7, ()),
    "isapre": ("Isapre", None, None, ()),
    "mutual": ("Mutual", None, None, ()),
    "afc": ("AFC", None, None, ()),
}

# fixed values: classification rules (profile, scope, weight, pattern)
_RULES = [
    ('ccaf', 'institution', 10, r"(?iu)caja\s+de\s+compensaci[oó]n"),
    ('ccaf', 'cover', 6, r"(?iu)\bC\.?C\.?A\.?F\.?\b"),
    ('ccaf', 'cover', 2, r"(?iu)asignaci[oó]n\s+familiar"),
    ('afp', 'institution', 10, r"(?iu)\bA\.?F\.?P\.?\b"),
    ('afp', 'cover', 4, r"(?iu)fondo\s+de\s+pensiones"),
    ('afp', 'cover', 3, r"seguro\s+invalidez\s+y\s+sobrevivencia|\bSIS\b"),
    ('afp', 'cover', 2, r"(?iu)cotizaci[oó]n\s+obligatoria"),
    ('afc', 'institution', 10, r"(?iu)administradora\s+de\s+fondos\s+de\s+cesant[ií]a"),
    ('afc', 'institution', 6, r"(?iu)\bA\.?F\.?C\.?\b"),
    ('afc', 'cover', 1, r"(?iu)seguro\s+de\s+cesant[ií]a"),
    ('afc', 'institution', -8, r"(?iu)\bA\.?F\.?P\.?\b"),
    ('isapre', 'institution', 10, r"(?iu)\bisapre\b"),
    ('isapre', 'cover', 2, r"(?iu)\bisapre\b"),
    ('isapre', 'institution', 8, r"(?iu)\b(colmena|consalud|cruz\s*blanca|banm[eé]dica|vida\s*tres|nueva\s*masvida)\b"),
    ('isapre', 'institution', 8, r"(?iu)\bisapre\s+esencial\b"),
    ('fonasa', 'cover', 10, r"(?iu)\bfonasa\b|fondo\s+nacional\s+de\s+salud"),
    ('fonasa', 'institution', 8, r"(?iu)instituto\s+de\s+previsi[oó]n\s+social|\bI\.?P\.?S\.?\b"),
    ('mutual', 'institution', 10, r"(?iu)mutual|asociaci[oó]n\s+chilena\s+de\s+seguridad|instituto\s+de\s+seguridad\s+(del\s+trabajo|laboral)"),
    ('mutual', 'institution', 6, r"(?iu)\b(achs|ist|isl)\b"),
]
MARGIN = 4

# fixed values: codes of institutions by normalised name
FUND_CODES = {"los andes": 1, "la araucana": 2, "los heroes": 3, "18 de septiembre": 4, "gabriela mistral": 5}
PENSION_CODES = {"cuprum": 3, "habitat": 5, "provida": 8, "planvital": 29, "plan vital": 29, "capital": 33, "modelo": 34, "uno": 35}

# fixed values: tolerances in points
ROW, BOX_WIDTH, BOX_HEIGHT, BAND, SAME_CELL, ALIGNED = 2.5, 2.0, 1.0, 0.6, 0.2, 0.6
HEADER_HEIGHT, TOUCHING, ANCESTOR_HEIGHT, ANCESTOR_LEVELS, OVERLAP = 48.0, 1.5, 24.0, 3, 0.4
LABEL_ABOVE, LABEL_SIDE, LABEL_ROWS = 24.0, 4.0, 3

# fixed values: printed forms on covers and detail pages
TOTALS_ROW = spaced(r"(?i)TOTALES?\s+ACUMULADOS?")
FOLIO = spaced(r"(?iu)N[úu]mero de Folio:\s*(\S+)")
LABELLED_PERIOD = spaced(r"(?iu)Per[íi]odo\s+de\s+Remuneraciones:?\s*(\d{2}/\d{4})")
EMPLOYER_NAME, EMPLOYER_ID = "nombre o razon social", "rut"
FORM_LABEL = r"(?iu)^(per[íi]odo|n[úu]mero de folio|folio|rut|identificaci[oó]n|direcci[oó]n|nombre o raz[oó]n|tel[eé]fono|comuna)"
FUND_NAME = spaced(r"(?iu)caja\s+de\s+compensaci[oó]n\s+([^\n]+)")
SHORT_FUND = spaced(r"(?iu)caja de compensaci[oó]n\s+(.+)")
PENSION_NAME = spaced(r"(?<![A-Za-z0-9_])(A\.?F\.?P\.?\s+[A-Za-zÁÉÍÓÚÑáéíóúñ]+)")
SUBSIDY = r"^([\d.]+)-([\dkK])$"

# fixed values: months as written out
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")

LAYOUT = [Column(at, header, kind, default) for at, (header, kind, default) in enumerate(_LAYOUT)]
NUMERIC = tuple(f for f, (rule, _) in FIELDS.items() if rule in ("sum", "max"))


def column(header: str) -> Column:
    """The layout's column of a header; the first that has it, but the fourth for `rut`."""
    if header == "rut":
        return LAYOUT[TAX_ID_AT]
    return next(c for c in LAYOUT if c.header and c.header == header)


@dataclass(frozen=True)
class Config:
    """What is known of institutions. profiles: name, pension regime, health code and fields that no cover can back;
    rules: (profile, scope, weight, pattern); sections: profile, title pattern, anchors and fields fed by several
    columns; labels: (section or "common", heading, field); totals that covers declare."""

    profiles: dict[str, tuple]
    rules: list[tuple[str, str, int, str]]
    sections: dict[str, tuple]
    labels: list[tuple[str, str, str]]
    totals: list[Total]

    def checked(self, spark: SparkSession) -> "Config":
        """self, if every name that is used is known and every pattern is one; else a ValueError that lists what isn't."""
        wrong = [f"rule of an unknown profile: {r[0]}" for r in self.rules if r[0] not in self.profiles]
        wrong += [f"rule of an unknown scope: {r[1]}" for r in self.rules if r[1] not in ("cover", "institution")]
        wrong += [f"section {s} of an unknown profile: {spec[0]}" for s, spec in self.sections.items() if spec[0] not in self.profiles]
        wrong += [f"label of an unknown section: {x[0]}" for x in self.labels if x[0] != "common" and x[0] not in self.sections]
        wrong += [f"heading that isn't normal: {x[1]}" for x in self.labels if not normal(x[1])]
        wrong += [f"total of an unknown profile: {t.profile}" for t in self.totals if t.profile not in self.profiles]
        wrong += [f"total of an unknown kind: {t.kind}" for t in self.totals if t.kind not in ("field", "terms", "count", "any", "note")]
        used = [x[2] for x in self.labels] + [f for t in self.totals for f in (*t.plus, *t.minus, *([t.where] if t.where else []))] + [f for *_, own in self.profiles.values() for f in own] + [f for *_, own in self.sections.values() for f in own]
        wrong += [f"unknown field: {f}" for f in dict.fromkeys(used) if f not in FIELDS]
        for pattern in [r[3] for r in self.rules] + [spec[1] for spec in self.sections.values()]:
            try:
                spark._jvm.java.util.regex.Pattern.compile(pattern)
            except Exception:  # noqa: BLE001  whatever the JVM's bridge raises
                wrong.append(f"no pattern: {pattern}")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self

    def with_tables(self, profiles: DataFrame, rules: DataFrame, sections: DataFrame, labels: DataFrame, totals: DataFrame) -> "Config":
        """self and what tables add to it; a profile or section of a known name takes its place.

        profiles(profile, shown, regime, health_code, unbacked), rules(profile, scope, weight, pattern, in order of
        ord), sections(section, profile, title, anchors, additive), labels(section, heading, field),
        totals(profile, key, kind, plus, minus, only, why, prefix, ord). Configuration is small: a few rows for each
        institution come to the driver and end as literals of the plan.
        """
        p = {r["profile"]: (r["shown"], r["regime"], r["health_code"], tuple(r["unbacked"] or ())) for r in profiles.orderBy("profile").collect()}
        s = {r["section"]: (r["profile"], r["title"], tuple(r["anchors"]), tuple(r["additive"] or ())) for r in sections.orderBy("section").collect()}
        more = [(r["profile"], r["scope"], r["weight"], spaced(r["pattern"])) for r in rules.orderBy("ord").collect()]
        heads = [(r["section"], r["heading"], r["field"]) for r in labels.orderBy("section", "heading").collect()]
        declared = [Total(r["profile"], r["key"], r["kind"], tuple(r["plus"] or ()), tuple(r["minus"] or ()), r["only"], r["why"], bool(r["prefix"])) for r in totals.orderBy("ord").collect()]
        return Config(self.profiles | p, self.rules + more, self.sections | s, heads + self.labels, self.totals + declared).checked(profiles.sparkSession)


BASE = Config(_PROFILES, [(profile, scope, weight, spaced(pattern)) for profile, scope, weight, pattern in _RULES], {s[0]: s[1:] for s in _SECTIONS}, _LABELS, _TOTALS)
_current: ContextVar[Config] = ContextVar("config", default=BASE)


@contextmanager
def using(config: Config):
    """Plans that are declared inside are those of this configuration: PROFILES, RULES, SECTIONS, LABELS and TOTALS are its."""
    token = _current.set(config)
    try:
        yield config
    finally:
        _current.reset(token)


def __getattr__(name: str):
    if name in ("PROFILES", "RULES", "SECTIONS", "LABELS", "TOTALS"):
        return getattr(_current.get(), name.lower())
    raise AttributeError(name)


def labels() -> dict[str, dict[str, str]]:
    """Section to key to field: a section's own entries before the common ones."""
    now = _current.get()
    common = {k: f for s, k, f in now.labels if s == "common"}
    return {s: common | {k: f for o, k, f in now.labels if o == s} for s in now.sections}


def fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, rule, f in NUMERIC, col) for f, (rule, col) in FIELDS.items()], "field string, rule string, numeric boolean, output string")


def name_of(total: Total) -> str:
    return f"{total.profile}/{total.key}"


def terms() -> list[tuple[str, str, int, int]]:
    """(name, field, sign, ord) of totals that add fields up or are any of them."""
    return [(name_of(t), f, sign, n) for t in _current.get().totals for sign, part in ((1, t.plus), (-1, t.minus)) for n, f in enumerate(part)]


def excused(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, f) for p, (*_, own) in _current.get().profiles.items() for f in own], "profile string, field string")


def normal(text: str) -> bool:
    return bool(re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", text))
