"""Semantic column types: how they are recognised and what their values must satisfy."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER = r"^\s*[+-]?\d{1,18}\s*$"


@dataclass(frozen=True)
class Domain:
    """``names`` match column names, ``keywords`` match descriptions, ``sample`` matches values.

    The remaining fields are the rules a value of the domain must satisfy.
    """

    name: str
    names: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    sample: str | None = None
    regex: str | None = None
    values: tuple[str, ...] = ()
    length: tuple[int, int] | None = None
    bounds: tuple[float, float] | None = None
    base_type: str | None = None
    severity: str = "warning"

    @property
    def has_rules(self) -> bool:
        return bool(self.regex or self.values or self.length or self.bounds or self.base_type)


# Postal codes of US states and territories.
US_STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID",
    "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS",
    "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK",
    "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV",
    "WI", "WY", "DC", "PR", "VI", "GU", "AS", "MP",
)
# The domain registry, with the names, keywords, patterns and rules it is known by.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
ZIP = r"^\d{5}$|^\d{5}-\d{4}$"
PLAN = r"^[A-Z_]+_(MEDICAID|MEDICARE|MARKETPLACE|DUALS)$"
VENDOR = r"^[A-Z][A-Z0-9]*(-[A-Z]+)*$"
DOMAINS = (
    Domain("unmapped"),
    Domain(
        "us_state_code",
        ("state", "statecd", "state_cd", "mbr_st", "mbrst", "state_code"),
        ("state code", "state abbreviation", "us state", "member state"),
        r"^[A-Z]{2}$",
        values=US_STATES,
        severity="critical",
    ),
    Domain(
        "zip_code",
        ("zip", "zipcode", "zip_code", "postal_code", "zip5", "zip9"),
        ("zip code", "postal code", "zip"),
        ZIP,
        regex=ZIP,
    ),
    Domain(
        "email",
        ("email", "email_address", "email_addr", "mail", "emailaddress"),
        ("email", "email address", "mail address"),
        EMAIL,
        regex=EMAIL,
    ),
    Domain(
        "npi",
        ("npi", "provider_npi", "provider_id", "npi_number"),
        ("npi", "national provider identifier"),
        r"^\d{10}$",
        regex=r"^\d{10}$",
        severity="critical",
    ),
    Domain(
        "loinc_code",
        ("loinc", "loinc_code", "lab_code"),
        ("loinc",),
        r"^\d{1,7}-\d$",
        regex=r"^\d{1,7}-\d$",
    ),
    Domain(
        "member_id",
        ("memberid", "member_id", "clientmemberid", "client_member_id", "mbr_id", "mbrid"),
        ("member id", "enrollee id", "client member"),
        r"^[A-Z]{2,}\d+$",
        regex=r"^(?=[A-Z]{2,}[0-9]*$)[A-Z0-9]{2,20}$",
        severity="critical",
    ),
    Domain(
        "lob",
        ("lob", "line_of_business", "pbptype", "pbp_type", "plan_type", "coverage_type"),
        ("line of business", "lob", "plan type", "coverage type"),
        r"^(MEDICAID|MEDICARE|MARKETPLACE|DUALS|MD|ME|MP)$",
        values=("MEDICAID", "MEDICARE", "MARKETPLACE", "DUALS", "MD", "ME", "MP"),
        severity="critical",
    ),
    Domain(
        "gender",
        ("gender", "sex", "gender_code", "sex_code"),
        ("gender", "sex", "biological sex"),
        r"^[MFUN]$",
        values=("M", "F", "U", "N"),
    ),
    Domain(
        "birth_date",
        ("birth_date", "birthdate", "dob", "date_of_birth", "birth_dt", "birth_date_time"),
        ("birth date", "date of birth", "dob"),
        base_type="DATE",
        severity="critical",
    ),
    Domain(
        "service_date",
        ("service_date", "service_dt", "encounter_date", "visit_date", "claim_date"),
        ("service date", "encounter date", "visit date", "claim date"),
        base_type="DATE",
    ),
    Domain(
        "address_line_1",
        ("address", "address_line_1", "address_line1", "addr_line1", "street_address"),
        ("address line 1", "street address", "address"),
        length=(1, 100),
    ),
    Domain(
        "calendar_year",
        ("calendar_year", "year", "cal_year"),
        ("calendar year", "year"),
        r"^\d{4}$",
        bounds=(1900, 2100),
        base_type="INTEGER",
    ),
    Domain("city", ("city", "city_name"), ("city",), length=(1, 50)),
    Domain(
        "timestamp",
        ("timestamp", "datetime", "created_at", "updated_at", "datetime_utc"),
        ("timestamp", "datetime"),
        base_type="TIMESTAMP",
    ),
    Domain(
        "ranking_tier",
        ("rank", "tier", "risk_tier", "total_rank", "totalrank", "priority_tier"),
        ("rank", "tier", "risk tier", "priority"),
        r"^\d{1,2}$",
        values=("1", "2", "3", "4", "5", "6", "99", "100", "115"),
    ),
    Domain(
        "claim_status",
        ("status", "claim_status", "paid_status", "payment_status", "claim_state", "disposition"),
        ("claim status", "payment status", "paid status", "disposition"),
        r"^(PAID|DENIED|PENDED|SET-TO-PAY|VOIDED)$",
        values=("PAID", "DENIED", "PENDED", "SET-TO-PAY", "VOIDED"),
    ),
    Domain(
        "population_type",
        ("population", "populationtype", "population_type", "population_cd", "pop_type"),
        ("population type", "population", "population code"),
        r"^[A-Z]{2}$|^[A-Za-z\s]+$",
        values=(
            "AA", "AC", "DA", "DC", "MA", "MC", "CA", "CC", "Adult", "Child", "Infant",
            "Acute Adult", "Acute Child", "Disabled Adult", "Disabled Child",
        ),
    ),
    Domain(
        "reporting_population",
        ("rptpop", "reporting_population", "h_contract", "hcontract", "contract", "report_pop"),
        ("reporting population", "h-contract", "report pop"),
        r"^(HMO|H\d{4})$",
        regex=r"^(HMO|H\d{4})$",
    ),
    Domain(
        "project_code",
        ("project", "project_code", "proj_code", "mattr", "vendor_code", "assignment"),
        ("project code", "project", "vendor code", "assignment"),
        r"^[A-Z0-9]",
        length=(1, 50),
    ),
    Domain(
        "project_number",
        ("project", "project_number", "proj_num", "project_id"),
        ("project number", "project id"),
        r"^\d+$",
        base_type="INTEGER",
    ),
    Domain(
        "vendor_identifier",
        ("vendor", "vendor_id", "vendor_name", "vendor_code", "outreach_vendor"),
        ("vendor", "outreach vendor", "vendor assignment"),
        VENDOR,
        regex=VENDOR,
    ),
    Domain(
        "plan_description",
        ("plan_description", "plandesc", "plandt", "plan_desc", "plan_name"),
        ("plan description", "plan"),
        PLAN,
        regex=PLAN,
    ),
    Domain(
        "amisys_member_id",
        ("clientmemberid", "client_member_id", "amisys_id", "amisys_member_id"),
        ("amisys", "client member", "amisys member id"),
        r"^[A-Z]{2}\d{11}$",
        regex=r"^[A-Z]{2}\d{11}$",
        severity="critical",
    ),
    Domain(
        "ndc_code",
        ("ndc", "ndc_code", "national_drug_code", "drug_code"),
        ("national drug code", "ndc", "drug code"),
        r"^\d{10,11}$",
        regex=r"^\d{10,11}$",
    ),
    Domain(
        "drg_code",
        ("drg", "drg_code", "diagnosis_related_group"),
        ("drg", "diagnosis related group"),
        r"^\d{3}$",
        regex=r"^\d{3}$",
    ),
    Domain(
        "revenue_code",
        ("revenue_code", "revenue_cd", "rev_code"),
        ("revenue code", "revenue"),
        r"^\d{4}$",
        regex=r"^\d{4}$",
    ),
    Domain(
        "bill_type_code",
        ("bill_type", "billtype", "bill_type_code"),
        ("bill type", "ub-04", "ub04"),
        r"^\d{3}$",
        regex=r"^\d{3}$",
    ),
    Domain(
        "place_of_service",
        ("pos", "place_of_service", "pos_code"),
        ("place of service", "pos"),
        r"^\d{2}$",
        regex=r"^\d{2}$",
    ),
    Domain(
        "tax_id",
        ("tin", "tax_id", "ein", "employer_id"),
        ("tax id", "tin", "ein"),
        r"^\d{9}$",
        regex=r"^\d{9}$",
    ),
    Domain(
        "modifier_code",
        ("modifier", "proc_modifier", "procedure_modifier"),
        ("modifier", "procedure modifier"),
        r"^[A-Z0-9]{2}$",
        regex=r"^[A-Z0-9]{2}$",
    ),
    Domain(
        "claim_number",
        ("claim_nbr", "claim_number", "claim_id"),
        ("claim number", "claim id"),
        r"^[A-Z0-9]+$",
        length=(1, 80),
    ),
    Domain(
        "phone_number",
        ("phone", "phone_number", "telephone", "cell_phone", "mobile"),
        ("phone", "telephone", "mobile"),
        r"^\d{10}$",
        regex=r"^\d{10}$|^\d{3}-\d{3}-\d{4}$|^\(\d{3}\)\s?\d{3}-\d{4}$",
    ),
    Domain(
        "person_first_name",
        ("first_name", "firstname", "fname", "given_name", "member_first_name"),
        ("first name", "given name"),
        r"^[A-Za-z]",
        length=(1, 50),
    ),
    Domain(
        "person_last_name",
        ("last_name", "lastname", "lname", "surname", "family_name", "member_last_name"),
        ("last name", "surname", "family name"),
        r"^[A-Za-z]",
        length=(1, 50),
    ),
    Domain("us_county", ("county", "county_name"), ("county",), r"^[A-Za-z]", length=(1, 50)),
    Domain(
        "yes_no_flag",
        ("_flag", "_ind", "_indicator"),
        ("yes or no", "y/n"),
        r"^[YN]$",
        values=("Y", "N"),
    ),
    Domain(
        "boolean_flag",
        ("_flag", "_ind", "_indicator", "is_", "has_"),
        ("boolean", "true/false"),
        r"^[01]$|^(true|false)$",
        values=("0", "1", "true", "false"),
    ),
    Domain(
        "service_type",
        ("service_type", "assessment_type"),
        ("service type", "assessment type"),
        r"^(IHA|TEL|AUD|RET)$",
        values=("IHA", "TEL", "AUD", "RET"),
    ),
    Domain(
        "schedule_type",
        ("schedule_type", "scheduling_type"),
        ("schedule type", "scheduling channel"),
        r"^(TEL|POR)$",
        values=("TEL", "POR"),
    ),
    Domain(
        "load_mode",
        ("load_mode", "file_mode", "source_load_mode"),
        ("load mode", "file mode"),
        r"^[IRAU]$",
        values=("I", "R", "A", "U"),
    ),
    Domain(
        "visit_count",
        ("visit_count", "vap_visit_count", "er_visit_count", "encounter_count"),
        ("visit count", "er visits", "encounter count"),
        r"^\d+$",
        bounds=(0, 100),
        base_type="INTEGER",
    ),
)
BY_NAME = {d.name: d for d in DOMAINS}

# Abbreviations in column names and what they stand for.
ABBREVIATIONS = {
    "mbr": ("member",),
    "dt": ("date",),
    "cd": ("code",),
    "desc": ("description",),
    "amt": ("amount",),
    "qty": ("quantity",),
    "num": ("number",),
    "addr": ("address",),
    "prov": ("provider",),
    "clm": ("claim",),
    "svc": ("service",),
    "diag": ("diagnosis",),
    "proc": ("procedure",),
    "id": ("identifier", "id"),
    "nm": ("name",),
    "tp": ("type",),
    "st": ("state", "status"),
    "ct": ("count",),
}
# Weights of the three signals and the share of values that counts as a match.
NAME_WEIGHT, TEXT_WEIGHT, VALUE_WEIGHT = 0.6, 0.2, 0.2
VALUE_SHARE = 0.7

# Which column types may carry a domain that expects a base type.
COMPATIBLE = {
    "DATE": ("DATE", "TIMESTAMP"),
    "TIMESTAMP": ("TIMESTAMP",),
    "INTEGER": ("INTEGER", "INT", "LONG"),
    "STRING": ("STRING", "CHAR", "VARCHAR", "TEXT"),
    "BOOLEAN": ("BOOLEAN",),
}


def spellings(name: str) -> set[str]:
    """The column name with every combination of its abbreviations written out."""
    words = name.lower().split("_")
    options = [(w, *ABBREVIATIONS.get(w, ())) for w in words]
    return {name.lower()} | {"_".join(combo) for combo in itertools.product(*options)}


def name_matches(domain: Domain, column: str) -> bool:
    """A known name is contained in, or is a word of, some spelling of the column name."""
    return any(known in spelling for spelling in spellings(column) for known in domain.names)


def text_matches(domain: Domain, description: str | None) -> bool:
    return bool(description) and any(k in description.lower() for k in domain.keywords)


def type_fits(domain: Domain, column_type: str) -> bool:
    if domain.base_type is None:
        return True
    kind = column_type.upper().removesuffix("TYPE")
    return kind in COMPATIBLE.get(domain.base_type, (domain.base_type,))


def _type_rule(base_type: str, dtype: T.DataType) -> bool:
    families = {
        "DATE": (T.DateType,),
        "TIMESTAMP": (T.TimestampType, T.TimestampNTZType),
        "INTEGER": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
        "STRING": (T.StringType,),
        "BOOLEAN": (T.BooleanType,),
    }
    return isinstance(dtype, families.get(base_type, ()))


def breaks_domain(c: Column, dtype: T.DataType, domain: Domain) -> Column:
    """True where a non-null value breaks some rule of the domain.

    Text columns are judged by their text: a declared base type then means the text can be cast.
    """
    text = c.cast("string")
    broken = F.lit(False)
    if domain.regex:
        anchored = domain.regex if domain.regex.startswith("^") else f"^(?:{domain.regex})"
        broken = broken | ~text.rlike(anchored)
    if domain.values:
        broken = broken | ~text.isin(*domain.values)
    if domain.length:
        broken = broken | ~F.length(text).between(*domain.length)
    if domain.bounds:
        number = F.when(text.rlike(NUMBER), text).try_cast("double")
        broken = broken | ~F.coalesce(number.between(*domain.bounds), F.lit(False))
    if domain.base_type and not _type_rule(domain.base_type, dtype):
        if isinstance(dtype, T.StringType) and domain.base_type == "INTEGER":
            broken = broken | ~text.rlike(INTEGER)
        else:
            broken = F.lit(True)
    return broken
