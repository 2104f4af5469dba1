"""Pages for the extraction queries: forms filled in with given columns, and the
given documents as they are. Every view is stated for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions.dates import ordinal_day
from credence.plans import domain as D

#: The form's short and long month names.
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
FULL_MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")


def _text(x: str, width: int = 0) -> str:
    return f"lpad(CAST({x} AS STRING), {width}, '0')" if width else f"CAST({x} AS STRING)"


def _amount(column: str) -> str:
    return f"CAST(floor(abs({column})) AS BIGINT)"


_C, _P, _S = _amount("c_acctbal"), _amount("p_retailprice"), _amount("s_acctbal")
_KEY = _text("c_custkey", 9)
#: Form -> (table, columns as expressions that both engines read).
COLUMNS = {
    "bir": ("customer", {
        "k": "c_custkey", "ocn": f"'1RC' || {_text('c_custkey', 10)}",
        "tin": f"substr({_KEY}, 1, 3) || '-' || substr({_KEY}, 4, 3) || '-' || substr({_KEY}, 7, 3) || '-' || {_text('c_nationkey', 4)}",
        "registered_name": "c_mktsegment || ' WORKS'",
        "registration_date": f"{_text(f'{_C} % 12 + 1')} || '/' || {_text(f'{_C} % 28 + 1')} || '/' || {_text(f'{_C} % 15 + 2009')}",
        "registered_address": f"'LOT ' || {_text(_C)} || ' ZONE ' || {_text('c_nationkey')}",
        "revenue_region_no": _text("c_nationkey % 19 + 1"), "rdo_code": _text("c_nationkey + 30"),
        "line_of_business": "c_mktsegment || ' GOODS'", "trade_name": "c_mktsegment || ' STORE'",
        "tax_types": "c_mktsegment || ' DUTY, ZONE DUTY'", "revenue_district_officer": "'OFFICER OF ' || c_mktsegment",
        "date_issued": f"substr('{MONTHS}', CAST({_C} % 12 AS INT) * 3 + 1, 3) || ' ' || {_text(f'{_C} % 28 + 1', 2)} || ' ' || {_text(f'{_C} % 15 + 2009')}",
    }),
    "permit": ("supplier", {
        "k": "s_suppkey", "city_issued": f"substr('{MONTHS}', CAST(s_nationkey % 12 AS INT) * 3 + 1, 3) || 'VILLE'",
        "name_of_proprietor": "upper(substr(s_name, 1, 8)) || ' OWNER'", "trade_name": "upper(substr(s_name, 1, 8)) || ' TRADE'",
        "business_location": f"'LOT ' || {_text(_S)} || ' ZONE ' || {_text('s_nationkey')}", "kind_of_business": "'GOODS OF ZONE ' || " + _text("s_nationkey"),
        "day": f"{_S} % 28 + 1", "month": f"{_S} % 12", "year": f"{_S} % 15 + 2009",
    }),
    "dti": ("part", {
        "k": "p_partkey", "business_name": "upper(p_name)", "business_address": f"'LOT ' || {_text('p_size')} || ' ' || p_type",
        "owner_representative_name": "p_type || ' OWNER'",
        "date_issued": f"{_text(f'{_P} % 12 + 1', 2)} || '/' || {_text(f'{_P} % 28 + 1', 2)} || '/' || {_text(f'{_P} % 9 + 2015')}",
        "expiry_date": f"{_text(f'{_P} % 12 + 1', 2)} || '/' || {_text(f'{_P} % 28 + 1', 2)} || '/' || {_text(f'{_P} % 9 + 2020')}",
        "certificate_no": f"'BN ' || {_text('p_partkey + 1000000')}", "trn_no": f"'DTI-' || {_text(f'{_P} % 9 + 2015')} || '-' || {_text('p_partkey', 8)}",
    }),
}
#: Form -> lines of its page: literals, and columns in braces. The captions are those
#: that the field rules look for; what stands around them is made up.
LINES = {
    "bir": ("REPUBLIC OF THE PHILIPPINES", "BUREAU OF INTERNAL REVENUE", "REVENUE REGION NO. {revenue_region_no}", "REVENUE DISTRICT NO. {rdo_code}", "Form No. 2303", "{ocn}", "OCN",
            "CERTIFICATE OF REGISTRATION", "TIN NAME REGISTRATION DATE", "{tin} | {registered_name}  {registration_date}", "REGISTERED ADDRESS", "{registered_address}", "TAX TYPE", "{tax_types}",
            "TRADE NAME", "{trade_name}", "LINE OF BUSINESS / INDUSTRY", "{line_of_business}", "REVENUE DISTRICT OFFICER: {revenue_district_officer}", "Date Issued {date_issued}"),
    "permit": ("Copy kept by the CITY OF {city_issued}", "BUSINESS PERMIT of one year", "{kind_of_business}", "KIND OF BUSINESS", "{business_location}", "BUSINESS LOCATION",
               "{trade_name}.", "TRADE NAME", "{name_of_proprietor}", "NAME OF PROPRIETOR", "Sealed and issued this  {date_issued}, fee paid"),
    "dti": ("TRN: {trn_no}", "Certificate No. {certificate_no}", "Extract from the DEPARTMENT OF TRADE", "The clerk certifies that", "{business_name}", "{business_address}",
            "is a BUSINESS NAME in the books, issued to", "{owner_representative_name}", "Good for use and valid from {date_issued} to {expiry_date}, both days counted"),
}
#: Form -> (template, place of its page ids among three).
TEMPLATES = {"bir": ("bir", 0), "permit": ("business_permit", 1), "dti": ("dti", 2)}
#: Template of a document's own text, by its id.
OWN = ("bir", "business_permit", "dti")


def _parts(line: str) -> list[tuple[bool, str]]:
    """A line as (is a column, text) parts."""
    out = []
    for n, piece in enumerate(line.replace("}", "{").split("{")):
        if piece:
            out.append((n % 2 == 1, piece))
    return out


# --- SQL ------------------------------------------------------------------------
def _form_sql(form: str) -> str:
    source, columns = COLUMNS[form]
    names = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    if form != "permit":
        return f"SELECT {names} FROM {source}"
    months = ", ".join(f"'{m}'" for m in FULL_MONTHS)
    return f"""SELECT *, day || CASE WHEN day BETWEEN 11 AND 13 THEN 'th' WHEN day % 10 = 1 THEN 'st' WHEN day % 10 = 2 THEN 'nd' WHEN day % 10 = 3 THEN 'rd' ELSE 'th' END
        || ' day of ' || [{months}][month + 1] || ' , ' || year AS date_issued FROM (SELECT {names} FROM {source})"""


def _page_sql(form: str) -> str:
    return " || chr(10) || ".join(" || ".join(x if column else f"'{x}'" for column, x in _parts(line)) for line in LINES[form])


def _worn_sql(text: str) -> str:
    """Misread captions and smudges on some pages."""
    text = f"CASE WHEN k % 10 = 0 THEN regexp_replace({text}, '([0-9]{{3}}-[0-9]{{3}}-[0-9]{{2}})[0-9]-[0-9]{{4}}', '\\1') ELSE {text} END"
    text = f"CASE WHEN k % 7 = 0 THEN replace({text}, 'TRADE NAME', 'TRADF NAMF') ELSE {text} END"
    text = f"CASE WHEN k % 11 = 0 THEN replace({text}, 'NAME REGISTRATION', 'NAMF REGISTRAUION') ELSE {text} END"
    return f"CASE WHEN k % 13 = 0 THEN replace({text}, ' WORKS', '|W=RKS') ELSE {text} END"


RECORDS = {
    **{form: _form_sql(form) for form in COLUMNS},
    "sheets": f"SELECT page_id, template, {_worn_sql('raw')} AS text FROM ("
    + " UNION ALL ".join(f"SELECT k, k * 3 + {place} AS page_id, '{template}' AS template, {_page_sql(form)} AS raw FROM {form}" for form, (template, place) in TEMPLATES.items())
    + f""") UNION ALL SELECT -doc_id - 1, ['{"', '".join(OWN)}'][doc_id % 3 + 1], text FROM documents""",
}


# --- Spark ----------------------------------------------------------------------
def records(spark: SparkSession, folder: str, form: str) -> DataFrame:
    """The filled-in columns of a form, one row per row of its table."""
    source, columns = COLUMNS[form]
    rows = D.table(spark, folder, source).selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])
    if form != "permit":
        return rows
    months = F.array(*[F.lit(m) for m in FULL_MONTHS])
    return rows.withColumn("date_issued", F.concat(ordinal_day(F.col("day")), F.lit(" day of "), F.get(months, F.col("month").cast("int")), F.lit(" , "), F.col("year")))


def _page(form: str) -> Column:
    lines = [F.concat(*[F.col(x) if column else F.lit(x) for column, x in _parts(line)]) for line in LINES[form]]
    return F.concat_ws("\n", *lines)


def sheets(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, template and text: one form per customer, supplier and part, worn in
    places, and every given document whole, under negative page ids."""
    parts = []
    for form, (template, place) in TEMPLATES.items():
        parts.append(records(spark, folder, form).select("k", (F.col("k") * 3 + place).alias("page_id"), F.lit(template).alias("template"), _page(form).alias("text")))
    pages = parts[0].unionByName(parts[1]).unionByName(parts[2])
    k = F.col("k")
    for modulus, change in (
            (10, lambda t: F.regexp_replace(t, r"(\d{3}-\d{3}-\d{2})\d-\d{4}", "$1")),
            (7, lambda t: F.replace(t, F.lit("TRADE NAME"), F.lit("TRADF NAMF"))),
            (11, lambda t: F.replace(t, F.lit("NAME REGISTRATION"), F.lit("NAMF REGISTRAUION"))),
            (13, lambda t: F.replace(t, F.lit(" WORKS"), F.lit("|W=RKS")))):
        pages = pages.withColumn("text", F.when(k % modulus == 0, change(F.col("text"))).otherwise(F.col("text")))
    own = D.table(spark, folder, "documents").select((-F.col("doc_id") - 1).alias("page_id"), F.get(F.array(*[F.lit(t) for t in OWN]), (F.col("doc_id") % 3).cast("int")).alias("template"), "text")
    return pages.drop("k").unionByName(own)
