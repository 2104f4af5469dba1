"""Field templates, thresholds, weights, settings and types.

These must equal the published ones for right results, so they are stated here
plainly and together; no logic lives in this file."""

from __future__ import annotations

# --- field templates -------------------------------------------------------
# mode: global = search the whole text; label = text after (or below) a caption;
#       above = line above a caption; header_name, certified_1, certified_2 =
#       the three block rules.
MONTH_DATE = (
    r"(?:JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUN(?:E)?|"
    r"JUL(?:Y)?|AUG(?:UST)?|SEP(?:T(?:EMBER)?)?|OCT(?:OBER)?|NOV(?:EMBER)?|"
    r"DEC(?:EMBER)?)\.?\s+\d{1,2},?\s+(?:19|20)\d{2}"
)
TIN_TOKEN = r"\d{3}\s*[-–]\s*\d{3}\s*[-–]\s*\d{3}\s*[-–]\s*\d{3,4}"
DATE_TOKEN = r"\d{1,2}/\d{1,2}/\d{2,4}"
DAY_OF_MONTH = r"\d{1,2}(?:st|nd|rd|th)?\s+day of\s+[A-Za-z]+\s*,?\s*(?:19|20)\d{2}"
CITY_NAME = r"[A-Z][A-Za-z]+(?:[ \t]+[A-Z][A-Za-z]+)*"

BIR_FIELDS = [
    dict(key="form_no", name="Form No.", mode="global", regex=r"\b(2303)\b", value_regex="2303", required=False),
    dict(key="ocn", name="OCN", mode="global", regex=r"\b(\d[A-Z]{1,3}\d{7,})\b",
         value_regex=r"\d[A-Z]{1,3}\d{7,}", required=True),
    dict(key="tin", name="TIN", mode="global", regex=f"({TIN_TOKEN})",
         value_regex=r"\d{3}-\d{3}-\d{3}-\d{3,4}", required=True),
    dict(key="registered_name", name="Registered Name", mode="header_name", required=True),
    dict(key="registration_date", name="Registration Date", mode="label", labels=["REGISTRATION DATE"],
         regex=f"({DATE_TOKEN})", value_regex=DATE_TOKEN, global_fallback=True, required=True),
    dict(key="registered_address", name="Registered Address", mode="label",
         labels=["REGISTERED ADDRESS"], required=True),
    dict(key="revenue_region_no", name="Revenue Region No.", mode="label",
         labels=["REVENUE REGION NO", "REVENUE REGION"], regex=r"(\d{1,3}[A-Z]?)",
         value_regex=r"\d{1,3}[A-Z]?", same_line=True, required=False),
    dict(key="rdo_code", name="Revenue District No. (RDO)", mode="label",
         labels=["REVENUE DISTRICT NO", "REVENUE DISTRICT", "RDO"], regex=r"(\d{1,3})",
         value_regex=r"\d{1,3}", same_line=True, required=False),
    dict(key="line_of_business", name="Line of Business / PSIC", mode="label",
         labels=["LINE OF BUSINESS", "INDUSTRY"], required=True),
    dict(key="trade_name", name="Trade Name", mode="label", labels=["TRADE NAME"], required=True),
    dict(key="tax_types", name="Registered Activity(ies)", mode="label",
         labels=["REGISTERED ACTIVITIES", "REGISTERED ACTIVITY", "TAX TYPE"], required=True),
    dict(key="revenue_district_officer", name="Revenue District Officer", mode="label",
         labels=["REVENUE DISTRICT OFFICER", "DISTRICT OFFICER"], required=False),
    dict(key="date_issued", name="Date Issued", mode="global", regex=rf"\b({MONTH_DATE})\b",
         value_regex=MONTH_DATE, required=True),
]
PERMIT_FIELDS = [
    dict(key="city_issued", name="City Issued", mode="global", regex=f"CITY OF ({CITY_NAME})",
         value_regex=CITY_NAME, required=True),
    dict(key="name_of_proprietor", name="Name of Proprietor", mode="above",
         labels=["NAME OF PROPRIETOR", "PROPRIETOR"], required=True),
    dict(key="trade_name", name="Trade Name", mode="above", labels=["TRADE NAME"], required=True),
    dict(key="business_location", name="Business Address / Location", mode="above",
         labels=["BUSINESS LOCATION", "BUSINESS ADDRESS", "LOCATION"], required=True),
    dict(key="kind_of_business", name="Kind of Business", mode="above",
         labels=["KIND OF BUSINESS", "NATURE OF BUSINESS"], required=True),
    dict(key="date_issued", name="Issued Date", mode="global", regex=rf"(?i)issued this\s+({DAY_OF_MONTH})",
         value_regex=f"(?i){DAY_OF_MONTH}", required=True),
]
DTI_FIELDS = [
    dict(key="business_name", name="Business Name", mode="certified_1", required=True),
    dict(key="business_address", name="Business Address", mode="certified_2", required=True),
    dict(key="owner_representative_name", name="Owner / Representative Name", mode="label",
         labels=["ISSUED TO"], required=True),
    dict(key="date_issued", name="Valid Date", mode="global", regex=rf"(?i)valid from\s+({DATE_TOKEN})",
         value_regex=DATE_TOKEN, required=True),
    dict(key="expiry_date", name="Expiration Date", mode="global",
         regex=rf"(?i)valid from\s+{DATE_TOKEN}\s+to\s+({DATE_TOKEN})", value_regex=DATE_TOKEN, required=True),
    dict(key="certificate_no", name="Certificate Number", mode="label",
         labels=["CERTIFICATE NO", "CERTIFICATE NUMBER"], regex=r"((?:BN\s*)?\d{5,})",
         value_regex=r"(?:BN\s*)?\d{5,}", same_line=True, required=True),
    dict(key="trn_no", name="TRN", mode="label", labels=["TRN"], regex=r"(DTI-\d{4}-\d+|[A-Z0-9-]{6,})",
         value_regex=r"DTI-\d{4}-\d+|[A-Z0-9-]{6,}", same_line=True, required=True),
]
TEMPLATE_FIELDS = {"bir": BIR_FIELDS, "business_permit": PERMIT_FIELDS, "dti": DTI_FIELDS}
TEMPLATE_KEYWORDS = {
    "bir": ["CERTIFICATE OF REGISTRATION", "BUREAU OF INTERNAL REVENUE", "REGISTERED", "TIN",
            "REVENUE REGION", "REVENUE DISTRICT"],
    "business_permit": ["BUSINESS PERMIT", "PROPRIETOR", "TRADE NAME", "KIND OF BUSINESS", "CITY OF"],
    "dti": ["DEPARTMENT OF TRADE", "BUSINESS NAME", "CERTIFICATE", "TRN"],
}
CERTIFIED_CAPTION = "CERTIFIES THAT"
CERTIFIED_STOP = r"IS A BUSINESS NAME REGISTERED|PURSUANT|IN COMPLIANCE"
HEADER_STOP = r"REGISTERED (ADDRESS|ACTIVIT)"
TYPE_TEMPLATES = {"bir_certificate": "bir", "business_permit": "business_permit", "dti_registration": "dti"}

# --- page quality ----------------------------------------------------------
TEXT_PASS = 0.70
LOW_CONFIDENCE = 60.0
MIN_WORDS = 15
FIELD_CONFIDENCE_FLOOR = 80.0
ROI_CONFIDENCE_FLOOR = 90.0
ROI_BUDGET_SECONDS = 210.0

# --- risk ------------------------------------------------------------------
RISK_WEIGHTS = {"text": 0.20, "classification": 0.20, "signature": 0.20, "stamp": 0.20, "tamper": 0.20}
MISSING_PENALTY = 15.0
HIGH_RISK = 61.0
MEDIUM_RISK = 31.0
TAMPER_HARD = 0.80
TAMPER_FLAG = "Document tampering suspected"
MISSING_FLAGS = {
    "text": "Text validation unavailable",
    "classification": "Classification unavailable",
    "signature": "Signature verification unavailable",
    "stamp": "Stamp verification unavailable",
}
PASS_MARKS = {"text": 0.70, "classification": 0.70, "signature": 0.75, "stamp": 0.85}
SIGNATURE_DISTANCE = 1.243976
STAMP_SIMILARITY = 0.80

# --- forensics -------------------------------------------------------------
TECHNIQUE_WEIGHTS = {"metadata": 0.20, "ela": 0.25, "copy_move": 0.25, "font": 0.15, "cross_reference": 0.15}
HARD_TECHNIQUES = ("metadata", "copy_move")
TAMPER_PASS = 0.50
EDITOR_SIGNATURES = ("photoshop", "gimp", "adobe", "affinity", "pixelmator", "paint.net",
                     "lightroom", "snapseed", "canva", "inkscape", "imagemagick", "krita")
EDITOR_PENALTY, MODIFIED_PENALTY, AFTER_ISSUE_PENALTY = 0.6, 0.3, 0.5
BAD_TIN_PENALTY, NO_TIN_PENALTY, BAD_NUMBER_PENALTY = 0.6, 0.15, 0.4
TIN_STRICT = r"\b(\d{3}-\d{3}-\d{3}(?:-\d{3,5})?)\b"
TIN_LOOSE = r"(?i)\bTIN[:\s]*([\d\- ]{7,20})"
NUMBER_CAPTION = r"(?i)\b(?:Certificate|Registration|Reg\.?)\s*(?:No\.?|Number)[:\s]*([A-Z0-9\-]{6,20})"
FONT_MAD_Z, FONT_MAD_FLOOR, FONT_MIN_LENGTH = 3.5, 0.05, 3
FONT_PEER_TOLERANCE, FONT_MIN_CONFIDENCE, FONT_PENALTY, FONT_MIN_SAMPLES = 0.20, 40.0, 0.30, 6
MAD_SCALE = 1.4826
ELA_BLOCK, ELA_MAD_K, ELA_FLOOR, ELA_MIN_CELLS = 16, 6.0, 10.0, 4
CLONE_MIN_OFFSET, CLONE_BIN, CLONE_MIN_VOTES, CLONE_HAMMING = 16.0, 8, 12, 40
CLONE_PERIODIC, CLONE_DOMINANCE, CLONE_NEIGHBOURS = 3, 2.0, 3

# --- signatures and stamps -------------------------------------------------
ENROL_COUNT, ENROL_CONSISTENCY, ENROL_MAX_SIGNATURES = 3, 0.80, 10
DETECTABLE = ("signature", "stamp", "logo")
DETECTION_ALIASES = {"stamp_seal": "stamp"}
EER_STEPS = 200

# --- intake ----------------------------------------------------------------
ACCEPTED_MIME = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
MAGIC_BYTES = {"application/pdf": "255044462D", "image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF"}
MAX_FILE_MB, MAX_BATCH_MB, MAX_PAGES = 10, 50, 2

# --- document types: (id, name, code, issuer scope) ------------------------
DOCUMENT_TYPES = [
    (1, "BIR Certificate of Registration", "bir_certificate", "national"),
    (2, "SEC Certificate of Registration", "sec_registration", "national"),
    (3, "SEC General Information Sheet", "sec_gis", "national"),
    (4, "DTI Business Name Registration", "dti_registration", "national"),
    (5, "Business Permit", "business_permit", "lgu"),
    (6, "Sanitary Permit", "sanitary_permit", "lgu"),
    (7, "FDA Registration", "fda_registration", "national"),
    (8, "Food Handler Certificate", "food_handler_certificate", "lgu"),
    (9, "Signed Contract", "signed_contract", None),
]

# --- settings: (key, type, min, max, default) ------------------------------
SETTINGS = [
    ("max_file_size_mb", "int", 1, 100, "10"),
    ("max_batch_size_mb", "int", 1, 500, "50"),
    ("accepted_formats", "string", None, None, "pdf,png,jpg,jpeg"),
    ("max_pdf_pages", "int", 1, 20, "2"),
    ("pdf_dpi", "int", 72, 600, "300"),
    ("resize_dimension", "int", 128, 2048, "512"),
    ("binarization_threshold", "int", 0, 255, "150"),
    ("morph_kernel_size", "int", 1, 15, "2"),
    ("classification_confidence_threshold", "float", 0, 1, "0.70"),
    ("yolo_detection_confidence", "float", 0, 1, "0.50"),
    ("signature_distance_threshold", "float", 0, 5, "1.243976"),
    ("stamp_similarity_threshold", "float", 0, 1, "0.80"),
    ("stamp_tamper_threshold", "float", 0, 1, "0.50"),
    ("risk_weight_text", "float", 0, 1, "0.20"),
    ("risk_weight_classification", "float", 0, 1, "0.20"),
    ("risk_weight_signature", "float", 0, 1, "0.20"),
    ("risk_weight_stamp", "float", 0, 1, "0.20"),
    ("risk_weight_tamper", "float", 0, 1, "0.20"),
    ("missing_component_penalty", "int", 0, 100, "15"),
    ("tamper_authenticity_threshold", "float", 0, 1, "0.50"),
    ("tamper_hard_threshold", "float", 0, 1, "0.80"),
    ("tamper_weight_metadata", "float", 0, 1, "0.20"),
    ("tamper_weight_ela", "float", 0, 1, "0.25"),
    ("tamper_weight_copy_move", "float", 0, 1, "0.25"),
    ("tamper_weight_font", "float", 0, 1, "0.15"),
    ("tamper_weight_cross_reference", "float", 0, 1, "0.15"),
    ("high_risk_threshold", "int", 0, 100, "61"),
    ("medium_risk_threshold", "int", 0, 100, "31"),
    ("data_retention_years", "int", 1, 50, "5"),
]
# --- runtime limits checked per attempt: (key, min, max, nullable) ----------
RUNTIME_LIMITS = [
    ("classification_confidence_threshold", 0, 1, False),
    ("yolo_detection_confidence", 0, 1, False),
    ("stamp_similarity_threshold", 0, 1, False),
    ("stamp_tamper_threshold", 0, 1, False),
    ("signature_distance_threshold", 0, None, True),
    ("pdf_dpi", 72, 600, False),
    ("max_pdf_pages", 1, 10, False),
    ("max_file_size_mb", 1, 100, False),
]
# --- retention: (key, data_type, days, archive?, archive days, delete?, delete days, keep unread?)
RETENTION = [
    ("submission_records", "submission", 1825, True, 1095, False, None, False),
    ("uploaded_documents", "document", 1825, True, 730, False, None, False),
    ("audit_logs", "audit", 2555, True, 1460, False, None, False),
    ("notifications", "notification", 365, False, None, True, 365, True),
]
# --- queue -----------------------------------------------------------------
MAX_TRIES, BACKOFF_SECONDS = 3, (10, 30, 60)
