"""Display formats of the review screens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence.functions.arrays import one_of


def submission_reference(submission_id: Column) -> Column:
    """SUB-00042; longer ids are never cut."""
    return F.format_string("SUB-%05d", submission_id)


def byte_size(size: Column) -> Column:
    """KB with one decimal below 1 MiB, MB with two from there on. Megabytes are taken
    to six decimals before they are rounded half up, as the SQL of the list states: a
    size one byte below such a half is printed as the half."""
    exact = size.cast("decimal(20,0)")  # rounded half up before it is printed
    kb = F.format_number(F.round(exact / F.lit(1024), 1).cast("decimal(20,1)"), 1)
    mb = F.format_number(F.round((size / F.lit(1048576)).cast("decimal(20,6)"), 2).cast("decimal(20,2)"), 2)
    return F.when(size < 1048576, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def preview_kind(mime: Column) -> Column:
    return (F.when(mime.startswith("image/"), "image")
            .when(mime == "application/pdf", "pdf").otherwise("other"))


def money(amount: Column) -> Column:
    """1,234.50"""
    return F.format_number(amount, 2)


def truthy_text(column: Column) -> Column:
    """NULL for the values a falsy-chain skips: NULL, '' and '0'."""
    return F.when(column.isNull() | column.isin("", "0"), None).otherwise(column)


def first_truthy(*columns: Column) -> Column:
    """First non-falsy text, else an em dash."""
    return F.coalesce(*[truthy_text(c) for c in columns], F.lit("—"))


def joined_address(*parts: Column) -> Column:
    """Non-empty parts joined by ', '."""
    kept = F.filter(F.array(*[truthy_text(p) for p in parts]), lambda x: x.isNotNull())
    return F.array_join(kept, ", ")


def initials(name: Column) -> Column:
    """First letters of the first two words."""
    words = F.slice(F.split(name, " "), 1, 2)
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def action_headline(action: Column) -> Column:
    """user.role_changed -> User Role Changed"""
    return F.initcap(F.regexp_replace(action, "[._]", " "))


def activity_icon(action: Column) -> Column:
    return (F.when(action.endswith(".approved"), "check-circle")
            .when(action.endswith(".resubmission_requested"), "arrow-path")
            .when(action.startswith("ml_model."), "cpu-chip")
            .otherwise("bolt"))


# Field-key words shown in capitals, and whole-key labels.
FIELD_ACRONYMS = {"tin": "TIN", "rdo": "RDO", "no": "No", "id": "ID",
                  "ocn": "OCN", "trn": "TRN", "psic": "PSIC"}
FIELD_LABELS = {"trn_no": "TRN", "tax_types": "Registered Activities"}


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def field_label(key: Column) -> Column:
    """registered_name -> Registered Name, keeping acronyms."""
    trimmed = F.trim(key)
    words = F.transform(F.split(trimmed, "_"), lambda w: one_of(w, FIELD_ACRONYMS, upper_first(w)))
    return one_of(trimmed, FIELD_LABELS, F.array_join(words, " "))


_MISSING = "missing_required_fields:"


def humanise_flag(flag: Column) -> Column:
    """Machine token to reader's phrase; prose (has a space) is kept."""
    listed = F.filter(F.split(flag.substr(F.lit(len(_MISSING) + 1), F.length(flag)), ","), lambda k: F.trim(k) != "")
    missing = F.concat(F.lit("Missing required fields: "),
                       F.array_join(F.transform(listed, field_label), ", "))
    return (F.when(flag.contains(" "), flag)
            .when(flag.startswith(_MISSING), missing)
            .otherwise(upper_first(F.regexp_replace(flag, "_", " "))))


# Category by first matching substring, in this order.
FLAG_CATEGORIES = (
    ("tampering", ("tamper",)),
    ("signature_mismatch", ("signature",)),
    ("stamp_mismatch", ("stamp", "logo")),
    ("low_classification", ("classif",)),
    ("text_mismatch", ("text", "ocr", "field")),
)


def flag_category(flag: Column) -> Column:
    needle = F.lower(flag)
    ladder = None
    for category, words in FLAG_CATEGORIES:
        hit = needle.contains(words[0])
        for word in words[1:]:
            hit = hit | needle.contains(word)
        ladder = F.when(hit, category) if ladder is None else ladder.when(hit, category)
    return ladder.otherwise("other")
