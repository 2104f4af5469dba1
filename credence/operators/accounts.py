"""Users, vendors and notifications: scopes, contracts and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.arrays import compact, flag_if
from credence.functions.formatting import truthy_text
from credence.functions.ids import valid_registration_number, valid_tin


def abandoned(users: DataFrame, now: str, days: int) -> DataFrame:
    """Vendor sign-ups never verified nor enrolled and old enough."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return users.where((F.col("role") == "vendor") & F.col("email_verified_at").isNull()
                       & F.col("signature_enrolled_at").isNull() & (F.col("created_at") <= cutoff))


def without_abandoned(users: DataFrame, now: str, days: int) -> DataFrame:
    """The user table after the prune."""
    return users.join(abandoned(users, now, days).select("user_id"), "user_id", "left_anti")


def unbacked_enrolments(vendors: DataFrame, users: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vendors whose user claims an enrolment that no stored vector supports."""
    claims = users.where(F.col("signature_enrolled_at").isNotNull()).select("user_id", "email", "signature_enrolled_at")
    stored = embeddings.select("vendor_id", "signature_embedding")
    missing = F.col("signature_embedding").isNull() | (F.col("signature_embedding") == "")
    return (vendors.select("vendor_id", "user_id", "company_name").join(claims, "user_id")
            .join(stored, "vendor_id", "left").where(missing)
            .select("vendor_id", "company_name", "user_id", "email", "signature_enrolled_at"))


def clear_enrolments(users: DataFrame, unbacked: DataFrame) -> DataFrame:
    """The user table with unsupported claims withdrawn."""
    marked = unbacked.select("user_id", F.lit(True).alias("_clear"))
    return (users.join(marked, "user_id", "left")
            .withColumn("signature_enrolled_at", F.when(F.col("_clear").isNull(), F.col("signature_enrolled_at")))
            .drop("_clear"))


# Fixed values: (column, required, longest).
PROFILE_RULES = (
    ("company_name", True, 150), ("trade_name", False, 150), ("business_entity_type", True, None), ("tin", True, 20),
    ("dti_registration_number", False, 50), ("sec_registration_number", False, 50), ("business_permit_number", True, 50),
    ("nature_of_business", True, 150), ("business_street", True, 255), ("business_barangay", True, 120), ("business_city", True, 120),
    ("business_province", True, 120), ("business_postal_code", True, 10), ("first_name", True, 100), ("middle_name", False, 100),
    ("last_name", True, 100), ("suffix", False, 20), ("date_of_birth", True, None), ("gender", True, None), ("contact_number", True, 20),
    ("government_id_type", True, None), ("government_id_number", True, 60), ("home_address", True, 500),
)
ENTITY_TYPES = ("sole_proprietorship", "partnership", "corporation")
GENDERS = ("male", "female")
ID_TYPES = ("national_id", "drivers_license", "passport", "umid", "sss_id", "philhealth_id", "postal_id", "prc_id", "voters_id", "tin_id")
NUMBER_NEEDED = {"dti_registration_number": ("sole_proprietorship",),
                 "sec_registration_number": ("partnership", "corporation")}


def profile_faults(today: Column) -> Column:
    """Every violated rule of a declared profile of a business and its
    representative; a birth date lies before ``today``."""
    faults: list[Column] = []
    for name, required, longest in PROFILE_RULES:
        value = F.col(name)
        blank = value.isNull() | (F.trim(value.cast("string")) == "")
        if required:
            faults.append(flag_if(blank, f"{name}:required"))
        if longest:
            faults.append(flag_if(F.length(value) > longest, f"{name}:too_long"))
    entity = F.col("business_entity_type")
    faults.append(flag_if(~entity.isin(*ENTITY_TYPES), "business_entity_type:unknown"))
    faults.append(flag_if(~valid_tin(F.col("tin")), "tin:format"))
    born = F.col("date_of_birth").try_cast("date")
    given = F.trim(F.col("date_of_birth")) != ""
    faults.append(flag_if(given & born.isNull(), "date_of_birth:not_a_date"))
    faults.append(flag_if(born >= today, "date_of_birth:not_before_today"))
    for name, known in (("gender", GENDERS), ("government_id_type", ID_TYPES)):
        faults.append(flag_if((F.trim(name) != "") & ~F.col(name).isin(*known), f"{name}:unknown"))
    for name, entities in NUMBER_NEEDED.items():
        value = truthy_text(F.col(name))
        faults.append(flag_if(entity.isin(*entities) & value.isNull(), f"{name}:required_for_entity"))
        faults.append(flag_if(value.isNotNull() & ~valid_registration_number(value), f"{name}:format"))
    return compact(*faults)


def mark_read(notifications: DataFrame, user_id: int, notification_id: int | None = None) -> DataFrame:
    """Mark one or all of a user's notifications read."""
    target = F.col("user_id") == user_id
    if notification_id is not None:
        target = target & (F.col("notification_id") == notification_id)
    return notifications.withColumn("is_read", F.when(target, True).otherwise(F.col("is_read")))


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"), F.count("*").alias("total"))
