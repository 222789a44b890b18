"""Identity fields: validation, extraction from messages, keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docloom.functions.text import collapse, fold

#: The fields in the order they are asked for, and what is said.
FIELDS = ("full_name", "date_of_birth", "ssn_last4")
PROMPTS = {
    "full_name": "Please share your full name.",
    "date_of_birth": "Please share your date of birth in DD-MM-YYYY format.",
    "ssn_last4": "Please share the last 4 digits of your SSN.",
}
NAME_MISSING = "Full name is required."
NAME_SHORT = "Please provide your full name with at least first and last name."
SSN_MISSING = "SSN last 4 is required."
SSN_WRONG = "Please provide the last 4 digits of your SSN as exactly 4 numbers."
DOB_MISSING = "Date of birth is required."
DOB_WRONG = "Please provide your date of birth in DD-MM-YYYY format."
RESTARTS = (
    r"\bwhere(?: s| is)? my order\b", r"\bwhere(?: s| is)? my package\b", r"\btrack(?:ing)?(?: my)? order\b", r"\btrack(?:ing)?(?: my)? package\b",
    r"\bcheck(?:ing)?(?: my)? order(?: status)?\b", r"\bcheck(?:ing)?(?: my)? shipment(?: status)?\b", r"\border status\b", r"\bshipment status\b", r"\bdelivery status\b",
)
#: How a message tells a field.
NAME_TOLD, NAME_BARE = r"(?i)(?:my name is|i am|this is)\s+([A-Za-z]+(?:\s+[A-Za-z]+)+)", r"^([A-Za-z]+(?:\s+[A-Za-z]+)+)$"
BIRTH_TOLD, ISO_TOLD = r"\b([0-9]{2}-[0-9]{2}-[0-9]{4})\b", r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"
SSN_BARE, SSN_TOLD = r"^\s*([0-9]{4})\s*$", r"(?i)(?:ssn|last\s*4|last\s*four)[^0-9]*([0-9]{4})"


def _verdict(error: Column, value: Column) -> Column:
    return F.struct(error.isNull().alias("is_valid"), F.when(error.isNull(), value).alias("normalized_value"), error.alias("error_message"))


def full_name(value: Column) -> Column:
    clean = collapse(value)
    error = F.when(value.isNull() | (clean == ""), NAME_MISSING).when(F.size(F.split(clean, " ")) < 2, NAME_SHORT)
    return _verdict(error, clean)


def ssn_last4(value: Column) -> Column:
    clean = F.trim(value)
    return _verdict(F.when(value.isNull(), SSN_MISSING).when(~clean.rlike(r"^[0-9]{4}$"), SSN_WRONG), clean)


def iso_date(value: Column) -> Column:
    """DD-MM-YYYY as YYYY-MM-DD; null if there is no such day."""
    parts = [F.regexp_extract(F.trim(value), r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$", i) for i in (3, 2, 1)]
    return F.date_format(F.try_to_date(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def date_of_birth(value: Column) -> Column:
    iso = iso_date(value)
    return _verdict(F.when(value.isNull(), DOB_MISSING).when(iso.isNull(), DOB_WRONG), iso)


def find_name(message: Column) -> Column:
    """After an introduction, or a message that is nothing but words."""
    told = F.regexp_extract(message, NAME_TOLD, 1)
    return F.nullif(F.trim(F.when(told != "", told).otherwise(F.regexp_extract(message, NAME_BARE, 1))), F.lit(""))


def find_birth_date(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, BIRTH_TOLD, 1), F.lit(""))


def find_ssn_last4(message: Column) -> Column:
    bare = F.regexp_extract(message, SSN_BARE, 1)
    return F.nullif(F.when(bare != "", bare).otherwise(F.regexp_extract(message, SSN_TOLD, 1)), F.lit(""))


def customer_ref(name: Column, birth: Column, last4: Column) -> Column:
    return F.concat(F.lit("CUSTOMER#"), fold(collapse(name)), F.lit("#"), birth, F.lit("#"), last4)
