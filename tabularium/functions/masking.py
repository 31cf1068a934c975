"""Masking of personal data: patterns in a fixed order, each on what the ones before have left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.expressions import unused

MASK = "****"

#: Fixed values, in the order that they are applied in.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": r"(?<!\d)(\+?\d[\d\-\s().]{7,}\d)(?!\d)",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,16}\b",
    "IP": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "DOB": r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b",
    "MRN": r"\b(?:MRN[:#]?\s*)?\d{6,10}\b",
}

#: Parts of a column's name that mark the whole column (fixed values).
NAME_HINTS = (
    "name", "patient", "email", "phone", "address", "ssn", "mrn",
    "record", "dob", "birth", "id_number", "national_id", "insurance",
)

IDENTITY = "IDENTITY"
#: Every pattern needs one of these; most texts have none and are passed over.
_ANY = r"(?U)[\d@]"


def _java(label: str) -> str:
    return ("(?iU)" if label == "MRN" else "(?U)") + PATTERNS[label]


def is_hinted(column_name: str) -> bool:
    lowered = column_name.lower()
    return any(hint in lowered for hint in NAME_HINTS)


def mask(text: Column) -> Column:
    """The text with every match of every pattern masked."""
    masked = text
    for name in PATTERNS:
        masked = F.regexp_replace(masked, _java(name), MASK)
    return F.when(text.rlike(_ANY), masked).otherwise(text)


def fired(df: DataFrame, column: str) -> DataFrame:
    """Adds a boolean for each label, whether it fires on the text; rows on whose text none can, and rows without one, are left out.

    The stages are columns of their own, so each text is searched once for each pattern and replaced only where that one fires; ``column`` becomes what they leave.
    In texts of ASCII, as most are, characters' classes need no Unicode.
    """
    text, ascii_ = F.col(column), unused("__ascii", df.columns)
    found = df.where(text.rlike(_ANY)).withColumn(ascii_, F.octet_length(text) == F.length(text))
    for name, pattern in PATTERNS.items():
        plain = ("(?i)" if name == "MRN" else "") + pattern
        found = found.withColumn(name, F.when(F.col(ascii_), text.rlike(plain)).otherwise(text.rlike(_java(name))))
        found = found.withColumn(column, F.when(F.col(name), F.regexp_replace(text, _java(name), MASK)).otherwise(text))
    return found.drop(ascii_)


def hits(text: Column) -> Column:
    """The labels that fire on a text, in the patterns' order; an empty array for null."""
    now, found = text, []
    for name in PATTERNS:
        found.append(F.when(now.rlike(_java(name)), F.lit(name)))
        now = F.regexp_replace(now, _java(name), MASK)
    none = F.array().cast("array<string>")
    return F.when(text.rlike(_ANY), F.array_compact(F.array(*found))).otherwise(none)
