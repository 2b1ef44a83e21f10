"""Names, composite keys, feature families and message triage."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Triage rules, tried in this order on the message.
# (One more alternative, an organisation's name, is left to the ``sensitive`` argument.)
SENSITIVE_PATTERN = r"(?i)(aadhaar|aadhar|id\s*number|enrol(?:l)?ment\s*id|\b\d{10,12}\b)"
EXPORT_PATTERN = r"(export|download|dump|csv|excel|all\s+districts|full\s+table|show\s+all)"
OVER_CAPACITY_WORDS = (
    "over capacity", "over-capacity", "overcapacity", "capacity gap", "gap", "exceeding capacity",
    "highest demand", "top states", "top districts", "which states", "which districts",
)
SIMULATION_WORDS = (
    "extra centre", "extra center", "extra centres", "extra centers", "add centre", "add center",
    "add centres", "add centers", "camp", "camps", "if we add", "what if", "simulate", "simulation",
    "impact of adding",
)
EXPLAIN_WORDS = ("explain", "what does", "how is", "meaning of", "define", "dashboard")
MONTH_PATTERN = r"\b(20[2-9]\d)-(0[1-9]|1[0-2])\b"
NUMBER_PATTERN = r"\b\d+\b"

# Name fragments of the feature families, first match wins.
FEATURE_FAMILIES = (
    ("lag", ("lag_", "_prev_")),
    ("rolling", ("rolling_", "roll_")),
    ("holiday", ("holiday", "festival", "exam", "monsoon", "harvest")),
    ("policy", ("policy", "campaign", "phase", "fy_")),
    ("demographics", ("age_", "demo_", "bio_", "enrolment")),
    ("calendar", ("month", "year", "quarter", "sin", "cos")),
)


def _any_word(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def trimmed(col: str) -> Column:
    return F.trim(col)


def composite_key(*cols: str) -> Column:
    return F.concat_ws("_", *cols)


def name_contains(col: str, part: Column) -> Column:
    """Case-insensitive literal containment."""
    return F.contains(F.lower(col), F.lower(part))


def feature_family(name: str) -> Column:
    text = F.lower(name)
    ladder = None
    for family, parts in FEATURE_FAMILIES:
        hit = _any_word(text, parts)
        ladder = F.when(hit, family) if ladder is None else ladder.when(hit, family)
    return ladder.otherwise("other")


def intent(message: str, sensitive: str = SENSITIVE_PATTERN) -> Column:
    """Class of a message: safety rules first, then topics."""
    raw, text = F.col(message), F.lower(message)
    return (
        F.when(raw.rlike(sensitive), "unsafe_personal")
        .when(text.rlike(EXPORT_PATTERN), "raw_export")
        .when(_any_word(text, OVER_CAPACITY_WORDS), "over_capacity")
        .when(_any_word(text, SIMULATION_WORDS), "simulate")
        .when(_any_word(text, EXPLAIN_WORDS), "explain_dashboard")
        .otherwise("unsupported")
    )


def _first(message: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(message, pattern, 0), F.lit(""))


def first_month(message: str) -> Column:
    return _first(message, MONTH_PATTERN)


def first_count(message: str) -> Column:
    """First whole number of the message, at least 1."""
    n = _first(message, NUMBER_PATTERN).try_cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.coalesce(n, F.lit(1).cast("bigint")))


def first_region(message: str, regions: Sequence[str]) -> Column:
    """First name of the (short) list that the message contains."""
    names = F.array(*[F.lit(r) for r in regions])
    found = F.filter(names, lambda r: F.contains(F.lower(message), F.lower(r)))
    return F.get(found, F.lit(0))


def triage(df: DataFrame, message: str, regions: Sequence[str], sensitive: str = SENSITIVE_PATTERN) -> DataFrame:
    return df.withColumns(
        {
            "intent": intent(message, sensitive),
            "asked_month": first_month(message),
            "asked_camps": first_count(message),
            "asked_region": first_region(message, regions),
        }
    )


def canonical_names(df: DataFrame, col: str, mapping: Mapping[str, str], out: str = "canonical") -> DataFrame:
    """Upper-case, trim and collapse blanks, then replace known variants.

    The variant list is a parameter of the caller and travels as a map literal in the plan.
    """
    clean = F.regexp_replace(F.trim(F.upper(col)), r"\s+", " ")
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, clean).withColumn(out, F.coalesce(F.try_element_at(pairs, F.col(out)), F.col(out)))


def name_change_report(df: DataFrame, col: str, out: str = "canonical") -> DataFrame:
    """Every spelling that was changed, what it became, and how many rows it touched."""
    return df.where(F.col(col) != F.col(out)).groupBy(col, out).agg(F.count(F.lit(1)).alias("rows_changed"))
