"""Normal forms of identifiers, symbols and dates. Every function maps null to null and never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCESSION = r"(?<!\d)(\d{10})-?(\d{2})-?(\d{6})(?!\d)"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def cik(c: Column) -> Column:
    """Ten digits, zeros in front restored; no digits at all: null; more than ten digits stay as they are."""
    digits = F.nullif(F.regexp_replace(c, r"\D", ""), F.lit(""))
    return F.when(F.length(digits) <= 10, F.lpad(digits, 10, "0")).otherwise(digits)


def accession(*candidates: Column) -> Column:
    """0123456789-24-000123 from the first candidate that holds such a number in any spelling, else null."""
    found = [F.when(F.regexp_extract(c, ACCESSION, 1) != "", F.regexp_replace(F.regexp_extract(c, ACCESSION, 0), r"^(\d{10})-?(\d{2})-?(\d{6})$", "$1-$2-$3")) for c in candidates]
    return F.coalesce(*found)


def symbol(c: Column) -> Column:
    """Trimmed, upper case."""
    return blank_to_null(F.upper(c))


def ticker(c: Column) -> Column:
    """Trimmed, upper case, '-' before a share class whatever separated it."""
    return F.regexp_replace(symbol(c), r"[\s./_-]+([A-Z0-9]{1,2})$", "-$1")


def loose_date(c: Column) -> Column:
    """A date out of 2024-08-29, 20240829, 08/29/2024, 29-AUG-2024 or an ISO timestamp; anything else is null."""
    s = F.trim(c)
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
        .when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))
        .when(s.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(s, "MM/dd/yyyy"))
        .when(s.rlike(r"^\d{2}-[A-Za-z]{3}-\d{4}$"), F.try_to_date(s, "dd-MMM-yyyy"))
    )


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def zoned_date(c: Column) -> Column:
    """A date out of 2024-08-29, maybe with Z or an offset such as -05:00 behind it, which is dropped; anything else is null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}(Z|[+-]\d{2}:\d{2})?$"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))
