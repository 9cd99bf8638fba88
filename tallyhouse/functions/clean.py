"""Cleaning of typed text: spaces, dates, postcodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters typed for the digits they resemble.
DIGIT_LOOKALIKES = ("OILZSB", "011258")

#: Outward parts of postcodes, with the letters that may follow the digit.
OUTWARD = "^([A-Z]{1,2}[0-9][0-9]?|[A-Z][0-9][ABCDEFGHJKPSTUW]|[A-Z]{2}[0-9][ABEHMNPRVWXY])$"

_SPACES = "[\\s\\u00a0\\u2000-\\u200b\\u202f\\u3000\\ufeff]+"


def squash(c: Column) -> Column:
    """Trimmed, every run of white space (of any kind) as one space; null stays null."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def fold(c: Column) -> Column:
    """``squash`` in lower case."""
    return F.lower(squash(c))


def loose_date(c: Column) -> Column:
    """A date typed as dd-mm-yyyy, dd/mm/yyyy, yyyy-mm-dd, ``4 March 2024`` or five digits (days since 1899-12-30).

    Null, empty and unreadable texts give null.
    """
    t = squash(c)
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("date"))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
        .when(t.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$"), F.try_to_date(F.regexp_replace(t, "[/.]", "-"), "d-M-yyyy"))
        .when(t.rlike(r"^\d{5}$"), F.date_add(F.lit("1899-12-30").cast("date"), t.try_cast("int")))
        .when(t.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.try_to_date(F.initcap(t), "d MMM yyyy"))
        .when(t.rlike(r"^\d{1,2} [A-Za-z]{4,} \d{4}$"), F.try_to_date(F.initcap(t), "d MMMM yyyy"))
    )


def postcode(c: Column) -> Column:
    """A postcode as ``AREA9 9AA`` however typed, null if it can't be one.

    Case, spaces and punctuation don't matter; a letter in the place of a digit is read as the digit it resembles.
    """
    t = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    n = F.length(t)
    inward = F.concat(
        F.translate(t.substr(n - 2, F.lit(1)), *DIGIT_LOOKALIKES), t.substr(n - 1, F.lit(2))
    )
    out = t.substr(F.lit(1), n - 3)
    # An outward part without any digit has look-alikes after its one or two area letters.
    area = F.when(F.length(out) >= 3, F.lit(2)).otherwise(F.lit(1))
    tail = F.translate(out.substr(area + 1, F.length(out)), *DIGIT_LOOKALIKES)
    mended = F.concat(out.substr(F.lit(1), area), tail)
    outward = F.when(out.rlike(OUTWARD), out).otherwise(mended)
    return F.when(
        n.between(5, 7) & outward.rlike("^[A-Z]{1,2}[0-9][0-9A-Z]?$") & inward.rlike("^[0-9][A-Z]{2}$"),
        F.concat(outward, F.lit(" "), inward),
    )
