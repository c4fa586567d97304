"""Money text to numbers, in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean no amount, currency symbols and codes.
MISSING = ["nan", "n/a", "na", "-", "none", "null", "—", "–", "nil", "missing"]
SYMBOLS = "[$€£₹¥₩]"
CODES = r"\b(?:USD|EUR|GBP|INR|CAD|CNY|JPY|CHF|AUD|RUB|ZAR|NZD|SGD|SEK|NOK|DKK|Rs\.?)\b"


def parse_amount(text: Column) -> Column:
    """A double from money text, null where it is none.

    Outer parentheses make it negative; symbols, codes and blanks go, then one
    leading sign is read. What is left must be a number: with both separators
    the last one is the decimal mark, a lone comma is decimal before exactly two
    digits and groups otherwise, a lone point groups before exactly three digits.
    Any number of groups of three is read. Other letters make it no amount.
    """
    raw = F.trim(text)
    inner = F.regexp_replace(F.regexp_replace(raw, r"^\((.*)\)$", "$1"), rf"{SYMBOLS}|(?i:{CODES})|\s", "")
    # One-element arrays bind what several branches read, so it is worked out once.
    return F.transform(F.array(F.struct(raw.alias("raw"), inner.alias("bare"))), _signed)[0]


def _signed(x: Column) -> Column:
    number = F.transform(F.array(F.regexp_replace(x["bare"], r"^[+-]", "")), _plain)[0].try_cast("double")
    negative = x["raw"].rlike(r"^\(.*\)$") | F.startswith(x["bare"], F.lit("-"))
    return F.when(F.lower(x["raw"]).isin(MISSING), None).otherwise(F.when(negative, -number).otherwise(number))


def _plain(digits: Column) -> Column:
    """The digits as a literal with a point, null where they are no number."""
    points_out = F.replace(digits, F.lit("."), F.lit(""))
    commas_out = F.replace(digits, F.lit(","), F.lit(""))
    return (
        F.when(digits.rlike(r"^\d{1,3}(\.\d{3})+,\d{1,2}$|^\d+,\d{2}$"), F.replace(points_out, F.lit(","), F.lit(".")))
        .when(digits.rlike(r"^\d{1,3}(,\d{3})+\.\d{1,2}$|^\d+,\d+$|^\d{1,3}(,\d{3})+$"), commas_out)
        .when(digits.rlike(r"^\d+\.\d{3}$|^\d{1,3}(\.\d{3})+$"), points_out)
        .when(digits.rlike(r"^(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), digits)
    )
