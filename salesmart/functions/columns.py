"""Scalar expressions: all built-in, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"

# The age groups of the customer dimension (upper bound, label).
AGE_BANDS = ((25, "18-25"), (35, "26-35"), (45, "36-45"), (55, "46-55"))
OLDEST_BAND = "56+"

# Month names by number.
MONTH_NAMES = {
    "en": ["January", "February", "March", "April", "May", "June", "July", "August",
           "September", "October", "November", "December"],
    "he": ["ינואר", "פברואר", "מרץ", "אפריל", "מאי", "יוני", "יולי", "אוגוסט",
           "ספטמבר", "אוקטובר", "נובמבר", "דצמבר"],
}


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient in double; null, not an error, when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(numerator: Column, denominator: Column) -> Column:
    return ratio(numerator, denominator) * 100


def age_band(age: Column) -> Column:
    band = F.when(age.isNull(), None)
    for upper, label in AGE_BANDS:
        band = band.when(age <= upper, label)
    return band.otherwise(OLDEST_BAND)


def line_amount(unit_price: Column, quantity: Column) -> Column:
    """Price times quantity, rounded to cents in decimal arithmetic."""
    return (unit_price.cast(MONEY) * quantity.cast("decimal(10,0)")).cast(MONEY)


def month_name(month: Column, language: str = "en") -> Column:
    return F.element_at(F.array(*map(F.lit, MONTH_NAMES[language])), month)


def quarter_name(quarter: Column) -> Column:
    return F.concat(F.lit("Q"), quarter.cast("string"))


def quarter_of(month: Column) -> Column:
    return F.ceil(month / 3).cast("int")


def period_label(year: Column, month: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))


def shekels(amount: Column) -> Column:
    """Whole amount with thousands separators, rounded half to even."""
    return F.concat(F.lit("₪"), F.format_number(amount, 0))


def money_text(amount: Column) -> Column:
    """A two-decimal amount as a float would print: 12.50 is 12.5, 12.00 is 12.0."""
    return F.regexp_replace(amount.cast(MONEY).cast("string"), "0$", "")


def timestamp_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def truncated(value: Column) -> Column:
    """Integer part, towards zero."""
    return value.cast("int")
