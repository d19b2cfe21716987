"""Dates and money as Columns; money is DECIMAL(18,2), rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def iso_date(c: Column) -> Column:
    """The date that a text begins with; null if it doesn't begin with one."""
    return F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd")


def year_end_deadline(event: Column, years: int) -> Column:
    return F.make_date(F.year(event) + years, F.lit(12), F.lit(31))


def against_deadline(event: Column, deadline: Column) -> Column:
    return F.when(event < deadline, "before_deadline").when(event == deadline, "on_deadline").otherwise("after_deadline")


def proportion(income: Column, expense: Column, revenue: Column) -> Column:
    """income * expense / revenue to the cent; null where there is no revenue."""
    exact = income.cast("decimal(18,2)") * expense.cast("decimal(18,2)") / F.when(revenue > 0, revenue.cast("decimal(18,2)"))
    return F.round(exact, 2).cast(MONEY)


def share_tax(base: Column, percent: int) -> Column:
    """Tax to the whole unit."""
    return F.round(base.cast(MONEY) * F.lit(percent) / F.lit(100), 0).cast(MONEY)


def net_of_gross(gross: Column, percent: int) -> Column:
    return F.round(gross.cast(MONEY) * F.lit(100) / F.lit(100 + percent), 0).cast(MONEY)


def excess_tax(total: Column, free: int, percent: int) -> Column:
    """Tax on what exceeds a free amount."""
    over = F.greatest(total.cast(MONEY) - F.lit(free), F.lit(0).cast(MONEY))
    return F.round(over * F.lit(percent) / F.lit(100), 2).cast(MONEY)


def next_key(key: Column) -> Column:
    """The paragraph after 25 is 25a, after 25a 25b, after 25z 26."""
    number, letter = F.regexp_extract(key, "^([0-9]+)", 1), F.regexp_extract(key, "^[0-9]+([a-z]?)$", 1)
    up = F.concat(number, F.chr(F.ascii(letter) + 1))
    return F.when(letter == "", F.concat(number, F.lit("a"))).when(letter == "z", (number.cast("int") + 1).cast("string")).otherwise(up)


def amounts(text: Column) -> Column:
    """Amounts of a text, digits in groups parted by spaces and a decimal comma or none, as decimals."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9]{1,3}(?: [0-9]{3})+(?:,[0-9]{1,2})?|[0-9]+(?:,[0-9]{1,2})?"), F.lit(0))
    return F.transform(found, lambda x: F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).cast(MONEY))


def total_amount(text: Column, label: str) -> Column:
    """The amount after the label, or else the sum of all amounts; 0 without any."""
    stated = amounts(F.regexp_extract(F.lower(text), label + r"[^0-9]{0,40}([0-9][0-9 ]*(?:,[0-9]{1,2})?)", 1))
    every = F.aggregate(amounts(text), F.lit(0).cast("decimal(38,2)"), lambda s, x: (s + F.coalesce(x, F.lit(0).cast(MONEY))).cast("decimal(38,2)"))
    return F.when(F.size(stated) > 0, F.element_at(stated, 1).cast("decimal(38,2)")).otherwise(every)


def mixed_claim(net: Column, rate: Column, business_percent: Column) -> tuple[Column, Column]:
    """(deductible, not deductible) tax of an invoice of which a share serves the business, to the cent."""
    tax = (net.cast(MONEY) * rate.cast("decimal(5,2)") / 100).cast(MONEY)
    own = (tax * business_percent.cast("decimal(5,2)") / 100).cast(MONEY)
    return own, (tax - own).cast(MONEY)


def date_of(text: Column, otherwise: Column) -> Column:
    """The first ISO date of a text, or the other date."""
    return F.coalesce(F.try_to_date(F.nullif(F.regexp_extract(text, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), "yyyy-MM-dd"), otherwise)
