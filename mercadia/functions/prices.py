"""Prices and package quantities in text as Column expressions, one for each way of reading them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercadia.functions.text import as_text


def _bare(c: Column) -> Column:
    return F.replace(F.replace(as_text(c), F.lit("R$"), F.lit("")), F.lit(" "), F.lit(""))


def _positive(c: Column) -> Column:
    return F.when((c > 0) & ~F.isnan(c), c)


def _number(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))


def table_price(c: Column) -> Column:
    """Price tables and quotes: a comma is a decimal point; 1.234,56 has two of them and is no price."""
    return _positive(_number(F.replace(_bare(c), F.lit(","), F.lit("."))))


def page_price(c: Column) -> Column:
    """Extracted pages: with a comma dots group thousands; three digits after the only or last dot are decimals."""
    text = _bare(c)
    last = F.concat(F.regexp_replace(F.regexp_replace(text, r"\.\d{3}$", ""), r"\.", ""), F.regexp_extract(text, r"\.\d{3}$", 0))
    return _number(
        F.when(F.contains(text, F.lit(",")), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(text.rlike(r"\..*\.\d{3}$"), last)
        .otherwise(text)
    )


def offer_price(c: Column) -> Column:
    """Offer lists: a comma is a decimal point; null where that gives no number."""
    return _number(F.replace(_bare(c), F.lit(","), F.lit(".")))


def merge_price(c: Column) -> Column:
    """Comparison of tables: dots before groups of three digits go, the first comma is a decimal point."""
    text = F.regexp_replace(F.regexp_replace(as_text(c), "[^0-9,.-]", ""), r"\.(?=\d{3}(\D|$))", "")
    return _positive(_number(F.regexp_replace(text, "^([^,]*),", "$1.")))


def typed_price(c: Column) -> Column:
    """Typed money: every dot goes, the first comma is a decimal point, what follows the number is ignored; 0 for none."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(as_text(c), "[^0-9,.-]", ""), r"\.", ""), "^([^,]*),", "$1.")
    return F.coalesce(F.regexp_extract(text, r"^-?(\d+\.?\d*|\.\d+)", 0).try_cast("double"), F.lit(0.0))


def price_text(c: Column) -> Column:
    """12.5 as 12,50."""
    return F.translate(F.format_string("%.2f", c.cast("double")), ".", ",")


def package_units(c: Column) -> Column:
    """The first number of a text as units a package, from above 0 to 9999: whole, or with up to 3 decimals."""
    raw = as_text(c)
    value = F.replace(F.regexp_extract(raw, r"\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")
    whole = F.abs(value - F.rint(value)) < 0.0001
    decimals = F.translate(F.regexp_replace(F.regexp_replace(F.format_string("%.3f", value), "0+$", ""), r"\.$", ""), ".", ",")
    return F.when((value > 0) & (value <= 9999), F.when(whole, F.rint(value).cast("int").cast("string")).otherwise(decimals))


#: Forms of package texts whose quantity is certain, tried in this order; fixed values.
PACKAGE_FORMS = (
    r"(?i)^(?:CX|FD|CJ|PCT|DP|SC|CAIXA|FARDO|UN)\s*-?\s*C?/?\s*([0-9]{1,4})(?![0-9.,])",
    r"(?i)^[A-Z]{1,5}\s*-\s*([0-9]{1,4})$",
    r"(?i)^([0-9]{1,4})\s*X\s*[0-9]",
    r"(?i)\bC/\s*([0-9]{1,4})\b",
    r"(?i)^([0-9]{1,4})\s*UN\b",
)


def package_quantity(c: Column) -> Column:
    """Units of a package in a text such as CX-12 or 12X750G, or null."""
    raw = F.trim(as_text(c))
    return F.coalesce(*[F.when(F.regexp_extract(raw, form, 1) != "", F.regexp_extract(raw, form, 1).cast("int")) for form in PACKAGE_FORMS])


def money(c: Column) -> Column:
    """Two decimals, halves away from zero, in exact decimals."""
    return F.round(c.cast("decimal(20,6)"), 2).cast("decimal(18,2)")


def discounted(price: Column, percent: Column) -> Column:
    return money(price.cast("decimal(18,4)") * (F.lit(100).cast("decimal(10,2)") - percent.cast("decimal(10,2)")) / 100)


def term_price(base: Column, percent: Column) -> Column:
    """A price for a payment term: base and percent of it more, in two decimals."""
    return money(base.cast("decimal(18,4)") * (F.lit(100).cast("decimal(10,2)") + percent.cast("decimal(10,2)")) / 100)


def adjusted(price: Column, percent: Column) -> Column:
    """A price with percent of it more, halves up; no percent or 0 leaves it as it is."""
    changed = F.floor(price * (1 + percent / 100) * 100 + 0.5) / 100
    return F.when(percent.isNull() | (percent == 0), price).otherwise(changed)


def offer_prices(unit_price: Column, price: Column, units: Column) -> Column:
    """struct(unit_price, price): the unit's price, 0 counting as missing, and the package's."""
    unit = F.coalesce(F.nullif(unit_price.cast("double"), F.lit(0.0)), price.cast("double"), F.lit(0.0))
    whole = F.when(units > 0, F.round(unit * units, 2)).otherwise(F.round(unit, 2))
    return F.struct(F.round(unit, 3).alias("unit_price"), whole.alias("price"))
