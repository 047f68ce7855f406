"""Product codes, tax documents and telephone numbers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercadia.functions.text import as_text

#: Texts that stand for a missing value in spreadsheets; fixed values.
MISSING = ("", "nan", "none", "null")


def digits(c: Column) -> Column:
    return F.regexp_replace(as_text(c), r"\D", "")


def _digit(c: Column, at: int) -> Column:
    """The at-th character, from 1, as a number; no cast, so no text can make it fail."""
    return F.ascii(F.substring(c, at, 1)) - 48


def _weighted(c: Column, weights: list[int]) -> Column:
    """The weighted sum of the first digits of a text, at most 15 of them.

    Read as a hexadecimal number the text has a digit in every four bits. For each bit of the weights the digits that have it are
    masked and summed at once: neighbours into bytes, and bytes by the rest of a division by 255. A fold over the digits
    is interpreted, and a sum written out makes methods which the JVM refuses to compile.
    """
    packed = F.conv(F.substring(c, 1, len(weights)), 16, 10).cast("bigint")
    low = 0x0F0F0F0F0F0F0F0F

    def digits_of(bit: int) -> Column:
        mask = sum(15 << 4 * i for i, w in enumerate(reversed(weights)) if w >> bit & 1)
        even = packed.bitwiseAND(F.lit(mask & low).cast("bigint"))
        odd = F.shiftright(packed, 4).bitwiseAND(F.lit(mask >> 4 & low).cast("bigint"))
        return (even + odd) % 255 * (1 << bit)

    return reduce(lambda x, y: x + y, [digits_of(b) for b in range(max(weights).bit_length())]).cast("int")


def _stripped(c: Column) -> Column:
    text = F.trim(F.translate(as_text(c), "\u00a0\ufeff", " "))
    return F.when(F.lower(text).isin(*MISSING), F.lit("")).otherwise(F.regexp_replace(text, "^['\"]+|['\"]+$", ""))


_NUMBER = r"^[+-]?\d+([.,]\d+)?([eE][+-]?\d+)?$"


def _whole_number(text: Column) -> Column:
    """The whole part of a number in text, also in scientific form; null beyond 15 digits."""
    value = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.abs(value) < 1e15, value.try_cast("bigint").cast("string"))


def _of_code_length(c: Column) -> Column:
    return F.when(F.length(c).between(8, 14), c)


def clean_ean(c: Column) -> Column:
    """A barcode of 8 to 14 digits, or "".

    Numbers, also in scientific form, lose leading zeros, and give "" at once if their length is wrong;
    other texts give all their digits, or else their first run of 8 to 14 digits.
    """
    text = _stripped(c)
    number = F.coalesce(_of_code_length(_whole_number(text)), F.lit(""))
    other = F.coalesce(_of_code_length(digits(text)), F.regexp_extract(text, r"\d{8,14}", 0))
    whole = F.when(text == "", F.lit("")).when(F.replace(text, F.lit(" "), F.lit("")).rlike(_NUMBER), number).otherwise(other)
    # most codes are plain digits without leading zeros
    return F.when(as_text(c).rlike(r"^[1-9]\d{7,13}$"), as_text(c)).otherwise(whole)


def clean_ean_page(c: Column) -> Column:
    """As clean_ean, but a number of the wrong length falls through to the search for digits."""
    text = _stripped(c)
    number = F.when(F.replace(text, F.lit(" "), F.lit("")).rlike(_NUMBER), _of_code_length(_whole_number(text)))
    return F.coalesce(number, _of_code_length(digits(text)), F.regexp_extract(text, r"\d{8,14}", 0))


def clean_ean_offer(c: Column) -> Column:
    """All digits of the text with their leading zeros if they are 8 to 14, or ""."""
    return F.coalesce(_of_code_length(digits(c)), F.lit(""))


def clean_ean_photo(c: Column) -> Column:
    """Digits without leading zeros if they are 8 to 14, or ""."""
    return F.coalesce(_of_code_length(F.regexp_replace(digits(c), "^0+", "")), F.lit(""))


def looks_like_ean(c: Column) -> Column:
    return F.length(clean_ean(c)).between(12, 14)


def ean13_check(c: Column) -> Column:
    """The check digit of 12 digits."""
    return (10 - _weighted(c, [1, 3] * 6) % 10) % 10


def dun14_check(c: Column) -> Column:
    """The check digit of 13 digits."""
    return (10 - _weighted(c, [3, 1] * 6 + [3]) % 10) % 10


def unit_ean_of_dun14(c: Column) -> Column:
    """The unit's EAN-13 in a package code of 14 digits that doesn't begin with 0, or ""."""
    core = F.substring(c, 2, 12)
    return F.when(c.rlike(r"^[1-9]\d{13}$"), F.concat(core, ean13_check(core).cast("string"))).otherwise(F.lit(""))


def _mod11(c: Column, weights: list[int]) -> Column:
    # a rest of 0 or 1 gives 0
    return (11 - _weighted(c, weights) % 11) % 11 % 10


def tax_document_kind(c: Column) -> Column:
    """cpf or cnpj if the digits are a valid document of that kind, else null; one repeated digit is none."""
    d = digits(c)
    repeated = d == F.repeat(F.substring(d, 1, 1), F.length(d))

    def valid(first: list[int], second: list[int]) -> Column:
        return (_mod11(d, first) == _digit(d, len(first) + 1)) & (_mod11(d, second) == _digit(d, len(second) + 1))

    cpf = valid(list(range(10, 1, -1)), list(range(11, 1, -1)))
    long = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return F.when(~repeated & (F.length(d) == 11) & cpf, F.lit("cpf")).when(~repeated & (F.length(d) == 14) & valid(long, [6, *long]), F.lit("cnpj"))


def cpf_check_digits(c: Column) -> Column:
    """The two check digits that belong to nine digits."""
    first = _mod11(c, list(range(10, 1, -1))).cast("string")
    return F.concat(first, _mod11(F.concat(c, first), list(range(11, 1, -1))).cast("string"))


def _phone(c: Column) -> Column:
    text = F.trim(c)
    number = text.try_cast("double")
    plain = F.when(F.lower(text).isin(*MISSING), F.lit("")).otherwise(F.coalesce(F.when(F.abs(number) < 1e15, number.try_cast("bigint").cast("string")), text))
    d = F.regexp_replace(F.regexp_replace(plain, r"\D", ""), "^0", "")
    d = F.when(F.length(d).isin(10, 11), F.concat(F.lit("55"), d)).otherwise(d)
    return F.when(F.length(d).isin(12, 13), d)


def clean_phone(c: Column) -> Column:
    """The first valid number among parts separated by :::, with the country code 55, or null."""
    return F.get(F.filter(F.transform(F.split(as_text(c), ":::"), _phone), lambda p: p.isNotNull()), F.lit(0))


def last_phone(c: Column) -> Column:
    """The digits of the last part separated by :::, of any length."""
    return digits(F.element_at(F.split(as_text(c), ":::"), -1))


def phone_area(c: Column) -> Column:
    """The area code in a number's digits, or null."""
    d = digits(c)
    return F.when(d.startswith("55") & (F.length(d) >= 12), F.substring(d, 3, 2)).when(F.length(d) >= 10, F.substring(d, 1, 2))


def document_digits(*columns: Column) -> Column:
    """The digits of the first column that has 11 or 14 of them, or null."""
    return F.coalesce(*[F.when(F.length(digits(c)).isin(11, 14), digits(c)) for c in columns])
