"""Text keys, hashes and redaction as Column expressions: all of it stays inside whole-stage codegen."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _letters(ascii_only: bool) -> tuple[str, str]:
    """Letters with one base letter each, and those base letters: from Unicode's own decompositions."""
    source, target = [], []
    for point in range(0xA0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point) and (base.isascii() or not ascii_only):
            source.append(chr(point))
            target.append(base)
    return "".join(source), "".join(target)


_ASCII = _letters(True)
_ANY = _letters(False)
_MARKS = "[\u0300-\u036f]"


def as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def fold_ascii(c: Column) -> Column:
    """Accented letters become plain ones, whatever else isn't ASCII goes (dashes and symbols too)."""
    return F.regexp_replace(F.translate(as_text(c), *_ASCII), r"[^\x00-\x7F]", "")


def fold_marks(c: Column) -> Column:
    """Only the marks go; other symbols stay."""
    return F.regexp_replace(F.translate(as_text(c), *_ANY), _MARKS, "")


def header_key(c: Column) -> Column:
    """A column header in upper-case ASCII words."""
    return F.trim(F.regexp_replace(fold_ascii(F.upper(as_text(c))), "[^A-Z0-9]+", " "))


def search_key(c: Column) -> Column:
    """Lower-case words of letters a-z and digits, with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(fold_marks(c)), "[^a-z0-9]+", " "))


#: Words that don't tell one industry from another; fixed values.
INDUSTRY_NOISE = ("industria", "turbinado")


def word_key(c: Column, ignored: Iterable[str] = INDUSTRY_NOISE) -> Column:
    """The words of search_key in order of the alphabet, joined by |; ignored words are left out."""
    words = F.split(search_key(c), " ")
    noise = F.array(*[F.lit(w) for w in ignored]) if ignored else F.array().cast("array<string>")
    return F.array_join(F.array_sort(F.filter(words, lambda w: (w != "") & ~F.array_contains(noise, w))), "|")


def sorted_words(c: Column) -> Column:
    """Runs of A-Z, digits and dots in order of the alphabet."""
    return F.array_join(F.array_sort(F.regexp_extract_all(as_text(c), F.lit("[A-Z0-9.]+"), F.lit(0))), " ")


#: Abbreviations in offers and what they stand for; fixed values.
OFFER_UNITS = (("lt", "l"), ("lts", "l"), ("gr", "g"), ("grs", "g"), ("cx", "caixa"), ("un", "unidade"), ("fd", "fardo"), ("pc", "paco"), ("pct", "pacote"))


def offer_key(c: Column) -> Column:
    """A product name of an offer: no marks, lower case, single blanks, units spelt out."""
    out = F.regexp_replace(F.trim(F.lower(fold_marks(c))), r"\s+", " ")
    for short, long in OFFER_UNITS:
        out = F.regexp_replace(out, rf"\b{short}\b", long)
    return out


def matches_search(name: Column, code: Column, query: Column) -> Column:
    """Whether every word of the query is part of the name's key or the code's digits; an empty query matches."""
    where = F.concat_ws(" ", search_key(name), F.regexp_replace(as_text(code), r"\D", ""))
    return F.forall(F.split(search_key(query), " "), lambda w: (w == "") | F.contains(where, w))


def matches_person(name: Column, document: Column, query: Column) -> Column:
    """Whether the folded query is in the folded name, or its digits (if any) are in the document's."""
    digits = F.regexp_replace(as_text(query), r"\D", "")
    return F.contains(search_key(name), search_key(query)) | ((digits != "") & F.contains(F.regexp_replace(as_text(document), r"\D", ""), digits))


def starts_with_word(c: Column, names: Iterable[str]) -> Column:
    """Whether a name's key is one of names, or begins with one and a blank."""
    key, found = search_key(c), F.lit(False)
    for n in names:
        found = found | (key == n) | key.startswith(f"{n} ")
    return found


def slug(c: Column, most: int = 40) -> Column:
    """A name for an address; uniqueness is the caller's matter."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(fold_marks(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def sheet_title(c: Column, index: Column, most: int = 31) -> Column:
    """A sheet's title without the characters that workbooks forbid."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(as_text(c), r"[\[\]:*?/\\]+", " "), r"\s+", " "))
    return F.substring(F.when(clean == "", F.concat(F.lit("Sheet "), index.cast("string"))).otherwise(clean), 1, most)


def redact_detail(c: Column, most: int = 500) -> Column:
    """E-mail addresses, numbers of 8 digits or more, and access tokens are hidden."""
    out = F.regexp_replace(as_text(c), r"[\w.+-]+@[\w-]+(\.[\w-]+)+", "[email]")
    out = F.regexp_replace(out, r"\b\d{8,}\b", "[number]")
    out = F.regexp_replace(out, r"(?i)access_token=[^&\s]+", "access_token=[redacted]")
    return F.substring(out, 1, most)


#: Keys of metadata whose values are hidden; fixed values.
SENSITIVE_KEYS = ("token", "password", "senha", "cpf", "cpfcnpj", "telefone", "phone", "mobilephone")


def clean_metadata(c: Column, entries: int = 30, most: int = 300) -> Column:
    """A map<string,string> for an audit log: at most `entries` entries, long values cut, secret ones hidden."""

    def hidden(key: Column) -> Column:
        key = F.replace(F.lower(key), F.lit("-"), F.lit("_"))
        return key.isin(*SENSITIVE_KEYS) | F.contains(key, F.lit("token")) | F.contains(key, F.lit("password")) | F.contains(key, F.lit("senha"))

    kept = F.map_from_entries(F.slice(F.map_entries(c), 1, entries))
    return F.transform_values(kept, lambda k, v: F.when(hidden(k), F.lit("[redacted]")).otherwise(F.substring(v, 1, most)))


def hash_identifier(c: Column, salt: str) -> Column:
    """24 hex digits of a salted SHA-256; null for null and empty."""
    return F.when(as_text(c) != "", F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), as_text(c)), 256), 1, 24))


def escape_csv(c: Column, separator: str = ";") -> Column:
    """A CSV field, quoted if it holds quotes, line ends or the separator."""
    text = as_text(c)
    return F.when(text.rlike(f'["\\n\\r{separator}]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def escape_html(c: Column) -> Column:
    out = as_text(c)
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


#: Product words that stand for others in descriptions; fixed values.
DESCRIPTION_ALIASES = (
    ("refresco em po", "ref po"),
    ("refresco po", "ref po"),
    ("suco po", "ref po"),
    ("refr po", "ref po"),
    ("casa e perfume", "casa perfume"),
    ("cha bco", "cha branco"),
    ("erva doce", "ervadoce"),
)
_DESCRIPTION_UNITS = (("(?:litros?|lts?|lt|l)", "l"), ("ml", "ml"), ("(?:gramas?|gr|g)", "g"), ("kg", "kg"))


def description_key(c: Column) -> Column:
    """A product description for recognition: lower-case ASCII, decimal points, units glued to their numbers."""
    out = F.replace(F.lower(fold_ascii(c)), F.lit("&"), F.lit(" e "))
    out = F.regexp_replace(out, r"(?<=\d),(?=\d)", ".")
    out = F.trim(F.regexp_replace(F.replace(F.regexp_replace(out, "[^a-z0-9.%/]+", " "), F.lit("/"), F.lit(" ")), r"\s+", " "))
    for unit, short in _DESCRIPTION_UNITS:
        out = F.regexp_replace(out, rf"\b(\d+(?:\.\d+)?)\s*{unit}\b", f"$1{short}")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    for words, short in DESCRIPTION_ALIASES:
        out = F.regexp_replace(out, rf"\b{words}\b", short)
    return out


def description_measures(key: Column) -> Column:
    """struct(weight, volume): the first of each in a description_key."""

    def first(units: str) -> Column:
        found = F.regexp_extract(key, rf"\b(\d+(?:\.\d+)?(?:{units}))\b", 1)
        plain = F.regexp_replace(found, r"(\.\d*?)0+(?=[a-z])", "$1")
        return F.nullif(F.regexp_replace(plain, r"\.(?=[a-z])", ""), F.lit(""))

    return F.struct(first("kg|g").alias("weight"), first("ml|l").alias("volume"))


def truthy(c: Column) -> Column:
    """null for the values that count as missing where a field falls through to its alias: "", "0", "false"."""
    return F.when(~F.lower(as_text(c)).isin("", "0", "0.0", "false", "none", "null"), c)
