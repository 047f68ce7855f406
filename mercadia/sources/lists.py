"""Product lists pasted as text, text lines of documents, and contact files: rows (list_id, text) or lines.

Each form has its parser; `parse_lists` takes, for each list, the first form that fits and gives rows. A
list is one user's paste, so its lines are an array of that row until they are exploded into rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.functions.codes import clean_ean, clean_phone
from mercadia.functions.prices import offer_price, page_price
from mercadia.functions.text import as_text, offer_key

#: Package units of lists; fixed values.
UNITS = "CX|FD|SC|TP|PC|PCT|BD|DR|VD|LT|CJ|PT|FRS|PTE|RL|TB|GF|GL|KG|UN|EMB"
#: Forms of packages and prices in lists; fixed values.
PRICE = r"\d+[,\.]\d+"
INLINE = rf"(?i)^(.+?)\s+\b({UNITS})-(\d+)\s+({PRICE})\s*$"
PACKAGE_END = rf"(?i)\b({UNITS})-(\d+)\s*$"
_COMPACT = rf"\b({UNITS})\s*-?\s*(\d+)\s*(?:UN)?\s+(\d+[,\.]\d{{1,3}})\b"
COMPACT = f"(?i){_COMPACT}"
TWO_PRICES, ONE_PRICE = rf"^({PRICE})\s+({PRICE})", rf"^({PRICE})\s*$"
LETTER = r"[A-Za-zÀ-ÖØ-öø-ÿ]"
#: Words that tell a product's category, the first that fits; fixed values.
CATEGORIES = (
    ("Biscoito", ("bisc",)),
    ("Laticínio", ("leite", "iogurte", "manteiga", "queijo", "requeijao", "nata")),
    ("Enlatado", ("sard", "atum", "molho", "extrato")),
    ("Bebida", ("cha ", "cafe", "suco", "refri")),
    ("Limpeza", ("lava roupa", "lava loucas", "sabao", "deterg", "cera ", "inset", "brilho")),
    ("Higiene", ("sabonete", "shampoo", "creme dent", "fio dental", "desodor")),
)
OTHER_CATEGORY = "Mercearia"
FIELDS = ("list_id", "item_no", "name", "unit", "units", "unit_price", "price", "ean", "category")


def category(name: Column) -> Column:
    lower = F.lower(name)
    return reduce(lambda w, kv: w.when(reduce(lambda a, b: a | b, [F.contains(lower, F.lit(x)) for x in kv[1]]), F.lit(kv[0])), CATEGORIES, F.when(F.lit(False), F.lit(""))).otherwise(F.lit(OTHER_CATEGORY))


def lines(lists: DataFrame) -> DataFrame:
    """(list_id, line_no, line) of lists' lines that aren't blank, from 0."""
    return lists.select("list_id", F.posexplode(F.split(as_text(F.col("text")), "\n")).alias("line_no", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).where("line <> ''")


def _two(c: Column) -> Column:
    return F.round(c, 2)


def _item(name: Column, unit: Column, units: Column, unit_price: Column, price: Column, ean: Column | None = None) -> list[Column]:
    return [name.alias("name"), F.upper(unit).alias("unit"), units.cast("int").alias("units"), unit_price.alias("unit_price"), price.alias("price"), (F.lit(None).cast("string") if ean is None else ean).alias("ean"), category(name).alias("category")]


def _packaged(line: Column) -> tuple[Column, Column, Column]:
    """(name, unit, units) of a line without a price: a package at its end is split off."""
    has = line.rlike(PACKAGE_END)
    return F.when(has, F.trim(F.regexp_replace(line, PACKAGE_END, ""))).otherwise(line), F.when(has, F.regexp_extract(line, PACKAGE_END, 1)).otherwise(F.lit("UN")), F.when(has, F.regexp_extract(line, PACKAGE_END, 2))


def _group(line: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(line, pattern, n)


def inline_items(lists: DataFrame) -> DataFrame:
    """Lines NAME CX-24 2,05: the unit's price; lines that begin with a letter but have no price cost 0."""
    line, hit = F.col("line"), F.col("line").rlike(INLINE)
    name, unit, units = _packaged(line)
    price = offer_price(_group(line, INLINE, 4))
    count = _group(line, INLINE, 3).try_cast("int")
    own = lines(lists).where(hit | line.rlike(rf"^{LETTER}"))
    return own.select(
        "list_id",
        F.col("line_no").alias("item_no"),
        *_item(
            F.when(hit, F.trim(_group(line, INLINE, 1))).otherwise(name),
            F.when(hit, _group(line, INLINE, 2)).otherwise(unit),
            F.when(hit, count).otherwise(units.try_cast("int")),
            F.when(hit, price),
            F.when(hit, _two(price * count)).otherwise(F.lit(0.0)),
        ),
    )


def two_line_items(lists: DataFrame) -> DataFrame:
    """A product's line, then a line with its unit's price, or with that and the package's; a product without prices costs 0."""
    line = F.col("line")
    priced = line.rlike(TWO_PRICES) | line.rlike(ONE_PRICE)
    own = lines(lists).withColumn("priced", priced).where(F.col("priced") | line.rlike(rf"^{LETTER}"))
    after = Window.partitionBy("list_id").orderBy("line_no")
    own = own.withColumn("next", F.when(F.lead("priced").over(after), F.lead("line").over(after))).where(~F.col("priced"))
    name, unit, units = _packaged(line)
    both = F.col("next").rlike(TWO_PRICES)
    single = offer_price(F.regexp_extract("next", rf"^({PRICE})", 1))
    count = units.try_cast("int")
    whole = F.when(both, offer_price(F.regexp_extract("next", TWO_PRICES, 2))).when(count > 0, _two(single * count)).otherwise(single)
    return own.select("list_id", F.col("line_no").alias("item_no"), *_item(name, unit, count, single, F.coalesce(whole, F.lit(0.0))))


def compact_items(lists: DataFrame) -> DataFrame:
    """One run-on text: what stands between two prices is the name of the second."""
    flat = lists.select("list_id", F.trim(F.regexp_replace(as_text(F.col("text")), r"\s+", " ")).alias("flat"))
    # a mark that no text holds cuts the text after each price
    cut = F.split(F.regexp_replace("flat", f"(?i)({_COMPACT})", "$1\u0001"), "\u0001")
    parts = flat.select("list_id", F.posexplode(cut).alias("item_no", "part")).where(F.col("part").rlike(COMPACT + "$"))
    part = F.col("part")
    tail = COMPACT + "$"
    head = r"(?i)^\s*(Nome\s*do\s*Produto\s*Quantidade\s*da\s*Embalagem\s*Preço\s*Unitário\s*(?:\(R\$\))?|Produto\s+Embalagem\s+Preço)\s*"
    name = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(part, tail, "")), head, ""), r"^[ \-;|\t]+|[ \-;|\t]+$", "")
    price, count = offer_price(_group(part, tail, 3)), _group(part, tail, 2).try_cast("int")
    return parts.select("list_id", "item_no", *_item(name, _group(part, tail, 1), count, price, _two(price * count))).where(F.col("name").rlike(LETTER))


#: Headers of lists with semicolons, by what they tell, the first that fits; fixed values.
CSV_NAMES = ("produto", "nome do produto", "product_name", "nome")
CSV_UNIT_PRICES = ("preco unitario", "r$ unitario", "unitario", "preco_unitario")
CSV_PRICES = ("preco caixa", "preco embalagem", "r$ emb.", "r$ emb", "preco_embalagem")
CSV_PACKAGES = ("quantidade da embalagem", "qtd embalagem", "qtd por embalagem", "embalagem", "emb.", "emb")


def csv_items(lists: DataFrame) -> DataFrame:
    """Lines with semicolons: columns by the last header line above, or name; package; unit's price; package's price."""
    own = lines(lists.where(F.contains("text", F.lit(";"))))
    own = own.withColumn("cols", F.transform(F.split("line", ";"), lambda c: F.trim(c)))
    keys = F.transform("cols", offer_key)
    heading = F.exists(keys, lambda k: k.isin("produto", "product_name", "nome"))
    above = Window.partitionBy("list_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("heading", heading).withColumn("header", F.last(F.when(F.col("heading"), keys), ignorenulls=True).over(above))
    own = own.where(~F.col("heading") & (F.size("cols") >= 2) & F.col("cols")[0].rlike(LETTER))

    def value(names: tuple[str, ...]) -> Column:
        """The column whose header is or holds one of the names, the leftmost one."""
        fits = lambda h: reduce(lambda a, b: a | b, [F.contains(h, F.lit(n)) for n in names])
        at = F.get(F.array_compact(F.transform("header", lambda h, i: F.when(fits(h), i))), F.lit(0))
        return F.coalesce(F.get(F.col("cols"), at), F.lit(""))

    headed, width = F.col("header").isNotNull(), F.size("cols")
    at = lambda i: F.get(F.col("cols"), F.lit(i))
    packaged = F.coalesce(F.get(F.filter("cols", lambda c: c.rlike(PACKAGE_END)), F.lit(0)), F.lit(""))
    unit_text = F.when(headed, value(CSV_UNIT_PRICES)).when(width == 2, at(1)).otherwise(at(2))
    price_text = F.when(headed, F.coalesce(F.nullif(value(CSV_PRICES), F.lit("")), value(CSV_UNIT_PRICES))).when(width == 2, at(1)).when(width == 3, at(2)).otherwise(at(3))
    package = F.when(headed, value(CSV_PACKAGES)).when(width == 2, packaged).otherwise(at(1))
    own = own.withColumns({"name0": F.when(headed, F.coalesce(F.nullif(value(CSV_NAMES), F.lit("")), at(0))).otherwise(at(0)), "unit_text": unit_text, "price_text": price_text, "package": package})
    where = F.coalesce(F.nullif("package", F.lit("")), F.col("name0"))
    has = where.rlike(PACKAGE_END)
    strip = has & (F.col("package") != "") & ~headed
    name = F.when(strip, F.trim(F.regexp_replace("name0", PACKAGE_END, ""))).otherwise(F.col("name0"))
    return own.select(
        "list_id",
        F.col("line_no").alias("item_no"),
        *_item(name, F.when(has, _group(where, PACKAGE_END, 1)).otherwise(F.lit("UN")), F.when(has, _group(where, PACKAGE_END, 2)).try_cast("int"), offer_price(F.col("unit_text")), F.coalesce(offer_price(F.col("price_text")), F.lit(0.0))),
    )


def free_items(lists: DataFrame) -> DataFrame:
    """Any line with a letter and without a semicolon: its last price, the first as the unit's, a 13-digit code, a package."""
    line = F.col("line")
    own = lines(lists).where(line.rlike(LETTER) & ~F.contains(line, F.lit(";")))
    money = r"(?:R\$\s*)?(\d+[,.]\d{1,3})"
    package = rf"(?i)\b({UNITS})\s*-?\s*(\d+)?\s*(?:UN)?\b"
    found = lambda p, g: F.regexp_extract_all(line, F.lit(p), F.lit(g))
    prices, units, counts = found(money, 1), found(package, 1), found(package, 2)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    name = F.when(F.size(prices) > 0, F.trim(F.regexp_replace(line, rf"(?s){money}.*$", ""))).otherwise(line)
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\b\d{13}\b", ""), r"\s+$", ""), PACKAGE_END, ""))
    own = own.withColumns({"__n": F.regexp_replace(name, r"\s+", " "), "__p": offer_price(last(prices)), "__u": F.when(F.size(prices) > 1, offer_price(prices[0])), "__c": F.nullif(last(counts), F.lit("")).try_cast("int")})
    price = F.when((F.col("__u") == F.col("__p")) & (F.col("__c") > 0), _two(F.col("__u") * F.col("__c"))).otherwise(F.coalesce("__p", F.lit(0.0)))
    return own.where("__n <> ''").select("list_id", F.col("line_no").alias("item_no"), *_item(F.col("__n"), F.coalesce(last(units), F.lit("UN")), F.col("__c"), F.col("__u"), price, F.nullif(F.regexp_extract(line, r"\b(\d{13})\b", 1), F.lit(""))))


def list_form(lists: DataFrame) -> DataFrame:
    """lists with form: compact, inline, two_line, csv or free, the first whose test they pass."""
    text = as_text(F.col("text"))
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    count = lambda *patterns: F.size(F.filter(rows, lambda x: reduce(lambda a, b: a | b, [x.rlike(p) for p in patterns])))
    compact = F.regexp_count(flat, F.lit(COMPACT))
    single = (compact == 1) & ~F.contains(text, F.lit("\n")) & (F.length(flat) > 20)
    share = lambda n, part: n >= F.greatest(F.lit(1), F.floor(F.size(rows) * part))
    form = (
        F.when((compact >= 2) | single, F.lit("compact"))
        .when(share(count(INLINE), 0.4), F.lit("inline"))
        .when(share(count(TWO_PRICES, ONE_PRICE), 0.25), F.lit("two_line"))
        .when(F.exists(rows, lambda x: F.contains(x, F.lit(";"))), F.lit("csv"))
        .otherwise(F.lit("free"))
    )
    return lists.withColumn("form", form)


PARSERS = {"compact": compact_items, "inline": inline_items, "two_line": two_line_items, "csv": csv_items, "free": free_items}


def parse_lists(lists: DataFrame) -> DataFrame:
    """Items of lists (list_id, text), each by its form. The five branches scan disjoint lists."""
    formed = list_form(lists)
    return reduce(DataFrame.unionByName, [parse(formed.where(F.col("form") == form)) for form, parse in PARSERS.items()])


# ---- text lines of documents ----
_ROW = r"^\s*\d[\w./-]*\s+(.+?)\s+(\d{8,14})\s+(.+)$"
_LOOSE_ROW = r"^\s*(.+?)\s+(\d{8,14})\s+(.+)$"
_PAGE_PRICE = r"(?<!\d)(\d+(?:[.,]\d{2,3})+)(?!\d)"


def document_rows(text_lines: DataFrame) -> DataFrame:
    """Products (file, line_no, name, ean, price) of text lines (file, line_no, text) of documents.

    A line without a code and a price of at most 80 characters continues the product above it.
    """
    line = F.trim(F.regexp_replace(as_text(F.col("text")), r"\s+", " "))
    own = text_lines.withColumn("line", line).where("line <> ''")
    form = F.when(F.col("line").rlike(_ROW), F.lit(_ROW)).when(F.col("line").rlike(_LOOSE_ROW), F.lit(_LOOSE_ROW))
    part = lambda n: F.when(F.col("line").rlike(_ROW), F.regexp_extract("line", _ROW, n)).otherwise(F.regexp_extract("line", _LOOSE_ROW, n))
    name = F.trim(F.regexp_replace(F.trim(part(1)), r"^\d[\w./-]*\s+", ""))
    price = page_price(F.nullif(F.regexp_extract(part(3), _PAGE_PRICE, 1), F.lit("")))
    own = own.withColumns({"is_row": form.isNotNull(), "name": name, "ean": clean_ean(part(2)), "price": price})
    good = F.col("is_row") & F.col("price").isNotNull() & (F.length("name") >= 3) & ~F.upper("name").isin("PRODUTO", "CODIGO", "CÓDIGO")
    above = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # every row line begins a group; only a good one has products, and lines that follow a bad one go with it
    own = own.withColumn("good", good).withColumn("start", F.last(F.when(F.col("is_row"), F.col("line_no")), ignorenulls=True).over(above))
    more = ~F.col("is_row") & ~F.col("line").rlike(r"\d{8,14}") & (F.length("line") <= 80) & ~F.col("line").rlike(_PAGE_PRICE)
    words = F.when(F.col("is_row"), F.col("name")).when(more, F.col("line"))
    grouped = own.where("start IS NOT NULL").groupBy("file", "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(words.isNotNull(), F.struct("line_no", words.alias("w"))))), lambda x: x["w"]), " ").alias("name"),
        F.max_by("good", F.col("is_row").cast("int")).alias("good"),
        F.max("ean").alias("ean"),
        F.max("price").alias("price"),
    )
    return grouped.where("good").select("file", F.col("start").alias("line_no"), "name", "ean", "price")


# ---- contacts ----
#: Words of headers of names and of numbers; fixed values.
NAME_HEADERS = ("nome completo", "first name", "full name", "nome", "name")
PHONE_HEADERS = ("phone 1 - value", "telefone", "whatsapp", "celular", "phone1", "numero", "número", "phone")
LAST_NAME_HEADERS = ("last name", "sobrenome", "surname")


def _column(columns: list[str], words: tuple[str, ...]) -> str | None:
    clean = {c: c.strip().lower().replace("﻿", "") for c in columns}
    return next((c for w in sorted(words, key=len, reverse=True) for c in columns if w in clean[c]), None)


def contacts(table: DataFrame) -> DataFrame:
    """(name, phone) of a contact file read with spark.read.csv(header=True); phone is null where there is no valid number.

    The longest header word that fits chooses the column. Count the nulls for the number of invalid rows.
    """
    name, phone = _column(table.columns, NAME_HEADERS), _column(table.columns, PHONE_HEADERS)
    if not name or not phone:
        raise ValueError(f"a contact file needs columns for a name and a phone; found {table.columns}")
    last = next((c for c in table.columns if c.strip().lower() in LAST_NAME_HEADERS), None)
    parts = [F.trim(as_text(F.col(f"`{c}`"))) for c in (name, last) if c]
    full = F.trim(F.concat_ws(" ", *parts))
    return table.select(F.when(full == "", F.lit("Cliente")).otherwise(full).alias("name"), clean_phone(F.col(f"`{phone}`")).alias("phone"))
