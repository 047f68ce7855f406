"""Price tables and quotes from decoded cells, and columns found by their headers.

Binary workbooks are decoded by whatever reads them into rows (file, sheet, row, col, value), one a cell,
value a string; from there on all is DataFrames. Header rows are few and are scored like any other rows;
files are independent keys, so many are read at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.functions.codes import MISSING, clean_ean, looks_like_ean
from mercadia.functions.prices import package_quantity, package_units, table_price
from mercadia.functions.text import as_text, header_key

#: Rows in which a header is looked for, and rows of values that a column without a header is judged by.
HEADER_ROWS, SAMPLE_ROWS = 15, 50
#: Rows of which a price table's header is the first that fits.
PRICE_HEADER_ROWS = 12
TERMS = (7, 14, 21, 28, 35, 42)


def _any(c: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


# ---- scores of headers: the words and points are fixed values ----
def name_score(header: Column) -> Column:
    k = header_key(header)
    return (
        F.when(F.contains(k, F.lit("PRODUTO")) & _any(k, "COD", "CODIGO"), 0)
        .when(k.isin("NOME", "NOME PRODUTO", "NOME DO PRODUTO", "DESCRICAO", "DESCRICAO PRODUTO"), 100)
        .when(_any(k, "PRODUTO", "DESCRI", "ITEM", "MERCAD"), 80)
        .otherwise(0)
    )


def ean_score(header: Column) -> Column:
    k = header_key(header)
    less = F.when(k.rlike(r"\b(CAIXA|CX|EMB|EMBALAGEM|DUN|MASTER|PACK)\b"), 10).otherwise(0)
    return (
        F.when(_any(k, "COD PROD", "CODIGO PROD", "COD INTERNO", "CODIGO INTERNO") | k.isin("", "COD", "CODIGO"), 0)
        .when(_any(k, "EAN", "GTIN"), F.lit(100) - less)
        .when(_any(k, "CODIGO DE BARRAS", "COD BARRAS", "COD BARRA"), F.lit(95) - less)
        .when(_any(k, "COD BARR", "CODBAR"), F.lit(92) - less)
        .when(_any(k, "BARRAS", "BARRA", "BARCODE"), F.lit(90) - less)
        .otherwise(0)
    )


def has_term(header: Column, term: int) -> Column:
    """Whether a number of the header is the payment term: 07 counts as 7."""
    return header_key(header).rlike(rf"\b0*{int(term)}\b")


def price_score(header: Column, term: int | None = None) -> Column:
    k = header_key(header)
    return (
        F.when((k == "") | _any(k, "TOTAL", "EMB", "CAIXA", "CX", "QTD", "QTDE", "QUANT"), 0)
        .when(has_term(header, term) if term is not None else F.lit(False), 100)
        .when(k.rlike(r"\b(VL|VLR|VALOR|VAL)\b.*\bLIQUIDO\b"), 90)
        .when(F.contains(k, F.lit("UNIT")), 95)
        .when(k.isin("PRECO", "PRE O", "VALOR", "R", "RS"), 60)
        .when(_any(k, "PRECO", "VALOR") | k.rlike(r"\bVR\b"), 55)
        .otherwise(0)
    )


def package_score(header: Column) -> Column:
    k = header_key(header)
    return (
        F.when(_any(k, "PRECO", "VALOR", "TOTAL", "R ", "RS ", "EAN", "GTIN", "BARRA", "COD PROD", "CODIGO PROD", "COD INTERNO", "CODIGO INTERNO") | (k == ""), 0)
        .when(F.contains(k, F.lit("FRACION")), 100)
        .when(_any(k, "QTD CAIXA", "QTDE CAIXA", "QUANTIDADE CAIXA", "QUANT CAIXA"), 98)
        .when(_any(k, "QTD CX", "QTDE CX", "QUANT CX", "QTE CX"), 96)
        .when(_any(k, "UN CAIXA", "UND CAIXA", "UN POR CAIXA", "UND POR CAIXA"), 94)
        .when(F.contains(k, F.lit("MULTIPLO")), 90)
        .when(k.isin("CX", "CAIXA", "QTD", "QTDE", "QUANTIDADE", "EMB", "EMBALAGEM"), 84)
        .when(_any(k, "QTD EMB", "QTDE EMB", "QUANT EMB", "QTD EMBALAGEM"), 88)
        .otherwise(0)
    )


#: The least score with which a column is taken.
NAME_LEAST, EAN_LEAST, PRICE_LEAST, PACKAGE_LEAST = 80, 80, 55, 84


def nameless(header: Column) -> Column:
    k = header_key(header)
    return (k == "") | k.startswith("UNNAMED ")


def may_hold_eans(header: Column) -> Column:
    """Whether a column's values may tell that it holds barcodes: internal codes' may not."""
    k = header_key(header)
    own = _any(k, "COD PROD", "CODIGO PROD", "COD INTERNO", "CODIGO INTERNO", "INTERNO")
    return nameless(header) | (~own & (k.isin("COD", "CODIGO") | _any(k, "EAN", "GTIN", "BARRA", "BARCODE")))


def column_index(c: Column) -> Column:
    """The place from 0 of a spreadsheet column given by letters or by number from 1, up to 16384; null for others."""
    text = F.upper(F.trim(as_text(c)))
    letters = F.aggregate(F.split(text, ""), F.lit(0), lambda acc, x: F.when(x == "", acc).otherwise(acc * 26 + F.ascii(x) - 64))
    place = F.when(text.rlike("^[0-9]{1,6}$"), text.try_cast("int")).when(text.rlike("^[A-Z]{1,3}$"), letters)
    return F.when(place.between(1, 16384), place - 1)


def ean_in_name(c: Column) -> Column:
    """struct(ean, name): a barcode at a name's beginning, with a separator after it; ean is "" without one."""
    text = F.trim(as_text(c))
    form = r"^\s*['\"]?((?:\d[\s.-]?){8,14})\s*(?:[-–—:|]\s*)+(.+?)\s*$"
    code = F.regexp_replace(F.regexp_extract(text, form, 1), r"\D", "")
    name = F.trim(F.regexp_extract(text, form, 2))
    ok = F.length(code).between(8, 14) & (name != "")
    return F.struct(F.when(ok, code).otherwise(F.lit("")).alias("ean"), F.when(ok, name).otherwise(text).alias("name"))


# ---- sheets ----
def header_row(cells: DataFrame, term: int | None = None, first_of: int | None = None) -> DataFrame:
    """(file, sheet, row, name_col, ean_col, price_col, package_col): the best row of the first HEADER_ROWS as a header.

    A row counts 4 for a name column, 3 for a barcode and 2 for a price column; without a name it is none. With
    first_of it is the first of that many rows that has a name and a price column, as in price tables.
    """
    top = cells.where(F.col("row") <= (HEADER_ROWS if first_of is None else first_of - 1))
    kinds = {"name": (name_score(F.col("value")), NAME_LEAST), "ean": (ean_score(F.col("value")), EAN_LEAST), "price": (price_score(F.col("value"), term), PRICE_LEAST), "package": (package_score(F.col("value")), PACKAGE_LEAST)}
    top = top.withColumns({f"s_{k}": s for k, (s, _) in kinds.items()})
    best = lambda k, least: F.max_by("col", F.when(F.col(f"s_{k}") >= least, F.struct(f"s_{k}", -F.col("col"))))
    rows = top.groupBy("file", "sheet", "row").agg(*[best(k, least).alias(f"{k}_col") for k, (_, least) in kinds.items()])
    if first_of is not None:
        first_name = top.where(F.col("s_name") >= NAME_LEAST).groupBy("file", "sheet", "row").agg(F.min("col").alias("name_col"))
        both = rows.drop("name_col").where("price_col IS NOT NULL").join(first_name, ["file", "sheet", "row"])
        one = both.groupBy("file", "sheet").agg(F.min_by(F.struct("row", *[f"{k}_col" for k in kinds]), "row").alias("h"))
        return one.select("file", "sheet", "h.*")
    points = F.lit(4) + F.when(F.col("ean_col").isNotNull(), 3).otherwise(0) + F.when(F.col("price_col").isNotNull(), 2).otherwise(0)
    one = rows.where("name_col IS NOT NULL").groupBy("file", "sheet").agg(F.max_by(F.struct("row", *[f"{k}_col" for k in kinds]), F.struct(points, -F.col("row"))).alias("h"))
    return one.select("file", "sheet", "h.*")


def available_terms(cells: DataFrame, terms: tuple[int, ...] = TERMS) -> DataFrame:
    """(file, terms): the terms of the row of the first ten that names most of them, or [28]."""
    top = cells.where(F.col("row") <= 10)
    rows = top.groupBy("file", "row").agg(F.array_sort(F.array_compact(F.array(*[F.max(F.when(has_term(F.col("value"), t), F.lit(t))) for t in terms]))).alias("terms"))
    best = rows.groupBy("file").agg(F.max_by("terms", F.struct(F.size("terms"), -F.col("row"))).alias("terms"))
    return best.withColumn("terms", F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.array(F.lit(28))))


def inferred_ean_column(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, sheet, ean_col): the column whose first SAMPLE_ROWS values look most like barcodes, 80 % of them at least."""
    at = headers.select("file", "sheet", F.col("row").alias("header_row"))
    joined = cells.join(at, ["file", "sheet"])
    heads = joined.where("row = header_row").select("file", "sheet", "col", F.col("value").alias("header"))
    filled = ~F.lower(F.trim(as_text(F.col("value")))).isin("", "nan")
    sample = joined.where((F.col("row") > F.col("header_row")) & (F.col("row") <= F.col("header_row") + SAMPLE_ROWS) & filled)
    judged = sample.groupBy("file", "sheet", "col").agg(F.count(F.lit(1)).alias("n"), F.count_if(looks_like_ean(F.col("value"))).alias("hits"))
    judged = judged.join(heads, ["file", "sheet", "col"], "left").where(may_hold_eans(F.col("header")))
    least = F.when(nameless(F.col("header")), 2).otherwise(1)
    good = judged.withColumn("share", F.col("hits") / F.col("n")).where((F.col("hits") >= least) & (F.col("share") >= 0.8))
    return good.groupBy("file", "sheet").agg(F.max_by("col", F.struct("share", -F.col("col"))).alias("ean_col"))


def inferred_price_column(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, sheet, price_col): the last column with at least 3 prices, 30 % of its filled cells, below the header; else the last column."""
    joined = cells.join(headers.select("file", "sheet", F.col("row").alias("header_row")), ["file", "sheet"])
    below = (F.col("row") > F.col("header_row")) & (F.trim(as_text(F.col("value"))) != "")
    judged = joined.groupBy("file", "sheet", "col").agg(F.count_if(below).alias("n"), F.count_if(below & table_price(F.col("value")).isNotNull()).alias("prices"))
    priced = F.when(F.col("prices") >= F.greatest(F.lit(3), F.col("n") * 0.3), F.col("col"))
    return judged.groupBy("file", "sheet").agg(F.coalesce(F.max(priced), F.max("col")).alias("price_col"))


def base_table(cells: DataFrame) -> DataFrame:
    """A table of base prices for terms: file, sheet, row_no, name, ean, price. A header needs a name; the price column may be inferred."""
    headers = header_row(cells)
    guessed = inferred_price_column(cells, headers).withColumnRenamed("price_col", "__p")
    headers = headers.join(guessed, ["file", "sheet"], "left").withColumn("price_col", F.coalesce("price_col", "__p")).drop("__p")
    rows = sheet_rows(cells, headers)
    read = rows.select("file", "sheet", F.col("row").alias("row_no"), F.trim(as_text(F.col("name"))).alias("name"), clean_ean(F.col("code")).alias("ean"), table_price(F.col("price_text")).alias("price"))
    return read.where(~F.lower("name").isin(*MISSING) & F.col("price").isNotNull())


def sheet_rows(cells: DataFrame, headers: DataFrame, blank_rows: int = 200) -> DataFrame:
    """(file, sheet, row, name, code, price_text, package_text) below each header, up to a gap of blank_rows rows.

    headers as of header_row, with the columns' places. One shuffle of the cells by row pivots them.
    """
    joined = cells.join(headers.withColumnRenamed("row", "header_row"), ["file", "sheet"]).where("row > header_row")
    at = lambda c: F.max(F.when(F.col("col") == F.col(c), F.col("value")))
    rows = joined.groupBy("file", "sheet", "row", "header_row").agg(at("name_col").alias("name"), at("ean_col").alias("code"), at("price_col").alias("price_text"), at("package_col").alias("package_text"))
    filled = rows.where((F.trim(as_text(F.col("name"))) != "") | (F.trim(as_text(F.col("code"))) != ""))
    before = Window.partitionBy("file", "sheet").orderBy("row")
    gap = F.col("row") - F.coalesce(F.lag("row").over(before), F.col("header_row")) > blank_rows
    cut = F.max(gap.cast("int")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return filled.withColumn("cut", cut).where("cut = 0").drop("cut", "header_row")


def price_table(cells: DataFrame, term: int = 28) -> DataFrame:
    """A price table's rows: file, sheet, row_no, name, ean, price, units (a package)."""
    headers = header_row(cells, term, PRICE_HEADER_ROWS)
    guessed = inferred_ean_column(cells, headers).withColumnRenamed("ean_col", "__e")
    headers = headers.join(guessed, ["file", "sheet"], "left").withColumn("ean_col", F.coalesce("ean_col", "__e")).drop("__e")
    rows = sheet_rows(cells, headers.where("price_col IS NOT NULL"))
    units = F.coalesce(package_units(F.col("package_text")), package_quantity(F.col("package_text")).cast("string"))
    named = ~F.lower(F.trim(as_text(F.col("name")))).isin(*MISSING)
    read = rows.select("file", "sheet", F.col("row").alias("row_no"), F.when(named, F.col("name")).alias("name"), clean_ean(F.col("code")).alias("ean"), table_price(F.col("price_text")).alias("price"), units.alias("units"))
    return read.where((F.col("name").isNotNull() | (F.col("ean") != "")) & F.col("price").isNotNull())


def quote_items(cells: DataFrame) -> DataFrame:
    """A quote's items: file, sheet, row_no, name, code, current (price text), price_col; catalogue-like sheets are left out."""
    headers = header_row(cells)
    guessed = inferred_ean_column(cells, headers).withColumnRenamed("ean_col", "__e")
    headers = headers.join(guessed, ["file", "sheet"], "left").withColumn("ean_col", F.coalesce("ean_col", "__e")).drop("__e")
    rows = sheet_rows(cells, headers)
    size = rows.groupBy("file", "sheet").agg(F.count(F.lit(1)).alias("n"))
    quotes = headers.join(size, ["file", "sheet"]).where("NOT (ean_col IS NULL AND price_col IS NULL AND n > 500)").select("file", "sheet", "price_col", "ean_col")
    rows = rows.join(quotes, ["file", "sheet"])
    split = ean_in_name(F.col("name"))
    lacks = as_text(F.col("code")).isin("", "nan")
    out = rows.withColumn("__x", split).select("file", "sheet", F.col("row").alias("row_no"), F.when(lacks, F.col("__x.name")).otherwise(F.trim(as_text(F.col("name")))).alias("name"), F.when(lacks, F.col("__x.ean")).otherwise(F.col("code")).alias("code"), F.col("price_text").alias("current"), "price_col")
    return out.where((F.col("name") != "") | (clean_ean(F.col("code")) != ""))


# ---- the workbook of a weekly campaign ----
AWARD_COLUMNS = (5, 9, 13, 17, 21, 25)


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _seller(c: Column) -> Column:
    """A seller's code: digits, also as 12.0."""
    text = F.regexp_replace(F.trim(as_text(c)), r"\.0$", "")
    return F.when(text.rlike(r"^\d+$"), text)


def _cell(cells: DataFrame, row: int, col: Column | int):
    return F.max(F.when((F.col("row") == row) & (F.col("col") == col), F.col("value")))


def campaign_suppliers(cells: DataFrame, sheet: str) -> DataFrame:
    """(file, block, supplier, goal, realised, remaining, percent) of the award sheet's blocks with a name and a goal. Rows and columns count from 1."""
    own = cells.where(F.col("sheet") == sheet)
    blocks = own.withColumn("block", F.explode(F.array(*[F.lit(c) for c in AWARD_COLUMNS]))).where(F.col("col").between(F.col("block"), F.col("block") + 1) & F.col("row").between(6, 8))
    read = blocks.groupBy("file", "block").agg(_cell(own, 6, F.col("block")).alias("supplier"), _cell(own, 8, F.col("block") + 1).alias("goal"), _cell(own, 7, F.col("block") + 1).alias("realised"))
    read = read.withColumns({"supplier": F.trim(as_text(F.col("supplier"))), "goal": _number(F.col("goal")), "realised": _number(F.col("realised"))})
    read = read.where(~F.col("supplier").isin("", "#N/A") & (F.col("goal") > 0))
    return read.withColumns({"remaining": F.greatest(F.col("goal") - F.col("realised"), F.lit(0.0)), "percent": F.col("realised") / F.col("goal") * 100})


def campaign_sellers(cells: DataFrame, sheet: str) -> DataFrame:
    """(file, code, name, total_prize, block, prize, sales, boxes): one row a seller and a block of the award sheet."""
    own = cells.where((F.col("sheet") == sheet) & (F.col("row") >= 10))
    at = lambda c: F.max(F.when(F.col("col") == c, F.col("value")))
    wide = own.groupBy("file", "row").agg(at(1).alias("c1"), at(2).alias("c2"), at(4).alias("c4"), *[at(b + k).alias(f"b{b}_{k}") for b in AWARD_COLUMNS for k in range(3)])
    wide = wide.withColumn("code", _seller(F.col("c1"))).where("code IS NOT NULL")
    last = wide.groupBy("file", "code").agg(F.max_by(F.struct("*"), "row").alias("w")).select("w.*")
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), _number(F.col(f"b{b}_0")).alias("prize"), _number(F.col(f"b{b}_1")).alias("sales"), _number(F.col(f"b{b}_2")).alias("boxes")) for b in AWARD_COLUMNS])
    return last.select("file", "code", F.trim(as_text(F.col("c2"))).alias("name"), _number(F.col("c4")).alias("total_prize"), F.explode(blocks).alias("x")).select("file", "code", "name", "total_prize", "x.*")


def campaign_industries(cells: DataFrame, sheet: str) -> DataFrame:
    """(file, industry, code, minimum, sales, client_target, clients) of the other sheets, for sellers of the award sheet."""
    others = cells.where(F.col("sheet") != sheet)
    head = others.where((F.col("col") == 3) & (F.col("row") <= 20) & (F.upper(F.trim(as_text(F.col("value")))) == "RCA")).groupBy("file", "sheet").agg(F.min("row").alias("head"))
    at = lambda c: F.max(F.when(F.col("col") == c, F.col("value")))
    rows = others.join(head, ["file", "sheet"]).where("row > head").groupBy("file", "sheet", "row").agg(*[at(c).alias(f"c{c}") for c in (3, 6, 7, 8, 9)])
    rows = rows.withColumn("code", _seller(F.col("c3"))).where("code IS NOT NULL")
    last = rows.groupBy("file", "sheet", "code").agg(F.max_by(F.struct("c6", "c7", "c8", "c9"), "row").alias("w"))
    out = last.select("file", F.col("sheet").alias("industry"), "code", _number(F.col("w.c6")).alias("minimum"), _number(F.col("w.c7")).alias("sales"), _number(F.col("w.c8")).alias("client_target"), _number(F.col("w.c9")).alias("clients"))
    return out.join(campaign_sellers(cells, sheet).select("file", "code").distinct(), ["file", "code"], "left_semi")
