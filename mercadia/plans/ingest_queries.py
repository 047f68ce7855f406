"""Queries on sheets, lists and contact files made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercadia.functions.prices import package_quantity, package_units
from mercadia.plans.registry import query
from mercadia.plans.views import SQL_CLIENTS, SQL_PRICES, clients, price_rows, table
from mercadia.sources import lists, sheets

_NUMBERED = f"{SQL_PRICES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY row_no) - 1 AS n FROM price_rows)"
_HEADERS = ("Produto", "Cód. Produto", "EAN", "EAN Caixa", "Código de Barras", "Preço", "R$ Unit.", "Total R$", "Qtde CX", "28 dias", "Descrição", "VR_VENDA", "Emb.", "")
_SCORES = {  # name, ean, price at 28 days, package
    "Produto": (80, 0, 0, 0), "Cód. Produto": (0, 0, 0, 0), "EAN": (0, 100, 0, 0), "EAN Caixa": (0, 90, 0, 0), "Código de Barras": (0, 95, 0, 0), "Preço": (0, 0, 60, 0), "R$ Unit.": (0, 0, 95, 0),
    "Total R$": (0, 0, 0, 0), "Qtde CX": (0, 0, 0, 96), "28 dias": (0, 0, 100, 0), "Descrição": (100, 0, 0, 0), "VR_VENDA": (0, 0, 55, 0), "Emb.": (0, 0, 0, 84), "": (0, 0, 0, 0),
}


def _case(i: int) -> str:
    return "CASE header " + " ".join(f"WHEN '{h}' THEN {s[i]}" for h, s in _SCORES.items()) + " END"


@query(f"""WITH h AS (SELECT p_partkey, [{", ".join(f"'{h}'" for h in _HEADERS)}][p_partkey % {len(_HEADERS)} + 1] AS header FROM part)
    SELECT p_partkey, header, CAST({_case(0)} AS INTEGER) AS name, CAST({_case(1)} AS INTEGER) AS ean, CAST({_case(2)} AS INTEGER) AS price, CAST({_case(3)} AS INTEGER) AS package FROM h""")
def q_header_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("header")
    t = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in _HEADERS]), (F.col("p_partkey") % len(_HEADERS) + 1).cast("int")).alias("header"))
    return t.select("p_partkey", "header", sheets.name_score(h).alias("name"), sheets.ean_score(h).alias("ean"), sheets.price_score(h, 28).alias("price"), sheets.package_score(h).alias("package"))


def _place(by: Column) -> Column:
    """Places from 0 of rows in order of row_no."""
    return F.row_number().over(Window.partitionBy(by).orderBy("row_no")) - 1


def price_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price tables as cells, one file a brand: a preamble, headers at row 3, codes under a header that doesn't tell them, no price in every 7th row."""
    p = price_rows(spark, sf_dir)
    own = p.select(F.col("p_brand").alias("file"), F.lit("t").alias("sheet"), (_place(F.col("p_brand")) + 4).cast("long").alias("row"), "name", "ean", "price", "p_size", "row_no")
    price = F.when(F.col("row_no") % 7 == 0, F.lit("-")).otherwise(F.concat(F.lit("R$ "), F.translate(F.format_string("%.2f", "price"), ".", ",")))
    values = [(0, F.col("name")), (1, F.col("ean")), (2, price), (3, F.concat(F.lit("CX-"), F.col("p_size")))]
    cells = own.select("file", "sheet", "row", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in values])).alias("x")).select("file", "sheet", "row", "x.*")
    top = [(1, 0, "Tabela"), (3, 0, "Descrição"), (3, 1, "Código"), (3, 2, "R$ Unit."), (3, 3, "Embalagem")]
    head = p.select(F.col("p_brand").alias("file")).distinct().select("file", F.lit("t").alias("sheet"), F.explode(F.array(*[F.struct(F.lit(r).cast("long").alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in top])).alias("x")).select("file", "sheet", "x.*")
    return cells.unionByName(head)


@query(f"WITH {_NUMBERED} SELECT p_brand AS file, n + 4 AS row_no, name, ean, price, CAST(p_size AS VARCHAR) AS units FROM numbered WHERE row_no % 7 <> 0")
def q_price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = price_cells(spark, sf_dir)
    return sheets.price_table(cells).drop("sheet")


@query(f"WITH {SQL_PRICES} SELECT DISTINCT p_brand AS file, 1 AS ean_col FROM price_rows")
def q_ean_column_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = price_cells(spark, sf_dir)
    return sheets.inferred_ean_column(cells, sheets.header_row(cells)).select("file", "ean_col")


@query(f"WITH {_NUMBERED} SELECT p_brand AS file, n + 4 AS row_no, name, ean AS code FROM numbered")
def q_quote_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sheets as quotes, whose names hold the codes."""
    cells = price_cells(spark, sf_dir).where("NOT (col = 1)")
    eans = price_rows(spark, sf_dir).select(F.col("p_brand").alias("file"), (_place(F.col("p_brand")) + 4).cast("long").alias("row"), "ean")
    named = cells.join(eans, ["file", "row"], "left").withColumn("value", F.when((F.col("col") == 0) & F.col("ean").isNotNull(), F.concat_ws(" - ", "ean", "value")).otherwise(F.col("value"))).drop("ean")
    return sheets.quote_items(named).select("file", "row_no", "name", "code")


@query("SELECT p_brand AS file, '7,28' AS terms FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#1') UNION ALL SELECT 'Brand#1', '28' FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand = 'Brand#1')")
def q_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file")).distinct()
    values = F.when(F.col("file") != "Brand#1", F.array(F.lit("Produto"), F.lit("07 dias"), F.lit("28"))).otherwise(F.array(F.lit("Produto"), F.lit("Preço")))
    cells = files.select("file", F.lit("t").alias("sheet"), F.lit(2).cast("long").alias("row"), F.posexplode(values).alias("col", "value"))
    return sheets.available_terms(cells).withColumn("terms", F.concat_ws(",", "terms"))


@query("SELECT p_partkey, CASE WHEN p_partkey <= 16383 THEN CAST(p_partkey AS INTEGER) END AS place, CAST(p_partkey % 26 AS INTEGER) AS letter FROM part")
def q_column_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.char((F.col("p_partkey") % 26 + 65).cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", sheets.column_index((F.col("p_partkey") + 1).cast("string")).alias("place"), sheets.column_index(letter).alias("letter"))


# ---- lists ----
def _list(spark: SparkSession, sf_dir: str, line, separator: str = "\n") -> DataFrame:
    """One list a brand: a line a part, in order of its key."""
    p = price_rows(spark, sf_dir).withColumn("line", line)
    rows = F.array_sort(F.collect_list(F.struct("row_no", "line")))
    return p.groupBy(F.col("p_brand").alias("list_id")).agg(F.array_join(F.transform(rows, lambda x: x["line"]), separator).alias("text"))


def _named() -> Column:
    return F.upper("p_name")


def _money(c) -> Column:
    return F.translate(F.format_string("%.2f", c), ".", ",")


_TOTAL = "CAST(round(CAST(price AS DECIMAL(18,2)) * p_size, 2) AS DOUBLE)"


@query(f"WITH {_NUMBERED} SELECT p_brand AS list_id, CAST(n AS INTEGER) AS item_no, upper(p_name) AS name, 'CX' AS unit, p_size AS units, price AS unit_price, {_TOTAL} AS price, NULL::VARCHAR AS ean, 'Mercearia' AS category FROM numbered")
def q_inline_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.inline_items(_list(spark, sf_dir, F.concat(_named(), F.lit(" CX-"), "p_size", F.lit(" "), _money("price"))))


@query(f"WITH {_NUMBERED} SELECT p_brand AS list_id, CAST(2 * n AS INTEGER) AS item_no, upper(p_name) AS name, 'FD' AS unit, p_size AS units, price AS unit_price, {_TOTAL} AS price, NULL::VARCHAR AS ean, 'Mercearia' AS category FROM numbered")
def q_two_line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.two_line_items(_list(spark, sf_dir, F.concat(_named(), F.lit(" FD-"), "p_size", F.lit("\n"), _money("price"))))


@query(f"WITH {_NUMBERED} SELECT p_brand AS list_id, CAST(n AS INTEGER) AS item_no, upper(p_name) AS name, 'CX' AS unit, p_size AS units, price AS unit_price, {_TOTAL} AS price, NULL::VARCHAR AS ean, 'Mercearia' AS category FROM numbered")
def q_compact_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.compact_items(_list(spark, sf_dir, F.concat(_named(), F.lit(" CX-"), "p_size", F.lit(" "), _money("price")), " "))


@query(f"WITH {_NUMBERED} SELECT p_brand AS list_id, CAST(n + 1 AS INTEGER) AS item_no, upper(p_name) AS name, 'PCT' AS unit, p_size AS units, price AS unit_price, price * 2 AS price, NULL::VARCHAR AS ean, 'Mercearia' AS category FROM numbered")
def q_csv_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(";", _named(), _money("price"), _money(F.col("price") * 2), F.concat(F.lit("PCT-"), "p_size"))
    made = _list(spark, sf_dir, line)
    return lists.csv_items(made.withColumn("text", F.concat(F.lit("Produto;Preço unitário;Preço caixa;Embalagem\n"), "text")))


@query(f"WITH {_NUMBERED} SELECT p_brand AS list_id, CAST(n AS INTEGER) AS item_no, upper(p_name) AS name, 'UN' AS unit, NULL::INTEGER AS units, NULL::DOUBLE AS unit_price, price, ean, 'Mercearia' AS category FROM numbered")
def q_free_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.free_items(_list(spark, sf_dir, F.concat(_named(), F.lit(" "), "ean", F.lit("  R$ "), _money("price"))))


@query(f"""WITH {_NUMBERED}, b AS (SELECT p_brand, count(*) AS n FROM price_rows GROUP BY 1) SELECT p_brand AS list_id, n AS items,
    CASE CAST(substr(p_brand, 7) AS INTEGER) % 4 WHEN 0 THEN 'compact' WHEN 1 THEN 'two_line' WHEN 2 THEN 'csv' ELSE 'free' END AS form FROM b""")
def q_parse_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each list by the first form that fits: packages with prices are compact even over several lines."""
    kind = F.substring("p_brand", 7, 9).cast("int") % 4
    line = (
        F.when(kind == 0, F.concat(_named(), F.lit(" CX-"), "p_size", F.lit(" "), _money("price")))
        .when(kind == 1, F.concat(_named(), F.lit("\n"), _money("price")))
        .when(kind == 2, F.concat_ws(";", _named(), F.concat(F.lit("CX-"), "p_size"), _money("price")))
        .otherwise(F.concat(_named(), F.lit(" "), "ean", F.lit(" "), _money("price")))
    )
    made = _list(spark, sf_dir, line)
    counts = lists.parse_lists(made).groupBy("list_id").agg(F.count(F.lit(1)).alias("items"))
    return lists.list_form(made).select("list_id", "form").join(counts, "list_id")


@query("""SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN p_size ELSE NULL END AS INTEGER) AS quantity,
    CASE WHEN p_partkey % 4 = 3 THEN replace(CAST(CAST(p_size + 0.5 AS DECIMAL(9,1)) AS VARCHAR), '.', ',') ELSE CAST(p_size AS VARCHAR) END AS units FROM part""")
def q_package_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, size = F.col("p_partkey") % 4, F.col("p_size")
    text = F.when(kind == 0, F.concat(F.lit("CX-"), size)).when(kind == 1, F.concat(size, F.lit("X750G"))).when(kind == 2, F.concat(F.lit("c/ "), size)).otherwise(F.concat(size, F.lit(",5KG")))
    return table(spark, sf_dir, "part").withColumn("t", text).select("p_partkey", package_quantity(F.col("t")).alias("quantity"), package_units(F.col("t")).alias("units"))


@query(f"WITH {SQL_PRICES} SELECT p_brand AS file, row_no * 2 AS line_no, upper(p_name) || ' extra' AS name, ean, price FROM price_rows")
def q_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = price_rows(spark, sf_dir)
    first = F.concat_ws(" ", F.concat(F.lit("1"), "row_no"), _named(), F.col("ean"), F.lit("UN"), _money("price"))
    two = F.array(F.struct((F.col("row_no") * 2).alias("line_no"), first.alias("text")), F.struct((F.col("row_no") * 2 + 1).alias("line_no"), F.lit("extra").alias("text")))
    return lists.document_rows(p.select(F.col("p_brand").alias("file"), F.explode(two).alias("x")).select("file", "x.*"))


@query(f"WITH {SQL_CLIENTS} SELECT CASE WHEN client_id % 5 = 4 THEN 0 ELSE 1 END AS valid, name || ' Silva' AS name, count(*) AS n FROM clients GROUP BY ALL")
def q_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = clients(spark, sf_dir).select(F.col("name").alias("First Name"), F.lit("Silva").alias("Last Name"), F.col("phone").alias("Phone 1 - Value"))
    return lists.contacts(file).groupBy(F.when(F.col("phone").isNull(), 0).otherwise(1).alias("valid"), "name").agg(F.count(F.lit(1)).alias("n"))


# ---- the weekly workbook ----
_SHEET = "Itens Premiados"


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook from suppliers: the award sheet, and a sheet of an industry's goals. Rows and columns count from 1."""
    s = table(spark, sf_dir, "supplier")
    cell = lambda sheet, row, col, value: F.struct(F.lit(sheet).alias("sheet"), row.cast("long").alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value"))
    row, key = F.col("s_suppkey") + 10, F.col("s_suppkey")
    seller = s.select(F.lit("w").alias("file"), F.explode(F.array(cell(_SHEET, row, 1, F.concat(key, F.lit(".0"))), cell(_SHEET, row, 2, F.col("s_name")), cell(_SHEET, row, 4, F.col("s_acctbal")), cell(_SHEET, row, 5, key * 2), cell(_SHEET, row, 6, key * 3), cell("Ind A", row + 5, 3, key + 1), cell("Ind A", row + 5, 6, key * 10), cell("Ind A", row + 5, 7, key * 11))).alias("x"))
    one = spark.range(1).select(F.lit("w").alias("file"), F.explode(F.array(cell(_SHEET, F.lit(6), 5, F.lit("Supplier X")), cell(_SHEET, F.lit(8), 6, F.lit("200")), cell(_SHEET, F.lit(7), 6, F.lit("50")), cell(_SHEET, F.lit(6), 9, F.lit("#N/A")), cell("Ind A", F.lit(4), 3, F.lit("rca")))).alias("x"))
    return seller.unionByName(one).select("file", "x.*")


@query("SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS code, s_acctbal AS total_prize, CAST(s_suppkey * 2 AS DOUBLE) AS prize, CAST(s_suppkey * 3 AS DOUBLE) AS sales, 'Supplier X' AS supplier, 25.0::DOUBLE AS percent FROM supplier")
def q_campaign_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = workbook_cells(spark, sf_dir)
    out = sheets.campaign_sellers(cells, _SHEET).join(sheets.campaign_suppliers(cells, _SHEET), ["file", "block"])
    return out.select(F.col("code").cast("long").alias("k"), "code", "total_prize", "prize", "sales", "supplier", "percent")


@query("SELECT CAST(s_suppkey + 1 AS VARCHAR) AS code, 'Ind A' AS industry, CAST(s_suppkey * 10 AS DOUBLE) AS minimum, CAST(s_suppkey * 11 AS DOUBLE) AS sales FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)")
def q_campaign_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.campaign_industries(workbook_cells(spark, sf_dir), _SHEET).select("code", "industry", "minimum", "sales")
