"""Queries on quotes, price tables and offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.functions.codes import clean_ean, clean_ean_offer, clean_ean_page, clean_ean_photo, unit_ean_of_dun14
from mercadia.functions.names import BrandRules, normalise_names
from mercadia.functions.prices import adjusted, discounted, merge_price, offer_price, offer_prices, page_price, price_text, table_price, typed_price
from mercadia.functions.text import search_key, sorted_words
from mercadia.operators import catalogue, fuzzy, matching
from mercadia.operators.locks import light_locks, strict_locks
from mercadia.operators.recognise import recognise
from mercadia.plans.registry import query
from mercadia.plans.views import ITEM_ID, SQL_MATCHED, SQL_PRICES, price_rows, quote_rows, spread, table
from mercadia.sources.sinks import first_empty_cells, result_cells, term_table

_ID = ", ".join(ITEM_ID)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = price_rows(spark, sf_dir).select("ean", "price", "row_no")
    out = matching.match_codes(quote_rows(spark, sf_dir), prices)
    return out.withColumn("price", matching.cheaper(F.col("table_price"), F.col("current")))


@query(f"WITH {SQL_MATCHED} SELECT {_ID}, current, table_price, price, CASE WHEN table_price IS NOT NULL THEN 'EAN' END AS kind FROM priced")
def q_ean_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select(*ITEM_ID, "current", "table_price", "price", "kind")


@query(f"""WITH {SQL_MATCHED} SELECT l_linenumber, count(*) AS total, count(*) FILTER (price IS NULL) AS no_match, count(*) FILTER (price IS NOT NULL) AS by_code,
       CAST(0 AS BIGINT) AS learned, CAST(0 AS BIGINT) AS manual, CAST(0 AS BIGINT) AS by_name FROM priced GROUP BY 1""")
def q_match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_stats(_matched(spark, sf_dir), "l_linenumber")


@query(f"""WITH {SQL_MATCHED} SELECT l_linenumber, count(*) AS total, count(*) FILTER (price IS NOT NULL AND (current IS NULL OR price < current)) AS filled,
       count(*) FILTER (price IS NOT NULL AND price >= current) AS kept, count(*) FILTER (price IS NULL) AS not_found FROM priced GROUP BY 1""")
def q_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.batch_stats(_matched(spark, sf_dir), "l_linenumber")


@query(f"""WITH {SQL_MATCHED} SELECT {_ID}, price, CASE WHEN price IS NULL THEN 'not_found' WHEN current IS NOT NULL AND price >= current THEN 'keep' ELSE 'update' END AS decision,
       CASE WHEN price IS NOT NULL AND (current IS NULL OR price < current) THEN replace(printf('%.2f', price), '.', ',') END AS written
       FROM priced WHERE (l_linenumber % 2 = 0 OR current IS NOT NULL) AND code IS NOT NULL""")
def q_only_cheaper(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = matching.to_match(quote_rows(spark, sf_dir).withColumns({"filled": F.col("l_linenumber") % 2 != 0, "name": F.lit("")}))
    out = matching.match_codes(items, price_rows(spark, sf_dir).select("ean", "price", "row_no"))
    price = matching.cheaper(F.col("table_price"), F.col("current"))
    out = out.withColumn("price", price)
    written = F.when(matching.should_update(F.col("price"), F.col("current")), price_text(F.col("price")))
    return out.select(*ITEM_ID, "price", matching.decision(F.col("price"), F.col("current")).alias("decision"), written.alias("written"))


@query(f"""WITH {SQL_MATCHED}, answers AS (
    SELECT {_ID}, t AS table_no, table_price * CASE t WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 + (l_suppkey % 10) / 10.0 ELSE 2.0 END AS price
    FROM matched, (SELECT unnest([1, 2, 3]) AS t) WHERE table_price IS NOT NULL AND (l_partkey + t) % 3 <> 0)
    SELECT {_ID}, price, table_no FROM (SELECT *, row_number() OVER (PARTITION BY {_ID} ORDER BY price, table_no) AS r FROM answers) WHERE r = 1""")
def q_multi_table_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match_codes(quote_rows(spark, sf_dir), price_rows(spark, sf_dir).select("ean", "price", "row_no")).where("table_price IS NOT NULL")
    answers = found.select(F.struct(*ITEM_ID).alias("item_id"), "table_price", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("table_no")).where("(item_id.l_partkey + table_no) % 3 <> 0")
    factor = F.when(F.col("table_no") == 1, 1.0).when(F.col("table_no") == 2, F.lit(0.5) + (F.col("item_id.l_suppkey") % 10) / 10.0).otherwise(2.0)
    best = matching.best_of_tables(answers.select("item_id", "table_no", (F.col("table_price") * factor).alias("price")))
    return best.select("item_id.*", "price", "table_no")


@query(f"""WITH {SQL_MATCHED} SELECT {_ID} FROM matched WHERE table_price IS NULL""")
def q_missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matched(spark, sf_dir).select(F.struct(*ITEM_ID).alias("item_id"), "price", "current", "code")
    update = matching.should_update(F.col("price"), F.col("current"))
    priced, kept = found.where(update), found.where(F.col("price").isNotNull() & ~update)
    return matching.missing_items(found.select("item_id"), priced, matching.kept_items(kept, priced)).select("item_id.*")


@query(f"""WITH {SQL_MATCHED} SELECT {_ID}, CASE WHEN table_price IS NULL THEN current WHEN current > 0 THEN least(least(table_price, table_price * 0.75), current) ELSE least(table_price, table_price * 0.75) END AS price FROM matched""")
def q_table_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = price_rows(spark, sf_dir).select("ean", "price", "row_no")
    tables = [prices, prices.withColumn("price", F.col("price") * 0.75)]
    return matching.over_tables(quote_rows(spark, sf_dir), tables).select(*ITEM_ID, "price")


@query(f"""WITH {SQL_PRICES}, terms AS (SELECT unnest([7, 14, 21, 28, 35, 42]) AS term)
    SELECT name, row_no, CAST(term AS INTEGER) AS term, CAST(round(CAST(price AS DECIMAL(12,4)) * CAST(100 + term / 7.0 AS DECIMAL(8,2)) * CAST(0.01 AS DECIMAL(4,2)), 2) AS DOUBLE) AS term_price FROM price_rows, terms""")
def q_term_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = price_rows(spark, sf_dir)
    wide = term_table(prices, {7 * n: float(n) for n in range(1, 7)})
    wide = prices.select("name", "ean", "row_no").join(wide.drop("name"), "ean")
    terms = F.array(*[F.struct(F.lit(7 * n).alias("term"), F.col(f"term_{7 * n}").cast("double").alias("term_price")) for n in range(1, 7)])
    return wide.select("name", "row_no", F.explode(terms).alias("t")).select("name", "row_no", "t.term", "t.term_price")


@query(f"""WITH {SQL_MATCHED}, results AS (
    SELECT l_suppkey AS user_id, CAST(l_partkey AS VARCHAR) AS name_key, l_orderkey, l_linenumber, l_extendedprice, price, CASE WHEN price IS NOT NULL THEN 'EAN' END AS kind FROM priced),
    taught AS (SELECT user_id, name_key, l_extendedprice AS price, l_linenumber <> 4 AS confirmed, l_orderkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS updated_at FROM results WHERE price IS NULL),
    learned AS (SELECT user_id, name_key, price FROM (SELECT *, row_number() OVER (PARTITION BY user_id, name_key ORDER BY updated_at DESC, price DESC) AS r FROM taught) WHERE r = 1 AND confirmed)
    SELECT r.user_id, r.name_key, r.l_orderkey, r.l_linenumber, r.l_extendedprice, coalesce(l.price, r.price) AS price, CASE WHEN l.price IS NOT NULL THEN 'LEARNED' ELSE r.kind END AS kind
    FROM results r LEFT JOIN learned l USING (user_id, name_key)""")
def q_learned_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _matched(spark, sf_dir).select(F.col("l_suppkey").alias("user_id"), F.lit("1").alias("table_id"), F.col("l_partkey").cast("string").alias("name_key"), "l_orderkey", "l_linenumber", "l_extendedprice", "price", "kind")
    stamp = F.col("l_orderkey") * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long")
    # a review of what found no price: typed prices, of which those of line 4 are refused
    typed = base.where("price IS NULL").withColumns({"edited": F.col("l_extendedprice"), "approved": F.lit(True), "updated_at": stamp})
    lessons = matching.lessons(matching.reviewed(typed).withColumn("approved", F.col("l_linenumber") != 4))
    return matching.with_learned(base, lessons).drop("table_id")


@query(f"""WITH {SQL_PRICES}, items AS (SELECT row_no, lower(name) AS name, CASE WHEN row_no % 2 = 0 THEN ean ELSE '' END AS ean, price AS old_price FROM price_rows),
    by_name AS (SELECT lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')) AS k, any_value(price) AS price FROM price_rows GROUP BY 1 HAVING count(*) = 1)
    SELECT i.row_no, i.name, old_price, CASE WHEN i.ean <> '' THEN p.price ELSE n.price END AS new_price
    FROM items i LEFT JOIN price_rows p ON i.ean = p.ean LEFT JOIN by_name n ON regexp_replace(i.name, '[^a-z0-9]+', ' ', 'g') = n.k""")
def q_price_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = price_rows(spark, sf_dir)
    items = prices.select("row_no", F.lower("name").alias("name"), F.when(F.col("row_no") % 2 == 0, F.col("ean")).otherwise("").alias("ean"), F.col("price").alias("old_price"))
    return catalogue.refreshed_prices(items, prices.select("ean", "name", "price")).select("row_no", "name", "old_price", "new_price")


@query(f"""WITH {SQL_PRICES} SELECT row_no, CASE WHEN row_no % 2 = 0 THEN 'learned/' || ean WHEN row_no % 3 = 0 THEN 'bank/' || ean WHEN row_no % 5 = 0 THEN 'candidate/' || ean END AS photo FROM price_rows""")
def q_photo_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = price_rows(spark, sf_dir).select("row_no", "ean")
    of = lambda n, label: p.where(F.col("row_no") % n == 0).select("ean", F.concat(F.lit(label), "ean").alias("url"))
    return catalogue.photos(p, of(2, "learned/"), of(3, "bank/"), of(5, "candidate/")).select("row_no", "photo")


@query(f"""WITH {SQL_PRICES}, images AS (SELECT p_name AS name, row_no % 7 AS created_by, row_no % 11 AS selected, price AS updated_at, 'img/' || row_no AS url FROM price_rows)
    SELECT name, url FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY (created_by = 3)::INTEGER DESC, selected DESC, updated_at DESC, url DESC) AS r FROM images) WHERE r = 1""")
def q_learned_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = price_rows(spark, sf_dir)
    images = p.select(F.col("p_name").alias("name"), (F.col("row_no") % 7).alias("created_by"), (F.col("row_no") % 11).alias("selected"), F.col("price").alias("updated_at"), F.concat(F.lit("img/"), "row_no").alias("url"))
    return catalogue.learned_image(images, 3)


@query(f"""WITH {SQL_PRICES} SELECT row_no, list_aggregate(list_sort(regexp_extract_all(name, '[A-Z0-9.]+')), 'string_agg', ' ') AS words,
    trim(lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g'))) AS key FROM price_rows""")
def q_word_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_rows(spark, sf_dir).select("row_no", sorted_words(F.col("name")).alias("words"), search_key(F.col("name")).alias("key"))


_TEXTS = ("12,5", "R$ 3,99", "1.234,56", "3.121", "1.234.567", "7", "abc", "-4,20", "0")
_SQL_TEXTS = ", ".join(f"'{t}'" for t in _TEXTS)


@query(f"""WITH t AS (SELECT p_partkey, [{_SQL_TEXTS}][p_partkey % 9 + 1] AS s FROM part), u AS (
    SELECT *, replace(replace(s, 'R$', ''), ' ', '') AS b, regexp_replace(s, '[^0-9,.-]', '', 'g') AS d FROM t), v AS (
    SELECT *, TRY_CAST(replace(b, ',', '.') AS DOUBLE) AS plain FROM u)
    SELECT p_partkey, s AS price_text, CASE WHEN plain > 0 THEN plain END AS as_table, plain AS as_offer,
           CASE WHEN contains(b, ',') THEN TRY_CAST(replace(replace(b, '.', ''), ',', '.') AS DOUBLE) WHEN b = '1.234.567' THEN 1234.567 ELSE TRY_CAST(b AS DOUBLE) END AS as_page,
           CASE WHEN s IN ('abc', '-4,20', '0') THEN NULL WHEN s = '3.121' THEN 3121.0 WHEN s = '1.234.567' THEN 1234567.0 ELSE TRY_CAST(replace(replace(d, '.', ''), ',', '.') AS DOUBLE) END AS as_merge,
           coalesce(TRY_CAST(replace(replace(d, '.', ''), ',', '.') AS DOUBLE), 0.0) AS as_typed FROM v""")
def q_price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in _TEXTS]), (F.col("p_partkey") % 9 + 1).cast("int")).alias("price_text"))
    c = F.col("price_text")
    return t.select("p_partkey", "price_text", table_price(c).alias("as_table"), offer_price(c).alias("as_offer"), page_price(c).alias("as_page"), merge_price(c).alias("as_merge"), typed_price(c).alias("as_typed"))


@query("""SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(12,4)) * CAST(100 - p_size AS DECIMAL(8,2)) * CAST(0.01 AS DECIMAL(4,2)), 2) AS DOUBLE) AS discounted,
    CASE WHEN p_size % 5 = 0 THEN p_retailprice ELSE floor(p_retailprice * (1 + (p_size % 5) / 100.0::DOUBLE) * 100 + 0.5) / 100 END AS adjusted,
    CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE CAST(p_size AS DOUBLE) END AS unit_price, CAST(p_size AS INTEGER) AS units,
    CAST(CAST(CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE p_size END AS DECIMAL(18,2)) * p_size AS DOUBLE) AS package_price FROM part""")
def q_price_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    price, size = F.col("p_retailprice"), F.col("p_size")
    both = offer_prices(F.when(size % 3 == 0, F.lit(0)).otherwise(size), price, size)
    return p.select("p_partkey", discounted(price, size).cast("double").alias("discounted"), adjusted(price, size % 5).alias("adjusted"), both["unit_price"].alias("unit_price"), size.cast("int").alias("units"), both["price"].alias("package_price"))


@query(f"""WITH {SQL_PRICES}, t AS (SELECT row_no, ean, CASE row_no % 6 WHEN 0 THEN ' ' || ean || ' ' WHEN 1 THEN ean || '.0' WHEN 2 THEN substr(ean, 1, 7) || '-' || substr(ean, 8) WHEN 3 THEN '123' WHEN 4 THEN 'none' ELSE 'cod ' || ean || ' x1' END AS code FROM price_rows)
    SELECT row_no, CASE WHEN row_no % 6 IN (3, 4) THEN '' WHEN row_no % 6 = 5 THEN ean || '1' ELSE ean END AS as_table,
           CASE WHEN row_no % 6 IN (3, 4) THEN '' WHEN row_no % 6 = 5 THEN ean || '1' ELSE ean END AS as_page,
           CASE WHEN row_no % 6 IN (3, 4) THEN '' WHEN row_no % 6 = 1 THEN ean || '0' WHEN row_no % 6 = 5 THEN ean || '1' ELSE ean END AS as_offer,
           CASE WHEN row_no % 6 IN (3, 4) THEN '' WHEN row_no % 6 = 1 THEN ean || '0' WHEN row_no % 6 = 5 THEN ean || '1' ELSE ean END AS as_photo,
           CASE WHEN row_no % 6 = 5 THEN substr(ean, 2, 12) ELSE '' END AS unit_core FROM t""")
def q_clean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, e = price_rows(spark, sf_dir), F.col("ean")
    kind = F.col("row_no") % 6
    code = (
        F.when(kind == 0, F.concat(F.lit(" "), e, F.lit(" ")))
        .when(kind == 1, F.concat(e, F.lit(".0")))
        .when(kind == 2, F.concat_ws("-", F.substring(e, 1, 7), F.substring(e, 8, 6)))
        .when(kind == 3, F.lit("123"))
        .when(kind == 4, F.lit("none"))
        .otherwise(F.concat(F.lit("cod "), e, F.lit(" x1")))
    )
    c = F.col("code")
    return p.withColumn("code", code).select("row_no", clean_ean(c).alias("as_table"), clean_ean_page(c).alias("as_page"), clean_ean_offer(c).alias("as_offer"), clean_ean_photo(c).alias("as_photo"), F.substring(unit_ean_of_dun14(clean_ean(c)), 1, 12).alias("unit_core"))


@query(f"""WITH {SQL_MATCHED} SELECT l_orderkey % 16 AS file, CAST(l_linenumber AS INTEGER) AS sheet, l_orderkey AS row, CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE 8 END AS col, count(*) AS cells, min(price) AS lowest
    FROM priced WHERE price IS NOT NULL GROUP BY ALL""")
def q_result_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _matched(spark, sf_dir).select((F.col("l_orderkey") % 16).alias("file"), F.col("l_linenumber").cast("int").alias("sheet"), F.col("l_orderkey").alias("row_no"), "price", F.when(F.col("l_linenumber") % 2 == 0, F.lit(5)).alias("price_col"))
    cells = items.select("file", "sheet").distinct().withColumn("col", F.explode(F.array(F.lit(0), F.lit(7))))
    return result_cells(items, cells).groupBy("file", "sheet", "row", "col").agg(F.count(F.lit(1)).alias("cells"), F.min("value").alias("lowest"))


# sheets of orders: a line's number is a column that is taken, unless its quantity leaves it blank
@query("""
    WITH s AS (SELECT DISTINCT l_orderkey % 16 AS file, l_orderkey AS row, CAST(l_orderkey % 3 + 1 AS INTEGER) AS start_col, CASE WHEN l_orderkey % 5 = 0 THEN 2 END AS price_col FROM lineitem),
    c AS (SELECT l_orderkey AS row, l_linenumber AS col FROM lineitem WHERE l_quantity >= 10),
    f AS (SELECT s.row, min(k) AS first FROM (SELECT row, unnest(range(start_col, start_col + 9)) AS k FROM s) AS s LEFT JOIN c ON c.row = s.row AND c.col = k WHERE c.col IS NULL GROUP BY ALL)
    SELECT file, s.row, coalesce(price_col, CAST(first AS INTEGER)) AS col FROM s JOIN f ON f.row = s.row""")
def q_first_empty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 16).alias("file"), F.lit(1).alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("int").alias("col"), F.when(F.col("l_quantity") >= 10, "x").otherwise(" ").alias("value"))
    rows = line.select("file", "sheet", "row", F.when(F.col("row") % 5 == 0, F.lit(2)).alias("price_col"), (F.col("row") % 3 + 1).cast("int").alias("start_col")).distinct()
    return first_empty_cells(rows, line).select("file", "row", "col")


@query("""SELECT l_orderkey AS cart_id, count(*) AS lines, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS INTEGER)) AS DOUBLE) AS total
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 4 <> 0 GROUP BY 1""")
def q_cart_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").where(F.col("p_size") % 4 != 0).select(F.col("p_partkey").alias("item_id"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    cart = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cart_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("int").alias("quantity"))
    return catalogue.cart_totals(cart, items).withColumn("total", F.col("total").cast("double"))


@query("""SELECT p_brand AS offer_id, p_partkey AS item_id, CASE WHEN p_size <= 10 THEN row_number() OVER (PARTITION BY p_brand, p_size <= 10 ORDER BY p_retailprice DESC, p_partkey) - 1 ELSE p_size END AS sort_order FROM part""")
def q_reorder_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    items = p.select(F.col("p_brand").alias("offer_id"), F.col("p_partkey").alias("item_id"), F.col("p_size").cast("long").alias("sort_order"))
    chosen = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("r"), "p_partkey"))), lambda x: x["p_partkey"])
    order = p.where("p_size <= 10").groupBy(F.col("p_brand").alias("offer_id")).agg(chosen.alias("item_ids"))
    return catalogue.reordered(items, order).select("offer_id", "item_id", F.col("sort_order").cast("long").alias("sort_order"))


# ---- names: rows that SQL can't express; tests/ holds them against brute force and cases ----
def _table_id() -> Column:
    return F.concat_ws("/", "p_brand", "p_type").alias("table_id")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_id, name, price, row_no) with names in normal form: one price table a brand and type."""
    p = price_rows(spark, sf_dir).withColumn("raw", F.concat_ws(" ", F.col("name"), F.concat(F.col("p_size"), F.lit(" gramas"))))
    return normalise_names(p, "raw", "norm").select(_table_id(), F.col("norm").alias("name"), "price", "row_no")


def brand_rules(spark: SparkSession, sf_dir: str) -> BrandRules:
    """The test tables' brands by the last word of product names."""
    p = table(spark, sf_dir, "part")
    return BrandRules.from_table(p.select(F.upper(F.substring_index("p_name", " ", -1)).alias("category"), F.upper("p_brand").alias("brand")).distinct())


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as buyers write them: words swapped, a word missing, or another size."""
    p = price_rows(spark, sf_dir)
    kind = F.col("row_no") % 3
    words = F.split("p_name", " ")
    raw = F.when(kind == 0, F.concat_ws(" ", "p_brand", "p_name")).when(kind == 1, F.concat_ws(" ", words[1], "p_brand")).otherwise(F.concat_ws(" ", "p_name", "p_brand", F.concat(F.col("p_size") + 1, F.lit("G"))))
    return normalise_names(p.withColumn("raw", raw), "raw", "norm").select(_table_id(), F.col("norm").alias("name"))


@query()
def q_normalise_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))


@query()
def q_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.match_names(_quoted(spark, sf_dir), _names(spark, sf_dir), brand_rules(spark, sf_dir))


# plain names of parts, one table a brand, and the same as buyers write them; a name stands for its first part
_PLAIN_SQL = r"""
    n AS (SELECT p_brand AS table_id, upper(concat_ws(' ', p_name, replace(p_brand, '#', ' '), p_type, CAST(p_size AS VARCHAR) || 'G')) AS name, min(p_partkey) AS row_no FROM part GROUP BY ALL),
    q AS (SELECT DISTINCT p_brand AS table_id, upper(CASE p_partkey % 3 WHEN 0 THEN concat_ws(' ', p_type, p_name) WHEN 1 THEN concat_ws(' ', p_name, CAST(p_size + 1 AS VARCHAR) || 'G') ELSE concat_ws(' ', p_type, p_brand) END) AS quoted FROM part),
    w AS (SELECT table_id, quoted, name, row_no, list_sort(list_distinct(string_split(quoted, ' '))) AS a, list_sort(list_distinct(string_split(name, ' '))) AS b FROM q JOIN n USING (table_id)),
    s AS (SELECT *, list_sort(list_intersect(a, b)) AS c FROM w),
    t AS (
        SELECT table_id, quoted, name, row_no, array_to_string(list_sort(string_split(quoted, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(name, ' ')), ' ') AS sb, array_to_string(c, ' ') AS cw,
               concat_ws(' ', nullif(array_to_string(c, ' '), ''), nullif(array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ' '), '')) AS wa,
               concat_ws(' ', nullif(array_to_string(c, ' '), ''), nullif(array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ' '), '')) AS wb
        FROM s
    ), m AS (
        SELECT *, {lcs_set} AS lcs_set, {lcs_sort} AS lcs_sort FROM t
    ), r AS (
        SELECT table_id, quoted, name, row_no, 200.0 * lcs_sort / (length(sa) + length(sb)) AS by_sort,
               CASE WHEN cw <> '' AND (cw = wa OR cw = wb) THEN 100.0
                    ELSE greatest(200.0 * lcs_set / (length(wa) + length(wb)), 200.0 * length(cw) / (length(cw) + least(length(wa), length(wb)))) END AS by_set
        FROM m
    )
"""


def _lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence by the bits of a's places: a letter of b moves each row's lowest free match."""
    places = f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] = c THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END), lambda x, y: x | y, 0::HUGEINT)"
    every = f"((1::HUGEINT << length({a})::INT) - 1)"
    rows = f"list_reduce(list_transform(string_split({b}, ''), lambda c: {places}), lambda r, h: ((r + (r & h)) | (r - (r & h))) & {every}, {every})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({rows}) END"


_PLAIN_SQL = _PLAIN_SQL.replace("{lcs_set}", _lcs_sql("wa", "wb")).replace("{lcs_sort}", _lcs_sql("sa", "sb"))


def _plain_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items (table_id, name) and prices (table_id, name, price, row_no) of names that are taken as they are."""
    p = spread(table(spark, sf_dir, "part"))
    kind, size = F.col("p_partkey") % 3, lambda n: F.concat((F.col("p_size") + n).cast("string"), F.lit("G"))
    raw = F.when(kind == 0, F.concat_ws(" ", "p_type", "p_name")).when(kind == 1, F.concat_ws(" ", F.col("p_name"), size(1))).otherwise(F.concat_ws(" ", "p_type", "p_brand"))
    name = F.upper(F.concat_ws(" ", F.col("p_name"), F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")), F.col("p_type"), size(0)))
    items = p.select(F.col("p_brand").alias("table_id"), F.upper(raw).alias("name"))
    return items, p.select(F.col("p_brand").alias("table_id"), name.alias("name"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("row_no"))


@query(f"""
    WITH {_PLAIN_SQL}
    SELECT table_id, quoted, count(*) AS names, CAST(sum(round(by_set * 1000)) AS BIGINT) AS by_set, CAST(sum(round(by_sort * 1000)) AS BIGINT) AS by_sort, max(CAST(round(by_set * 1000) AS BIGINT)) AS best
    FROM r GROUP BY ALL
""")
def q_name_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ratios, in thousandths, of every quoted name with every name of its table, summed by quoted name."""
    items, prices = _plain_names(spark, sf_dir)
    return fuzzy.ratio_sums(items, prices)


@query(f"""
    WITH {_PLAIN_SQL}
    SELECT table_id, quoted, name, row_no, round(by_set, 6) AS by_set, round(greatest(by_set, by_sort) / 100, 8) AS score, row_number() OVER (PARTITION BY table_id, quoted ORDER BY by_set DESC, row_no) AS rank
    FROM r WHERE by_set >= 55 QUALIFY rank <= 40
""")
def q_fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every quoted name, by the indexes; the SQL scores all pairs of each table."""
    found = fuzzy.candidates(*_plain_names(spark, sf_dir))
    return found.select("table_id", "quoted", "name", "row_no", F.round("set", 6).alias("by_set"), F.round("score", 8).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query()
def q_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidate pairs each lock blocks."""
    rules = brand_rules(spark, sf_dir)
    return fuzzy.blocked_pairs(_quoted(spark, sf_dir), _names(spark, sf_dir), light_locks(rules) | strict_locks(rules), rules)


@query()
def q_word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.word_overlap(_quoted(spark, sf_dir), _names(spark, sf_dir))


@query()
def q_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    last = F.substring_index("p_name", " ", -1)
    row = lambda category, brand, field, value, term: [category.alias("category"), brand.alias("brand"), F.lit(field).alias("field"), value.alias("value"), term.alias("term")]
    none = F.lit(None).cast("string")
    knowledge = p.select(*row(last, none, "category", last, last)).union(p.select(*row(last, F.col("p_brand"), "brand", F.col("p_brand"), F.translate("p_brand", "#", " ")))).union(p.select(*row(last, none, "line", F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", 1))))
    knowledge = knowledge.distinct().withColumn("ordinal", F.xxhash64("category", "brand", "field", "value", "term"))
    return recognise(p.select(F.concat_ws(" ", "p_name", F.translate("p_brand", "#", " "), F.concat(F.col("p_size"), F.lit(" g"))).alias("text")), knowledge)


@query()
def q_image_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as image candidates of the products whose key their number gives."""
    pages = table(spark, sf_dir, "pages")
    p = price_rows(spark, sf_dir)
    n = p.agg(F.max("row_no").alias("m"))
    c = pages.crossJoin(F.broadcast(n)).select((F.col("page_id") % (F.col("m") + 1)).alias("row_no"), "page_id", F.col("url").alias("image_url"), F.lit(None).cast("string").alias("thumb_url"), F.coalesce("html", F.lit("")).alias("text"), (F.col("page_id") % 900).alias("width"), (F.col("page_id") % 700).alias("height"), (F.col("page_id") % 20).alias("rank"))
    scored = catalogue.image_candidates(c.join(p.select("row_no", F.col("name").alias("product")), "row_no"))
    return scored.select("page_id", "product", "score", "blocked", F.concat_ws(",", "flags").alias("flags"), "review")
