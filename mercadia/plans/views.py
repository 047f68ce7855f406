"""The engine's inputs made from the test tables, in Spark and as the same common table expressions in SQL.

NOW and EVENTS_NOW stand for the present of orders and of events: no query reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.functions.codes import dun14_check, ean13_check

NOW, EVENTS_NOW = "2001-08-01 00:00:00", "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files make fewer splits than there are; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _ean(key: str) -> tuple[Column, Column]:
    """The first twelve digits of a part's code, and the code."""
    core = (F.lit(789 * 10**9) + F.col(key)).cast("string")
    return core, F.concat(core, ean13_check(core).cast("string"))


def price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_no, ean, name, price, p_name, p_brand, p_type, p_size): one price table."""
    part = table(spark, sf_dir, "part").withColumn("full_ean", _ean("p_partkey")[1])
    name = F.upper(F.concat_ws(" ", "p_name", "p_brand"))
    return part.select(F.col("p_partkey").alias("row_no"), F.col("full_ean").alias("ean"), name.alias("name"), F.col("p_retailprice").alias("price"), "p_name", "p_brand", "p_type", "p_size")


ITEM_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def quote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITEM_ID, code (plain, of a package, with dashes, or null) and the current price, or null."""
    core, full = _ean("l_partkey")
    line, full, package = spread(table(spark, sf_dir, "lineitem").select(*ITEM_ID, "l_quantity")).withColumn("full", full), F.col("full"), F.concat(F.lit("1"), core)
    dashed = F.concat_ws("-", F.substring(full, 1, 3), F.substring(full, 4, 6), F.substring(full, 10, 4))
    kind = F.col("l_linenumber") % 4
    code = F.when(kind == 1, full).when(kind == 2, F.concat(package, dun14_check(package).cast("string"))).when(kind == 3, dashed)
    current = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice") / F.col("l_quantity"))
    return line.select(*ITEM_ID, code.alias("code"), current.alias("current"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client_id, name, city, neighbourhood, region, phone, balance)."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    kind, number = F.col("c_custkey") % 5, F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    phone = (
        F.when(kind == 0, F.concat(F.lit("(11) 9"), number))
        .when(kind == 1, F.concat(F.lit("+55 11 9"), number))
        .when(kind == 2, F.concat(F.lit("011 9"), number))
        .when(kind == 3, F.concat(F.lit("123 ::: (21) 9"), number))
        .otherwise(F.lit("nan"))
    )
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("name"), F.col("n_name").alias("city"), F.col("c_mktsegment").alias("neighbourhood"), F.col("r_name").alias("region"), phone.alias("phone"), F.col("c_acctbal").alias("balance"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(industry, product, ordinal): one campaign's products."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("industry"), F.col("p_type").alias("product")).agg(F.min("p_partkey").alias("ordinal"))


def sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client_id, industry, product, value decimal): what clients bought."""
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("o_custkey").alias("client_id"), F.col("p_brand").alias("industry"), F.col("p_type").alias("product")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("value"))


#: Actions that count as use of a tool.
TOOLS = ("click", "purchase")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, at, action, job_id, value)."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.col("ts").alias("at"), F.col("event_type").alias("action"), F.get_json_object("props", "$.k").alias("job_id"), "value")


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subscription a customer with orders: statuses and dates made from its key and its orders."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    dates = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))
    k = F.col("c_custkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("active", "trialing", "pending", "canceling", "canceled", "trial_expired", None)]), (k % 7 + 1).cast("int"))
    later = lambda days, n: F.when(k % n == 0, F.col("last_order") + F.expr(f"INTERVAL '{days}' DAY"))
    joined = c.join(dates, k == F.col("o_custkey")).withColumn("status", status)
    return joined.select(
        k.alias("user_id"),
        "status",
        F.col("c_acctbal").alias("amount"),
        later(40, 3).alias("trial_ends"),
        later(60, 4).alias("access_ends"),
        later(30, 5).alias("period_end"),
        F.col("last_order").alias("last_payment"),
        F.col("first_order").alias("first_payment"),
        F.when(F.col("status").isin("canceling", "canceled"), F.col("last_order")).alias("canceled_at"),
        later(5, 6).alias("issue_at"),
        later(25, 1).alias("next_due"),
    )


# ---- the same in SQL ----
def _weighted(core: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST(substr({core}, {i}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights, 1)) + ")"


def sql_ean13(core: str) -> str:
    return f"({core} || CAST((10 - {_weighted(core, [1, 3] * 6)} % 10) % 10 AS VARCHAR))"


def _sql_dun14(core: str) -> str:
    package = f"('1' || {core})"
    return f"({package} || CAST((10 - {_weighted(package, [3, 1] * 6 + [3])} % 10) % 10 AS VARCHAR))"


SQL_PRICES = f"""price_rows AS (
    SELECT p_partkey AS row_no, {sql_ean13("core")} AS ean, upper(p_name || ' ' || p_brand) AS name, p_retailprice AS price, p_name, p_brand, p_type, p_size
    FROM (SELECT *, '789' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS core FROM part))"""

SQL_QUOTES = f"""quote_rows AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           CASE l_linenumber % 4 WHEN 1 THEN e WHEN 2 THEN {_sql_dun14("core")} WHEN 3 THEN substr(e, 1, 3) || '-' || substr(e, 4, 6) || '-' || substr(e, 10, 4) END AS code,
           CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice / l_quantity END AS current
    FROM (SELECT *, {sql_ean13("core")} AS e FROM (SELECT *, '789' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS core FROM lineitem)))"""

#: Quotes with the table's price, by the code or by the unit's code in a package code.
SQL_MATCHED = f"""{SQL_PRICES}, {SQL_QUOTES}, matched AS (
    SELECT q.*, p.price AS table_price FROM (
        SELECT *, CASE WHEN length(c) = 14 THEN {sql_ean13("substr(c, 2, 12)")} ELSE c END AS unit FROM (SELECT *, regexp_replace(coalesce(code, ''), '[^0-9]', '', 'g') AS c FROM quote_rows)
    ) q LEFT JOIN price_rows p ON q.unit = p.ean), priced AS (
    SELECT *, CASE WHEN table_price IS NOT NULL AND current > 0 THEN least(table_price, current) ELSE table_price END AS price FROM matched)"""

SQL_CLIENTS = """clients AS (
    SELECT c_custkey AS client_id, c_name AS name, n_name AS city, c_mktsegment AS neighbourhood, r_name AS region, c_acctbal AS balance,
           CASE c_custkey % 5 WHEN 0 THEN '(11) 9' || num WHEN 1 THEN '+55 11 9' || num WHEN 2 THEN '011 9' || num WHEN 3 THEN '123 ::: (21) 9' || num ELSE 'nan' END AS phone
    FROM (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS num FROM customer) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SQL_CAMPAIGN = f"""{SQL_CLIENTS}, products AS (
    SELECT p_brand AS industry, p_type AS product, min(p_partkey) AS ordinal FROM part GROUP BY ALL), sold AS (
    SELECT o_custkey AS client_id, p_brand AS industry, p_type AS product, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), size AS (
    SELECT count(*) AS total FROM products), statuses AS (
    SELECT *, CASE WHEN status = 'complete' THEN 'done' WHEN status = 'partial' THEN CASE WHEN missing <= 3 OR completion >= 50 THEN 'high' ELSE 'medium' END WHEN has_phone THEN 'medium' ELSE 'low' END AS priority
    FROM (SELECT *, total - sold AS missing, CASE WHEN total > 0 THEN CAST(sold AS DOUBLE) / total * 100 ELSE 0 END AS completion,
                 CASE WHEN total > 0 AND sold >= total THEN 'complete' WHEN sold > 0 THEN 'partial' ELSE 'empty' END AS status,
                 length(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')) >= 10 AS has_phone
          FROM (SELECT c.*, total, coalesce(n, 0) AS sold, value FROM clients c LEFT JOIN (SELECT client_id, count(*) AS n, sum(value) AS value FROM sold GROUP BY 1) USING (client_id), size)))"""

SQL_AUDIT = """audit AS (
    SELECT user_id, event_id, ts AS t_at, event_type AS action, json_extract_string(props, '$.k') AS job_id, value FROM events)"""

SQL_SUBSCRIPTIONS = """subscriptions AS (
    SELECT c_custkey AS user_id, status, c_acctbal AS amount,
           CASE WHEN c_custkey % 3 = 0 THEN last_order + INTERVAL 40 DAY END AS trial_ends, CASE WHEN c_custkey % 4 = 0 THEN last_order + INTERVAL 60 DAY END AS access_ends,
           CASE WHEN c_custkey % 5 = 0 THEN last_order + INTERVAL 30 DAY END AS period_end, last_order AS last_payment, first_order AS first_payment,
           CASE WHEN status IN ('canceling', 'canceled') THEN last_order END AS canceled_at, CASE WHEN c_custkey % 6 = 0 THEN last_order + INTERVAL 5 DAY END AS issue_at, last_order + INTERVAL 25 DAY AS next_due
    FROM (SELECT *, CASE c_custkey % 7 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'pending' WHEN 3 THEN 'canceling' WHEN 4 THEN 'canceled' WHEN 5 THEN 'trial_expired' END AS status
          FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order FROM orders GROUP BY 1) ON c_custkey = o_custkey))"""
