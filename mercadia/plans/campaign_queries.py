"""Queries on campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.functions.codes import clean_phone, cpf_check_digits, last_phone, phone_area, tax_document_kind
from mercadia.functions.text import matches_search, word_key
from mercadia.operators import campaign
from mercadia.plans.registry import query
from mercadia.plans.views import NOW, SQL_CAMPAIGN, SQL_CLIENTS, clients, price_rows, products, sold, table


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.client_status(clients(spark, sf_dir), products(spark, sf_dir), sold(spark, sf_dir))


@query(f"""WITH {SQL_CAMPAIGN}, m AS (SELECT count(*) AS members FROM clients), d AS (SELECT industry, count(DISTINCT client_id) AS clients, count(*) AS positivated, sum(value) AS value FROM sold GROUP BY 1),
    s AS (SELECT industry, count(*) AS products FROM products GROUP BY 1)
    SELECT industry, products, coalesce(clients, 0) AS clients, coalesce(positivated, 0) AS positivated, CAST(coalesce(value, 0) AS DOUBLE) AS value, CAST(coalesce(positivated, 0) AS DOUBLE) / (products * members) * 100 AS rate
    FROM s LEFT JOIN d USING (industry), m""")
def q_positivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.positivation(clients(spark, sf_dir), products(spark, sf_dir), sold(spark, sf_dir)).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {SQL_CAMPAIGN} SELECT client_id, sold, missing, completion, status, priority, CAST(value AS DOUBLE) AS value, has_phone FROM statuses")
def q_client_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).select("client_id", "sold", "missing", "completion", "status", "priority", F.col("value").cast("double").alias("value"), "has_phone")


@query(f"""WITH {SQL_CAMPAIGN}, t AS (SELECT industry, count(*) AS total FROM products GROUP BY 1), d AS (SELECT client_id, industry, count(*) AS n FROM sold GROUP BY 1, 2),
    c AS (SELECT d.client_id, count(*) FILTER (n = total) AS n_full, bool_or(industry = 'Brand#1' AND n = total) AS first_full FROM d JOIN t USING (industry) GROUP BY 1)
    SELECT client_id, coalesce(n_full, 0) AS complete_industries, coalesce(first_full, false) AS every_wanted, NOT coalesce(first_full, false) AS any_open FROM clients LEFT JOIN c USING (client_id)""")
def q_industry_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = campaign.industry_progress(clients(spark, sf_dir).select("client_id"), products(spark, sf_dir), sold(spark, sf_dir))
    full = F.coalesce(F.size(F.filter(F.map_values("industries"), lambda p: p["complete"])), F.lit(0))
    done = lambda every: F.coalesce(campaign.completed(F.col("industries"), ["Brand#1"], every), F.lit(not every))
    return out.select("client_id", F.greatest(full, F.lit(0)).cast("long").alias("complete_industries"), done(True).alias("every_wanted"), done(False).alias("any_open"))


@query(f"WITH {SQL_CAMPAIGN} SELECT industry, product, coalesce(n, 0) AS clients FROM products LEFT JOIN (SELECT industry, product, count(*) AS n FROM sold GROUP BY 1, 2) USING (industry, product) ORDER BY clients DESC, industry, product LIMIT 10")
def q_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.top_products(products(spark, sf_dir), sold(spark, sf_dir))


@query(f"WITH {SQL_CAMPAIGN} SELECT client_id, name, CAST(value AS DOUBLE) AS value FROM statuses WHERE value IS NOT NULL ORDER BY statuses.value DESC, client_id LIMIT 10")
def q_top_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.top_clients(clients(spark, sf_dir), products(spark, sf_dir), sold(spark, sf_dir)).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {SQL_CAMPAIGN} SELECT client_id, status, completion FROM statuses WHERE total > 0 AND status <> 'complete' ORDER BY status <> 'empty', completion, name, client_id LIMIT 50")
def q_clients_to_attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.clients_to_attack(_statuses(spark, sf_dir), 50).select("client_id", "status", "completion")


@query(f"""WITH {SQL_CAMPAIGN} SELECT city, neighbourhood, count(*) AS clients, CAST(sum(missing) AS BIGINT) AS missing_products, count(*) FILTER (status = 'partial' AND missing BETWEEN 1 AND 2) AS easy_clients, count(*) FILTER (has_phone) AS with_phone
    FROM statuses WHERE status <> 'complete' GROUP BY 1, 2 ORDER BY easy_clients DESC, clients DESC, missing_products DESC, city, neighbourhood LIMIT 5""")
def q_route_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.route_ranking(_statuses(spark, sf_dir))


@query(f"""WITH {SQL_CAMPAIGN} SELECT city, count(*) AS total, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'complete') AS complete,
    count(*) FILTER (priority = 'high') AS priority, CAST(sum(missing) AS BIGINT) AS missing_products, count(*) FILTER (NOT has_phone) AS no_phone FROM statuses GROUP BY 1""")
def q_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.status_counts(_statuses(spark, sf_dir), "city")


_SQL_RESULTS = """results AS (
    SELECT industry, sales, minimum, clients, CAST(100 AS BIGINT) AS client_target, CASE WHEN minimum > 0 THEN minimum + 0.01::DOUBLE ELSE 0.0 END AS need
    FROM (SELECT industry, CAST(sum(value) AS DOUBLE) AS sales, CAST(round(sum(value) * (CAST(substr(industry, 7) AS INTEGER) % 3), 0) AS DOUBLE) AS minimum, count(DISTINCT client_id) AS clients FROM sold GROUP BY 1)),
    progress AS (SELECT *, need > 0 AND sales >= need AS sales_met, clients >= client_target AS clients_met, CASE WHEN need > 0 THEN sales / need * 100 ELSE 0.0 END AS sales_progress, CAST(clients AS DOUBLE) / client_target * 100 AS clients_progress FROM results)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    summed = sold(spark, sf_dir).groupBy("industry").agg(F.sum("value").alias("v"), F.count_distinct("client_id").alias("clients"))
    minimum = F.round(F.col("v") * (F.substring("industry", 7, 9).cast("int") % 3), 0).cast("double")
    return campaign.industry_results(summed.select("industry", F.col("v").cast("double").alias("sales"), minimum.alias("minimum"), "clients", F.lit(100).cast("long").alias("client_target")))


@query(f"""WITH {SQL_CAMPAIGN}, {_SQL_RESULTS} SELECT industry, sales, minimum, sales_met AND clients_met AS qualified, sales_progress, clients_progress, greatest(need - sales, 0.0) AS missing_sales,
    greatest(client_target - clients, 0) AS missing_clients, least(sales_progress, clients_progress) AS opportunity FROM progress""")
def q_goal_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _results(spark, sf_dir).orderBy(*campaign.opportunity_order())
    return out.select("industry", "sales", "minimum", "qualified", "sales_progress", "clients_progress", "missing_sales", "missing_clients", "opportunity")


@query(f"""WITH {SQL_CAMPAIGN}, {_SQL_RESULTS}, g AS (SELECT CAST(sum(CAST(minimum AS DECIMAL(18,2))) AS DOUBLE) AS target, CAST(sum(CAST(sales AS DECIMAL(18,2))) AS DOUBLE) AS sold FROM results WHERE minimum > 0),
    d AS (SELECT *, 2404 AS days_total, least(2404, 2000) AS days_elapsed FROM g)
    SELECT target, sold, CAST(days_total AS INTEGER) AS days_total, CAST(days_elapsed AS INTEGER) AS days_elapsed, sold / days_elapsed AS daily_rate, sold + sold / days_elapsed * (days_total - days_elapsed) AS projected,
           greatest(0.0, target - sold) / (days_total - days_elapsed) AS needed_a_day, sold + sold / days_elapsed * (days_total - days_elapsed) >= target AS will_hit FROM d""")
def q_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).select("industry", F.col("minimum").cast("decimal(18,2)").alias("target"), F.col("sales").cast("decimal(18,2)").alias("sold")).where("target > 0")
    totals = campaign.goal_total(rows).select(F.col("target").cast("double").alias("target"), F.col("sold").cast("double").alias("sold"))
    out = campaign.projection(totals, "1995-01-01", "2001-08-01", "2000-06-23")
    return out.select("target", "sold", "days_total", "days_elapsed", "daily_rate", "projected", "needed_a_day", "will_hit")


def _month(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    billed = o.where("o_orderstatus = 'F'")
    sales = billed.select(F.col("o_custkey").alias("client_id"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    last = o.groupBy(F.col("o_custkey").alias("client_id")).agg(F.max("o_orderdate").alias("last_sale_date"), F.max(F.struct("o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))).getField("v").alias("last_sale_value"))
    return campaign.month_sales(clients(spark, sf_dir).join(last, "client_id", "left"), sales, "2001-07-15 00:00:00")


_SQL_MONTH = """month_sales AS (
    SELECT client_id, CAST(CASE WHEN v > 0 THEN v WHEN date_trunc('month', last_sale_date) = DATE '2001-07-01' THEN last_sale_value ELSE 0 END AS DOUBLE) AS month_value
    FROM clients LEFT JOIN (SELECT o_custkey AS client_id, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders WHERE o_orderstatus = 'F' AND date_trunc('month', o_orderdate) = DATE '2001-07-01' GROUP BY 1) USING (client_id)
    LEFT JOIN (SELECT o_custkey AS client_id, o_orderdate AS last_sale_date, CAST(o_totalprice AS DECIMAL(18,2)) AS last_sale_value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC) AS r FROM orders) WHERE r = 1) USING (client_id))"""


@query(f"WITH {SQL_CLIENTS}, {_SQL_MONTH} SELECT client_id, month_value FROM month_sales")
def q_month_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _month(spark, sf_dir).select("client_id", F.col("month_value").cast("double").alias("month_value"))


@query(f"""WITH {SQL_CAMPAIGN}, {_SQL_MONTH}, plan AS (
    SELECT s.*, month_value, [NULL, 'follow_up', 'not_called', 'called', 'closed'][s.client_id % 5 + 1] AS attendance FROM statuses s JOIN month_sales USING (client_id)),
    scored AS (SELECT *, CASE WHEN status = 'partial' AND missing BETWEEN 1 AND 2 THEN 90.0::DOUBLE ELSE 0 END + CASE WHEN status <> 'complete' AND completion >= 60 THEN 55 ELSE 0 END + CASE WHEN status = 'partial' THEN 45 ELSE 0 END
        + CASE WHEN has_phone THEN 24 ELSE -22 END + CASE WHEN month_value <= 0 THEN 18 ELSE 0 END + CASE WHEN client_id % 6 <= 3 THEN 55 - (client_id % 6) * 10 ELSE 0 END
        + CASE attendance WHEN 'follow_up' THEN 42 WHEN 'not_called' THEN 30 WHEN 'called' THEN 18 ELSE 0 END + least(month_value / 180, 35) - least(missing * 3, 45) AS score FROM plan WHERE status <> 'complete' AND coalesce(attendance, '') <> 'closed')
    SELECT client_id, round(score, 6) AS score, completion, status FROM scored ORDER BY scored.score DESC, completion DESC, name, client_id LIMIT 12""")
def q_daily_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _statuses(spark, sf_dir).join(_month(spark, sf_dir).select("client_id", F.col("month_value").cast("double").alias("month_value")), "client_id")
    said = F.element_at(F.array(F.lit(None), F.lit("follow_up"), F.lit("not_called"), F.lit("called"), F.lit("closed")), (F.col("client_id") % 5 + 1).cast("int"))
    plan = campaign.daily_plan(s.withColumns({"attendance": said, "days_left": F.col("client_id") % 6}))
    return plan.select("client_id", F.round("score", 6).alias("score"), "completion", "status")


@query(f"""WITH {SQL_CAMPAIGN}, {_SQL_MONTH} SELECT client_id, priority, status, missing FROM statuses JOIN month_sales USING (client_id)
    ORDER BY month_value > 0, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, CASE status WHEN 'partial' THEN 0 WHEN 'empty' THEN 1 ELSE 2 END, missing DESC, client_id LIMIT 100""")
def q_central_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _statuses(spark, sf_dir).join(_month(spark, sf_dir).select("client_id", "month_value"), "client_id")
    return s.orderBy(*campaign.central_order()).limit(100).select("client_id", "priority", "status", "missing")


#: The campaign with one product an industry: all that an industry sells.
_SQL_INDUSTRIES = SQL_CAMPAIGN.replace("p_type AS product", "p_brand AS product")


def _industry_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = products(spark, sf_dir).groupBy("industry", F.col("industry").alias("product")).agg(F.min("ordinal").alias("ordinal"))
    bought = sold(spark, sf_dir).groupBy("client_id", "industry", F.col("industry").alias("product")).agg(F.sum("value").alias("value"))
    return campaign.client_status(clients(spark, sf_dir), whole, bought)


@query(f"""WITH {_SQL_INDUSTRIES} SELECT client_id, CASE WHEN status = 'partial' AND missing BETWEEN 1 AND 2 THEN -10000.0::DOUBLE ELSE 0 END + CASE WHEN has_phone THEN -1000 ELSE 0 END - completion + missing * 3 AS smart
    FROM statuses WHERE city = 'NATION_3' AND status <> 'complete' AND completion >= 60""")
def q_client_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = campaign.filtered(_industry_statuses(spark, sf_dir), city="NATION_3", neighbourhood="all").where(campaign.opportunity("almost_done"))
    return s.select("client_id", campaign.smart_score(F.col("status"), F.col("missing"), F.col("completion"), F.col("has_phone")).alias("smart"))


@query(f"""WITH {SQL_CAMPAIGN}, news AS (SELECT industry, product || ' NEW' AS product FROM products WHERE ordinal % 7 = 0), every AS (SELECT industry, product FROM products UNION ALL SELECT industry, product FROM news)
    SELECT industry, product FROM every ANTI JOIN sold USING (industry, product)""")
def q_zero_sale_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A campaign with products that came out after its sales."""
    own = products(spark, sf_dir)
    news = own.where("ordinal % 7 = 0").withColumn("product", F.concat("product", F.lit(" NEW")))
    return campaign.zero_sale_products(own.unionByName(news), sold(spark, sf_dir)).select("industry", "product")


_LARGE = 100000


@query(f"WITH {SQL_CAMPAIGN} SELECT client_id FROM clients ANTI JOIN (SELECT client_id FROM sold WHERE value >= {_LARGE}) AS s USING (client_id)")
def q_idle_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients without a large sale."""
    return campaign.idle_clients(clients(spark, sf_dir), products(spark, sf_dir), sold(spark, sf_dir).where(F.col("value") >= _LARGE)).select("client_id")


@query(f"""WITH {SQL_CAMPAIGN}, s AS (SELECT client_id, industry, product, 1 AS bought FROM sold)
    SELECT c.client_id, coalesce(string_agg(CASE WHEN bought IS NULL THEN p.product END, ',' ORDER BY ordinal), '') AS missing_products
    FROM clients c CROSS JOIN products p LEFT JOIN s ON s.client_id = c.client_id AND s.industry = p.industry AND s.product = p.product GROUP BY 1""")
def q_missing_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = campaign.missing_products(clients(spark, sf_dir).select("client_id"), products(spark, sf_dir), sold(spark, sf_dir))
    return out.select("client_id", F.concat_ws(",", "missing_products").alias("missing_products"))


@query(f"WITH {SQL_CLIENTS} SELECT client_id FROM clients WHERE (client_id % 10 = 1 AND client_id % 3 = 0) OR client_id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 = 1)")
def q_campaign_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = clients(spark, sf_dir).withColumn("campaign_id", F.when((F.col("client_id") % 10 == 1) & (F.col("client_id") % 3 == 0), 1))
    lists = table(spark, sf_dir, "orders").where("o_orderkey % 40 = 1").groupBy(F.lit(1).alias("campaign_id"), (F.col("o_orderkey") % 64).alias("part")).agg(F.collect_set("o_custkey").alias("client_ids"))
    return campaign.members(own, lists, 1).select("client_id")


@query(f"""WITH {SQL_CAMPAIGN}, a AS (SELECT DISTINCT industry FROM products) SELECT industry, 'INDUSTRIA ' || replace(industry, '#', ' - ') AS imported, CAST(substr(industry, 7) AS INTEGER) * 10 AS sales FROM a WHERE CAST(substr(industry, 7) AS INTEGER) % 2 = 0
    UNION ALL SELECT industry, NULL, NULL FROM a WHERE CAST(substr(industry, 7) AS INTEGER) % 2 <> 0""")
def q_industry_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = products(spark, sf_dir).select("industry").distinct()
    number = F.substring("industry", 7, 9).cast("int")
    imported = names.where(number % 2 == 0).select(F.concat(F.lit("INDUSTRIA "), F.replace("industry", F.lit("#"), F.lit(" - "))).alias("industry"), number.alias("ordinal"), (number * 10).alias("sales"))
    return campaign.by_industry_key(names, imported).select("industry", "imported", "sales")


@query(f"WITH {SQL_CLIENTS} SELECT city, neighbourhood, count(*) AS clients FROM clients WHERE region = 'ASIA' OR region LIKE '%_1' GROUP BY 1, 2")
def q_clients_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clients(spark, sf_dir).where((F.col("region") == "ASIA") | F.col("region").like("%_1")).groupBy("city", "neighbourhood").agg(F.count(F.lit(1)).alias("clients"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') AND contains(lower(p_name) || ' ' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), '01')")
def q_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    return table(spark, sf_dir, "part").where(matches_search(F.col("p_name"), code, F.lit("Ré 01"))).select("p_partkey", "p_name")


@query(f"""WITH {SQL_CLIENTS} SELECT client_id, CASE WHEN client_id % 5 = 4 THEN NULL WHEN client_id % 5 = 3 THEN '5521' || substr(phone, 12) ELSE '55119' || lpad(CAST(client_id AS VARCHAR), 8, '0') END AS phone,
    CASE WHEN client_id % 5 = 4 THEN NULL WHEN client_id % 5 = 3 THEN '21' ELSE '11' END AS area, CASE WHEN client_id % 5 = 3 THEN '21' || substr(phone, 12) WHEN client_id % 5 = 4 THEN '' ELSE regexp_replace(phone, '[^0-9]', '', 'g') END AS last_digits
    FROM (SELECT client_id, regexp_replace(phone, '[() ]', '', 'g') AS p, phone AS phone0, CASE WHEN client_id % 5 = 3 THEN '123:::(21) 9' || lpad(CAST(client_id AS VARCHAR), 8, '0') ELSE phone END AS phone FROM clients)""")
def q_phone_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clients(spark, sf_dir)
    return c.select("client_id", clean_phone(F.col("phone")).alias("phone"), phone_area(clean_phone(F.col("phone"))).alias("area"), last_phone(F.col("phone")).alias("last_digits"))


def _sql_mod11(base: str, weights: list[int]) -> str:
    total = " + ".join(f"CAST(substr({base}, {i}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights, 1))
    return f"CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END"


@query(f"""WITH b AS (SELECT c_custkey, '1' || lpad(CAST(c_custkey * 37 AS VARCHAR), 8, '0') AS b FROM customer), d AS (SELECT *, b || ({_sql_mod11("b", list(range(10, 1, -1)))}) AS b1 FROM b),
    e AS (SELECT *, b1 || ({_sql_mod11("b1", list(range(11, 1, -1)))}) AS doc FROM d)
    SELECT c_custkey, substr(doc, 10) AS check_digits, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'cpf' END AS kind FROM e""")
def q_cpf_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("1"), F.lpad((F.col("c_custkey") * 37).cast("string"), 8, "0")).alias("b"))
    own = base.withColumn("check_digits", cpf_check_digits(F.col("b")))
    spoilt = F.concat("b", F.lpad(((F.col("check_digits").cast("int") + 1) % 100).cast("string"), 2, "0"))
    document = F.when(F.col("c_custkey") % 3 == 0, spoilt).otherwise(F.concat(F.substring("b", 1, 3), F.lit("."), F.substring("b", 4, 6), F.lit("-"), "check_digits"))
    return own.select("c_custkey", "check_digits", tax_document_kind(document).alias("kind"))


@query("SELECT p_name, list_aggregate(list_sort(string_split(p_name, ' ')), 'string_agg', '|') AS key, count(*) AS n FROM part GROUP BY ALL")
def q_word_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_name", word_key(F.col("p_name")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'done' WHEN o_orderdate < TIMESTAMP '{NOW}' OR (o_orderdate = TIMESTAMP '{NOW}' AND o_orderkey % 2 = 0 AND false) THEN 'overdue'
    WHEN o_orderdate = TIMESTAMP '{NOW}' THEN 'today' ELSE 'upcoming' END AS status FROM orders""")
def q_agenda_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    time = F.when(F.col("o_orderkey") % 2 == 0, F.lit("09:30"))
    return table(spark, sf_dir, "orders").select("o_orderkey", campaign.agenda_status(F.col("o_orderkey") % 10 == 0, day, time, NOW).alias("status"))


@query("SELECT p_brand AS campaign_id, count(*) AS n_unlocks FROM part WHERE p_size > 40 GROUP BY 1")
def q_unlock_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = price_rows(spark, sf_dir)
    out = campaign.unlock_counts(p.select(F.col("p_brand").alias("campaign_id")).distinct(), p.where("p_size > 40").select(F.col("p_brand").alias("campaign_id")))
    return out.where("unlocks > 0").withColumnRenamed("unlocks", "n_unlocks")
