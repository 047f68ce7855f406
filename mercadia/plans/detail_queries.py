"""Queries on single rules: what other queries use only in part, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.functions.text import escape_html, sheet_title, slug, starts_with_word, truthy
from mercadia.operators import accounts, billing, campaign, catalogue, matching, merge
from mercadia.plans.registry import query
from mercadia.plans.views import EVENTS_NOW, NOW, SQL_AUDIT, SQL_CAMPAIGN, SQL_CLIENTS, SQL_PRICES, SQL_SUBSCRIPTIONS, audit, clients, price_rows, products, sold, subscriptions, table
from mercadia.sources.sinks import audit_rows, csv_lines
from mercadia.streaming.rules import session_counts


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# ---- offers and photos ----
@query(f"""WITH {SQL_PRICES}, a AS (SELECT ean, min('bank/' || row_no) AS url FROM price_rows WHERE row_no % 3 <> 0 GROUP BY 1), m AS (SELECT ean, 'own/' || row_no AS manual FROM price_rows WHERE row_no % 5 = 0)
    SELECT ean, coalesce(manual, url) AS url FROM a FULL JOIN m USING (ean)""")
def q_photo_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = price_rows(spark, sf_dir)
    rows = p.select("ean", F.concat(F.lit("bank/"), "row_no").alias("url"), F.when(F.col("row_no") % 3 != 0, "approved").otherwise("pending").alias("status"), "row_no")
    own = p.where("row_no % 5 = 0").select("ean", F.concat(F.lit("own/"), "row_no").alias("url"))
    return catalogue.photo_manifest(rows, own)


@query(f"""WITH e AS (SELECT o_orderkey, o_orderstatus = 'F' AS active, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL '86399.999999' SECOND + INTERVAL 3 HOUR WHEN 1 THEN o_orderdate + INTERVAL '12:30' HOUR END AS ends FROM orders)
    SELECT o_orderkey, strftime(ends, '%Y-%m-%d %H:%M:%S') AS ends, active AND NOT coalesce(ends < TIMESTAMP '{NOW}', false) AS is_public FROM e""".replace("INTERVAL '12:30' HOUR", "INTERVAL 750 MINUTE"))
def q_offer_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiries as dates, as times, and unreadable; the zone is three hours behind."""
    kind = F.col("o_orderkey") % 3
    text = F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(kind == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 12:30:00"))).otherwise("soon")
    o = table(spark, sf_dir, "orders").withColumn("ends", catalogue.expiry(text, "-03:00"))
    return o.select("o_orderkey", _text("ends"), catalogue.is_public(F.col("o_orderstatus") == "F", F.col("ends"), NOW).alias("is_public"))


@query("SELECT p_brand AS offer_id, count(*) FILTER (p_size % 4 <> 1) AS items, coalesce(sum(p_partkey) FILTER (p_size % 4 <> 1), 0)::BIGINT AS item_sum FROM part GROUP BY 1")
def q_active_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items are switched off, on, or say nothing of it."""
    on = F.when(F.col("p_size") % 4 == 1, False).when(F.col("p_size") % 4 == 2, True)
    offers = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("offer_id")).agg(F.collect_list(F.struct(F.col("p_partkey").alias("item_id"), on.alias("active"))).alias("items"))
    left = catalogue.active_items(offers)
    return left.select("offer_id", F.size("items").cast("long").alias("items"), F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["item_id"]).alias("item_sum"))


@query("SELECT l_orderkey AS cart_id, l_linenumber AS line FROM lineitem SEMI JOIN (SELECT p_partkey FROM part WHERE p_size > 25) AS p ON l_partkey = p_partkey")
def q_still_offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    cart = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cart_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("item_id"))
    return catalogue.still_offered(cart, table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("item_id"))).select("cart_id", "line")


# ---- subscriptions ----
@query(f"WITH {SQL_AUDIT} SELECT event_id, user_id FROM audit WHERE action IN ('error', 'purchase') AND t_at >= TIMESTAMP '2024-01-10' ORDER BY t_at DESC, event_id DESC LIMIT 50")
def q_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.alerts(audit(spark, sf_dir), ("error", "purchase"), "2024-01-10 00:00:00").select("event_id", "user_id")


@query(f"""WITH {SQL_SUBSCRIPTIONS} SELECT user_id, coalesce(status = 'active' AND (u IS NULL OR floor((epoch(TIMESTAMP '{NOW}') - epoch(u)) / 86400) >= 7), false) AS idle,
    coalesce(status = 'trialing' AND trial_ends > TIMESTAMP '{NOW}' AND trial_ends <= TIMESTAMP '{NOW}' + INTERVAL 3 DAY, false) AS ends_soon FROM (SELECT *, CASE WHEN user_id % 4 <> 0 THEN last_payment END AS u FROM subscriptions)""")
def q_subscription_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subscriptions(spark, sf_dir)
    used = F.when(F.col("user_id") % 4 != 0, F.col("last_payment"))
    idle = F.coalesce(billing.paying_but_idle(F.col("status"), used, NOW), F.lit(False))
    return s.select("user_id", idle.alias("idle"), billing.trial_ends_soon(F.col("status"), F.col("trial_ends"), NOW).alias("ends_soon"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'user-' || c_custkey WHEN 1 THEN 'u' || c_custkey END AS paid_by FROM customer")
def q_payment_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    reference = F.when(k % 3 == 0, F.concat(F.lit("user-"), k, F.lit("-monthly-1"))).when(k % 3 == 1, F.concat(F.lit("u"), k, F.lit("-yearly-2024-x"))).otherwise(F.concat(k, F.lit("-gift-1")))
    return table(spark, sf_dir, "customer").select("c_custkey", billing.user_of_reference(reference, ("monthly", "yearly")).alias("paid_by"))


@query("""SELECT l_orderkey, CAST(CASE WHEN l_orderkey % 4 = 0 THEN count(*) ELSE count(*) + 1 END AS INTEGER) AS total, CAST(count(*) FILTER (l_linenumber % 2 = 0) AS INTEGER) AS filled,
    CAST(CASE WHEN l_orderkey % 4 = 0 THEN count(*) ELSE count(*) + 1 END - count(*) FILTER (l_linenumber % 2 = 0) AS INTEGER) AS unmatched FROM lineitem GROUP BY 1""")
def q_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions; every fourth has no items of its own."""
    price = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice"))
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(price.alias("price"))).alias("results"), F.collect_list("l_linenumber").alias("n"))
    items = F.when(F.col("l_orderkey") % 4 == 0, F.array().cast("array<int>")).otherwise(F.concat("n", F.array(F.lit(0))))
    return accounts.session_summary(s.withColumn("items", items)).select("l_orderkey", *[F.col(c).cast("int").alias(c) for c in ("total", "filled", "unmatched")])


@query(f"WITH {SQL_CLIENTS} SELECT client_id FROM clients WHERE phone NOT IN (SELECT phone FROM clients WHERE balance < 0)")
def q_unsent_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clients(spark, sf_dir)
    return merge.unsent(c.select("client_id", "phone"), c.where("balance < 0").select("phone")).select("client_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN c_mktsegment || ',new' ELSE 'new,old' END AS tags FROM customer""")
def q_added_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, own = F.col("c_custkey") % 3, F.array("c_mktsegment")
    held = F.when(k < 2, own)
    more = F.when(k == 0, own).when(k == 1, F.array(F.lit("new"))).otherwise(F.array(F.lit("new"), F.lit("old"), F.lit("new")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(merge.add_if_absent(held, more), ",").alias("tags"))


# ---- campaigns ----
@query(f"""SELECT o_orderkey AS campaign_id, CAST(date_diff('day', TIMESTAMP '{NOW}', o_orderdate) + 1 AS BIGINT) AS days_left FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate BETWEEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND TIMESTAMP '{NOW}' + INTERVAL 2 DAY
    ORDER BY days_left, campaign_id LIMIT 3""")
def q_deadline_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "inactive").when(F.col("o_orderstatus") == "P", "active")
    return campaign.deadline_alerts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("campaign_id"), status.alias("status"), F.col("o_orderdate").alias("end_date")), NOW).select("campaign_id", "days_left")


def _mixed_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(campaign_id, industries): a campaign a type, whose industries' maps mix products with goals."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("campaign_id"), F.col("p_brand").alias("industry")).agg(F.collect_set("p_name").alias("names"), F.sum("p_size").alias("size"))
    target = F.when(F.col("size") % 3 == 0, F.lit("none")).otherwise(F.col("size").cast("string"))
    more = F.create_map(F.lit("targetValue"), target, F.lit("alreadySoldValue"), F.lit("7.5"))
    entries = F.map_concat(F.map_from_entries(F.transform("names", lambda n: F.struct(n, F.lit("x")))), more)
    return p.groupBy("campaign_id").agg(F.map_from_entries(F.collect_list(F.struct("industry", entries))).alias("industries"))


@query("SELECT DISTINCT p_type AS campaign_id, p_brand AS industry, p_name AS product FROM part")
def q_map_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.campaign_products(_mixed_maps(spark, sf_dir))


@query("SELECT p_type AS campaign_id, p_brand AS industry, CAST(CASE WHEN sum(p_size) % 3 = 0 THEN 0 ELSE sum(p_size) END AS DOUBLE) AS target, 7.5::DOUBLE AS sold FROM part GROUP BY 1, 2")
def q_map_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.campaign_goals(_mixed_maps(spark, sf_dir))


@query(f"""WITH {SQL_CAMPAIGN}, v AS (SELECT industry, CAST(sum(value) AS DOUBLE) AS sold, CAST(CAST(substr(industry, 7) AS INTEGER) % 3 * 1000000 AS DOUBLE) AS target FROM sold GROUP BY 1)
    SELECT industry, greatest(target - sold, 0) AS remaining, least(sold / target * 100, 100) AS percent FROM v WHERE target > 0""")
def q_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sold(spark, sf_dir).groupBy("industry").agg(F.sum("value").cast("double").alias("sold"))
    return campaign.goals(v.withColumn("target", (F.substring("industry", 7, 9).cast("int") % 3 * 1000000).cast("double"))).select("industry", "remaining", "percent")


@query("SELECT p_type AS campaign_id, p_brand AS industry, p_name AS product, CAST(max(p_size) AS DOUBLE) - 25 AS prize FROM part GROUP BY ALL HAVING max(p_size) > 25")
def q_prize_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("campaign_id"), "p_brand", "p_name").agg((F.max("p_size").cast("double") - 25).alias("prize"))
    maps = p.groupBy("campaign_id", "p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_name", F.struct("prize")))).alias("m")).groupBy("campaign_id").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "m"))).alias("industries"))
    return campaign.prize_rules(maps)


@query("""SELECT p_type AS master_id, p_brand AS industry, count(DISTINCT p_name) AS products, CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0 THEN CAST(substr(p_brand, 7) AS DOUBLE) * 10 ELSE 0.0 END AS goal FROM part GROUP BY ALL""")
def q_shared_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("master_id"), "p_brand", "p_name").distinct()
    masters = p.groupBy("master_id", "p_brand").agg(F.collect_list("p_name").alias("names")).groupBy("master_id").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "names"))).alias("industries"))
    own = p.select("master_id", "p_brand", F.substring("p_brand", 7, 9).cast("double").alias("n")).distinct().where("n % 2 = 0")
    overlays = own.groupBy("master_id").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", F.col("n") * 10))).alias("goals"), F.array(F.lit(1)).alias("client_ids"))
    flat = campaign.shared_campaigns(masters, overlays).select("master_id", F.explode("industries").alias("industry", "about"))
    return flat.select("master_id", "industry", F.size("about.products").cast("long").alias("products"), F.col("about.goal").alias("goal"))


@query("SELECT o_orderkey, o_orderkey % 5 = 0 OR o_orderdate >= TIMESTAMP '1998-01-01' AS may_replace FROM orders")
def q_newer_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = F.when(F.col("o_orderkey") % 5 != 0, F.lit("1998-01"))
    return table(spark, sf_dir, "orders").select("o_orderkey", campaign.newer_period(current, F.date_format("o_orderdate", "yyyy-MM")).alias("may_replace"))


@query("""SELECT p_type AS campaign_id, CAST(sum(p_size * 10) AS DOUBLE) AS sales, CAST(sum(p_size * 8) AS DOUBLE) AS previous, count(*) FILTER (p_size % 2 = 0) AS qualified, (CAST(sum(p_size * 10) AS DOUBLE) / CAST(sum(p_size * 8) AS DOUBLE) - 1) * 100 AS growth FROM part GROUP BY 1""")
def q_campaign_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("campaign_id"), (F.col("p_size") * 10).cast("double").alias("sales"), (F.col("p_size") * 8).cast("double").alias("minimum"), (F.col("p_size") % 2 == 0).alias("qualified"))
    return campaign.campaign_totals(rows, "campaign_id")


@query(f"""WITH {SQL_CAMPAIGN} SELECT industry, row_number() OVER (ORDER BY min(ordinal)) - 1 AS place FROM products GROUP BY 1""")
def q_filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of a filter in the order in which they first come."""
    return campaign.filter_values(products(spark, sf_dir), "industry", "ordinal").select("industry", "place")


@query("""SELECT o_custkey AS client_id, count(*) AS entries, count(*) FILTER (o_orderkey % 10 = 0) AS done, count(*) FILTER (o_orderkey % 10 <> 0 AND o_orderdate < TIMESTAMP '2001-06-01') AS overdue,
    count(*) FILTER (o_orderkey % 10 <> 0 AND o_orderdate = TIMESTAMP '2001-06-01') AS today, count(*) FILTER (o_orderkey % 10 <> 0 AND o_orderdate > TIMESTAMP '2001-06-01') AS upcoming FROM orders GROUP BY 1""")
def q_agenda_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = campaign.agenda_status(F.col("o_orderkey") % 10 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(None).cast("string"), "2001-06-01 00:00:00")
    return campaign.agenda_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client_id"), status.alias("status")), "client_id")


# ---- matches ----
@query(f"""WITH {SQL_PRICES} SELECT p_brand, row_no, name FROM (SELECT *, row_number() OVER (ORDER BY row_no) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY row_no) AS r FROM price_rows) WHERE r = 1) WHERE place <= 10""")
def q_first_of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.first_distinct(price_rows(spark, sf_dir).select("p_brand", "row_no", "name"), ["p_brand"], "row_no", 10).select("p_brand", "row_no", "name")


@query("SELECT l_orderkey, l_linenumber, p_name AS name, CASE WHEN p_name IS NOT NULL THEN CAST(l_partkey AS VARCHAR) END AS code FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size % 3 = 0) ON l_partkey = p_partkey")
def q_enriched_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item_id"))
    items = table(spark, sf_dir, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("code"))
    return matching.enriched(prices, items).select("l_orderkey", "l_linenumber", "name", "code")


_KINDS = "[NULL, 'EAN', 'LEARNED', 'SIMILAR 83%', 'APROX 64%', 'MANUAL'][p_partkey % 6 + 1]"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in (None, "EAN", "LEARNED", "SIMILAR 83%", "APROX 64%", "MANUAL")])
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")).alias("kind"))


@query(f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.83 WHEN 4 THEN 0.64 WHEN 5 THEN 0.0 END::DOUBLE AS score,
    CASE WHEN {_KINDS} IS NULL THEN 'no_match' WHEN {_KINDS} IN ('EAN', 'LEARNED') THEN 'approved' ELSE 'pending' END AS review FROM part""")
def q_review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("kind")
    return _kinds(spark, sf_dir).select("p_partkey", matching.score_of_kind(k).alias("score"), matching.review_status(k).alias("review"))


@query(f"""SELECT p_brand, count(*) AS total, count(*) FILTER ({_KINDS} IN ('EAN', 'LEARNED')) AS approved, count(*) FILTER ({_KINDS} NOT IN ('EAN', 'LEARNED')) AS pending, count(*) FILTER ({_KINDS} IS NULL) AS no_match FROM part GROUP BY 1""")
def q_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.review_counts(_kinds(spark, sf_dir), "p_brand")


@query(f"""WITH {SQL_PRICES} SELECT row_no, CASE WHEN row_no % 2 = 0 THEN p_name ELSE '' END AS description, CASE WHEN row_no % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '1' END AS pack FROM price_rows""")
def q_code_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a catalogue knows of codes; a code that it lacks is sold by ones."""
    p = price_rows(spark, sf_dir)
    about = p.where("row_no % 2 = 0").select("ean", F.col("p_name").alias("description"), F.col("p_size").cast("string").alias("pack"))
    return catalogue.with_metadata(p.select("row_no", "ean"), about, {"description": "", "pack": "1"}).select("row_no", "description", "pack")


# ---- texts and sinks ----
@query("SELECT p_partkey, split_part(p_name, ' ', 1) IN ('red', 'small') AS listed, replace(p_name || '-' || replace(lower(p_brand), '#', '-'), ' ', '-') AS slug, CASE WHEN p_size % 2 = 0 THEN 'Sheet ' || p_partkey ELSE substr(p_name || ' a b', 1, 31) END AS title, CASE WHEN p_size % 5 > 1 THEN CAST(p_size % 5 AS VARCHAR) WHEN p_size % 5 = 1 THEN 'yes' END AS value FROM part")
def q_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    title = F.when(size % 2 == 0, F.lit(" [] : ")).otherwise(F.concat("p_name", F.lit(":a / b")))
    value = F.when(size % 5 == 0, "False").when(size % 5 == 1, "yes").otherwise((size % 5).cast("string"))
    return p.select("p_partkey", starts_with_word(F.col("p_name"), ("red", "small")).alias("listed"), slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), sheet_title(title, F.col("p_partkey")).alias("title"), truthy(value).alias("value"))


@query("""SELECT p_partkey || ';' || p_name || ';"' || p_brand || ';""x""' || '"' AS line FROM part""")
def q_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_lines(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat("p_brand", F.lit(';"x"')).alias("b")))


@query("SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS escaped FROM pages")
def q_escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", escape_html(F.col("html")).alias("escaped"))


@query(f"WITH {SQL_AUDIT} SELECT user_id, action, CASE WHEN value > 20 THEN 'high' ELSE 'info' END AS status, job_id AS job, '[redacted]' AS secret, count(*) AS n FROM audit GROUP BY ALL")
def q_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = audit(spark, sf_dir).select("action", "user_id", F.when(F.col("value") > 20, "high").alias("status"), F.create_map(F.lit("api_token"), F.lit("abc"), F.lit("job"), "job_id").alias("metadata"))
    m = F.col("metadata")
    return audit_rows(e, EVENTS_NOW).groupBy("user_id", "action", "status", m["job"].alias("job"), m["api_token"].alias("secret")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SQL_AUDIT}, s AS (SELECT user_id, t_at, sum(fresh) OVER (PARTITION BY user_id ORDER BY t_at, event_id) AS session
    FROM (SELECT *, CASE WHEN t_at < lag(t_at) OVER (PARTITION BY user_id ORDER BY t_at, event_id) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM audit))
    SELECT user_id, strftime(min(t_at), '%Y-%m-%d %H:%M:%S') AS first_at, count(*) AS events FROM s GROUP BY user_id, session""")
def q_expiring_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_counts(audit(spark, sf_dir), "12 hours").select("user_id", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"), "events")
