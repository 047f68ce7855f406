"""Queries on users, subscriptions and what may be deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.functions.text import clean_metadata, hash_identifier, matches_person, redact_detail
from mercadia.operators import accounts, billing, merge
from mercadia.plans.registry import query
from mercadia.plans.views import EVENTS_NOW, NOW, SQL_AUDIT, SQL_CLIENTS, SQL_SUBSCRIPTIONS, TOOLS, audit, clients, subscriptions, table
from mercadia.streaming.rules import rate_bound, rate_limit

_SINCE = "2024-01-05 00:00:00"
_TOOL_SQL = "('click', 'purchase')"
_RECENT = f"""{SQL_AUDIT}, recent AS (
    SELECT *, action IN {_TOOL_SQL} AS tool FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_at DESC, event_id DESC) AS recency FROM audit) WHERE recency <= 60 AND t_at >= TIMESTAMP '{_SINCE}')"""


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.activity(audit(spark, sf_dir), _SINCE, accounts.is_tool_action(F.col("action"), TOOLS))


_ACTIVITY = f"""{_RECENT}, activity AS (
    SELECT user_id, count(*) AS events, count(*) FILTER (tool) AS tool_events, count(DISTINCT job_id) AS jobs, min(t_at) AS first_at, max(t_at) AS last_at, arg_max(action, (t_at, event_id)) AS last_action,
           max(t_at) FILTER (tool) AS last_tool_at, arg_max(action, (t_at, event_id)) FILTER (tool) AS last_tool_action, count(*) FILTER (action = 'click') AS clicks FROM recent GROUP BY 1)"""


@query(f"WITH {_ACTIVITY} SELECT user_id, events, tool_events, jobs, CAST(first_at AS VARCHAR) AS first_at, CAST(last_at AS VARCHAR) AS last_at, last_action, last_tool_action, clicks FROM activity")
def q_audit_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _activity(spark, sf_dir)
    clicks = F.coalesce(F.try_element_at("actions", F.lit("click")), F.lit(0))
    return out.select("user_id", "events", "tool_events", F.col("jobs").cast("long").alias("jobs"), F.col("first_at").cast("string").alias("first_at"), F.col("last_at").cast("string").alias("last_at"), "last_action", "last_tool_action", clicks.alias("clicks"))


@query(f"""WITH {_RECENT}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, coalesce(job_id, 'row ' || event_id) ORDER BY t_at DESC, event_id DESC) AS r FROM recent)
    SELECT user_id, event_id, action, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_at DESC, event_id DESC) AS rank FROM k WHERE r = 1) WHERE rank <= 8""")
def q_recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = accounts.recent_events(audit(spark, sf_dir), _SINCE)
    return accounts.newest_per_key(recent, [F.col("job_id")], 8, "user_id").select("user_id", "event_id", "action", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_RECENT} SELECT CASE WHEN action LIKE 'cl%' THEN 'cl' ELSE 'pur' END AS prefix, count(*) AS events FROM recent WHERE action LIKE 'cl%' OR action LIKE 'pur%' GROUP BY 1")
def q_tool_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.tool_totals(_activity(spark, sf_dir), ("cl", "pur"))


@query("""SELECT user_id, count(*) AS devices, CAST(sum(logins) AS BIGINT) AS logins, CAST(max(seen) AS VARCHAR) AS last_seen
    FROM (SELECT user_id, event_type, count(*) AS logins, max(ts) AS seen FROM events GROUP BY 1, 2) GROUP BY 1""")
def q_device_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices = audit(spark, sf_dir).groupBy("user_id", F.col("action").alias("device_id")).agg(F.count(F.lit(1)).alias("logins"), F.max("at").alias("seen_at"))
    return accounts.device_profile(devices).select("user_id", "devices", "logins", F.col("last_seen").cast("string").alias("last_seen"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions with the use of the event user of the same number; times of events are moved to the orders' present."""
    use = _activity(spark, sf_dir).select("user_id", (F.col("tool_events") > 0).alias("used_tool"), "last_tool_at")
    moved = F.timestamp_seconds(F.col("last_tool_at").cast("timestamp").cast("double") - (F.lit(EVENTS_NOW).cast("timestamp").cast("double") - F.lit(NOW).cast("timestamp").cast("double")))
    return subscriptions(spark, sf_dir).join(use.withColumn("last_tool_at", moved), "user_id", "left")


_USERS = f"""{_ACTIVITY}, {SQL_SUBSCRIPTIONS}, users AS (
    SELECT s.*, a.tool_events > 0 AS used_tool, a.last_tool_at - (TIMESTAMP '{EVENTS_NOW}' - TIMESTAMP '{NOW}') AS last_tool_at FROM subscriptions s LEFT JOIN activity a USING (user_id)), now AS (SELECT TIMESTAMP '{NOW}' AS now),
    access AS (SELECT *, coalesce(status = 'active', false) OR coalesce(status = 'trialing' AND trial_ends > now, false) OR coalesce(status IN ('canceling', 'canceled') AND coalesce(access_ends, last_payment + INTERVAL 30 DAY) > now, false) AS has_access,
        coalesce(status = 'active', false) OR coalesce(status = 'trialing' AND trial_ends > now, false) OR (coalesce(status IN ('canceling', 'canceled', 'pending'), false)
            AND (coalesce(access_ends > now, false) OR coalesce(period_end > now, false) OR coalesce(last_payment + INTERVAL 30 DAY > now, false))) AS gate,
        greatest(0, CAST(floor((epoch(now) - epoch(last_tool_at)) / 86400) AS INTEGER)) AS idle0 FROM users, now),
    followed AS (SELECT *, CASE WHEN last_tool_at IS NOT NULL THEN idle0 END AS idle_days, CASE WHEN NOT has_access AND coalesce(status = 'pending' AND trial_ends > now, false) THEN 'access_pending' WHEN NOT has_access THEN 'access_expired'
        WHEN NOT coalesce(used_tool, false) THEN 'never_used' WHEN last_tool_at IS NULL THEN 'used_unknown_time' WHEN idle0 >= 3 THEN 'stopped' WHEN idle0 >= 1 THEN 'watch' ELSE 'active' END AS follow_up FROM access)"""


@query(f"""WITH {_USERS} SELECT user_id, follow_up, idle_days, follow_up NOT IN ('watch', 'active') AS contact,
    CASE WHEN follow_up IN ('access_pending', 'access_expired', 'stopped') THEN 'high' WHEN follow_up = 'active' THEN 'low' ELSE 'medium' END AS urgency FROM followed""")
def q_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.follow_up(_users(spark, sf_dir), NOW).select("user_id", "follow_up", "idle_days", "contact", "urgency")


@query(f"""WITH {_USERS}, e AS (SELECT *, list_min(list_filter([access_ends, period_end, next_due], lambda x: x > now)) AS ahead FROM access)
    SELECT user_id, has_access AS in_report, gate AS at_gate, CAST(coalesce(ahead, CASE WHEN last_payment + INTERVAL 30 DAY > now THEN last_payment + INTERVAL 30 DAY END, now + INTERVAL 30 DAY) AS VARCHAR) AS cancel_end FROM e""")
def q_access_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subscriptions(spark, sf_dir)
    c = {n: F.col(n) for n in s.columns}
    report = accounts.has_access_report(c["status"], c["trial_ends"], c["access_ends"], c["last_payment"], NOW)
    gate = accounts.has_access_gate(c["status"], c["trial_ends"], c["access_ends"], c["period_end"], c["last_payment"], NOW)
    end = accounts.access_end_for_cancel(c["last_payment"], NOW, c["access_ends"], c["period_end"], c["next_due"])
    return s.select("user_id", report.alias("in_report"), gate.alias("at_gate"), end.cast("string").alias("cancel_end"))


_SEGMENT_SINCE = "2001-07-01 00:00:00"
_SEGMENTS = f"""{_USERS}, flagged AS (SELECT *, greatest(last_tool_at, last_payment) AS last_activity, user_id % 9 = 0 AS suspicious FROM followed)"""


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = accounts.follow_up(_users(spark, sf_dir), NOW).withColumns({"created_at": F.col("first_payment"), "last_activity": accounts.last_activity(F.col("last_tool_at"), F.col("last_payment")), "suspicious": F.col("user_id") % 9 == 0})
    return accounts.segment_flags(users, _SEGMENT_SINCE, NOW)


@query(f"""WITH {_SEGMENTS} SELECT count(*) AS "all", count(*) FILTER (first_payment >= TIMESTAMP '{_SEGMENT_SINCE}') AS new, count(*) FILTER (last_activity >= now - INTERVAL 1 DAY) AS active_today,
    count(*) FILTER (last_activity >= now - INTERVAL 7 DAY) AS active_week, count(*) FILTER (status = 'trialing' AND trial_ends > now AND used_tool) AS trial_using, count(*) FILTER (follow_up = 'stopped') AS stopped,
    count(*) FILTER (follow_up NOT IN ('watch', 'active')) AS needs_contact, count(*) FILTER (suspicious) AS suspicious, count(*) FILTER (NOT coalesce(used_tool, false)) AS never_used FROM flagged""")
def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.segment_totals(_flagged(spark, sf_dir))


@query(f"WITH {_SEGMENTS} SELECT user_id, follow_up FROM flagged WHERE follow_up NOT IN ('watch', 'active') ORDER BY last_activity DESC NULLS LAST, user_id LIMIT 50")
def q_needs_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.segment(_flagged(spark, sf_dir), "needs_contact", 50).select("user_id", "follow_up")


@query(f"""WITH {SQL_SUBSCRIPTIONS}, n AS (SELECT *, TIMESTAMP '{NOW}' AS now, TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS since FROM subscriptions), c AS (SELECT
    count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'trialing' AND coalesce(trial_ends > now, false)) AS trialing_active, count(*) FILTER (status = 'trial_expired' OR (status = 'trialing' AND NOT coalesce(trial_ends > now, false))) AS trial_expired,
    count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'canceling') AS canceling, count(*) FILTER (status = 'canceled') AS canceled, count(*) FILTER (status IS NULL) AS other,
    CAST(coalesce(sum(CAST(CASE WHEN amount > 0 THEN amount ELSE 99.90 END AS DECIMAL(18,2))) FILTER (status = 'active'), 0) AS DOUBLE) AS revenue,
    count(*) FILTER (status = 'active' AND next_due <= now + INTERVAL 7 DAY) AS renewals, count(*) FILTER (status = 'pending' OR (status IS DISTINCT FROM 'pending' AND issue_at >= since)) AS payment_issues,
    count(*) FILTER (status = 'active' AND first_payment >= since) AS conversions, count(*) FILTER (status IN ('trialing', 'trial_expired') AND trial_ends BETWEEN now - INTERVAL 7 DAY AND now) AS rescues,
    count(*) FILTER (canceled_at >= since) AS cancellations, count(*) FILTER (first_payment BETWEEN date_trunc('month', now) AND now) AS month_new, count(*) FILTER (canceled_at BETWEEN date_trunc('month', now) AND now) AS month_lost FROM n)
    SELECT *, CAST(CASE WHEN conversions + rescues > 0 THEN round_even(conversions * 100.0 / (conversions + rescues), 0) END AS BIGINT) AS conversion_percent, greatest(0, active - month_new + month_lost) AS month_start, active - greatest(0, active - month_new + month_lost) AS month_change FROM c""")
def q_billing_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.overview(subscriptions(spark, sf_dir), 30, NOW)


@query(f"WITH {SQL_SUBSCRIPTIONS} SELECT user_id, CAST(next_due AS VARCHAR) AS next_due FROM subscriptions WHERE status = 'active' AND next_due <= TIMESTAMP '{NOW}' + INTERVAL 7 DAY ORDER BY subscriptions.next_due, user_id LIMIT 50")
def q_upcoming_renewals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.upcoming_renewals(subscriptions(spark, sf_dir), NOW).select("user_id", F.col("next_due").cast("string").alias("next_due"))


@query(f"WITH {SQL_SUBSCRIPTIONS} SELECT user_id FROM subscriptions WHERE status IN ('trialing', 'trial_expired') AND trial_ends BETWEEN TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND TIMESTAMP '{NOW}' ORDER BY trial_ends DESC, user_id LIMIT 50")
def q_trial_rescues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.trial_rescues(subscriptions(spark, sf_dir), NOW).select("user_id")


@query(f"""WITH {_USERS} SELECT user_id, greatest(0, CAST(floor(epoch(now + INTERVAL 14 DAY - last_tool_at) / 86400) AS INTEGER)) AS idle_days FROM followed
    WHERE status = 'active' AND last_tool_at <= now + INTERVAL 7 DAY ORDER BY last_tool_at, user_id LIMIT 50""")
def q_inactive_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir)
    # two weeks later, when everyone's last use is some days ago
    return billing.inactive_subscribers(users.drop("last_tool_at"), users.select("user_id", "last_tool_at"), "2001-08-15 00:00:00").select("user_id", "idle_days")


@query(f"""WITH {_ACTIVITY}, {SQL_SUBSCRIPTIONS}, s AS (SELECT o_custkey AS user_id, count(*) AS n, max(o_orderdate) AS t_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), u AS (SELECT o_custkey AS user_id, count(*) AS n, max(o_orderdate) AS t_at FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
    l AS (SELECT o_custkey AS user_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT b.user_id, greatest(coalesce(a.jobs, 0), coalesce(s.n, 0)) AS ready, coalesce(u.n, 0) AS uploads, coalesce(l.n, 0) AS learned, CAST(greatest(b.last_payment, s.t_at, u.t_at) AS VARCHAR) AS last_tool_at,
           greatest(coalesce(a.jobs, 0), coalesce(s.n, 0)) > 0 OR u.n > 0 IS TRUE OR l.n > 0 IS TRUE AS used_tool
    FROM subscriptions b LEFT JOIN activity a USING (user_id) LEFT JOIN s USING (user_id) LEFT JOIN u USING (user_id) LEFT JOIN l USING (user_id)""")
def q_merge_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    users = subscriptions(spark, sf_dir).select("user_id", F.col("last_payment").alias("last_tool_at")).join(_activity(spark, sf_dir).select("user_id", F.col("jobs").cast("long").alias("ready")), "user_id", "left")
    of = lambda s: o.where(F.col("o_orderstatus") == s)
    out = accounts.merged_activity(users, of("F"), of("O"), of("P"))
    return out.select("user_id", "ready", "uploads", "learned", F.col("last_tool_at").cast("string").alias("last_tool_at"), "used_tool")


def _sign_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sign-ups: every 50th shares a document with its successor, some share phones and names."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    base = F.concat(F.lit("1"), F.lpad((F.floor(k / 50) * 50 + F.when(k % 50 <= 1, 0).otherwise(k % 50)).cast("string"), 10, "0"))
    phone = F.when(k % 7 == 0, F.concat(F.lit("119"), F.lpad(F.floor(k / 14).cast("string"), 8, "0")))
    start = F.lit("2001-01-01 00:00:00").cast("timestamp").cast("double")
    return c.select(
        k.alias("user_id"),
        F.concat(F.lit("Person "), F.col("c_mktsegment")).alias("name"),
        F.concat(F.lit("u"), k, F.lit("@mail.com")).alias("email"),
        phone.alias("phone"),
        base.alias("document"),
        F.timestamp_seconds(start + k * 43200).alias("created_at"),
        F.when(k % 11 == 0, F.timestamp_seconds(start + k * 43200 + 7 * 86400)).alias("trial_ends"),
        F.when(k % 100 < 3, F.array(F.concat(F.lit("dev"), F.floor(k / 100)))).alias("device_ids"),
    )


_SIGN_UPS = """p AS (SELECT c_custkey AS u, 'person' AS w1, lower(c_mktsegment) AS w2, floor(c_custkey / 50) * 50 + CASE WHEN c_custkey % 50 <= 1 THEN 0 ELSE c_custkey % 50 END AS doc,
        CASE WHEN c_custkey % 7 = 0 THEN floor(c_custkey / 14) END AS phone, c_custkey * 43200 AS born, CASE WHEN c_custkey % 11 = 0 THEN c_custkey * 43200 + 7 * 86400 END AS trial, CASE WHEN c_custkey % 100 < 3 THEN floor(c_custkey / 100) END AS dev FROM customer),
    x AS (SELECT a.u AS a, b.u AS b, CASE WHEN a.doc = b.doc THEN 8 ELSE 0 END + CASE WHEN a.phone = b.phone THEN 7 ELSE 0 END + CASE WHEN a.dev = b.dev THEN 6 ELSE 0 END + CASE WHEN a.phone IS NOT NULL AND b.phone IS NOT NULL THEN 1 ELSE 0 END + 2
        + CASE WHEN (abs(a.born - b.trial) <= 172800 AND NOT a.born < b.born) OR (abs(b.born - a.trial) <= 172800 AND NOT b.born < a.born) THEN 4 ELSE 0 END AS score FROM p a JOIN p b ON a.u < b.u)"""


@query(f"WITH {_SIGN_UPS} SELECT a, b, CAST(score AS INTEGER) AS score FROM x WHERE score >= 5")
def q_duplicate_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.duplicate_pairs(_sign_ups(spark, sf_dir))


@query(f"WITH {_SIGN_UPS}, y AS (SELECT a AS user_id, score FROM x WHERE score >= 5 UNION ALL SELECT b, score FROM x WHERE score >= 5) SELECT user_id, CAST(sum(score) AS BIGINT) AS risk, count(*) AS related, CASE WHEN sum(score) >= 8 THEN 'high' ELSE 'medium' END AS level FROM y GROUP BY 1")
def q_duplicate_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.duplicate_risk(accounts.duplicate_pairs(_sign_ups(spark, sf_dir)))


@query(f"""WITH {SQL_SUBSCRIPTIONS}, u AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'C' || c_nationkey END AS a, CASE WHEN c_custkey % 3 = 0 THEN 'C' || (c_custkey % 25) END AS b FROM customer),
    n AS (SELECT user_id, a AS code FROM u WHERE a IS NOT NULL UNION SELECT user_id, b FROM u WHERE b IS NOT NULL)
    SELECT code, count(*) AS referrals, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'active') * 15 AS commission FROM n LEFT JOIN subscriptions USING (user_id) GROUP BY 1""")
def q_referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    users = table(spark, sf_dir, "customer").select(k.alias("user_id"), F.when(k % 2 == 0, F.concat(F.lit("C"), "c_nationkey")).alias("referred_by"), F.when(k % 3 == 0, F.concat(F.lit("C"), k % 25)).alias("referral_code"))
    return accounts.referrals(users, subscriptions(spark, sf_dir), 15)


@query(f"WITH {SQL_CLIENTS} SELECT client_id FROM clients WHERE contains(lower(name), 'customer 000000001') OR contains(regexp_replace(phone, '[^0-9]', '', 'g'), '000000001') OR contains(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), 'customer 000000001')")
def q_user_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clients(spark, sf_dir).where(matches_person(F.col("name"), F.col("phone"), F.lit("Cústomer#000000001"))).select("client_id")


@query(f"""SELECT o_orderkey, CASE WHEN s IN ('done', 'error') THEN age >= 43200 WHEN s = 'processing' THEN age >= 7200 AND o_orderkey % 10 <> 0 END AS job_expired, age >= 691200 AS table_expired
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'processing' ELSE 'error' END AS s, CAST(epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate) AS DOUBLE) AS age FROM orders)""")
def q_cleanup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", F.lit("done")).when(F.col("o_orderstatus") == "O", F.lit("processing")).otherwise(F.lit("error"))
    now, t_at = "1998-01-01 00:00:00", F.col("o_orderdate")
    return o.select("o_orderkey", merge.job_expired(status, t_at, F.col("o_orderkey") % 10 == 0, now).alias("job_expired"), merge.expired(t_at, merge.TABLE_TTL, now).alias("table_expired"))


@query("SELECT p_partkey AS file_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-07-20') AND p_partkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-20')")
def q_orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"))
    used = table(spark, sf_dir, "lineitem").where("l_shipdate >= '2001-07-20'").select(F.col("l_partkey").alias("file_id"))
    jobs = table(spark, sf_dir, "orders").where("o_orderdate >= '2001-07-20'").select(F.col("o_custkey").alias("file_id"))
    return merge.orphans(files, used, jobs)


@query("""WITH u AS (SELECT o_custkey AS k, o_orderdate AS t_at, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderkey FROM orders), n AS (SELECT k, arg_max(price, (t_at, o_orderkey)) AS price, count(*) AS n, max(t_at) AS t_at FROM u GROUP BY 1)
    SELECT c_custkey AS k, CAST(coalesce(n.price, CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS price, 1 + coalesce(n, 0) AS chosen, CAST(coalesce(t_at, TIMESTAMP '1990-01-01') AS VARCHAR) AS updated FROM customer LEFT JOIN n ON k = c_custkey""")
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.struct(F.lit("1990-01-01 00:00:00").cast("timestamp_ntz").alias("t"), F.lit(0).cast("long").alias("n")).alias("at"), F.col("c_acctbal").cast("decimal(18,2)").alias("price"), F.lit(1).cast("long").alias("chosen"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.struct(F.col("o_orderdate").cast("timestamp_ntz").alias("t"), F.col("o_orderkey").cast("long").alias("n")).alias("at"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.lit(1).cast("long").alias("chosen"))
    out = merge.upsert(old, new, ["k"], "at", add=("chosen",))
    return out.select("k", F.col("price").cast("double").alias("price"), "chosen", F.col("at.t").cast("string").alias("updated"))


_EVENT = "['PAYMENT_CONFIRMED', 'PAYMENT_OVERDUE', 'SUBSCRIPTION_DELETED', 'PAYMENT_CREATED', 'PAYMENT_RECEIVED', 'PAYMENT_REFUNDED']"


@query(f"""WITH e AS (SELECT o_custkey AS user_id, o_orderkey AS event_id, o_orderdate AS t_at, {_EVENT}[o_orderkey % 6 + 1] AS event FROM orders),
    w AS (SELECT *, max(CASE WHEN event IN ('PAYMENT_CONFIRMED', 'PAYMENT_RECEIVED') THEN t_at END) OVER (PARTITION BY user_id ORDER BY t_at, event_id) AS paid FROM e),
    s AS (SELECT *, CASE WHEN event IN ('PAYMENT_CONFIRMED', 'PAYMENT_RECEIVED') THEN 'active' WHEN event = 'PAYMENT_OVERDUE' AND NOT coalesce(paid + INTERVAL 30 DAY > t_at, false) THEN 'pending' WHEN event IN ('SUBSCRIPTION_DELETED', 'PAYMENT_REFUNDED') THEN 'canceled' END AS sets FROM w)
    SELECT user_id, arg_max(sets, (t_at, event_id)) FILTER (sets IS NOT NULL) AS status, CAST(max(t_at) FILTER (sets = 'active') AS VARCHAR) AS last_payment, CAST(min(t_at) FILTER (sets = 'active') AS VARCHAR) AS first_payment,
           CAST(max(t_at) FILTER (sets = 'canceled') AS VARCHAR) AS canceled_at, CAST(max(t_at) FILTER (event = 'PAYMENT_OVERDUE' AND sets IS NULL) AS VARCHAR) AS last_issue FROM s GROUP BY 1""")
def q_webhook_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("PAYMENT_CONFIRMED", "PAYMENT_OVERDUE", "SUBSCRIPTION_DELETED", "PAYMENT_CREATED", "PAYMENT_RECEIVED", "PAYMENT_REFUNDED")
    event = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("at"), event.alias("event"))
    out = billing.subscription_after(events)
    return out.select("user_id", "status", *[F.col(c).cast("string").alias(c) for c in ("last_payment", "first_payment", "canceled_at", "last_issue")])


@query("""WITH u AS (SELECT o_orderkey AS use_id, o_custkey % 40 AS user_id, 'K' || (o_orderkey % 97) AS code, o_orderdate AS t_at FROM orders), f AS (SELECT code, arg_min(user_id, (t_at, use_id)) AS fu, arg_min(use_id, (t_at, use_id)) AS fi FROM u GROUP BY 1)
    SELECT use_id, code, CASE WHEN use_id = fi THEN 'created' WHEN user_id = fu THEN 'reused' ELSE 'refused' END AS outcome FROM u JOIN f USING (code)""")
def q_coupon_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    uses = o.select(F.col("o_orderkey").alias("use_id"), (F.col("o_custkey") % 40).alias("user_id"), F.concat(F.lit("K"), F.col("o_orderkey") % 97).alias("code"), F.col("o_orderdate").alias("at"))
    return billing.first_reservations(uses).select("use_id", "code", "outcome")


@query(f"""WITH {SQL_SUBSCRIPTIONS} SELECT user_id, CAST(CASE WHEN status = 'trialing' AND trial_ends > TIMESTAMP '{NOW}' THEN trial_ends ELSE TIMESTAMP '{NOW}' END + INTERVAL 30 DAY AS VARCHAR) AS trial_ends,
    user_id % 2 = 0 AND user_id % 5 < 3 AND NOT coalesce(access_ends < TIMESTAMP '{NOW}', false) AS valid FROM subscriptions""")
def q_coupons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subscriptions(spark, sf_dir)
    valid = billing.coupon_is_valid(F.col("user_id") % 2 == 0, F.col("user_id") % 5, F.lit(3), F.col("access_ends"), NOW)
    return s.select("user_id", billing.trial_end_with_coupon(F.col("status"), F.col("trial_ends"), F.lit(30), NOW).cast("string").alias("trial_ends"), valid.alias("valid"))


@query(r"""SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+(\.[0-9A-Za-z_-]+)+', '[email]', 'g'), '\b[0-9]{8,}\b', '[number]', 'g'), 'access_token=[^&\s]+', 'access_token=[redacted]', 'gi'), 500) AS detail,
    substr(sha256('salt:' || source), 1, 24) AS source_hash FROM documents""")
def q_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact_detail(F.col("text")).alias("detail"), hash_identifier(F.col("source"), "salt").alias("source_hash"))


@query(f"WITH {SQL_AUDIT} SELECT event_id, action, '[redacted]' AS token, job_id AS job FROM audit")
def q_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = audit(spark, sf_dir).withColumn("m", F.create_map(F.lit("Access-Token"), F.lit("abc"), F.lit("job"), F.col("job_id")))
    clean = clean_metadata(F.col("m"))
    return e.select("event_id", "action", clean["Access-Token"].alias("token"), clean["job"].alias("job"))


# ---- sequential rules ----
def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("client"), F.col("event_type").alias("bucket"), F.col("event_id").alias("call_id"), F.col("ts").alias("at"))


@query()
def q_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 3 calls in 5 days of a client and bucket; each refusal changes what follows, so there is no SQL."""
    return rate_limit(calls(spark, sf_dir), 3, 432000.0)


@query("""SELECT event_id AS call_id, count(*) OVER (PARTITION BY user_id % 10, event_type ORDER BY epoch(ts) RANGE BETWEEN 432000 PRECEDING AND CURRENT ROW) AS calls_in_window FROM events""")
def q_rate_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_bound(calls(spark, sf_dir), 432000.0).select("call_id", "calls_in_window")
