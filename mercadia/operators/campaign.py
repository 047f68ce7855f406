"""Sales campaigns: which clients bought which products, progress to goals, whom to visit next.

The data model is flat: `members` (client_id, city, neighbourhood, phone, ...) are a campaign's clients,
`products` (industry, product, ordinal) its products, `sold` (client_id, industry, product, value) what members
bought, one row a pair at most. A campaign's products are few next to its clients: per-client counts come
from one aggregate of `sold`, and what is missing from the difference to the products, so that no
clients-by-products table is made but where a report lists missing products.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.functions.text import word_key


def members(clients: DataFrame, campaign_clients: DataFrame, campaign_id) -> DataFrame:
    """Clients of a campaign: those that name it (campaign_id) and those it lists (campaign_id, client_ids)."""
    listed = campaign_clients.where(F.col("campaign_id") == campaign_id).select(F.explode("client_ids").alias("client_id")).distinct().withColumn("listed", F.lit(True))
    return clients.join(listed, "client_id", "left").where((F.col("campaign_id") == campaign_id) | F.col("listed")).drop("listed")


def filtered(clients: DataFrame, **wanted) -> DataFrame:
    """Clients whose columns have the wanted values; None and "all" ask for nothing."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]) if kv[1] not in (None, "all") else df, wanted.items(), clients)


def positivation(clients: DataFrame, products: DataFrame, sold: DataFrame) -> DataFrame:
    """By industry: products, clients that bought any, sales by (client, product), value and rate in percent."""
    own = sold.join(products.select("industry", "product"), ["industry", "product"], "left_semi").join(clients.select("client_id"), "client_id", "left_semi")
    done = own.groupBy("industry").agg(F.count_distinct("client_id").alias("clients"), F.count(F.lit(1)).alias("positivated"), F.sum("value").alias("value"))
    size = products.groupBy("industry").agg(F.count(F.lit(1)).alias("products"))
    total = clients.agg(F.count(F.lit(1)).alias("members"))
    out = size.join(done, "industry", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    rate = F.coalesce(F.try_divide(zero("positivated"), F.col("products") * F.col("members")) * 100, F.lit(0.0))
    return out.select("industry", "products", zero("clients").alias("clients"), zero("positivated").alias("positivated"), zero("value").alias("value"), rate.alias("rate"))


def client_status(clients: DataFrame, products: DataFrame, sold: DataFrame) -> DataFrame:
    """By client: total, sold, missing, completion in percent, value, status, priority, has_phone."""
    own = sold.join(products.select("industry", "product"), ["industry", "product"], "left_semi")
    done = own.groupBy("client_id").agg(F.count(F.lit(1)).alias("sold"), F.sum("value").alias("value"))
    total = products.agg(F.count(F.lit(1)).alias("total"))
    out = clients.join(done, "client_id", "left").crossJoin(F.broadcast(total)).withColumn("sold", F.coalesce("sold", F.lit(0)))  # one row
    out = out.withColumns({"missing": F.col("total") - F.col("sold"), "completion": F.coalesce(F.try_divide("sold", "total") * 100, F.lit(0.0)), "has_phone": F.length(F.regexp_replace(F.coalesce("phone", F.lit("")), r"\D", "")) >= 10})
    out = out.withColumn("status", status(F.col("sold"), F.col("total")))
    return out.withColumn("priority", priority(F.col("status"), F.col("missing"), F.col("completion"), F.col("has_phone")))


def status(sold: Column, total: Column) -> Column:
    return F.when((total > 0) & (sold >= total), F.lit("complete")).when(sold > 0, F.lit("partial")).otherwise(F.lit("empty"))


def priority(state: Column, missing: Column, completion: Column, has_phone: Column) -> Column:
    partial = F.when((missing <= 3) | (completion >= 50), F.lit("high")).otherwise(F.lit("medium"))
    return F.when(state == "complete", F.lit("done")).when(state == "partial", partial).otherwise(F.when(has_phone, F.lit("medium")).otherwise(F.lit("low")))


def few_missing(state: Column, missing: Column) -> Column:
    return (state == "partial") & missing.between(1, 2)


def opportunity(name: str | None) -> Column:
    """Filters of client_status by opportunity."""
    known = {
        "few_missing": few_missing(F.col("status"), F.col("missing")),
        "almost_done": (F.col("status") != "complete") & (F.col("completion") >= 60),
        "with_phone": F.col("has_phone"),
        "bought_month": F.col("month_value") > 0,
    }
    return known.get(name or "all", F.lit(True))


def industry_progress(clients: DataFrame, products: DataFrame, sold: DataFrame) -> DataFrame:
    """By client: map industries of struct(sold, total, value, complete)."""
    size = products.groupBy("industry").agg(F.count(F.lit(1)).alias("total"))
    own = sold.join(products.select("industry", "product"), ["industry", "product"], "left_semi")
    done = own.groupBy("client_id", "industry").agg(F.count(F.lit(1)).alias("sold"), F.sum("value").alias("value")).join(size, "industry")
    entry = F.struct("industry", F.struct("sold", "total", "value", (F.col("sold") == F.col("total")).alias("complete")).alias("p"))
    return clients.join(done.groupBy("client_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("industries")), "client_id", "left")


def completed(industries: Column, wanted: Iterable[str], every: bool) -> Column:
    """Whether a client's industries (industry_progress) are all complete, or, if not every, any isn't."""
    done = [F.coalesce(industries[i]["complete"], F.lit(False)) for i in wanted]
    return reduce(lambda a, b: a & b, done, F.lit(True)) if every else reduce(lambda a, b: a | b, [~d for d in done], F.lit(False))


def missing_products(clients: DataFrame, products: DataFrame, sold: DataFrame) -> DataFrame:
    """By client: array of the products it lacks, in the campaign's order. Its size is clients by products at most."""
    have = sold.groupBy("client_id").agg(F.collect_set(F.struct("industry", "product")).alias("have"))
    every = products.agg(F.array_sort(F.collect_list(F.struct("ordinal", "industry", "product"))).alias("every"))
    lacks = F.filter("every", lambda p: ~F.coalesce(F.array_contains(F.col("have"), F.struct(p["industry"].alias("industry"), p["product"].alias("product"))), F.lit(False)))
    return clients.join(have, "client_id", "left").crossJoin(F.broadcast(every)).withColumn("missing_products", F.transform(lacks, lambda p: p["product"])).drop("have", "every")


def zero_sale_products(products: DataFrame, sold: DataFrame) -> DataFrame:
    return products.join(sold.select("industry", "product").distinct(), ["industry", "product"], "left_anti")


def idle_clients(clients: DataFrame, products: DataFrame, sold: DataFrame) -> DataFrame:
    own = sold.join(products.select("industry", "product"), ["industry", "product"], "left_semi")
    return clients.join(own.select("client_id").distinct(), "client_id", "left_anti")


def top_products(products: DataFrame, sold: DataFrame, most: int = 10) -> DataFrame:
    """The products that most clients bought; equal ones in order of their names."""
    counts = sold.groupBy("industry", "product").agg(F.count(F.lit(1)).alias("clients"))
    every = products.select("industry", "product").join(counts, ["industry", "product"], "left").withColumn("clients", F.coalesce("clients", F.lit(0)))
    return every.orderBy(F.desc("clients"), "industry", "product").limit(most)


def top_clients(clients: DataFrame, products: DataFrame, sold: DataFrame, most: int = 10) -> DataFrame:
    own = sold.join(products.select("industry", "product"), ["industry", "product"], "left_semi")
    value = own.groupBy("client_id").agg(F.sum("value").alias("value"))
    return clients.select("client_id", "name").join(value, "client_id").orderBy(F.desc("value"), "client_id").limit(most)


def clients_to_attack(statuses: DataFrame, most: int | None = None) -> DataFrame:
    """Clients that lack products: empty ones first, then the least complete."""
    open_ = statuses.where((F.col("total") > 0) & (F.col("status") != "complete"))
    ordered = open_.orderBy((F.col("status") != "empty").cast("int"), "completion", "name", "client_id")
    return ordered.limit(most) if most else ordered


def central_order() -> list[Column]:
    """Order of the central list: without a purchase this month first, then priority, status and most missing."""
    rank = lambda c, values: reduce(lambda w, iv: w.when(c == iv[1], iv[0]), enumerate(values), F.when(F.lit(False), 0)).otherwise(4)
    return [(F.col("month_value") > 0).cast("int"), rank(F.col("priority"), ("high", "medium", "low", "done")), rank(F.col("status"), ("partial", "empty", "complete")), F.desc("missing"), F.col("client_id")]


def smart_score(state: Column, missing: Column, completion: Column, has_phone: Column) -> Column:
    """Sort key of a client list, least first."""
    return F.when(few_missing(state, missing), F.lit(-10000.0)).otherwise(0.0) + F.when(has_phone, F.lit(-1000.0)).otherwise(0.0) - completion + missing * 3


def status_counts(statuses: DataFrame, *by: str) -> DataFrame:
    """Counts of client_status by status and what is missing."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return statuses.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), of("empty"), of("partial"), of("complete"), F.count_if(F.col("priority") == "high").alias("priority"), F.sum("missing").alias("missing_products"), F.count_if(~F.col("has_phone")).alias("no_phone"))


def route_ranking(statuses: DataFrame, most: int = 5) -> DataFrame:
    """City and neighbourhood with the most clients that lack little, then most open clients, then most missing."""
    open_ = statuses.where("status <> 'complete'")
    grouped = open_.groupBy(F.coalesce("city", F.lit("?")).alias("city"), F.coalesce("neighbourhood", F.lit("?")).alias("neighbourhood")).agg(
        F.count(F.lit(1)).alias("clients"),
        F.sum("missing").alias("missing_products"),
        F.count_if(few_missing(F.col("status"), F.col("missing"))).alias("easy_clients"),
        F.count_if("has_phone").alias("with_phone"),
    )
    return grouped.orderBy(F.desc("easy_clients"), F.desc("clients"), F.desc("missing_products"), "city", "neighbourhood").limit(most)


def goals(industries: DataFrame) -> DataFrame:
    """industries (industry, target, sold) with a target: remaining and percent, 100 at most."""
    target, done = F.col("target"), F.col("sold")
    return industries.where(target > 0).withColumns({"remaining": F.greatest(target - done, F.lit(0).cast("double")), "percent": F.least(done / target * 100, F.lit(100.0))})


def goal_total(industries: DataFrame, *by: str) -> DataFrame:
    """Target, sold, remaining and percent over industries."""
    summed = industries.groupBy(*by).agg(F.sum("target").alias("target"), F.sum("sold").alias("sold"))
    percent = F.when(F.col("target") > 0, F.least(F.col("sold") / F.col("target") * 100, F.lit(100.0))).otherwise(0.0)
    return summed.withColumns({"remaining": F.greatest(F.col("target") - F.col("sold"), F.lit(0).cast("double")), "percent": percent})


#: A goal of sales is met from this much above the minimum.
CENT = 0.01


def industry_results(results: DataFrame) -> DataFrame:
    """results (industry, sales, minimum, clients, client_target): progress, what is missing, qualified, opportunity."""
    need = F.when(F.col("minimum") > 0, F.col("minimum") + CENT).otherwise(0.0)
    out = results.withColumn("need", need)
    met = (F.col("need") > 0) & (F.col("sales") >= F.col("need"))
    clients_met = (F.col("client_target") > 0) & (F.col("clients") >= F.col("client_target"))
    sales_progress = F.coalesce(F.try_divide("sales", "need") * 100, F.lit(0.0))
    clients_progress = F.when(F.col("client_target") > 0, F.col("clients") / F.col("client_target") * 100).otherwise(0.0)
    out = out.withColumns({"sales_met": met, "clients_met": clients_met, "qualified": met & clients_met, "sales_progress": sales_progress, "clients_progress": clients_progress})
    return out.withColumns(
        {
            "missing_sales": F.greatest(F.col("need") - F.col("sales"), F.lit(0.0)),
            "missing_clients": F.greatest(F.col("client_target") - F.col("clients"), F.lit(0).cast("long")),
            "opportunity": F.least("sales_progress", "clients_progress"),
        }
    ).drop("need")


def opportunity_order() -> list[Column]:
    """Unqualified industries first, the nearest to its goals first, then names as Portuguese sorts them."""
    return [F.col("qualified").cast("int"), F.desc("opportunity"), F.collate("industry", "UNICODE_CI_AI"), F.col("industry")]


def campaign_totals(results: DataFrame, *by: str) -> DataFrame:
    """Sales, minimum sales, growth in percent and qualified industries of industry_results."""
    summed = results.groupBy(*by).agg(F.sum("sales").alias("sales"), F.sum("minimum").alias("previous"), F.count_if("qualified").alias("qualified"))
    return summed.withColumn("growth", F.when(F.col("previous") > 0, (F.col("sales") / F.col("previous") - 1) * 100).otherwise(0.0))


def projection(totals: DataFrame, start: str, end: str, now: str) -> DataFrame:
    """totals (target, sold) with days, daily rate, projected sales, what a day needs, and whether the goal will be met."""
    to_now, whole = F.datediff(F.lit(now), F.lit(start)), F.datediff(F.lit(end), F.lit(start))
    days = F.greatest(F.lit(1), whole)
    elapsed = F.least(days, F.greatest(F.lit(1), to_now))
    left = F.greatest(F.lit(0), days - elapsed)
    rate = F.col("sold") / elapsed
    projected = F.col("sold") + rate * left
    needed = F.when(left > 0, F.greatest(F.lit(0.0), F.col("target") - F.col("sold")) / left).otherwise(0.0)
    return totals.withColumns({"days_total": days, "days_elapsed": elapsed, "days_left": left, "daily_rate": rate, "projected": projected, "needed_a_day": needed, "will_hit": F.when(F.col("target") > 0, projected >= F.col("target"))})


def month_sales(clients: DataFrame, sales: DataFrame, now: str) -> DataFrame:
    """clients (client_id, last_sale_date, last_sale_value) with month_value: their sales (client_id, day, value) in the month of now, or else the last sale's value if it was in that month."""
    month = lambda c: F.date_trunc("month", c)
    current = month(F.lit(now).cast("timestamp"))
    summed = sales.where(month(F.col("day").cast("timestamp")) == current).groupBy("client_id").agg(F.sum("value").alias("__v"))
    fallback = F.when(month(F.col("last_sale_date").cast("timestamp")) == current, F.col("last_sale_value"))
    return clients.join(summed, "client_id", "left").withColumn("month_value", F.when(F.col("__v") > 0, F.col("__v")).otherwise(F.coalesce(fallback, F.lit(0)))).drop("__v")


#: What a client's answer to a call adds to the score of a daily plan; fixed values.
ATTENDANCE = (("follow_up", 42), ("not_called", 30), ("called", 18))


def plan_score(state: Column, missing: Column, completion: Column, has_phone: Column, month_value: Column, attendance: Column, days_left: Column) -> Column:
    """How much a visit is worth today."""
    zero = lambda c, points: F.when(c, F.lit(float(points))).otherwise(0.0)
    called = reduce(lambda w, ap: w.when(attendance == ap[0], float(ap[1])), ATTENDANCE, F.when(F.lit(False), 0.0)).otherwise(0.0)
    return (
        zero(few_missing(state, missing), 90)
        + zero((state != "complete") & (completion >= 60), 55)
        + zero(state == "partial", 45)
        + F.when(has_phone, F.lit(24.0)).otherwise(-22.0)
        + zero(month_value <= 0, 18)
        + F.when(days_left.between(0, 3), F.lit(55.0) - days_left * 10).otherwise(0.0)
        + called
        + F.least(month_value / 180, F.lit(35.0))
        - F.least(missing * 3.0, F.lit(45.0))
    )


def daily_plan(statuses: DataFrame, most: int = 12) -> DataFrame:
    """Clients to visit today: statuses with month_value, attendance and days_left, closed ones left out."""
    open_ = statuses.where((F.col("status") != "complete") & ~F.coalesce("attendance", F.lit("")).isin("closed", "not_interested"))
    score = plan_score(*[F.col(c) for c in ("status", "missing", "completion", "has_phone", "month_value", "attendance", "days_left")])
    return open_.withColumn("score", score).orderBy(F.desc("score"), F.desc("completion"), "name", "client_id").limit(most)


def agenda_status(done: Column, day: Column, time: Column, now: str) -> Column:
    """done, overdue, today or upcoming of an agenda entry with a day and, perhaps, a time HH:mm."""
    today = F.lit(now[:10])
    late = time.isNotNull() & (F.try_to_timestamp(F.concat_ws(" ", day, time), F.lit("yyyy-MM-dd HH:mm")) < F.lit(now).cast("timestamp"))
    return F.when(done, F.lit("done")).when((day < today) | ((day == today) & late), F.lit("overdue")).when(day == today, F.lit("today")).otherwise(F.lit("upcoming"))


def deadline_alerts(campaigns: DataFrame, now: str, most: int = 3) -> DataFrame:
    """Active campaigns (campaign_id, status, end_date) that end within 3 days."""
    end = F.col("end_date").cast("date").cast("timestamp") + F.expr("INTERVAL '86399' SECOND")
    days = F.ceil((end.cast("double") - F.lit(now).cast("timestamp").cast("double")) / 86400)
    return campaigns.where((F.coalesce("status", F.lit("")) != "inactive") & F.col("end_date").isNotNull()).withColumn("days_left", days).where(F.col("days_left").between(0, 3)).orderBy("days_left", "campaign_id").limit(most)


def agenda_counts(entries: DataFrame, *by: str) -> DataFrame:
    """Counts of agenda entries (status of agenda_status) by status."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return entries.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), of("done"), of("overdue"), of("today"), of("upcoming"))


def filter_values(rows: DataFrame, column: str, order: str) -> DataFrame:
    """The distinct values of a column, without null and "", with their place in order of first appearance.

    Values of a filter are few, so that their places come from one sorted list of them.
    """
    first = rows.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").groupBy(column).agg(F.min(order).alias("__first"))
    listed = first.agg(F.array_sort(F.collect_list(F.struct("__first", column))).alias("__all"))
    return listed.select(F.posexplode("__all").alias("place", "__v")).select(F.col(f"__v.{column}").alias(column), F.col("place").cast("long").alias("place"))


def by_industry_key(industries: DataFrame, imported: DataFrame) -> DataFrame:
    """industries (industry) with the imported rows (industry, ordinal, ...) whose names have the same words; the first one counts."""
    others = [c for c in imported.columns if c != "industry"]
    first = imported.withColumn("__k", word_key(F.col("industry"))).where("__k <> ''").groupBy("__k").agg(F.min_by(F.struct(F.col("industry").alias("imported"), *others), "ordinal").alias("__m"))
    joined = industries.withColumn("__k", word_key(F.col("industry"))).join(first, "__k", "left")
    return joined.select(*industries.columns, F.col("__m.imported").alias("imported"), *[F.col("__m")[c].alias(c) for c in others])


def shared_campaigns(masters: DataFrame, overlays: DataFrame) -> DataFrame:
    """Master campaigns (master_id, industries map of products) with a seller's own goals (master_id, goals map, client_ids)."""
    joined = masters.join(overlays, "master_id")
    return joined.withColumn("industries", F.transform_values("industries", lambda name, products: F.struct(products.alias("products"), F.coalesce(F.try_element_at("goals", name), F.lit(0.0)).alias("goal")))).drop("goals")


def newer_period(current: Column, incoming: Column) -> Column:
    """Whether results of a period may replace the current ones: an older ISO date may not."""
    return current.isNull() | (incoming >= current)


def unlock_counts(campaigns: DataFrame, unlocks: DataFrame) -> DataFrame:
    """Campaigns with how many unlocks they have."""
    counts = unlocks.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("unlocks"))
    return campaigns.join(counts, "campaign_id", "left").withColumn("unlocks", F.coalesce("unlocks", F.lit(0)))


def prize_rules(campaigns: DataFrame) -> DataFrame:
    """(campaign_id, industry, product, prize) of products with a prize, from industries map<string, map<string, struct<prize>>>."""
    flat = campaigns.select("campaign_id", F.explode("industries").alias("industry", "products")).select("campaign_id", "industry", F.explode("products").alias("product", "about"))
    return flat.select("campaign_id", "industry", "product", F.col("about.prize").alias("prize")).where("prize > 0")


#: Keys of an industry's map that are no products; fixed values.
META_KEYS = ("targetValue", "alreadySoldValue")


def campaign_products(campaigns: DataFrame) -> DataFrame:
    """(campaign_id, industry, product) from industries map<string, map<string, string>>, whose maps mix products and META_KEYS."""
    flat = campaigns.select("campaign_id", F.explode("industries").alias("industry", "entries")).select("campaign_id", "industry", F.explode("entries").alias("product", "__v"))
    return flat.where(~F.col("product").isin(*META_KEYS)).drop("__v")


def campaign_goals(campaigns: DataFrame) -> DataFrame:
    """(campaign_id, industry, target, sold) from the META_KEYS of industries; what is no number counts 0."""
    number = lambda k: F.coalesce(F.try_element_at("entries", F.lit(k)).try_cast("double"), F.lit(0.0))
    return campaigns.select("campaign_id", F.explode("industries").alias("industry", "entries")).select("campaign_id", "industry", number("targetValue").alias("target"), number("alreadySoldValue").alias("sold"))
