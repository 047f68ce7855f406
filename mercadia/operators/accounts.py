"""Users: what they did, whether they have access, whom to contact, and who may have signed up twice.

Inputs are plain tables: `events` (user_id, event_id, at, action, job_id, ...), `devices` (user_id, device_id,
seen_at, logins), `subscriptions` (user_id, status, trial_ends, access_ends, period_end, last_payment, ...).
Times are timestamps in UTC; `now` is always a parameter. Per-user facts are aggregated before they are
joined, so that one busy user is no hot key of a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.functions.codes import digits, document_digits, phone_area
from mercadia.functions.text import search_key

#: Events of a user that an activity report looks at; a feature of the report.
RECENT_EVENTS = 60
#: Days without use after which a user has stopped, or is watched.
STALE_DAYS, WATCH_DAYS = 3, 1


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def _time(c: Column) -> Column:
    return c.cast("timestamp")


def days_since(c: Column, now: str) -> Column:
    """Whole days from a time to now, 0 at least; null for null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0), F.floor((_at(now).cast("double") - _time(c).cast("double")) / 86400))).cast("int")


def is_tool_action(action: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [action.startswith(p) for p in prefixes], F.lit(False))


def recent_events(events: DataFrame, since: str, most: int = RECENT_EVENTS) -> DataFrame:
    """The newest `most` events of each user, and of those the ones from `since` on; `recency` is 1 for the newest.

    row_number with a bound becomes a WindowGroupLimit: each task keeps `most` rows a user before the shuffle.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("event_id"))
    return events.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= most).where(_time(F.col("at")) >= _at(since))


def activity(events: DataFrame, since: str, tool: Column, most: int = RECENT_EVENTS) -> DataFrame:
    """By user: counts, distinct jobs, first and last event, last tool use, and a map of counts by action."""
    recent = recent_events(events.withColumn("tool", tool), since, most)
    by_action = recent.groupBy("user_id", "action").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("tool").alias("tools"),
        F.collect_set("job_id").alias("jobs"),
        F.min("at").alias("first"),
        F.max(F.struct("at", "event_id", "action")).alias("last"),
        F.max(F.when(F.col("tool"), F.struct("at", "event_id", "action"))).alias("last_tool"),
    )
    return by_action.groupBy("user_id").agg(
        F.sum("n").alias("events"),
        F.sum("tools").alias("tool_events"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("actions"),
        F.size(F.array_distinct(F.flatten(F.collect_list("jobs")))).alias("jobs"),
        F.min("first").alias("first_at"),
        F.max("last").getField("at").alias("last_at"),
        F.max("last").getField("action").alias("last_action"),
        F.max("last_tool").getField("at").alias("last_tool_at"),
        F.max("last_tool").getField("action").alias("last_tool_action"),
    )


def newest_per_key(items: DataFrame, keys: list[Column], most: int, *by: str) -> DataFrame:
    """The newest row of each (by, key), where key is the first of keys that isn't null; of those the newest `most` of each by.

    Rows without any key are all kept. Columns at and event_id order the rows.
    """
    keyed = items.withColumn("__k", F.coalesce(*[k.cast("string") for k in keys]))
    newest = [F.desc("at"), F.desc("event_id")]
    in_key = F.row_number().over(Window.partitionBy(*by, F.coalesce("__k", F.concat(F.lit("row "), F.col("event_id").cast("string")))).orderBy(*newest))
    once = keyed.withColumn("__r", in_key).where("__r = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).where(F.col("rank") <= most).drop("__k", "__r")


def tool_totals(activities: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Events by the first of prefixes that an action has, over the actions maps of activities."""
    flat = activities.select(F.explode("actions").alias("action", "n"))
    prefix = F.coalesce(*[F.when(F.col("action").startswith(p), F.lit(p)) for p in prefixes])
    return flat.withColumn("prefix", prefix).where("prefix IS NOT NULL").groupBy("prefix").agg(F.sum("n").alias("events"))


def device_profile(devices: DataFrame) -> DataFrame:
    """By user: devices, logins, last seen, and the set of devices."""
    return devices.groupBy("user_id").agg(F.count(F.lit(1)).alias("devices"), F.sum(F.coalesce("logins", F.lit(0))).alias("logins"), F.max("seen_at").alias("last_seen"), F.array_sort(F.collect_set("device_id")).alias("device_ids"))


# ---- access ----
def trial_is_active(status: Column, trial_ends: Column, now: str) -> Column:
    return F.coalesce((status == "trialing") & (_time(trial_ends) > _at(now)), F.lit(False))


def paid_until(access_ends: Column, last_payment: Column) -> Column:
    """When paid access ends: the date that is set, or 30 days after the last payment."""
    return F.coalesce(_time(access_ends), _time(last_payment) + F.expr("INTERVAL '30' DAY"))


def has_access_report(status: Column, trial_ends: Column, access_ends: Column, last_payment: Column, now: str) -> Column:
    """Access as reports see it: a set end of access hides later payments, pending has none."""
    paid = status.isin("canceling", "canceled") & (paid_until(access_ends, last_payment) > _at(now))
    return F.coalesce(status == "active", F.lit(False)) | trial_is_active(status, trial_ends, now) | F.coalesce(paid, F.lit(False))


def has_access_gate(status: Column, trial_ends: Column, access_ends: Column, period_end: Column, last_payment: Column, now: str) -> Column:
    """Access as the gate grants it: any date that reaches beyond now, also for pending."""
    later = lambda c: F.coalesce(_time(c) > _at(now), F.lit(False))
    paid = later(access_ends) | later(period_end) | later(_time(last_payment) + F.expr("INTERVAL '30' DAY"))
    return F.coalesce(status == "active", F.lit(False)) | trial_is_active(status, trial_ends, now) | (F.coalesce(status.isin("canceling", "canceled", "pending"), F.lit(False)) & paid)


def access_end_for_cancel(last_payment: Column, now: str, *dates: Column) -> Column:
    """When access ends after a cancellation: the first date after now, or 30 days after the last payment if that is later than now, or 30 days from now."""
    ahead = lambda c: F.when(_time(c) > _at(now), _time(c))
    month = F.expr("INTERVAL '30' DAY")
    return F.coalesce(F.array_min(F.array_compact(F.array(*[ahead(d) for d in dates]))), ahead(_time(last_payment) + month), _at(now) + month)


def follow_up(users: DataFrame, now: str) -> DataFrame:
    """users (status, trial_ends, access_ends, last_payment, used_tool, last_tool_at) with follow_up, contact and urgency."""
    access = has_access_report(F.col("status"), F.col("trial_ends"), F.col("access_ends"), F.col("last_payment"), now)
    idle = days_since(F.col("last_tool_at"), now)
    waiting = F.coalesce((F.col("status") == "pending") & (_time(F.col("trial_ends")) > _at(now)), F.lit(False))
    state = (
        F.when(~access & waiting, F.lit("access_pending"))
        .when(~access, F.lit("access_expired"))
        .when(~F.coalesce("used_tool", F.lit(False)), F.lit("never_used"))
        .when(idle.isNull(), F.lit("used_unknown_time"))
        .when(idle >= STALE_DAYS, F.lit("stopped"))
        .when(idle >= WATCH_DAYS, F.lit("watch"))
        .otherwise(F.lit("active"))
    )
    out = users.withColumns({"follow_up": state, "idle_days": idle})
    urgency = F.when(F.col("follow_up").isin("access_pending", "access_expired", "stopped"), F.lit("high")).when(F.col("follow_up") == "active", F.lit("low")).otherwise(F.lit("medium"))
    return out.withColumns({"contact": ~F.col("follow_up").isin("watch", "active"), "urgency": urgency})


def last_activity(*times: Column) -> Column:
    return F.greatest(*[_time(t) for t in times]) if len(times) > 1 else _time(times[0])


def segment_flags(users: DataFrame, since: str, now: str) -> DataFrame:
    """users (created_at, last_activity, follow_up, contact, suspicious, used_tool, status, trial_ends) with a flag for each segment."""
    ago = lambda days: _at(now) - F.expr(f"INTERVAL '{days}' DAY")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return users.withColumns(
        {
            "in_all": F.lit(True),
            "in_new": flag(_time(F.col("created_at")) >= _at(since)),
            "in_active_today": flag(_time(F.col("last_activity")) >= ago(1)),
            "in_active_week": flag(_time(F.col("last_activity")) >= ago(7)),
            "in_trial_using": trial_is_active(F.col("status"), F.col("trial_ends"), now) & flag(F.col("used_tool")),
            "in_stopped": flag(F.col("follow_up") == "stopped"),
            "in_needs_contact": flag(F.col("contact")),
            "in_suspicious": flag(F.col("suspicious")),
            "in_never_used": ~flag(F.col("used_tool")),
        }
    )


SEGMENTS = ("all", "new", "active_today", "active_week", "trial_using", "stopped", "needs_contact", "suspicious", "never_used")


def segment_totals(flagged: DataFrame) -> DataFrame:
    """One row: how many users each segment has."""
    return flagged.agg(*[F.count_if(f"in_{s}").alias(s) for s in SEGMENTS])


def segment(flagged: DataFrame, name: str, most: int) -> DataFrame:
    """The first `most` users of a segment in its order; missing times come last."""
    first = {"active_today": "last_activity", "active_week": "last_activity", "stopped": "last_activity", "needs_contact": "last_activity"}.get(name, "created_at")
    order = [F.asc_nulls_last("trial_ends")] if name == "trial_using" else [F.desc_nulls_last("risk")] * (name == "suspicious") + [F.desc_nulls_last(first)]
    return flagged.where(f"in_{name}").orderBy(*order, "user_id").limit(most)


def merged_activity(users: DataFrame, sessions: DataFrame, uploads: DataFrame, learned: DataFrame) -> DataFrame:
    """users (user_id, ready, last_tool_at) with counts of sessions (user_id, at), uploads (user_id, at) and learned prices (user_id)."""
    per = lambda df, n, at=None: df.groupBy("user_id").agg(F.count(F.lit(1)).alias(n), *([F.max("at").alias(at)] if at else []))
    joined = users.join(per(sessions, "__s", "__sa"), "user_id", "left").join(per(uploads, "uploads", "__ua"), "user_id", "left").join(per(learned, "learned", None), "user_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = joined.withColumns({"ready": F.greatest(zero("ready"), zero("__s")), "uploads": zero("uploads"), "learned": zero("learned"), "last_tool_at": F.greatest("last_tool_at", "__sa", "__ua")})
    return out.withColumn("used_tool", (F.col("ready") > 0) | (F.col("uploads") > 0) | (F.col("learned") > 0)).drop("__s", "__sa", "__ua")


def session_summary(sessions: DataFrame) -> DataFrame:
    """sessions (items array, results array<struct<price>>) with total, filled and unmatched."""
    total = F.when(F.size("items") > 0, F.size("items")).otherwise(F.size("results"))
    filled = F.size(F.filter("results", lambda r: r["price"].isNotNull()))
    return sessions.withColumns({"total": F.greatest(total, F.lit(0)), "filled": F.greatest(filled, F.lit(0)), "unmatched": F.greatest(total - filled, F.lit(0))})


# ---- referrals and search ----
def referrals(users: DataFrame, subscriptions: DataFrame, commission) -> DataFrame:
    """By partner code: users that name it in either column, those with an active subscription, and the month's commission."""
    named = users.select("user_id", F.explode(F.array_compact(F.array_distinct(F.array("referred_by", "referral_code")))).alias("code"))
    status = subscriptions.select("user_id", (F.lower("status") == "active").alias("active"))
    counted = named.join(status, "user_id", "left").groupBy("code").agg(F.count(F.lit(1)).alias("referrals"), F.count_if("active").alias("active"))
    return counted.withColumn("commission", F.col("active") * F.lit(commission))


# ---- duplicate sign-ups ----
#: Words of names and addresses that identify nobody; fixed values.
COMMON_WORDS = ("admin", "gmail", "hotmail", "outlook", "yahoo", "live", "email", "mail", "com", "combr", "br", "loja", "teste", "usuario", "user", "rca")
SUSPICIOUS_SCORE, HIGH_SCORE, TRIAL_DAYS, SHARED_LETTERS = 5, 8, 2, 7


def identity_words(name: Column, email: Column) -> Column:
    """Words of 4 letters or more in a name and the local part of an address, but common ones and numbers."""
    local = F.translate(F.substring_index(F.coalesce(email, F.lit("")), "@", 1), "._-", "   ")
    words = F.split(search_key(F.concat_ws(" ", name, local)), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*COMMON_WORDS) & ~w.rlike(r"^\d+$")))


def local_part(email: Column) -> Column:
    return F.regexp_replace(search_key(F.substring_index(F.coalesce(email, F.lit("")), "@", 1)), " ", "")


def _grams(c: Column, n: int) -> Column:
    """The distinct substrings of n letters."""
    many = F.length(c) - n + 1
    return F.when(many > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def sign_up_profiles(users: DataFrame) -> DataFrame:
    """users (user_id, name, email, phone, document, created_at, trial_ends, device_ids) with what pairs are compared by."""
    return users.select(
        "user_id",
        _time(F.col("created_at")).alias("created_at"),
        _time(F.col("trial_ends")).alias("trial_ends"),
        F.coalesce("device_ids", F.array().cast("array<string>")).alias("device_ids"),
        document_digits(F.col("document")).alias("document"),
        digits(F.col("phone")).alias("phone"),
        phone_area(F.col("phone")).alias("area"),
        identity_words(F.col("name"), F.col("email")).alias("words"),
        local_part(F.col("email")).alias("local"),
    )


def _trial_follows(a: Column, b: Column) -> Column:
    """Whether one signed up around the end of the other's trial."""

    def after(new: Column, old: Column) -> Column:
        near = F.abs(new["created_at"].cast("double") - old["trial_ends"].cast("double")) <= TRIAL_DAYS * 86400
        return F.coalesce(near & ~F.coalesce(new["created_at"] < old["created_at"], F.lit(False)), F.lit(False))

    return after(a, b) | after(b, a)


def pair_score(a: Column, b: Column) -> Column:
    """The score of two profiles (structs of sign_up_profiles); 0 below the threshold or without a strong sign."""
    same = lambda f: F.coalesce(a[f] == b[f], F.lit(False))
    points = lambda c, n: F.when(c, F.lit(n)).otherwise(0)
    document = same("document")
    phone = same("phone") & (F.length(a["phone"]) >= 10)
    device = F.arrays_overlap(a["device_ids"], b["device_ids"])
    inside = lambda x, y: F.exists(x, lambda s: (F.length(s) >= 6) & F.exists(y, lambda t: (F.length(t) >= 6) & F.contains(t, s)))
    alike = F.arrays_overlap(a["words"], b["words"]) | inside(a["words"], b["words"]) | inside(b["words"], a["words"]) | F.arrays_overlap(_grams(a["local"], SHARED_LETTERS), _grams(b["local"], SHARED_LETTERS))
    score = points(document, 8) + points(phone, 7) + points(device, 6) + points(same("area"), 1) + points(alike, 2) + points(_trial_follows(a, b), 4)
    return F.when((score >= SUSPICIOUS_SCORE) & (document | phone | device | alike), score).otherwise(0)


def duplicate_pairs(users: DataFrame) -> DataFrame:
    """(a, b, score) of suspicious pairs.

    A pair needs a strong sign: the same document, phone or device, alike names or addresses. Each of these is
    a key (a device, a word, the first 6 letters in a row, 7 letters in a row), so pairs come from an equi-join
    on such keys, in which a pair is taken up once, at its least shared key. Alike names and addresses alone
    reach the threshold only together with the trial's timing; their keys also hold the day, so that a common
    word pairs only users whose times are near.
    """
    profiles = sign_up_profiles(users).withColumn("me", F.struct("*"))
    strong = F.concat(
        F.array(F.concat(F.lit("d:"), F.col("document")), F.when(F.length("phone") >= 10, F.concat(F.lit("p:"), F.col("phone")))),
        F.transform("device_ids", lambda d: F.concat(F.lit("v:"), d)),
    )
    parts = F.array_distinct(F.concat(F.transform("words", lambda w: F.concat(F.lit("w:"), w)), F.flatten(F.transform("words", lambda w: F.transform(_grams(w, 6), lambda g: F.concat(F.lit("g:"), g)))), F.transform(_grams(F.col("local"), SHARED_LETTERS), lambda g: F.concat(F.lit("e:"), g))))
    keyed = profiles.select("user_id", "me", F.array_compact(strong).alias("strong"), parts.alias("parts"))
    day = lambda c: F.floor(c.cast("double") / 86400).cast("long")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = left.select(F.col("key"), F.col("me").alias("x")), right.select(F.col("key"), F.col("me").alias("y"))
        return a.join(b, "key").select(F.least(F.col("x.user_id"), F.col("y.user_id")).alias("a"), F.greatest(F.col("x.user_id"), F.col("y.user_id")).alias("b"), "x", "y").where("a < b")

    by_sign = keyed.select("me", F.explode("strong").alias("key"))
    # one's day of sign-up against the days around the end of the other's trial
    signed = keyed.where("me.created_at IS NOT NULL").select("me", F.explode("parts").alias("part"), day(F.col("me.created_at")).alias("day"))
    trials = keyed.where("me.trial_ends IS NOT NULL").select("me", F.explode("parts").alias("part"), F.explode(F.sequence(day(F.col("me.trial_ends")) - TRIAL_DAYS - 1, day(F.col("me.trial_ends")) + TRIAL_DAYS + 1)).alias("day"))
    key = F.concat_ws("|", "part", F.col("day").cast("string")).alias("key")
    found = met(by_sign, by_sign).unionByName(met(signed.select("me", key), trials.select("me", key)))
    scored = found.withColumn("score", pair_score(F.col("x"), F.col("y"))).where("score > 0")
    return scored.groupBy("a", "b").agg(F.max("score").cast("int").alias("score"))


def duplicate_risk(pairs: DataFrame) -> DataFrame:
    """By user of duplicate_pairs: score, level, related users."""
    both = pairs.select(F.col("a").alias("user_id"), F.col("b").alias("other"), "score").unionByName(pairs.select(F.col("b").alias("user_id"), F.col("a").alias("other"), "score"))
    out = both.groupBy("user_id").agg(F.sum("score").alias("risk"), F.count(F.lit(1)).alias("related"))
    return out.withColumn("level", F.when(F.col("risk") >= HIGH_SCORE, F.lit("high")).otherwise(F.lit("medium")))
