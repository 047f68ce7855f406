"""Subscriptions: an overview of a month, lists, coupons, and what payment events do to a subscription."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.operators.accounts import days_since, trial_is_active

#: What a month costs where a subscription tells no amount.
FALLBACK_PRICE = 99.90
UPCOMING_DAYS, RESCUE_DAYS, INACTIVE_DAYS, LIST_ROWS = 7, 7, 7, 50


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def _time(name: str) -> Column:
    return F.col(name).cast("timestamp")


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' DAY")


def amount(c: Column, fallback: float = FALLBACK_PRICE) -> Column:
    return F.when(c > 0, c).otherwise(F.lit(fallback))


def billing_state(status: Column, trial_ends: Column, now: str) -> Column:
    """The count that a subscription goes to."""
    return (
        F.when(status == "active", F.lit("active"))
        .when((status == "trialing") & trial_is_active(status, trial_ends, now), F.lit("trialing_active"))
        .when(status.isin("trialing", "trial_expired"), F.lit("trial_expired"))
        .when(status == "pending", F.lit("pending"))
        .when(status.isin("canceling", "canceled"), status)
        .otherwise(F.lit("other"))
    )


def overview(subscriptions: DataFrame, days: int, now: str) -> DataFrame:
    """One row: counts by state, monthly revenue, renewals, conversions, rescues, cancellations and the month's movement."""
    since, month = _at(now) - _days(days), F.date_trunc("month", _at(now))
    state = billing_state(F.col("status"), F.col("trial_ends"), now)
    within = lambda c, a, b: F.coalesce((c >= a) & (c <= b), F.lit(False))
    marked = subscriptions.withColumn("state", state)
    is_state = lambda s: F.coalesce(F.col("state") == s, F.lit(False))
    first, canceled = _time("first_payment"), _time("canceled_at")
    gone = F.col("status").isin("canceling", "canceled")
    issue = ~F.col("status").eqNullSafe("pending") & (_time("issue_at") >= since)
    counted = marked.agg(
        *[F.count_if(is_state(s)).alias(s) for s in ("active", "trialing_active", "trial_expired", "pending", "canceling", "canceled", "other")],
        F.coalesce(F.sum(F.when(is_state("active"), amount(F.col("amount")).cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("revenue"),
        F.count_if(is_state("active") & F.coalesce(_time("next_due") <= _at(now) + _days(UPCOMING_DAYS), F.lit(False))).alias("renewals"),
        F.count_if(is_state("pending") | F.coalesce(issue, F.lit(False))).alias("payment_issues"),
        F.count_if(is_state("active") & F.coalesce(first >= since, F.lit(False))).alias("conversions"),
        F.count_if(F.col("status").isin("trialing", "trial_expired") & within(_time("trial_ends"), _at(now) - _days(RESCUE_DAYS), _at(now))).alias("rescues"),
        F.count_if(gone & F.coalesce(canceled >= since, F.lit(False))).alias("cancellations"),
        F.count_if(within(first, month, _at(now))).alias("month_new"),
        F.count_if(gone & within(canceled, month, _at(now))).alias("month_lost"),
    )
    finished = F.col("conversions") + F.col("rescues")
    start = F.greatest(F.lit(0).cast("long"), F.col("active") - F.col("month_new") + F.col("month_lost"))
    # halves to even, as the counts' ratio is reported
    return counted.withColumns({"conversion_percent": F.rint(F.try_divide(F.col("conversions") * 100, finished)).cast("long"), "month_start": start, "month_change": F.col("active") - start})


def upcoming_renewals(subscriptions: DataFrame, now: str, most: int = LIST_ROWS) -> DataFrame:
    """Active subscriptions due soon, the earliest first; the list's length is a feature."""
    due = subscriptions.where((F.col("status") == "active") & (_time("next_due") <= _at(now) + _days(UPCOMING_DAYS)))
    return due.orderBy(F.asc_nulls_last("next_due"), "user_id").limit(most)


def trial_rescues(subscriptions: DataFrame, now: str, most: int = LIST_ROWS) -> DataFrame:
    """Trials that ended lately without a subscription, the newest first."""
    ended = F.col("status").isin("trialing", "trial_expired") & _time("trial_ends").between(_at(now) - _days(RESCUE_DAYS), _at(now))
    return subscriptions.where(ended).orderBy(F.desc("trial_ends"), "user_id").limit(most)


def inactive_subscribers(subscriptions: DataFrame, last_use: DataFrame, now: str, most: int = LIST_ROWS) -> DataFrame:
    """Active subscribers whose last tool use (user_id, last_tool_at) is INACTIVE_DAYS ago or more, the longest first."""
    joined = subscriptions.where("status = 'active'").join(last_use.where("last_tool_at IS NOT NULL"), "user_id").withColumn("idle_days", days_since(F.col("last_tool_at"), now))
    return joined.where(F.col("idle_days") >= INACTIVE_DAYS).orderBy("last_tool_at", "user_id").limit(most)


def paying_but_idle(status: Column, last_use: Column, now: str, days: int = INACTIVE_DAYS) -> Column:
    """Active and without use for days; never used counts as idle."""
    return (status == "active") & (last_use.isNull() | (days_since(last_use, now) >= days))


def trial_ends_soon(status: Column, trial_ends: Column, now: str, days: int = 3) -> Column:
    end = trial_ends.cast("timestamp")
    return F.coalesce((status == "trialing") & (end > _at(now)) & (end <= _at(now) + _days(days)), F.lit(False))


def alerts(events: DataFrame, actions: tuple[str, ...], since: str, most: int = LIST_ROWS) -> DataFrame:
    """The newest events with one of the actions."""
    return events.where(F.col("action").isin(*actions) & (F.col("at").cast("timestamp") >= _at(since))).orderBy(F.desc("at"), F.desc("event_id")).limit(most)


def user_of_reference(reference: Column, plans: tuple[str, ...]) -> Column:
    """The user in a payment's reference user-plan-rest, or null."""
    return F.coalesce(*[F.when(F.contains(reference, F.lit(f"-{p}-")), F.substring_index(reference, f"-{p}-", 1)) for p in plans])


def coupon_is_valid(active: Column, used: Column, most: Column, expires: Column, now: str) -> Column:
    return F.coalesce(active, F.lit(False)) & (F.coalesce(used, F.lit(0)) < F.coalesce(most, F.lit(0))) & ~F.coalesce(expires.cast("timestamp") < _at(now), F.lit(False))


def trial_end_with_coupon(status: Column, trial_ends: Column, days: Column, now: str) -> Column:
    """A live trial is made longer from its end, any other starts now."""
    start = F.when(trial_is_active(status, trial_ends, now), trial_ends.cast("timestamp")).otherwise(_at(now))
    return F.timestamp_seconds(start.cast("double") + days * 86400)


def first_reservations(uses: DataFrame) -> DataFrame:
    """uses (code, user_id, at, use_id) of one-time coupons with outcome: created, reused (by the same user) or refused."""
    first = uses.groupBy("code").agg(F.min(F.struct("at", "use_id", "user_id")).alias("first"))
    outcome = F.when(F.col("use_id") == F.col("first.use_id"), F.lit("created")).when(F.col("user_id") == F.col("first.user_id"), F.lit("reused")).otherwise(F.lit("refused"))
    return uses.join(first, "code").withColumn("outcome", outcome).drop("first")


#: Payment events and what they do; fixed values.
PAID = ("PAYMENT_CONFIRMED", "PAYMENT_RECEIVED")
LATE = ("PAYMENT_OVERDUE", "PAYMENT_CREDIT_CARD_CAPTURE_REFUSED")
ENDED = ("SUBSCRIPTION_INACTIVATED", "SUBSCRIPTION_DELETED")
UNDONE = ("PAYMENT_DELETED", "PAYMENT_REFUNDED")
#: Days that a payment buys.
PERIOD_DAYS = 30


def subscription_after(events: DataFrame) -> DataFrame:
    """The state of each user's subscription after payment events (user_id, event_id, at, event), in order of (at, event_id).

    A late payment makes a subscription pending unless the last payment's period still runs. Each state
    follows from the last event that sets one and the last payment before it, so ordered windows do what a
    fold over the events would: user_id, status, last_payment, first_payment, canceled_at, last_issue.
    """
    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paid, late = F.col("event").isin(*PAID), F.col("event").isin(*LATE)
    gone = F.col("event").isin(*ENDED, *UNDONE)
    at = F.col("at").cast("timestamp")
    lines = events.withColumn("paid_at", F.last(F.when(paid, at), ignorenulls=True).over(so_far))
    covered = F.coalesce(F.col("paid_at") + _days(PERIOD_DAYS) > at, F.lit(False))
    sets = F.when(paid, F.lit("active")).when(late & ~covered, F.lit("pending")).when(gone, F.lit("canceled"))
    lines = lines.withColumns({"sets": sets, "issue": F.when(late & covered, at)})
    return lines.groupBy("user_id").agg(
        F.max_by("sets", F.when(F.col("sets").isNotNull(), F.struct("at", "event_id"))).alias("status"),
        F.max(F.when(paid, at)).alias("last_payment"),
        F.min(F.when(paid, at)).alias("first_payment"),
        F.max(F.when(gone, at)).alias("canceled_at"),
        F.max("issue").alias("last_issue"),
    )
