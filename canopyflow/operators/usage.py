"""Usage analytics over audit events: attribution, clean-up and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import constants as K

EVENT_COUNTS = {"logins": "login", "clicks": "click", "analyses": "analyze",
                "vectorizations": "vectorize", "calibrations": "calibrate"}


def clean_audit(events: DataFrame) -> DataFrame:
    """Bound the free-text fields as they are stored: nulls become empty text."""
    return events.withColumns({
        "target": F.substring(F.coalesce("target", F.lit("")), 1, K.TARGET_CHARS),
        "meta": F.substring(F.coalesce("meta", F.lit("")), 1, K.META_CHARS),
    })


def client_truncate(events: DataFrame) -> DataFrame:
    """Limits applied where events arise: labels, meta text, coordinates."""
    label = F.substring(F.trim(F.coalesce("target", F.lit(""))), 1, K.CLICK_LABEL_CHARS)
    return events.withColumns({
        "target": F.when(F.col("event") == "click", label)
                   .otherwise(F.substring(F.coalesce("target", F.lit("")), 1, K.TARGET_CHARS)),
        "meta": F.substring("meta", 1, K.CLIENT_META_CHARS),
    })


def is_demo(meta: str = "meta", literal: bool = False) -> Column:
    """Demo marker in the JSON text; ``literal`` is the text match without a space."""
    if literal:
        return F.coalesce(F.col(meta).ilike('%"demo":true%'), F.lit(False))
    return F.coalesce(F.get_json_object(meta, "$.demo") == "true", F.lit(False))


def clear_events(events: DataFrame, only_demo: bool = True, literal: bool = False) -> DataFrame:
    """Events left after a clean-up."""
    return events.where(~is_demo(literal=literal)) if only_demo else events.where(F.lit(False))


def clicks_with_target(events: DataFrame) -> DataFrame:
    return events.where((F.col("event") == "click") & (F.col("target") != ""))


def valid_sessions(sessions: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Sessions of active users that have not expired at ``as_of``."""
    open_sessions = sessions.where(F.col("expires_at") >= as_of)
    active = users.where("active").select("user_id", "username", "role")
    return (open_sessions.join(active, "user_id")
            .select("token", "user_id", "username", "role", "expires_at"))


def attribute_events(events: DataFrame, valid: DataFrame, at: str | None = None) -> DataFrame:
    """User name per event through its session token, ``anon`` without a valid one.

    ``at`` names an event time that must not lie after the session's expiry.
    One session may produce a large share of all events: adaptive execution splits it.
    Events without a token are given a key of their own and match nothing.
    """
    lookup = valid.select(F.col("token").alias("join_token"), F.col("username").alias("session_user"),
                          *(["expires_at"] if at else []))
    key = F.coalesce(F.col("token"), F.concat(F.lit("no-token:"), F.col("id").cast("string")))
    joined = events.drop("username").withColumn("join_token", key).join(lookup, "join_token", "left")
    name = F.when(F.col("expires_at") >= F.col(at), F.col("session_user")) if at else F.col("session_user")
    named = joined.withColumn("username", F.coalesce(name, F.lit("anon")))
    return named.drop("session_user", "join_token", *(["expires_at"] if at else []))


def user_summary(users: DataFrame, events: DataFrame) -> DataFrame:
    """Every account with its event count and last access."""
    summary = events.groupBy("username").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_access"))
    return (users.join(summary, "username", "left")
            .withColumn("events", F.coalesce("events", F.lit(0)))
            .orderBy("username"))


def per_user(events: DataFrame) -> DataFrame:
    """Events, active days, counts per kind and first/last time per user.

    Grouping by user and day first leaves one row per user and day, so a user
    with a third of all events is reduced map-side and the distinct day count
    becomes a plain count.
    """
    counts = [F.count_if(F.col("event") == kind).alias(name) for name, kind in EVENT_COUNTS.items()]
    daily = (events.groupBy("username", F.to_date("ts").alias("day"))
             .agg(F.count(F.lit(1)).alias("events"), *counts,
                  F.min("ts").alias("first_event"), F.max("ts").alias("last_event")))
    return (daily.groupBy("username")
            .agg(F.sum("events").alias("events"), F.count("day").alias("active_days"),
                 *[F.sum(n).alias(n) for n in EVENT_COUNTS],
                 F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"))
            .orderBy(F.desc("events"), "username"))


def per_kind(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event")


def per_day(events: DataFrame, days: int = 30) -> DataFrame:
    """Latest ``days`` days, oldest first."""
    daily = events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.orderBy(F.desc("day")).limit(days).orderBy("day")


def per_page(events: DataFrame, top: int = 20) -> DataFrame:
    return (events.where(F.col("page").isNotNull()).groupBy("page").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "page").limit(top))


def per_target(events: DataFrame, top: int = 30) -> DataFrame:
    return (clicks_with_target(events).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "target").limit(top))


def recent(events: DataFrame, top: int = 100) -> DataFrame:
    return events.orderBy(F.desc("id")).limit(top)


def totals(events: DataFrame, as_of: Column) -> DataFrame:
    """Dashboard header: all events, users, events of the day, runs of both analyses."""
    by_user = events.groupBy("username").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.to_date("ts") == as_of).alias("events_today"),
        F.count_if(F.col("event") == "analyze").alias("analyses"),
        F.count_if(F.col("event") == "vectorize").alias("vectorizations"))
    return by_user.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
                       F.count(F.lit(1)).alias("users"),
                       *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
                         for c in ("events_today", "analyses", "vectorizations")])


def sessions_after_password_change(sessions: DataFrame, users: DataFrame, changed: DataFrame) -> DataFrame:
    """Drop every session of the accounts named in ``changed(username)``."""
    ids = users.join(changed, "username", "left_semi").select("user_id")
    return sessions.join(ids, "user_id", "left_anti")
