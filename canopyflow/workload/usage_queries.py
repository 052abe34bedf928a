"""Queries over audit events, users and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyflow.operators import usage
from canopyflow.workload import views as V
from canopyflow.workload.registry import query



def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_stamp(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')"


@query("src9_audit_events", f"WITH {V.AUDIT} SELECT id, username, {sql_stamp('ts')} AS ts, event, page, target, meta "
       "FROM audit")
def src9(spark, sf):
    return V.audit_events(spark, sf).select("id", "username", stamp("ts").alias("ts"), "event", "page", "target", "meta")


@query("a21_audit_per_user", f"""WITH {V.AUDIT} SELECT username, count(*) AS events,
  count(DISTINCT CAST(ts AS DATE)) AS active_days, count(*) FILTER (event = 'login') AS logins,
  count(*) FILTER (event = 'click') AS clicks, count(*) FILTER (event = 'analyze') AS analyses,
  count(*) FILTER (event = 'vectorize') AS vectorizations, count(*) FILTER (event = 'calibrate') AS calibrations,
  {sql_stamp('min(ts)')} AS first_event, {sql_stamp('max(ts)')} AS last_event FROM audit GROUP BY 1""")
def a21(spark, sf):
    df = usage.per_user(V.audit_events(spark, sf))
    return df.withColumns({"first_event": stamp("first_event"), "last_event": stamp("last_event")})


@query("a22_audit_per_kind", f"WITH {V.AUDIT} SELECT event, count(*) AS n FROM audit GROUP BY 1")
def a22(spark, sf):
    return usage.per_kind(V.audit_events(spark, sf))


@query("a23_audit_per_day", f"""WITH {V.AUDIT} SELECT day, n FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n
  FROM audit GROUP BY 1 ORDER BY day DESC LIMIT 30)""")
def a23(spark, sf):
    return usage.per_day(V.audit_events(spark, sf))


@query("a24_audit_per_page", f"""WITH {V.AUDIT} SELECT page, count(*) AS n FROM audit WHERE page IS NOT NULL
  GROUP BY 1 ORDER BY n DESC, page LIMIT 20""")
def a24(spark, sf):
    return usage.per_page(V.audit_events(spark, sf))


@query("a25_audit_per_target", f"""WITH {V.AUDIT} SELECT target, count(*) AS n FROM audit
  WHERE event = 'click' AND target <> '' GROUP BY 1 ORDER BY n DESC, target LIMIT 30""")
def a25(spark, sf):
    return usage.per_target(V.audit_events(spark, sf))


@query("a26_dashboard_totals", f"""WITH {V.AUDIT} SELECT count(*) AS events, count(DISTINCT username) AS users,
  count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-10') AS events_today,
  count(*) FILTER (event = 'analyze') AS analyses, count(*) FILTER (event = 'vectorize') AS vectorizations
  FROM audit""")
def a26(spark, sf):
    return usage.totals(V.audit_events(spark, sf), F.lit("2024-01-10").cast("date"))


@query("t2_recent_events", f"""WITH {V.AUDIT} SELECT id, username, {sql_stamp('ts')} AS ts, event, page, target
  FROM audit ORDER BY id DESC LIMIT 100""")
def t2(spark, sf):
    return (usage.recent(V.audit_events(spark, sf))
            .select("id", "username", stamp("ts").alias("ts"), "event", "page", "target"))


@query("t3_users_by_events", f"WITH {V.AUDIT} SELECT username, count(*) AS events FROM audit GROUP BY 1")
def t3(spark, sf):
    return usage.per_user(V.audit_events(spark, sf)).select("username", "events")


@query("p17_demo_events", f"""WITH {V.AUDIT} SELECT count(*) FILTER (meta ILIKE '%"demo":true%') AS literal_match,
  count(*) FILTER (json_extract_string(meta, '$.demo') = 'true') AS parsed_match, count(*) AS n FROM audit""")
def p17(spark, sf):
    return V.audit_events(spark, sf).agg(
        F.count_if(usage.is_demo(literal=True)).alias("literal_match"),
        F.count_if(usage.is_demo()).alias("parsed_match"), F.count(F.lit(1)).alias("n"))


@query("j16_clear_demo", f"""WITH {V.AUDIT} SELECT id, event FROM audit
  WHERE NOT coalesce(json_extract_string(meta, '$.demo') = 'true', FALSE)""")
def j16_demo(spark, sf):
    return usage.clear_events(V.audit_events(spark, sf)).select("id", "event")


@query("j16_purge_sessions", f"""WITH {V.SESSIONS}, {V.USERS} SELECT token, user_id FROM sessions WHERE user_id NOT IN (
  SELECT user_id FROM users WHERE role = 'admin')""")
def j16_sessions(spark, sf):
    accounts = V.users(spark, sf)
    changed = accounts.where(F.col("role") == "admin").select("username")
    return usage.sessions_after_password_change(V.sessions(spark, sf), accounts, changed).select("token", "user_id")


@query("p18_clicks_with_target", f"""WITH {V.AUDIT} SELECT id, target FROM audit
  WHERE event = 'click' AND target <> ''""")
def p18(spark, sf):
    return usage.clicks_with_target(V.audit_events(spark, sf)).select("id", "target")


@query("p20_client_truncation", """SELECT event_id AS id, substr(trim(repeat(event_type || ' ', 20)), 1, 60) AS target,
  substr(repeat(props, 60), 1, 400) AS meta, floor(value * 1.23456 * 10000::DOUBLE + 0.5) / 10000::DOUBLE AS lat
  FROM events""")
def p20(spark, sf):
    from canopyflow.functions.numbers import half_up
    ev = V.table(spark, sf, "events")
    long = ev.select(F.col("event_id").alias("id"), F.lit("click").alias("event"),
                     F.repeat(F.concat("event_type", F.lit(" ")), 20).alias("target"),
                     F.repeat("props", 60).alias("meta"), half_up(F.col("value") * 1.23456, 4).alias("lat"))
    return usage.client_truncate(long).select("id", "target", "meta", "lat")


@query("snk7_clean_audit", f"""WITH {V.AUDIT} SELECT id, substr(coalesce(repeat(target, 40), ''), 1, 200) AS target,
  substr(coalesce(repeat(meta, 50), ''), 1, 500) AS meta FROM audit""")
def snk7(spark, sf):
    ev = V.audit_events(spark, sf).withColumns({"target": F.repeat("target", 40), "meta": F.repeat("meta", 50)})
    return usage.clean_audit(ev).select("id", "target", "meta")


@query("f19_json_meta_field", f"""WITH {V.AUDIT} SELECT CAST(ts AS DATE) AS day,
  json_extract_string(meta, '$.demo') AS demo, count(*) AS n FROM audit GROUP BY 1, 2""")
def f19(spark, sf):
    ev = V.audit_events(spark, sf)
    return (ev.groupBy(F.to_date("ts").alias("day"), F.get_json_object("meta", "$.demo").alias("demo"))
            .agg(F.count(F.lit(1)).alias("n")))


_VALID = """valid AS (SELECT token, s.user_id, username, role, expires_at FROM sessions s JOIN users u USING (user_id)
  WHERE active AND expires_at >= TIMESTAMP '2024-01-12 00:00:00')"""
_AS_OF = "2024-01-12 00:00:00"


def _valid(spark, sf):
    return usage.valid_sessions(V.sessions(spark, sf), V.users(spark, sf), F.lit(_AS_OF).cast("timestamp_ntz"))


@query("j9_valid_sessions", f"WITH {V.SESSIONS}, {V.USERS}, {_VALID} SELECT token, user_id, username, role FROM valid")
def j9(spark, sf):
    return _valid(spark, sf).select("token", "user_id", "username", "role")


@query("j10_user_summary", f"""WITH {V.USERS}, {V.AUDIT} SELECT username, role, active, created_at,
  (SELECT count(*) FROM audit e WHERE e.username = u.username) AS events,
  (SELECT {sql_stamp('max(ts)')} FROM audit e WHERE e.username = u.username) AS last_access FROM users u""")
def j10(spark, sf):
    df = usage.user_summary(V.users(spark, sf), V.audit_events(spark, sf))
    return df.select("username", "role", "active", "created_at", "events", stamp("last_access").alias("last_access"))


@query("j11_attributed_events", f"""WITH {V.SESSIONS}, {V.USERS}, {V.AUDIT}, {_VALID} SELECT a.id, a.event,
  coalesce(v.username, 'anon') AS username FROM audit a
  LEFT JOIN valid v ON v.token = CASE WHEN a.id % 5 <> 0 THEN 'tok' || a.user_id END""")
def j11(spark, sf):
    ev = V.audit_events(spark, sf).withColumn(
        "token", F.when(F.col("id") % 5 != 0, F.concat(F.lit("tok"), F.col("user_id").cast("string"))))
    return usage.attribute_events(ev, _valid(spark, sf)).select("id", "event", "username")
