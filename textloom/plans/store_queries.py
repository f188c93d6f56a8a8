"""Store analytics, dictionaries, mutations and evidence over the driver's tables.

``events`` is the usage log (event_type as abbreviation, the number in ``props`` as expansion),
``part`` a layered dictionary, ``conversations`` the history, customers and nations users and roles.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import dictionary, evidence, mutate, store
from textloom.session import table

AS_OF = dt.date(2024, 1, 30)
#: A deployment takes its own from its settings.
SECRET = "key of the registered queries"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k"))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.col("event_type").alias("abbr"), F.col("k").alias("expanded_chosen"), F.to_date("ts").alias("usage_date"), F.lit(1).cast("long").alias("usage_count"), F.lit("live").alias("source_kind"))


_USAGE = "SELECT event_type AS abbr, json_extract_string(props, '$.k') AS expanded_chosen, ts::DATE AS usage_date, 1::BIGINT AS usage_count, 'live' AS source_kind FROM events"


def usage_top(spark: SparkSession, d: str) -> DataFrame:
    return store.top_usage(_usage(spark, d), AS_OF, days=20, limit=50)


USAGE_TOP = f"""
SELECT abbr, expanded_chosen, sum(usage_count)::BIGINT AS total_count, max(usage_date) AS last_used, count(DISTINCT usage_date)::BIGINT AS active_days
FROM ({_USAGE}) WHERE usage_date >= DATE '2024-01-30' - 20 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50
"""


def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return store.daily_usage(_usage(spark, d), AS_OF, days=7)


USAGE_DAILY = f"""
SELECT usage_date, count(DISTINCT abbr)::BIGINT AS unique_abbreviations, sum(usage_count)::BIGINT AS total_uses
FROM ({_USAGE}) WHERE usage_date >= DATE '2024-01-30' - 7 GROUP BY 1
"""


def usage_bulk_preagg(spark: SparkSession, d: str) -> DataFrame:
    return store.usage_counts(_usage(spark, d).select("abbr", "expanded_chosen"))


USAGE_BULK = f"""
SELECT left(trim(abbr), 100) AS abbr, left(trim(expanded_chosen), 500) AS expanded_chosen, count(*)::BIGINT AS n
FROM ({_USAGE}) WHERE trim(abbr) <> '' AND trim(expanded_chosen) <> '' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 200
"""


def usage_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = _usage(spark, d)
    first, second = rows.filter("usage_date < DATE '2024-01-15'"), rows.filter("usage_date >= DATE '2024-01-10'")
    return mutate.merge_usage(first.groupBy(*mutate.USAGE_KEY).agg(F.sum("usage_count").alias("usage_count")), second)


USAGE_MERGE = f"""
SELECT abbr, expanded_chosen, usage_date, source_kind, sum(usage_count)::BIGINT AS usage_count FROM (
  SELECT * FROM ({_USAGE}) WHERE usage_date < DATE '2024-01-15' UNION ALL SELECT * FROM ({_USAGE}) WHERE usage_date >= DATE '2024-01-10')
GROUP BY 1, 2, 3, 4
"""


def admission_rolling(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    seconds = F.unix_micros("ts")
    recent = lambda key: Window.partitionBy(*key).orderBy(seconds).rangeBetween(-60_000_000, 0)
    rows = _events(spark, d).select("event_id", "event_type", "user_id", "ts")
    counted = rows.withColumn("own", F.count(F.lit(1)).over(recent(["user_id"]))).withColumn("account", F.count(F.lit(1)).over(recent(["event_type"])))
    return counted.select("event_id", "own", "account", ((F.col("own") > 10) | (F.col("account") > 30)).alias("over_limit"))


ADMISSION = """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS own,
  count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS account,
  own > 10 OR account > 30 AS over_limit FROM events
"""


def rate_limit_minute(spark: SparkSession, d: str) -> DataFrame:
    counted = _events(spark, d).groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("minute"), "n", (F.col("n") > 1).alias("over_limit"))


RATE_LIMIT = "SELECT user_id, date_trunc('minute', ts) AS minute, count(*)::BIGINT AS n, count(*) > 1 AS over_limit FROM events GROUP BY 1, 2"


def _parts(spark: SparkSession, d: str, layer: int) -> DataFrame:
    rows = table(spark, d, "part").filter(F.col("p_size") % 4 == layer)
    return rows.select(F.lower(F.split("p_name", " ")[0]).alias("abbr"), F.col("p_brand").alias("domain"), F.col("p_name").alias("expanded"), "p_partkey").groupBy("abbr", "domain").agg(F.min("expanded").alias("expanded"))


def dictionary_layers(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.layered([_parts(spark, d, layer) for layer in range(4)], ["abbr", "domain"])


DICTIONARY_LAYERS = """
WITH p AS (SELECT lower(split_part(p_name, ' ', 1)) AS abbr, p_brand AS domain, p_size % 4 AS layer, min(p_name) AS expanded FROM part GROUP BY 1, 2, 3)
SELECT abbr, domain, arg_max(expanded, layer) AS expanded FROM p GROUP BY 1, 2
"""


def phrase_priority(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_name").alias("phrase"), F.col("p_brand").alias("expanded"), "p_size", "p_partkey")
    batches = []
    for layer, source in enumerate(("mined", "db", "override")):
        rows = parts.filter(F.col("p_size") % 3 == layer).groupBy("phrase").agg(F.min("expanded").alias("expanded"))
        batches.append(rows.select("phrase", "expanded", F.lit(source).alias("source"), F.lit("0.5").alias("confidence")))
    return dictionary.phrase_table(batches).select("phrase", "expanded", "source", F.col("priority").cast("long").alias("priority"))


PHRASE_PRIORITY = """
WITH p AS (SELECT array_to_string(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda t: t <> ''), ' ') AS phrase, p_size % 3 AS layer, min(p_brand) AS expanded FROM part GROUP BY 1, 2)
SELECT phrase, arg_max(expanded, layer) AS expanded, CASE max(layer) WHEN 2 THEN 'override' WHEN 1 THEN 'db' ELSE 'mined' END AS source, (max(layer) + 1)::BIGINT AS priority
FROM p WHERE len(string_split(phrase, ' ')) BETWEEN 2 AND 5 GROUP BY 1
"""


def roles_csv(spark: SparkSession, d: str) -> DataFrame:
    customers, nations = table(spark, d, "customer"), table(spark, d, "nation")
    users = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("username"))
    roles = nations.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("role_name"))
    owned = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select(F.col("n_regionkey").alias("user_id"), F.col("n_nationkey").alias("role_id")).distinct()
    return store.with_roles(users, owned, roles).select("username", "roles_csv")


ROLES_CSV = """
SELECT r_name AS username, string_agg(n_name, ',' ORDER BY n_name) AS roles_csv FROM region
LEFT JOIN (SELECT DISTINCT n_regionkey, n_name FROM nation JOIN customer ON c_nationkey = n_nationkey) ON n_regionkey = r_regionkey GROUP BY 1
"""


def history_page(spark: SparkSession, d: str) -> DataFrame:
    return store.page(table(spark, d, "conversations").select("conv_id", "turn", "role"), [F.desc("conv_id"), F.asc("turn")], offset=20, limit=500)


HISTORY_PAGE = "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn LIMIT 100 OFFSET 20"


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(_events(spark, d), "user_id", "ts", "event_id").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


LATEST_EVENT = "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1"


def newest_evidence(spark: SparkSession, d: str) -> DataFrame:
    return store.newest_per_key(_events(spark, d), "user_id", "ts", "event_id", 10).select("user_id", "event_id")


NEWEST_EVIDENCE = "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10"


def retention_dry_run(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    as_of = dt.datetime(2024, 4, 10)
    created = rows.select(F.col("ts").alias("created_at"))
    expires = rows.select((F.col("ts") + F.make_dt_interval(days=F.lit(80))).alias("expires_at"))
    return store.retention_counts(history=created, errors=created, cache=expires, sessions=expires, as_of=as_of)


RETENTION = """
WITH e AS (SELECT ts, ts + INTERVAL 80 DAY AS x FROM events)
SELECT 'history' AS table_name, count(*) FILTER (ts < TIMESTAMP '2024-04-10' - INTERVAL 365 DAY)::BIGINT AS expired FROM e
UNION ALL SELECT 'errors', count(*) FILTER (ts < TIMESTAMP '2024-04-10' - INTERVAL 90 DAY) FROM e
UNION ALL SELECT 'cache', count(*) FILTER (x < TIMESTAMP '2024-04-10') FROM e
UNION ALL SELECT 'sessions', count(*) FILTER (x < TIMESTAMP '2024-04-10') FROM e
"""


def pending_submit_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("ts", F.col("k").alias("abbr"), F.lit("general").alias("domain"), "user_id", F.col("event_type").alias("suggestion"))
    folded = mutate.fold_submissions(rows)
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_submitted_at", "last_submitted_at")]
    return folded.select("abbr", "domain", "submission_count", *times, "submitted_by", F.array_join("suggestions", ",").alias("suggestions"))


PENDING_FOLD = """
WITH e AS (SELECT ts, lower(trim(json_extract_string(props, '$.k'))) AS abbr, user_id, event_type FROM events),
f AS (SELECT abbr, event_type, min(ts) AS t FROM e GROUP BY 1, 2),
s AS (SELECT abbr, string_agg(event_type, ',' ORDER BY t, event_type) AS suggestions FROM f GROUP BY 1)
SELECT e.abbr, 'general' AS domain, count(*)::BIGINT AS submission_count, min(ts) AS first_submitted_at, max(ts) AS last_submitted_at,
  arg_min(user_id, (ts, user_id)) AS submitted_by, any_value(suggestions) AS suggestions FROM e JOIN s USING (abbr) GROUP BY e.abbr
"""


def preferences_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("user_id", F.col("event_type").alias("preference_key"), F.struct(F.col("k"), F.col("event_id")).alias("v"), F.struct("ts", "event_id").alias("updated_at"), (F.col("k").cast("int") % 7 == 0).alias("gone"))
    state, changes = rows.filter("updated_at.ts < '2024-01-15'").drop("gone"), rows.filter("updated_at.ts >= '2024-01-15'")
    return mutate.last_wins(state, changes, ["user_id", "preference_key"], deleted="gone").select("user_id", "preference_key", F.col("v.k").alias("preference_value"))


PREFERENCES = """
WITH r AS (SELECT user_id, event_type AS preference_key, json_extract_string(props, '$.k') AS k, ts, event_id,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, preference_key, k AS preference_value FROM r WHERE r = 1 AND NOT (ts >= TIMESTAMP '2024-01-15' AND k::INT % 7 = 0)
"""


def login_lockouts(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_id", "ts", "user_id", (F.col("value") > 50).alias("ok"))
    counted = mutate.failed_logins(rows, most=3)
    return counted.select("event_id", F.col("failures").cast("long").alias("failures"), F.col("locked_until").isNotNull().alias("locked"))


LOGIN = """
WITH i AS (SELECT event_id, ts, user_id, value > 50 AS ok, sum((value > 50)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM events),
f AS (SELECT event_id, sum((NOT ok)::INT) OVER (PARTITION BY user_id, run ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS failures FROM i)
SELECT event_id, failures, failures >= 3 AS locked FROM f
"""


def moderation(spark: SparkSession, d: str) -> DataFrame:
    """Customers are the queue; each order is a decision on its customer's row."""
    pending = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("PENDING").alias("status"), F.lit("meaning").alias("suggested"), F.lit(None).cast("string").alias("reviewed_by"))
    orders = table(spark, d, "orders")
    decisions = orders.select(F.struct("o_orderdate", "o_orderkey").alias("ts"), F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "REJECT").otherwise("APPROVE").alias("action"), F.col("o_orderpriority").alias("reviewer"), F.lit(None).cast("string").alias("expanded"))
    return mutate.moderate(pending, decisions).select("id", "status", "reviewed_by")


MODERATION = """
WITH o AS (SELECT o_custkey AS id, (o_orderdate, o_orderkey) AS t, o_orderkey % 3 = 0 AS rejects, o_orderpriority AS reviewer FROM orders),
r AS (SELECT id, max(t) AS t, arg_max(reviewer, t) AS reviewer FROM o WHERE rejects GROUP BY 1),
a AS (SELECT o.id, min(o.t) AS t, arg_min(o.reviewer, o.t) AS reviewer FROM o WHERE NOT rejects GROUP BY 1),
x AS (SELECT id, min(t) AS t FROM o WHERE rejects GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN r.id IS NOT NULL THEN 'REJECTED' WHEN a.id IS NOT NULL THEN 'APPROVED' ELSE 'PENDING' END AS status,
  CASE WHEN r.id IS NOT NULL THEN r.reviewer ELSE a.reviewer END AS reviewed_by
FROM customer LEFT JOIN r ON r.id = c_custkey LEFT JOIN a ON a.id = c_custkey
"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return e.select(
        "ts",
        F.substring("event_type", 1, 2).alias("abbr"),
        F.when(F.col("user_id") % 10 == 0, "other meaning").otherwise("some meaning").alias("meaning"),
        F.concat(F.lit("d"), F.col("user_id") % 40).alias("domain"),
        F.concat(F.substring("event_type", 1, 2), F.lit(" alpha beta "), F.translate("k", "0123456789", "abcdefghij")).alias("context"),
        F.col("event_id").alias("request_id"),
        "user_id",
        F.to_date("ts").alias("session_id"),
        F.lit(0.9).alias("confidence"),
        *(F.lit(False).alias(c) for c in ("from_cache", "retry", "reused")),
    )


def evidence_promotion(spark: SparkSession, d: str) -> DataFrame:
    found = evidence.candidates(evidence.distinct_evidence(_evidence(spark, d), SECRET))
    return found.select("abbr", "domain", "meaning", "evidence_count", "users", "status")


EVIDENCE = """
WITH e AS (
  SELECT ts, event_id, lower(left(event_type, 2)) AS abbr, CASE WHEN user_id % 10 = 0 THEN 'other meaning' ELSE 'some meaning' END AS meaning,
    'd' || (user_id % 40) AS domain, json_extract_string(props, '$.k') AS k, user_id FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY abbr, domain, meaning, k ORDER BY ts, event_id::VARCHAR) AS r FROM e),
c AS (SELECT abbr, domain, meaning, count(*)::BIGINT AS evidence_count, count(DISTINCT user_id)::BIGINT AS users FROM f WHERE r = 1 GROUP BY 1, 2, 3),
s AS (SELECT *, count(*) OVER (PARTITION BY abbr, domain) AS rivals FROM c)
SELECT abbr, domain, meaning, evidence_count, users, CASE WHEN rivals > 1 THEN 'needs_review' WHEN evidence_count >= 3 AND users >= 2 THEN 'conditional_shared' ELSE 'candidate' END AS status FROM s
"""


def reusable_meanings(spark: SparkSession, d: str) -> DataFrame:
    found = evidence.reusable(evidence.candidates(evidence.distinct_evidence(_evidence(spark, d), SECRET)))
    return found.select("abbr", "domain", "meaning")


REUSABLE = f"SELECT abbr, domain, meaning FROM ({EVIDENCE}) WHERE status = 'conditional_shared'"


QUERIES = {
    "usage_top": usage_top,
    "usage_daily": usage_daily,
    "usage_bulk_preagg": usage_bulk_preagg,
    "usage_merge": usage_merge,
    "admission_rolling": admission_rolling,
    "rate_limit_minute": rate_limit_minute,
    "dictionary_layers": dictionary_layers,
    "phrase_priority": phrase_priority,
    "roles_csv": roles_csv,
    "history_page": history_page,
    "latest_event": latest_event,
    "newest_evidence": newest_evidence,
    "retention_dry_run": retention_dry_run,
    "pending_submit_fold": pending_submit_fold,
    "preferences_last_wins": preferences_last_wins,
    "login_lockouts": login_lockouts,
    "moderation": moderation,
    "evidence_promotion": evidence_promotion,
    "reusable_meanings": reusable_meanings,
}

SQL = {
    "usage_top": USAGE_TOP,
    "usage_daily": USAGE_DAILY,
    "usage_bulk_preagg": USAGE_BULK,
    "usage_merge": USAGE_MERGE,
    "admission_rolling": ADMISSION,
    "rate_limit_minute": RATE_LIMIT,
    "dictionary_layers": DICTIONARY_LAYERS,
    "phrase_priority": PHRASE_PRIORITY,
    "roles_csv": ROLES_CSV,
    "history_page": HISTORY_PAGE,
    "latest_event": LATEST_EVENT,
    "newest_evidence": NEWEST_EVIDENCE,
    "retention_dry_run": RETENTION,
    "pending_submit_fold": PENDING_FOLD,
    "preferences_last_wins": PREFERENCES,
    "login_lockouts": LOGIN,
    "moderation": MODERATION,
    "evidence_promotion": EVIDENCE,
    "reusable_meanings": REUSABLE,
}
