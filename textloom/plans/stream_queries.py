"""Streaming jobs run over the event files to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import new_folder, table
from textloom.streaming import admission, exports, jobs


def _events(spark: SparkSession, d: str) -> DataFrame:
    stream = jobs.file_stream(spark, f"{d}/event*.parquet", table(spark, d, "events"))
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k"))


#: The first micro-batch of the late stream ends here; one in fifty of all events comes in the third.
CUT = "2024-01-20"


def streaming_usage_daily(spark: SparkSession, d: str) -> DataFrame:
    """Three micro-batches: events up to CUT, those after it, and stragglers of the whole month, some of them too late.

    The watermark lies a day behind the newest event; a batch drops what was late before the batch ahead of it.
    """
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    straggler, early = F.col("event_id") % 50 == 0, F.col("ts") < CUT
    folder, files = new_folder(spark, "late"), 4
    for batch in (~straggler & early, ~straggler & ~early, straggler):
        rows.filter(batch).repartition(files).write.mode("append").parquet(folder)
    stream = jobs.file_stream(spark, folder, rows, files)
    picks = stream.select("ts", F.col("event_type").alias("abbr"), F.get_json_object("props", "$.k").alias("expanded_chosen"))
    return jobs.snapshots(jobs.daily_usage(picks), ["usage_date", "abbr", "expanded_chosen"], new_folder(spark, "usage"))


USAGE = f"""
WITH e AS (SELECT ts, event_type AS abbr, json_extract_string(props, '$.k') AS expanded_chosen, event_id % 50 = 0 AS straggler FROM events),
w AS (SELECT date_trunc('millisecond', max(ts) - INTERVAL 1 DAY) AS mark FROM e WHERE NOT straggler AND ts < TIMESTAMP '{CUT}')
SELECT ts::DATE AS usage_date, abbr, expanded_chosen, count(*)::BIGINT AS usage_count FROM e, w
WHERE NOT straggler OR ts::DATE + INTERVAL 1 DAY > mark GROUP BY 1, 2, 3
"""


def streaming_rate_limits(spark: SparkSession, d: str) -> DataFrame:
    limits = jobs.rate_limits(_events(spark, d).select("ts", "user_id"), 1, per="1 hour")
    rows = jobs.snapshots(limits, ["user_id", "minute"], new_folder(spark, "limits"))
    return rows.withColumn("minute", F.col("minute").cast("timestamp_ntz"))


LIMITS = "SELECT user_id, date_trunc('hour', ts) AS minute, count(*)::BIGINT AS n, count(*) > 1 AS over_limit FROM events GROUP BY 1, 2"


def streaming_replays(spark: SparkSession, d: str) -> DataFrame:
    """Events of one type and first digit are submissions of one abbreviation; those of a low value fail."""
    submissions = _events(spark, d).select("ts", F.substring("k", 1, 1).alias("abbr"), F.col("event_type").alias("domain"), F.col("event_id").alias("request_id"), (F.col("value") > 20).alias("ok"))
    return jobs.appended(jobs.without_replays(submissions), new_folder(spark, "replays"))


REPLAYS = """
WITH RECURSIVE e AS (
  SELECT left(json_extract_string(props, '$.k'), 1) AS abbr, event_type AS domain, event_id AS request_id, ts, value > 20 AS ok FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY abbr, domain ORDER BY ts, request_id) AS n FROM e WHERE ok),
hop AS (SELECT *, min(n) OVER (PARTITION BY abbr, domain ORDER BY ts RANGE BETWEEN INTERVAL '30 seconds 1 microsecond' FOLLOWING AND UNBOUNDED FOLLOWING) AS m FROM g),
kept AS (
  SELECT abbr, domain, 1::BIGINT AS n FROM (SELECT DISTINCT abbr, domain FROM g)
  UNION ALL SELECT kept.abbr, kept.domain, hop.m FROM kept JOIN hop ON hop.abbr = kept.abbr AND hop.domain = kept.domain AND hop.n = kept.n WHERE hop.m IS NOT NULL),
good AS (SELECT g.abbr, g.domain, request_id, ts, true AS ok FROM g JOIN kept USING (abbr, domain, n)),
seen AS (
  SELECT *, max(CASE WHEN ok THEN ts END) OVER (PARTITION BY abbr, domain ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT * FROM good UNION ALL SELECT abbr, domain, request_id, ts, ok FROM e WHERE NOT ok))
SELECT abbr, domain, request_id FROM seen WHERE ok OR before IS NULL OR ts > before + INTERVAL 30 SECONDS
"""


def streaming_breaker(spark: SparkSession, d: str) -> DataFrame:
    """High values are refusals, which close a user's account for as many hours as the number in ``props``."""
    calls = _events(spark, d).select("ts", F.col("user_id").alias("account"), F.col("event_id").alias("call_id"), F.when(F.col("value") > 90, 429).otherwise(200).alias("status"), (F.col("k").cast("int") * 3600).alias("retry_after"))
    return jobs.appended(jobs.breaker(calls), new_folder(spark, "breaker"))


BREAKER = """
WITH e AS (SELECT *, CASE WHEN value > 90 THEN ts + INTERVAL 1 HOUR * json_extract_string(props, '$.k')::INT END AS until FROM events)
SELECT user_id AS account, event_id AS call_id,
  coalesce(max(until) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > ts, false) AS blocked FROM e
"""


def streaming_versions(spark: SparkSession, d: str) -> DataFrame:
    """A user's events without a pause of two days are one burst of edits; the one with the highest id is its last version."""
    edits = _events(spark, d).select("ts", F.col("user_id").alias("session_id"), F.col("event_type").alias("text"), F.col("event_id").alias("version"))
    return jobs.appended(jobs.latest_versions(edits, "2 days"), new_folder(spark, "versions"))


VERSIONS = """
WITH b AS (SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 DAY <= ts)::INT AS starts FROM events),
s AS (SELECT *, sum(coalesce(starts, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM b)
SELECT user_id AS session_id, max(event_id) AS version, arg_max(event_type, event_id) AS text FROM s
GROUP BY user_id, burst HAVING max(ts) + INTERVAL 2 DAY <= (SELECT date_trunc('millisecond', max(ts) - INTERVAL 10 SECOND) FROM events)
"""


def streaming_admission(spark: SparkSession, d: str) -> DataFrame:
    requests = _events(spark, d).select("ts", F.col("event_type").alias("account"), F.col("user_id").cast("string").alias("owner"), F.col("event_id").alias("request_id"), F.lit(None).cast("double").alias("took"))
    return jobs.appended(admission.admitted(requests), new_folder(spark, "admission"))


ADMISSION = """
WITH RECURSIVE e AS (SELECT event_type AS account, event_id AS request_id, user_id::VARCHAR AS owner, epoch_us(ts) / 1e6 AS now, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
s AS (
  SELECT account, 0::BIGINT AS k, []::STRUCT(o VARCHAR, t DOUBLE, x DOUBLE)[] AS held, NULL::BIGINT AS request_id, NULL::BOOLEAN AS admitted FROM (SELECT DISTINCT account FROM e)
  UNION ALL
  SELECT account, k, CASE WHEN good THEN list_append(h, {'o': owner, 't': now, 'x': now + 91}) ELSE h END, request_id, good
  FROM (
    SELECT *, len(h) < 30 AND len(list_filter(h, lambda y: y.o = owner)) < 10 AND len(list_filter(h, lambda y: y.x > now)) < 4 AND len(list_filter(h, lambda y: y.x > now AND y.o = owner)) < 2 AS good
    FROM (SELECT e.*, list_filter(s.held, lambda y: y.t > e.now - 60 OR y.x > e.now) AS h FROM s JOIN e ON e.account = s.account AND e.k = s.k + 1)))
SELECT account, request_id, admitted FROM s WHERE k > 0
"""


def streaming_export(spark: SparkSession, d: str) -> DataFrame:
    """Events approve a meaning of a user's abbreviation, or delete it; three micro-batches make three revisions."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = new_folder(spark, "approvals")
    for part in range(3):
        rows.filter(F.col("event_id") % 3 == part).repartition(2).write.mode("append").parquet(folder)
    stream = jobs.file_stream(spark, folder, rows, 2)
    changes = stream.select(F.col("user_id").cast("string").alias("domain"), F.col("event_type").alias("abbr"), F.get_json_object("props", "$.k").alias("expanded"), F.struct("ts", "event_id").alias("updated_at"), (F.col("value") > 90).alias("deleted"))
    return exports.exported(changes, new_folder(spark, "export"), ["domain", "abbr"]).select("domain", "abbr", "expanded")


#: A deletion drops its key at the end of its micro-batch, so an older approval in a later one stands again.
EXPORT = """
WITH e AS (SELECT user_id::VARCHAR AS domain, event_type AS abbr, json_extract_string(props, '$.k') AS expanded, (ts, event_id) AS t, value > 90 AS gone, event_id % 3 AS part FROM events),
b AS (SELECT domain, abbr, part, arg_max(expanded, t) AS expanded, max(t) AS t, arg_max(gone, t) AS gone FROM e GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT domain, abbr FROM e),
s0 AS (SELECT domain, abbr, expanded, t FROM b WHERE part = 0 AND NOT gone),
s1 AS (SELECT domain, abbr, expanded, t FROM (SELECT k.domain, k.abbr, CASE WHEN b.t IS NULL OR s0.t > b.t THEN s0.expanded ELSE b.expanded END AS expanded, CASE WHEN b.t IS NULL OR s0.t > b.t THEN s0.t ELSE b.t END AS t,
  CASE WHEN b.t IS NULL OR s0.t > b.t THEN false ELSE b.gone END AS gone FROM k LEFT JOIN s0 USING (domain, abbr) LEFT JOIN (SELECT * FROM b WHERE part = 1) AS b USING (domain, abbr)) WHERE t IS NOT NULL AND NOT gone),
s2 AS (SELECT domain, abbr, expanded, t FROM (SELECT k.domain, k.abbr, CASE WHEN b.t IS NULL OR s1.t > b.t THEN s1.expanded ELSE b.expanded END AS expanded, CASE WHEN b.t IS NULL OR s1.t > b.t THEN s1.t ELSE b.t END AS t,
  CASE WHEN b.t IS NULL OR s1.t > b.t THEN false ELSE b.gone END AS gone FROM k LEFT JOIN s1 USING (domain, abbr) LEFT JOIN (SELECT * FROM b WHERE part = 2) AS b USING (domain, abbr)) WHERE t IS NOT NULL AND NOT gone)
SELECT domain, abbr, expanded FROM s2
"""


QUERIES = {
    "streaming_usage_daily": streaming_usage_daily,
    "streaming_rate_limits": streaming_rate_limits,
    "streaming_replays": streaming_replays,
    "streaming_breaker": streaming_breaker,
    "streaming_versions": streaming_versions,
    "streaming_export": streaming_export,
    "streaming_admission": streaming_admission,
}

SQL = {"streaming_usage_daily": USAGE, "streaming_rate_limits": LIMITS, "streaming_replays": REPLAYS, "streaming_breaker": BREAKER, "streaming_versions": VERSIONS, "streaming_export": EXPORT, "streaming_admission": ADMISSION}
