"""Meanings that evidence promotes: candidates, competition, tombstones, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import spans
from textloom.functions import text as T

#: Evidence needed, and distinct users (production) or sessions (else).
MIN_EVIDENCE, MIN_USERS, MIN_SESSIONS = 3, 2, 3
KEY = ["abbr", "domain", "scope"]


def context_scope(context: Column, abbr: Column) -> Column:
    """The two words after the only occurrence of ``abbr``, or else the two before; null without either (STR-X4)."""
    tokens = T.words(context)
    n = F.size(F.filter(tokens, lambda t: t == F.lower(abbr)))
    at = F.array_position(tokens, F.lower(abbr)).cast("int")
    after = F.slice(tokens, at + 1, F.lit(2))
    before = F.when(at > 2, F.slice(tokens, F.greatest(at - 2, F.lit(1)), F.lit(2)))
    anchor = F.when(F.size(after) == 2, F.concat(F.lit("> "), F.array_join(after, " "))).when(F.size(before) == 2, F.concat(F.lit("< "), F.array_join(before, " ")))
    return F.when(n == 1, anchor)


def redact(context: Column, abbr: Column) -> Column:
    """The abbreviation with its anchor only (STR-X5)."""
    return F.concat_ws(" ", F.lower(abbr), context_scope(context, abbr))


def valid_evidence() -> Column:
    """Evidence that may count: fresh, with ids, and with plausible words and confidence."""
    return (
        ~(F.coalesce("from_cache", F.lit(False)) | F.coalesce("retry", F.lit(False)) | F.coalesce("reused", F.lit(False)))
        & F.col("request_id").isNotNull()
        & F.col("user_id").isNotNull()
        & F.col("session_id").isNotNull()
        & (T.canonical("domain") != "")
        & T.canonical("abbr").rlike(r"^\p{L}{1,20}$")
        & T.canonical("meaning").rlike(r"^\p{L}+(?: \p{L}+){0,11}$")
        & (T.canonical("abbr") != T.canonical("meaning"))
        & (F.col("confidence") > 0)
        & (F.col("confidence") <= 1)
    )


def distinct_evidence(events: DataFrame, secret: str) -> DataFrame:
    """One row per candidate, request and context: copies in either don't add evidence (JN13, AGG12).

    ``events``: ts, abbr, meaning, domain, context, request_id, user_id, session_id, confidence and
    the flags. The first of a request and the first of a context count, by time and request id; a
    row must be both. Ids and contexts are kept as hashes keyed by ``secret``; contexts that differ
    in a literal alone (a number, an address, a name) are one.
    """
    words = F.array_join(F.regexp_extract_all(T.canonical(spans.masked("context")), F.lit(r"\p{L}+"), F.lit(0)), " ")
    rows = events.filter(valid_evidence()).select(
        "ts",
        T.canonical("abbr").alias("abbr"),
        T.canonical("meaning").alias("meaning"),
        T.canonical("domain").alias("domain"),
        F.coalesce(context_scope(F.col("context"), F.col("abbr")), F.lit("unscoped")).alias("scope"),
        T.hmac_sha256(words, secret, "context").alias("context_key"),
        F.col("request_id").cast("string").alias("_id"),
        *(T.hmac_sha256(F.col(c), secret, c).alias(c) for c in ("request_id", "user_id", "session_id")),
    )
    candidate = [*KEY, "meaning"]
    order = ["ts", "_id", "context_key"]
    by_request = Window.partitionBy(*candidate, "request_id").orderBy(*order)
    by_context = Window.partitionBy(*candidate, "context_key").orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(by_request)).withColumn("_c", F.row_number().over(by_context)).filter("_r = 1 AND _c = 1").drop("_r", "_c", "_id")


def candidates(evidence: DataFrame, revoked: DataFrame | None = None, production: bool = True) -> DataFrame:
    """abbr, domain, scope, meaning, evidence_count, users, sessions, status (UPS12, JN14).

    Several meanings of one abbreviation, domain and scope send all to needs_review; a revoked one
    stays revoked and doesn't compete; a scoped candidate with enough evidence of enough users
    (production) or sessions becomes conditional_shared.
    """
    counted = evidence.groupBy(*KEY, "meaning").agg(
        F.count(F.lit(1)).alias("evidence_count"), F.countDistinct("user_id").alias("users"), F.countDistinct("session_id").alias("sessions")
    )
    if revoked is None:
        counted = counted.withColumn("_revoked", F.lit(False))
    else:
        gone = revoked.select(*KEY, "meaning").distinct().withColumn("_gone", F.lit(True))
        counted = counted.join(gone, [*KEY, "meaning"], "left").withColumn("_revoked", F.col("_gone").isNotNull()).drop("_gone")
    rivals = F.count_if(~F.col("_revoked")).over(Window.partitionBy(*KEY))
    enough = (F.col("users") >= MIN_USERS) if production else (F.col("sessions") >= MIN_SESSIONS)
    status = (
        F.when(F.col("_revoked"), "revoked")
        .when(rivals > 1, "needs_review")
        .when((F.col("scope") != "unscoped") & (F.col("evidence_count") >= MIN_EVIDENCE) & enough, "conditional_shared")
        .otherwise("candidate")
    )
    return counted.withColumn("status", status).drop("_revoked")


def reusable(rows: DataFrame) -> DataFrame:
    """abbr, domain, scope, meaning where exactly one shared or confirmed meaning stands (FLT11, REV5)."""
    eligible = rows.filter(F.col("status").isin("conditional_shared", "confirmed"))
    return eligible.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.first("meaning").alias("meaning")).filter("n = 1").drop("n")
