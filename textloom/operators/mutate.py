"""Changes to the store as pure functions: (state, changes) to the new state.

Parquet has no MERGE, so a writer replaces a table or its partitions with the result. A key's
changes are folded with aggregates; only state machines whose steps depend on each other sort one
key's few events in an array.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

USAGE_KEY = ["abbr", "expanded_chosen", "usage_date", "source_kind"]


def merge_usage(usage: DataFrame, increments: DataFrame) -> DataFrame:
    """Daily counters with ``increments`` added (UPS1)."""
    columns = [*USAGE_KEY, "usage_count"]
    return usage.select(columns).unionByName(increments.select(columns)).groupBy(USAGE_KEY).agg(F.sum("usage_count").alias("usage_count"))


def last_wins(state: DataFrame, changes: DataFrame, keys: list[str], time: str = "updated_at", deleted: str | None = None) -> DataFrame:
    """The newest row of each key; with ``deleted``, keys whose newest row is a tombstone go (UPS2, UPS3, UPS17)."""
    columns = state.columns
    extra = [deleted] if deleted else []
    rows = state.select(*columns, *(F.lit(False).alias(d) for d in extra), F.lit(0).alias("_new")).unionByName(changes.select(*columns, *extra, F.lit(1).alias("_new")))
    best = rows.groupBy(keys).agg(F.max_by(F.struct(*(c for c in [*columns, *extra] if c not in keys)), F.struct(time, "_new")).alias("row")).select(*keys, "row.*")
    return best.filter(~F.col(deleted)).select(columns) if deleted else best.select(columns)


def upsert_seed(state: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed rows into abbreviations (UPS4, seed side).

    A row whose last approver isn't the seeder stays as it is; else alternatives are merged, with
    the stored primary meaning first. Columns: abbr, domain, expanded, alternatives (array), approved_by.
    """
    return _upsert(state, seed, replace=False)


def upsert_admin(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows by an administrator replace what is stored (UPS4, admin side)."""
    return _upsert(state, rows, replace=True)


#: Fixed value: the actor under whose name seeds are stored.
SEED_ACTOR = "json_seed"


def _upsert(state: DataFrame, rows: DataFrame, replace: bool) -> DataFrame:
    old = state.select("abbr", "domain", F.struct("expanded", "alternatives", "approved_by").alias("old"))
    new = rows.select("abbr", "domain", F.struct("expanded", "alternatives", "approved_by").alias("new"))
    both = old.join(new, ["abbr", "domain"], "full_outer")
    merged = F.struct(
        F.col("old.expanded").alias("expanded"),
        F.array_except(T.ordered_union(F.col("old.alternatives"), F.array("new.expanded"), F.col("new.alternatives")), F.array("old.expanded")).alias("alternatives"),
        F.col("new.approved_by").alias("approved_by"),
    )
    kept = F.col("old") if not replace else F.col("new")
    row = F.when(F.col("new").isNull(), F.col("old")).when(F.col("old").isNull(), F.col("new"))
    row = row.otherwise(kept) if replace else row.when(F.col("old.approved_by") == SEED_ACTOR, merged).otherwise(F.col("old"))
    return both.select("abbr", "domain", row.alias("row")).select("abbr", "domain", "row.*")


def upsert_override(state: DataFrame, rows: DataFrame) -> DataFrame:
    """A user's new meaning becomes primary and the old one an alternative (UPS5). Adds user_id to the key."""
    keys = ["user_id", "abbr", "domain"]
    old = state.select(*keys, F.col("expanded").alias("old"), F.col("alternatives").alias("old_alternatives"))
    new = rows.select(*keys, F.col("expanded").alias("new"), F.col("alternatives").alias("new_alternatives"))
    both = old.join(new, keys, "full_outer")
    others = T.ordered_union(F.array("old"), F.col("old_alternatives"), F.col("new_alternatives"))
    return both.select(*keys, F.coalesce("new", "old").alias("expanded"), F.array_except(others, F.array(F.coalesce("new", "old"))).alias("alternatives"))


def fold_submissions(events: DataFrame) -> DataFrame:
    """abbr, domain, submission_count, first_submitted_at, last_submitted_at, submitted_by, suggestions (UPS6, UPS7).

    ``events``: ts, abbr, domain, user_id, suggestion (may be null). The first submitter stays;
    suggestions are distinct, in order of their first appearance.
    """
    keys = [F.lower(F.trim("abbr")).alias("abbr"), "domain"]
    # each suggestion's first time, before a key's distinct suggestions are put in order
    firsts = events.filter(F.trim(F.coalesce("suggestion", F.lit(""))) != "").groupBy(*keys, F.trim("suggestion").alias("suggestion")).agg(F.min("ts").alias("ts"))
    listed = firsts.groupBy("abbr", "domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "suggestion"))), lambda x: x["suggestion"]).alias("suggestions"))
    counted = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("submission_count"),
        F.min("ts").alias("first_submitted_at"),
        F.max("ts").alias("last_submitted_at"),
        F.min_by("user_id", F.struct("ts", "user_id")).alias("submitted_by"),
    )
    return counted.join(listed, ["abbr", "domain"], "left").withColumn("suggestions", F.coalesce("suggestions", F.array().cast("array<string>")))


def best_submissions(rows: DataFrame, order: str) -> DataFrame:
    """Pending submissions with one row for each abbreviation: the one that asks most of the user (AGG19).

    Needing a meaning counts before taking more meanings, and that before having an id alone; of equals the
    first by ``order`` stays. Blank abbreviations are never merged. Columns: abbr,
    needs_user_meaning, can_add_more_meanings, pending_id and any others.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rank = F.when(flag("needs_user_meaning"), 3).when(flag("can_add_more_meanings"), 2).when(F.coalesce(F.col("pending_id").cast("string"), F.lit("")) != "", 1).otherwise(0)
    keyed = rows.withColumn("_key", F.lower(F.trim(F.coalesce("abbr", F.lit(""))))).withColumn("_row", F.struct(*rows.columns))
    named = keyed.filter("_key <> ''").groupBy("_key").agg(F.max_by("_row", F.struct(rank, -F.col(order))).alias("_row"))
    return named.select("_row.*").unionByName(keyed.filter("_key = ''").select(rows.columns))


def suggestion_outcome(existing: Column, suggestion: Column) -> Column:
    """CAPTURED for the first meaning, EXISTS for a known one, else APPENDED (UPS7)."""
    return F.when(F.size(existing) == 0, "CAPTURED").when(F.array_contains(existing, suggestion), "EXISTS").otherwise("APPENDED")


def moderate(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue after ``decisions`` (ts, id, action APPROVE or REJECT, reviewer, expanded) (UPS8).

    Decisions on a row are taken in order. An approval counts on a PENDING row with a meaning (its
    own or the decision's); a rejection counts on any. Decisions that don't count change nothing.
    """
    listed = decisions.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ts", "action", "reviewer", "expanded"))).alias("decisions"))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    start = F.struct(F.col("status"), F.col("suggested"), F.col("reviewed_by"))

    def step(state: Column, d: Column) -> Column:
        meaning = F.when(text(d["expanded"]) != "", text(d["expanded"])).otherwise(text(state["suggested"]))
        approves = (d["action"] == "APPROVE") & (state["status"] == "PENDING") & (meaning != "")
        rejects = d["action"] == "REJECT"
        return F.struct(
            F.when(approves, "APPROVED").when(rejects, "REJECTED").otherwise(state["status"]).alias("status"),
            F.when(approves, meaning).otherwise(state["suggested"]).alias("suggested"),
            F.when(approves | rejects, d["reviewer"]).otherwise(state["reviewed_by"]).alias("reviewed_by"),
        )

    none = F.array().cast(listed.schema["decisions"].dataType)
    after = pending.join(listed, "id", "left").withColumn("_s", F.aggregate(F.coalesce("decisions", none), start, step))
    changed = {"status", "suggested", "reviewed_by"}
    return after.select(*(F.col(f"_s.{c}").alias(c) if c in changed else c for c in pending.columns))


def approved_meanings(state: DataFrame, approved: DataFrame) -> DataFrame:
    """Abbreviations with newly approved meanings; a stored primary meaning is never replaced (UPS8, UPS10)."""
    return _upsert(state.withColumn("approved_by", F.lit(SEED_ACTOR)), approved, replace=False)


def deactivate(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Soft delete: is_active is false for the ids of ``gone`` (UPS9)."""
    marked = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return rows.join(marked, key, "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).select(rows.columns)


def conditional_update(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns that a change gives; a null leaves the old value (FLT12)."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(new, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def start_sessions(sessions: DataFrame, logins: DataFrame, hours: int = 24) -> DataFrame:
    """``sessions`` with one for each login (ts, user_id, token_hash) of a token that isn't there yet (UPS13)."""
    new = logins.groupBy("token_hash").agg(F.min_by(F.struct("user_id", "ts"), F.struct("ts", "user_id")).alias("l"))
    new = new.join(sessions.select("token_hash"), "token_hash", "left_anti")
    columns = {"token_hash": F.col("token_hash"), "user_id": F.col("l.user_id"), "created_at": F.col("l.ts"), "expires_at": F.col("l.ts") + F.make_dt_interval(hours=F.lit(hours)), "revoked_at": F.lit(None).cast("timestamp"), "is_active": F.lit(True)}
    return sessions.unionByName(new.select(*(columns.get(c, F.lit(None)).alias(c) for c in sessions.columns)))


def end_sessions(sessions: DataFrame, as_of: dt.datetime, user_id: str | None = None, token_hash: str | None = None) -> DataFrame:
    """Revokes one session or all of a user's, and marks expired ones (UPS13)."""
    hit = F.lit(False)
    if token_hash is not None:
        hit = F.col("token_hash") == token_hash
    elif user_id is not None:
        hit = F.col("user_id") == user_id
    revoked = F.when(hit & F.col("is_active"), F.lit(as_of)).otherwise(F.col("revoked_at"))
    return sessions.withColumn("revoked_at", revoked).withColumn("is_active", F.col("is_active") & ~hit & (F.col("expires_at") > F.lit(as_of)))


def failed_logins(attempts: DataFrame, most: int = 5, lock_minutes: int = 15, nth: str = "ok") -> DataFrame:
    """attempts (ts, user_id, ok) with failures since the last success, and locked_until (UPS14).

    Attempts of one time go by the column ``nth``, as an id; without one, failures come first.
    """
    order = Window.partitionBy("user_id").orderBy("ts", nth).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = attempts.withColumn("_run", F.sum(F.col("ok").cast("int")).over(order))
    within = Window.partitionBy("user_id", "_run").orderBy("ts", nth).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = island.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(within))
    locked = F.when(F.col("failures") >= most, F.col("ts") + F.make_dt_interval(mins=F.lit(lock_minutes)))
    return counted.withColumn("locked_until", locked).drop("_run")


def delete_rows(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in ``gone`` (UPS16)."""
    return rows.join(gone.select(keys).distinct(), keys, "left_anti")


def delete_user(user_id: str, owned: dict[str, DataFrame], referring: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Tables without a user's rows, and tables where references to them are null (JN15)."""
    out = {name: df.filter(F.coalesce(F.col("user_id") != user_id, F.lit(True))) for name, df in owned.items()}
    for name, (df, columns) in referring.items():
        out[name] = df.select(*(F.when(F.col(c) != user_id, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))
    return out
