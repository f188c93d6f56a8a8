"""Reading the relational store: filters, lookups, paging, roles, usage statistics, retention.

All functions take and return tables, and the time of day as a value (``as_of``), so that a run can
be repeated. Dates and limits are checked like the service's query parameters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _check(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


def _since(date: str, as_of: dt.date, days: int) -> Column:
    """From ``days`` before ``as_of`` on: days + 1 calendar days."""
    return F.col(date) >= F.lit(as_of - dt.timedelta(days=days))


def top_usage(usage: DataFrame, as_of: dt.date, days: int = 30, limit: int = 50) -> DataFrame:
    """abbr, expanded_chosen, total_count, last_used, active_days of the most used (AGG1)."""
    recent = usage.filter(_since("usage_date", as_of, _check("days", days, 1, 365)))
    summed = recent.groupBy("abbr", "expanded_chosen").agg(
        F.sum("usage_count").alias("total_count"), F.max("usage_date").alias("last_used"), F.countDistinct("usage_date").alias("active_days")
    )
    return summed.orderBy(F.desc("total_count"), "abbr", "expanded_chosen").limit(_check("limit", limit, 1, 200))


def daily_usage(usage: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """usage_date, unique_abbreviations, total_uses, newest first (AGG2)."""
    recent = usage.filter(_since("usage_date", as_of, _check("days", days, 1, 90)))
    return recent.groupBy("usage_date").agg(F.countDistinct("abbr").alias("unique_abbreviations"), F.sum("usage_count").alias("total_uses")).orderBy(F.desc("usage_date"))


def usage_counts(picks: DataFrame, max_rows: int = 200) -> DataFrame:
    """abbr, expanded_chosen, n: trimmed, cut to length, blanks dropped, the ``max_rows`` most used (AGG3)."""
    cleaned = picks.select(F.left(F.trim("abbr"), F.lit(100)).alias("abbr"), F.left(F.trim("expanded_chosen"), F.lit(500)).alias("expanded_chosen"))
    counted = cleaned.filter("abbr <> '' AND expanded_chosen <> ''").groupBy("abbr", "expanded_chosen").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "abbr", "expanded_chosen").limit(max(1, max_rows))


def active_approved(abbreviations: DataFrame, abbr: str | None = None, domain: str | None = None) -> DataFrame:
    """Active, approved rows, of one abbreviation or domain if asked (FLT1, FLT2, FLT6)."""
    rows = abbreviations.filter("is_active AND approved")
    if abbr is not None:
        rows = rows.filter(F.lower("abbr") == abbr.strip().lower())
    if domain is not None:
        rows = rows.filter(F.col("domain") == domain)
    return rows.orderBy("abbr", "domain")


def dictionary_words(entries: DataFrame) -> DataFrame:
    """word: lower-cased, distinct (FLT3, SRC11)."""
    return entries.select(F.lower(F.trim("word")).alias("word")).filter("word <> ''").distinct()


def by_status(rows: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a moderation queue, newest first (FLT4, FLT5)."""
    rows = rows if status is None else rows.filter(F.col("status") == status)
    rows = rows.orderBy(F.desc("created_at"), "id")
    return rows if limit is None else rows.limit(limit)


def preferences(rows: DataFrame, user_id: str, category: str | None = None) -> DataFrame:
    """A user's preferences (FLT7)."""
    rows = rows.filter(F.col("user_id") == user_id)
    rows = rows if category is None else rows.filter(F.col("category") == category)
    return rows.orderBy("category", "preference_key")


def active_phrases(rows: DataFrame, domain: str) -> DataFrame:
    """Approved, active phrase overrides of a domain, by priority (FLT8)."""
    return rows.filter((F.col("domain") == domain) & F.col("is_active") & F.col("approved")).orderBy(F.desc("priority"), "phrase_key")


def active_sessions(sessions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Sessions that may still be used (FLT9)."""
    return sessions.filter(F.col("is_active") & F.col("revoked_at").isNull() & (F.col("expires_at") > F.lit(as_of)))


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 50, most: int = 100) -> DataFrame:
    """One page; ``limit`` is brought to 1..most (SRT3, SRT4). ``order`` should end in a unique column."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(limit, 1), most))


def latest(rows: DataFrame, key: str, time: str, id_: str) -> DataFrame:
    """key, id, time of the newest row of each key; ties go to the larger id (SRT5)."""
    best = F.max(F.struct(F.col(time).alias("t"), F.col(id_).alias("i"))).alias("b")
    return rows.groupBy(key).agg(best).select(key, F.col("b.i").alias(id_), F.col("b.t").alias(time))


def newest_per_key(rows: DataFrame, key: str, time: str, id_: str, most: int) -> DataFrame:
    """The ``most`` newest rows of each key (SRT6)."""
    order = Window.partitionBy(key).orderBy(F.desc(time), F.desc(id_))
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in an order that depends on key and seed only (SRT7)."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def with_roles(users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with roles_csv, sorted; null for users without a role (JN1)."""
    named = user_roles.join(roles.select(F.col("id").alias("role_id"), "role_name"), "role_id")
    joined = named.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("role_name")), ",").alias("roles_csv"))
    return users.join(joined, users["id"] == joined["user_id"], "left").drop("user_id")


def assign(users: DataFrame, roles: DataFrame, username: str, role: str) -> DataFrame:
    """user_id, role_id of one user and one role, if both exist (JN2).

    Both sides are filtered to single rows, and joined on a constant rather than as a cross join.
    """
    user = users.filter(F.col("username") == username).select(F.col("id").alias("user_id"), F.lit(1).alias("k"))
    return user.join(roles.filter(F.col("role_name") == role).select(F.col("id").alias("role_id"), F.lit(1).alias("k")), "k").drop("k")


def find_user(users: DataFrame, identifier: str) -> DataFrame:
    """By user name or e-mail address."""
    return users.filter((F.col("username") == identifier) | (F.col("email") == identifier))


def is_locked(as_of: dt.datetime) -> Column:
    """A lock that hasn't run out (DT2)."""
    return F.coalesce(F.col("locked_until") > F.lit(as_of), F.lit(False))


#: Days that histories and error logs are kept.
HISTORY_DAYS, ERROR_DAYS = 365, 90


def retention(history: DataFrame, errors: DataFrame, cache: DataFrame, sessions: DataFrame, as_of: dt.datetime) -> dict[str, tuple[DataFrame, Column]]:
    """Each table with the condition under which a row has outlived its term (UPS15)."""
    return {
        "history": (history, F.col("created_at") < F.lit(as_of - dt.timedelta(days=HISTORY_DAYS))),
        "errors": (errors, F.col("created_at") < F.lit(as_of - dt.timedelta(days=ERROR_DAYS))),
        "cache": (cache, F.col("expires_at") < F.lit(as_of)),
        "sessions": (sessions, F.col("expires_at") < F.lit(as_of)),
    }


def retention_counts(**tables) -> DataFrame:
    """table_name, rows that a clean-up would delete (AGG14, dry run)."""
    counts = None
    for name, (rows, expired) in retention(**tables).items():
        one = rows.agg(F.count_if(expired).alias("expired")).select(F.lit(name).alias("table_name"), "expired")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def retention_keep(**tables) -> dict[str, DataFrame]:
    """The tables without expired rows; a null time is kept."""
    return {name: rows.filter(~F.coalesce(expired, F.lit(False))) for name, (rows, expired) in retention(**tables).items()}


def global_revision(candidates: DataFrame) -> DataFrame:
    """revision: the sum over all rows, 0 for none (AGG13)."""
    return candidates.agg(F.coalesce(F.sum("revision"), F.lit(0)).alias("revision"))


def select_terms(documents: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, term: abbreviations of interest for each text (FLT17).

    A single word of up to five characters must stand as a word, so it joins on words. A longer term
    may stand anywhere, also amid a word: it joins on a word that holds its longest run of letters,
    found by that run's first three letters, and is then looked for in the text, which is fetched by id.
    A term without a letter is never selected.
    """
    from textloom.functions import text as T

    docs = documents.select("doc_id", F.lower(text).alias("low"))
    spoken = docs.select("doc_id", F.explode(F.array_distinct(T.words("low"))).alias("word"))
    cut = terms.select(F.lower("term").alias("term")).distinct()
    short = cut.filter((F.length("term") <= 5) & ~F.contains(F.col("term"), F.lit(" ")))
    exact = spoken.join(short, spoken["word"] == short["term"]).select("doc_id", "term")
    runs = F.array_sort(F.transform(T.words("term"), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    long = cut.join(short, "term", "left_anti").withColumn("run", F.coalesce(F.get(runs, F.lit(0))["w"], F.lit("")))
    head = F.substring("run", 1, 3)
    part = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - n + 1, F.lit(1))), lambda i: F.substring("word", i, n))
    grams = spoken.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(part(1), part(2), part(3)))).alias("head"))
    holding = grams.join(long.filter("run <> ''").withColumn("head", F.substring("run", 1, 3)), "head").filter(F.contains("word", F.col("run")))
    likely = spoken.join(holding.select("word", "term").distinct(), "word").select("doc_id", "term").distinct()
    inside = docs.join(likely, "doc_id").filter(F.contains("low", F.col("term"))).select("doc_id", "term")
    return exact.unionByName(inside).distinct()
