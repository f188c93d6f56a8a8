"""Filters, upserts, sessions and checks of the service over the driver's tables.

``part`` is a dictionary (the first word of a name as abbreviation, the brand as domain), ``events`` are
sessions, logins and preferences, ``orders`` a moderation queue.
"""

from __future__ import annotations

import datetime as dt
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import evaluate, mutate, normalize, review, store
from textloom.plans.corpus_queries import _PAIRS, _pairs, _words
from textloom.plans.store_queries import _events
from textloom.session import table

NOON = dt.datetime(2024, 1, 15, 12)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    flags = [(F.col("p_size") % 2 == 0).alias("is_active"), (F.col("p_size") % 3 > 0).alias("approved")]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.split("p_name", " ")[0]).alias("abbr"), F.col("p_brand").alias("domain"), F.col("p_name").alias("expanded"), "p_size", *flags)


_ENTRIES = "SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) AS abbr, p_brand AS domain, p_name AS expanded, p_size, p_size % 2 = 0 AS is_active, p_size % 3 > 0 AS approved FROM part"


def dictionary_active(spark: SparkSession, d: str) -> DataFrame:
    """All that is in use, one abbreviation's, and one domain's."""
    rows = _entries(spark, d)
    asked = [("all", store.active_approved(rows)), ("abbr", store.active_approved(rows, abbr=" Almond ")), ("domain", store.active_approved(rows, domain="Brand#13"))]
    found = [part.select(F.lit(name).alias("asked"), "id", "abbr", "domain") for name, part in asked]
    return found[0].unionByName(found[1]).unionByName(found[2])


DICTIONARY_ACTIVE = f"""
WITH e AS (SELECT * FROM ({_ENTRIES}) WHERE is_active AND approved)
SELECT 'all' AS asked, id, abbr, domain FROM e UNION ALL SELECT 'abbr', id, abbr, domain FROM e WHERE abbr = 'almond'
UNION ALL SELECT 'domain', id, abbr, domain FROM e WHERE domain = 'Brand#13'
"""


def dictionary_words(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "part").select(F.explode(F.split(F.concat(F.upper("p_name"), F.lit("  "), "p_name"), " ")).alias("word"))
    return store.dictionary_words(said)


DICTIONARY_WORDS = "SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE word <> ''"


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))


def moderation_queue(spark: SparkSession, d: str) -> DataFrame:
    """The newest of one status, and the newest of all."""
    one = store.by_status(_queue(spark, d), "F", 200).withColumn("asked", F.lit("F"))
    return one.unionByName(store.by_status(_queue(spark, d), limit=100).withColumn("asked", F.lit("all"))).select("asked", "id", "status")


MODERATION_QUEUE = """
WITH q AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS created_at FROM orders)
SELECT * FROM (SELECT 'F' AS asked, id, status FROM q WHERE status = 'F' ORDER BY created_at DESC, id LIMIT 200)
UNION ALL SELECT * FROM (SELECT 'all' AS asked, id, status FROM q ORDER BY created_at DESC, id LIMIT 100)
"""


def user_preferences(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("category"), F.col("k").alias("preference_key"), "event_id")
    return store.preferences(rows, "7").unionByName(store.preferences(rows, "8", "click")).select("user_id", "category", "preference_key", "event_id")


USER_PREFERENCES = """
SELECT user_id::VARCHAR AS user_id, event_type AS category, json_extract_string(props, '$.k') AS preference_key, event_id FROM events
WHERE user_id = 7 OR (user_id = 8 AND event_type = 'click')
"""


def phrases_active(spark: SparkSession, d: str) -> DataFrame:
    rows = _entries(spark, d).select("id", "domain", "is_active", "approved", F.col("p_size").alias("priority"), F.col("expanded").alias("phrase_key"))
    return store.active_phrases(rows, "Brand#22").select("id", "phrase_key", "priority")


PHRASES_ACTIVE = f"SELECT id, expanded AS phrase_key, p_size AS priority FROM ({_ENTRIES}) WHERE domain = 'Brand#22' AND is_active AND approved"


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events before noon of the fifteenth, each a session of as many hours as its number; every ninth is revoked."""
    rows = _events(spark, d).filter(F.col("ts") < F.lit(NOON))
    return rows.select(
        F.col("event_id").cast("string").alias("token_hash"), F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(hours=F.col("k").cast("int"))).alias("expires_at"), F.when(F.col("event_id") % 9 == 0, F.col("ts")).alias("revoked_at"), (F.col("value") > 30).alias("is_active"),
    )


_SESSIONS = """
SELECT event_id::VARCHAR AS token_hash, user_id::VARCHAR AS user_id, ts AS created_at, ts + INTERVAL 1 HOUR * json_extract_string(props, '$.k')::INT AS expires_at,
  CASE WHEN event_id % 9 = 0 THEN ts END AS revoked_at, value > 30 AS is_active FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00'
"""


def sessions_active(spark: SparkSession, d: str) -> DataFrame:
    return store.active_sessions(_sessions(spark, d), NOON).select("token_hash", "user_id")


SESSIONS_ACTIVE = f"SELECT token_hash, user_id FROM ({_SESSIONS}) WHERE is_active AND revoked_at IS NULL AND expires_at > TIMESTAMP '2024-01-15 12:00:00'"


def session_changes(spark: SparkSession, d: str) -> DataFrame:
    """Logins open sessions; then one user's are all revoked, and those that ran out are marked."""
    logins = _events(spark, d).filter(F.col("ts") >= F.lit(NOON)).select("ts", F.col("user_id").cast("string").alias("user_id"), (F.col("event_id") % 700).cast("string").alias("token_hash"))
    opened = mutate.start_sessions(_sessions(spark, d), logins)
    ended = mutate.end_sessions(opened, dt.datetime(2024, 1, 20), user_id="7")
    return ended.select("token_hash", "user_id", "is_active", F.col("revoked_at").isNotNull().alias("revoked"))


SESSION_CHANGES = f"""
WITH s AS ({_SESSIONS}),
l AS (SELECT ts, user_id::VARCHAR AS user_id, (event_id % 700)::VARCHAR AS token_hash FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'),
n AS (SELECT token_hash, arg_min(user_id, (ts, user_id)) AS user_id, min(ts) AS created_at FROM l WHERE token_hash NOT IN (SELECT token_hash FROM s) GROUP BY 1),
o AS (SELECT token_hash, user_id, expires_at, revoked_at, is_active FROM s UNION ALL SELECT token_hash, user_id, created_at + INTERVAL 24 HOUR, NULL, true FROM n)
SELECT token_hash, user_id, is_active AND user_id <> '7' AND expires_at > TIMESTAMP '2024-01-20' AS is_active, revoked_at IS NOT NULL OR (user_id = '7' AND is_active) AS revoked FROM o
"""


def _layer(spark: SparkSession, d: str, layer: int) -> DataFrame:
    rows = _entries(spark, d).filter(F.col("p_size") % 3 == layer)
    actor = F.when(F.min("p_size") % 2 == 0, mutate.SEED_ACTOR).otherwise("editor").alias("approved_by")
    return rows.groupBy("abbr", "domain").agg(F.min("expanded").alias("expanded"), F.array(F.max("expanded")).alias("alternatives"), actor)


_LAYERS = f"""
p AS ({_ENTRIES}),
l AS (SELECT p_size % 3 AS layer, abbr, domain, min(expanded) AS expanded, max(expanded) AS other, CASE WHEN min(p_size) % 2 = 0 THEN 'json_seed' ELSE 'editor' END AS actor FROM p GROUP BY 1, 2, 3),
b AS (
  SELECT abbr, domain, o.expanded AS old, o.other AS old_other, o.actor AS old_actor, n.expanded AS new, n.other AS new_other, n.actor AS new_actor
  FROM (SELECT * FROM l WHERE layer = 0) AS o FULL JOIN (SELECT * FROM l WHERE layer = 1) AS n USING (abbr, domain))
"""


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("alternatives", F.array_join("alternatives", ","))


def seed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Seed rows are merged into what the seeder stored; an administrator's replace what is there."""
    state, new = _layer(spark, d, 0), _layer(spark, d, 1)
    seeded = _flat(mutate.upsert_seed(state, new)).withColumn("side", F.lit("seed"))
    return seeded.unionByName(_flat(mutate.upsert_admin(state, new)).withColumn("side", F.lit("admin"))).select("side", "abbr", "domain", "expanded", "alternatives", "approved_by")


SEED_UPSERT = f"""
WITH {_LAYERS},
m AS (SELECT *, list_filter([old_other, new, new_other], lambda x, i: x <> old AND NOT list_contains([old_other, new, new_other][1:i - 1], x)) AS rest FROM b)
SELECT 'seed' AS side, abbr, domain, coalesce(old, new) AS expanded,
  CASE WHEN old IS NULL THEN new_other WHEN new IS NOT NULL AND old_actor = 'json_seed' THEN array_to_string(rest, ',') ELSE old_other END AS alternatives,
  CASE WHEN old IS NULL OR (new IS NOT NULL AND old_actor = 'json_seed') THEN new_actor ELSE old_actor END AS approved_by FROM m
UNION ALL SELECT 'admin', abbr, domain, coalesce(new, old), coalesce(new_other, old_other), coalesce(new_actor, old_actor) FROM b
"""


def override_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A user's new meanings become primary, the old ones alternatives."""
    of = lambda n: _layer(spark, d, n).select(F.lit("u").alias("user_id"), "abbr", "domain", "expanded", "alternatives")
    return _flat(mutate.upsert_override(of(0), of(1)))


OVERRIDE_UPSERT = f"""
WITH {_LAYERS},
m AS (SELECT *, [old, old_other, new_other] AS known, coalesce(new, old) AS first FROM b)
SELECT 'u' AS user_id, abbr, domain, first AS expanded,
  array_to_string(list_filter(known, lambda x, i: x IS NOT NULL AND x <> first AND NOT coalesce(list_contains(known[1:i - 1], x), false)), ',') AS alternatives FROM m
"""


def approved_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Approved meanings join a stored abbreviation as alternatives, whoever stored it; new ones are added."""
    state = _layer(spark, d, 0)
    merged = mutate.approved_meanings(state, _layer(spark, d, 1))
    known = state.select("abbr", "domain", F.col("alternatives").alias("old"))
    outcome = mutate.suggestion_outcome(F.coalesce("old", F.array().cast("array<string>")), F.col("expanded"))
    return _flat(merged.join(known, ["abbr", "domain"], "left").withColumn("outcome", outcome).drop("old")).select("abbr", "domain", "expanded", "alternatives", "outcome")


APPROVED_UPSERT = f"""
WITH {_LAYERS},
m AS (SELECT *, list_filter([old_other, new, new_other], lambda x, i: x <> old AND NOT list_contains([old_other, new, new_other][1:i - 1], x)) AS rest FROM b)
SELECT abbr, domain, coalesce(old, new) AS expanded, CASE WHEN old IS NULL THEN new_other WHEN new IS NULL THEN old_other ELSE array_to_string(rest, ',') END AS alternatives,
  CASE WHEN old IS NULL THEN 'CAPTURED' WHEN old_other = old THEN 'EXISTS' ELSE 'APPENDED' END AS outcome FROM m
"""


def rows_changed(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth entry is deactivated, every seventh gets another domain, every eleventh is deleted."""
    rows = _entries(spark, d).select("id", "abbr", "domain", "is_active")
    off = mutate.deactivate(rows, rows.filter("id % 5 = 0"))
    changes = rows.filter("id % 7 = 0").select("id", F.when(F.col("id") % 2 == 0, "other").alias("domain"), F.lit(None).cast("string").alias("abbr"))
    return mutate.delete_rows(mutate.conditional_update(off, changes, "id", ["domain", "abbr"]), rows.filter("id % 11 = 0"), ["id"])


ROWS_CHANGED = f"SELECT id, abbr, CASE WHEN id % 14 = 0 THEN 'other' ELSE domain END AS domain, is_active AND id % 5 <> 0 AS is_active FROM ({_ENTRIES}) WHERE id % 11 <> 0"


def user_deleted(spark: SparkSession, d: str) -> DataFrame:
    """A user goes: what was theirs too, and references to them are null."""
    rows = _events(spark, d).select("event_id", F.col("user_id").cast("string").alias("user_id"), (F.col("event_id") % 13).cast("string").alias("reviewer"))
    out = mutate.delete_user("7", {"sessions": rows}, {"queue": (rows, ["reviewer"])})
    return out["sessions"].withColumn("kept_in", F.lit("sessions")).unionByName(out["queue"].withColumn("kept_in", F.lit("queue")))


USER_DELETED = """
WITH r AS (SELECT event_id, user_id::VARCHAR AS user_id, (event_id % 13)::VARCHAR AS reviewer FROM events)
SELECT *, 'sessions' AS kept_in FROM r WHERE user_id <> '7' UNION ALL SELECT event_id, user_id, nullif(reviewer, '7'), 'queue' FROM r
"""


def role_assignment(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.concat("c_name", F.lit("@x.org")).alias("email"))
    roles = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("role_name"))
    given = users.orderBy("id").limit(1).first()["username"]
    found = store.find_user(users, f"{given}@x.org").select("username").first()["username"]
    role = roles.orderBy(F.desc("id")).limit(1).first()["role_name"]
    return store.assign(users, roles, found, role).unionByName(store.assign(users, roles, found, "no such role"))


ROLE_ASSIGNMENT = "SELECT min(c_custkey) AS user_id, (SELECT max(n_nationkey) FROM nation) AS role_id FROM customer"


def call_totals(spark: SparkSession, d: str) -> DataFrame:
    """A call log's totals, the revision that all its rows make up, and locks that still hold."""
    calls = _events(spark, d).select(F.when(F.col("value") > 90, 429).when(F.col("value") > 80, 500).otherwise(200).alias("status"), F.col("k").cast("int").alias("tokens"), F.col("event_id").alias("revision"), F.when(F.col("value") > 50, F.col("ts")).alias("locked_until"))
    locked = calls.agg(F.count_if(store.is_locked(NOON)).alias("locked"))
    return evaluate.call_usage(calls).select("*", store.global_revision(calls).scalar().alias("revision"), locked.scalar().alias("locked"))


CALL_TOTALS = """
SELECT count(*)::BIGINT AS calls, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS tokens, count(*) FILTER (value > 90)::BIGINT AS rate_limited, count(*) FILTER (value > 80)::BIGINT AS failed,
  sum(event_id)::BIGINT AS revision, count(*) FILTER (value > 50 AND ts > TIMESTAMP '2024-01-15 12:00:00')::BIGINT AS locked FROM events
"""


def terms_selected(spark: SparkSession, d: str) -> DataFrame:
    """Which benchmark words, and pairs of them, stand in which documents."""
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(T.words("text")).alias("pos", "w"))
    terms = words.filter("pos < 8").select(F.col("w").alias("term")).unionByName(words.filter("pos = 3").select(F.substring("w", 1, 6).alias("term")))
    return store.select_terms(table(spark, d, "documents"), terms)


TERMS_SELECTED = f"""
WITH b AS (SELECT {_words('text')} AS w FROM benchmark),
t AS (SELECT DISTINCT term FROM (SELECT unnest(w[1:8]) AS term FROM b UNION ALL SELECT left(w[4], 6) FROM b) WHERE term IS NOT NULL),
d AS (SELECT doc_id, lower(text) AS low, {_words('text')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM d)
SELECT doc_id, term FROM s JOIN t USING (term) WHERE length(term) <= 5
UNION SELECT doc_id, term FROM d JOIN t ON length(term) > 5 AND contains(low, term)
"""


def word_tests(spark: SparkSession, d: str) -> DataFrame:
    """The abbreviation tests, folds and keys of each distinct word of the documents."""
    words = table(spark, d, "documents").select(F.explode(T.words("text")).alias("w")).distinct()
    bare = T.strip_diacritics("w")
    return words.select(
        "w", T.short_abbreviation(F.col("w")).alias("short"), T.suspected_abbreviation(F.col("w")).alias("suspected"), T.true_abbreviation(F.col("w"), F.reverse(bare)).alias("changes_more"),
        T.has_diacritics("w").alias("accented"), T.phonetic_fold("w").alias("phonetic"), T.phrase_key(F.array(F.concat(F.lit("Ab"), "w"), bare)).alias("key"), T.is_word(F.col("w")).alias("is_word"),
    )


_FORCED = "length(w) BETWEEN 2 AND 3 AND (NOT regexp_matches(f, '[aeiouy]') OR (NOT regexp_matches(f, '[aeiou]') AND regexp_matches(w, '[jqxz]')))"
WORD_TESTS = f"""
WITH d AS (SELECT DISTINCT unnest({_words('text')}) AS w FROM documents),
p AS (SELECT w, replace(strip_accents(w), 'đ', 'd') AS f FROM d)
SELECT w, regexp_full_match(w, '\\p{{L}}{{2,3}}') AND NOT regexp_matches(f, '[aeiouy]') AS short,
  (length(w) = 1 AND NOT regexp_full_match(w, '[{T._VOWEL_LETTERS}]')) OR ({_FORCED}) AS suspected,
  strip_accents(w) <> strip_accents(reverse(f)) AS changes_more, f <> w AS accented, regexp_replace(f, '^(?:ch|tr)', 'tr') AS phonetic, 'ab' || w || '_' || f AS "key", true AS is_word FROM p
"""


def elongated_words(spark: SparkSession, d: str) -> DataFrame:
    """Words with each letter doubled or tripled, brought back to what the benchmark knows."""
    known = table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("word")).distinct()
    said = table(spark, d, "documents").select(F.explode(T.words("text")).alias("w")).distinct().filter(F.col("w").rlike("^[a-z]{2,12}$"))
    drawn = lambda n: F.regexp_replace("w", "^(.)", "$1" * n)
    tokens = said.select("w", F.explode(F.array("w", drawn(2), drawn(3))).alias("token")).withColumn("alpha", F.lit(True))
    return normalize.elongation(tokens, known).select("w", "token", "word")


ELONGATED_WORDS = f"""
WITH k AS (SELECT DISTINCT unnest({_words('text')}) AS k FROM benchmark),
d AS (SELECT DISTINCT unnest({_words('text')}) AS w FROM documents),
t AS (SELECT w, unnest([w, left(w, 1) || w, left(w, 1) || left(w, 1) || w]) AS token FROM d WHERE regexp_full_match(w, '[a-z]{{2,12}}')),
r AS (SELECT w, token, string_split(token, '') AS c FROM t),
g AS (SELECT *, list_transform(range(1, len(c) + 1), lambda i: len(list_filter(range(1, i), lambda j: c[j] <> c[j + 1]))) AS g FROM r),
n AS (SELECT *, list_transform(g, lambda x: len(list_filter(g, lambda y: y = x))) AS size FROM g),
s AS (
  SELECT w, token, array_to_string(list_filter(c, lambda x, i: size[i] < 3 OR i = 1 OR g[i] <> g[i - 1]), '') AS three, array_to_string(list_filter(c, lambda x, i: i = 1 OR g[i] <> g[i - 1]), '') AS two FROM n)
SELECT DISTINCT w, token, CASE WHEN token IN (SELECT k FROM k) THEN token WHEN three IN (SELECT k FROM k) THEN three WHEN two IN (SELECT k FROM k) THEN two ELSE three END AS word FROM s
"""


def change_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels of what became of each word of the accented texts: accents lost, capitals, cut, blanks."""
    pairs = _pairs(spark, d).select(F.explode(F.arrays_zip(T.space_tokens("no_diacritics").alias("a"), T.space_tokens("with_diacritics").alias("b"))).alias("z")).select("z.*").distinct()
    half = F.substring("b", F.lit(1), F.ceil(F.length("b") / 2).cast("int"))
    made = F.array(F.struct(F.col("b").alias("x"), F.col("a").alias("y")), F.struct(F.col("b").alias("x"), F.translate("b", ascii_lowercase, ascii_uppercase).alias("y")), F.struct(F.col("b").alias("x"), half.alias("y")), F.struct(F.col("b").alias("x"), F.concat("b", F.lit(" ")).alias("y")), F.struct(F.col("b").alias("x"), F.lit("").alias("y")))
    rows = pairs.select(F.explode(made).alias("c")).select("c.*").distinct()
    return rows.select("x", "y", F.array_join(T.change_kinds(F.col("x"), F.col("y")), ",").alias("kinds"))


CHANGE_LABELS = f"""
WITH p AS (SELECT list_filter(regexp_split_to_array(nd, '\\s+'), lambda t: t <> '') AS a, list_filter(regexp_split_to_array(wd, '\\s+'), lambda t: t <> '') AS b FROM ({_PAIRS})),
q AS (SELECT DISTINCT a[i] AS a, b[i] AS b FROM (SELECT a, b, unnest(range(1, len(b) + 1)) AS i FROM p)),
c AS (SELECT b AS x, a AS y FROM q UNION SELECT b, translate(b, '{ascii_lowercase}', '{ascii_uppercase}') FROM q UNION SELECT b, left(b, ceil(length(b) / 2)::INT) FROM q UNION SELECT b, b || ' ' FROM q UNION SELECT b, '' FROM q),
k AS (
  SELECT x, y, lower(x) = lower(y) AS s, strip_accents(lower(x)) = strip_accents(lower(y)) AND y <> '' AS e,
    y = '' OR (contains(lower(x), lower(y)) AND length(x) > length(y)) AS gone, x <> y AND regexp_replace(x, '\\s', '', 'g') = regexp_replace(y, '\\s', '', 'g') AS blank FROM c),
l AS (SELECT x, y, list_filter([CASE WHEN gone THEN 'deletion' END, CASE WHEN e AND NOT (x <> y AND s) THEN 'diacritic' END, CASE WHEN (x <> y AND s) OR (e AND NOT (x <> y AND s) AND NOT s) THEN 'case' END, CASE WHEN blank THEN 'whitespace' END], lambda z: z IS NOT NULL) AS kinds FROM k)
SELECT x, y, CASE WHEN len(kinds) = 0 THEN 'spelling' ELSE array_to_string(kinds, ',') END AS kinds FROM l
"""


def pending_best(spark: SparkSession, d: str) -> DataFrame:
    """Of events on one abbreviation the one that asks most of the user; a tenth have none and stay."""
    rows = _events(spark, d).select(
        "event_id", F.when(F.col("event_id") % 10 > 0, F.concat(F.lit(" "), F.upper("event_type"), F.col("user_id"))).otherwise("  ").alias("abbr"),
        (F.col("value") > 95).alias("needs_user_meaning"), (F.col("value") > 80).alias("can_add_more_meanings"), F.when(F.col("value") > 40, F.col("event_id")).alias("pending_id"),
    )
    return mutate.best_submissions(rows, "event_id").select("event_id", F.lower(F.trim("abbr")).alias("abbr"))


PENDING_BEST = """
WITH r AS (
  SELECT event_id, CASE WHEN event_id % 10 > 0 THEN lower(event_type) || user_id ELSE '' END AS abbr, CASE WHEN value > 95 THEN 3 WHEN value > 80 THEN 2 WHEN value > 40 THEN 1 ELSE 0 END AS rank FROM events)
SELECT event_id, abbr FROM r WHERE abbr = '' UNION ALL SELECT arg_max(event_id, (rank, -event_id)), abbr FROM r WHERE abbr <> '' GROUP BY abbr
"""


def review_gate(spark: SparkSession, d: str) -> DataFrame:
    """What the review of a turn stands at before any reply, and how long a reply may be."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text", F.when(F.col("turn") % 3 == 0, "typing").when(F.col("turn") % 3 == 1, "paste").otherwise("api").alias("input_method"))
    unsure = F.filter(T.words("text"), lambda w: w.isin("la", "en"))
    lost = F.filter(T.words("text"), lambda w: T.has_diacritics(w))
    wanted, allowed = review.wants_review(unsure, lost), review.may_review(F.col("input_method"), F.col("text"))
    return turns.select("conv_id", "turn", review.first_status(wanted, allowed).alias("status"), review.token_budget("text", 700).alias("budget"))


REVIEW_GATE = f"""
WITH t AS (SELECT conv_id, turn, text, {_words('text')} AS w, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN len(list_filter(w, lambda x: x IN ('la', 'en') OR replace(strip_accents(x), 'đ', 'd') <> x)) = 0 THEN 'not_needed' WHEN turn % 3 = 2 OR n = 0 THEN 'unavailable' ELSE 'not_checked' END AS status,
  least(greatest(greatest(n, 1) * 6, 256), 700)::INT AS budget FROM t
"""


def verified_merge(spark: SparkSession, d: str) -> DataFrame:
    """The accented text as a verified version of its bare one: used if sure, of this revision, and of the same punctuation."""
    pairs = _pairs(spark, d)
    status = F.when(F.col("doc_id") % 4 == 0, "uncertain").when(F.col("doc_id") % 4 == 1, "partial").otherwise("verified")
    new = F.when(F.col("doc_id") % 5 == 0, F.concat("with_diacritics", F.lit("!"))).otherwise(F.col("with_diacritics"))
    verified = pairs.select("doc_id", new.alias("text"), status.alias("status"), (F.col("doc_id") % 10 / 10.0).alias("confidence"), (F.col("doc_id") % 2).cast("int").alias("revision"))
    out = review.merged(pairs.select("doc_id", F.col("no_diacritics").alias("text")), verified.filter("doc_id % 7 <> 0"), 1)
    return out.select("doc_id", "used", F.sha2("text", 256).alias("sha256"))


VERIFIED_MERGE = f"""
WITH p AS (SELECT *, doc_id % 4 <> 0 AND doc_id % 10 >= 7 AND doc_id % 2 = 1 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS used FROM ({_PAIRS}))
SELECT doc_id, used, sha256(CASE WHEN used THEN wd ELSE nd END) AS sha256 FROM p
"""


QUERIES = {
    "dictionary_active": dictionary_active, "dictionary_words": dictionary_words, "moderation_queue": moderation_queue, "user_preferences": user_preferences, "phrases_active": phrases_active,
    "sessions_active": sessions_active, "session_changes": session_changes, "seed_upsert": seed_upsert, "override_upsert": override_upsert, "approved_upsert": approved_upsert, "rows_changed": rows_changed,
    "user_deleted": user_deleted, "role_assignment": role_assignment, "call_totals": call_totals, "terms_selected": terms_selected, "word_tests": word_tests, "elongated_words": elongated_words,
    "change_labels": change_labels, "pending_best": pending_best, "review_gate": review_gate, "verified_merge": verified_merge,
}

SQL = {
    "dictionary_active": DICTIONARY_ACTIVE, "dictionary_words": DICTIONARY_WORDS, "moderation_queue": MODERATION_QUEUE, "user_preferences": USER_PREFERENCES, "phrases_active": PHRASES_ACTIVE,
    "sessions_active": SESSIONS_ACTIVE, "session_changes": SESSION_CHANGES, "seed_upsert": SEED_UPSERT, "override_upsert": OVERRIDE_UPSERT, "approved_upsert": APPROVED_UPSERT, "rows_changed": ROWS_CHANGED,
    "user_deleted": USER_DELETED, "role_assignment": ROLE_ASSIGNMENT, "call_totals": CALL_TOTALS, "terms_selected": TERMS_SELECTED, "word_tests": WORD_TESTS, "elongated_words": ELONGATED_WORDS,
    "change_labels": CHANGE_LABELS, "pending_best": PENDING_BEST, "review_gate": REVIEW_GATE, "verified_merge": VERIFIED_MERGE,
}
