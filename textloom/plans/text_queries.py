"""Text functions, dictionary joins, restoration and normalization over the driver's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import diffs, patterns, spans
from textloom.functions import text as T
from textloom.operators import dictionary, evaluate, mining, normalize, restore, review, segments
from textloom.plans.corpus_queries import _PAIRS, _clean, _clean_all, _pairs, _words
from textloom.session import kept, table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_ACCENTED = T.ACCENTED_VOWELS


def accent_ratio(spark: SparkSession, d: str) -> DataFrame:
    counted = _documents(spark, d).select("doc_id", T.accented_vowels("text").alias("accented"), T.all_vowels("text").alias("vowels"))
    return counted.select("doc_id", F.col("accented").cast("long").alias("accented"), F.col("vowels").cast("long").alias("vowels"), F.round(F.when(F.col("vowels") > 0, F.col("accented") / F.col("vowels")), 4).alias("ratio"))


ACCENT_RATIO = f"""
WITH c AS (SELECT doc_id, length(regexp_replace(lower(text), '[^{_ACCENTED}]', '', 'g'))::BIGINT AS accented, length(regexp_replace(lower(text), '[^{_ACCENTED}aeiouy]', '', 'g'))::BIGINT AS vowels FROM documents)
SELECT doc_id, accented, vowels, CASE WHEN vowels > 0 THEN round(accented / vowels, 4) END AS ratio FROM c
"""


def missing_accents(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.lacks_diacritics("text").alias("lacks"), T.cache_key("text").alias("cache_key"), F.size(T.punctuation("text")).cast("long").alias("n_marks"))


MISSING_ACCENTS = f"""
WITH t AS (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS b FROM documents),
c AS (SELECT *, length(regexp_replace(lower(b), '[^{_ACCENTED}]', '', 'g')) AS a, length(regexp_replace(lower(b), '[^{_ACCENTED}aeiouy]', '', 'g')) AS v, length(regexp_replace(b, '\\P{{L}}', '', 'g')) AS l FROM t)
SELECT doc_id, length(b) >= 8 AND CASE WHEN length(b) > 0 THEN l / length(b) ELSE 0 END >= 0.3 AND coalesce(CASE WHEN v > 0 THEN a / v END < 0.6, false) AS lacks,
  sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS cache_key, len(regexp_extract_all(text, '\\p{{P}}'))::BIGINT AS n_marks FROM c
"""


def scan_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "conversations").select("conv_id", "turn", T.scan_tokens("text").alias("t"))
    return tokens.select("conv_id", "turn", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", "|").alias("tokens"))


SCAN_TOKENS = r"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '(?:https?://|www\.)\S+|[\pL\pN_.+-]+@[\pL\pN_-]+(?:\.[\pL\pN_-]+)+|[a-zA-ZÀ-ỹ\d_]+|\r?\n[\r\n]*|[^\s\pL\pN_]|[^\s]') AS t FROM conversations)
SELECT conv_id, turn, len(t)::BIGINT AS n_tokens, array_to_string(t, '|') AS tokens FROM t
"""


def unknown_words(spark: SparkSession, d: str) -> DataFrame:
    said = _documents(spark, d).select(F.explode(T.words("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("word")).distinct()
    return said.join(known, "word", "left_anti")


UNKNOWN_WORDS = f"""
SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest({_words('text')}) AS word FROM documents)
WHERE word NOT IN (SELECT unnest({_words('text')}) FROM benchmark) GROUP BY 1
"""


def unknown_runs(spark: SparkSession, d: str) -> DataFrame:
    tokens = _documents(spark, d).select("doc_id", F.posexplode(T.space_tokens("text")).alias("pos", "token")).withColumn("alpha", F.col("token").rlike(r"^\p{L}+$"))
    known = table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("_w")).distinct()
    marked = tokens.join(known, F.lower("token") == F.col("_w"), "left").withColumn("unknown", F.col("_w").isNull()).withColumn("consumed", F.lit(False))
    return normalize.unknown_runs(marked).select("doc_id", F.col("first_pos").cast("long").alias("first_pos"), "phrase_key")


UNKNOWN_RUNS = f"""
WITH k AS (SELECT DISTINCT unnest({_words('text')}) AS w FROM benchmark),
s AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS w FROM documents),
t AS (SELECT doc_id, i - 1 AS pos, w[i] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM s)),
a AS (SELECT t.*, k.w IS NULL AS unknown, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM t LEFT JOIN k ON lower(token) = k.w WHERE regexp_full_match(token, '\\p{{L}}+')),
r AS (SELECT doc_id, run, min(pos) AS first_pos, bool_and(unknown) AS u, count(*) AS n, list(lower(token) ORDER BY pos) AS l FROM a GROUP BY 1, 2)
SELECT doc_id, first_pos, array_to_string(l[1:5], '_') AS phrase_key FROM r WHERE u AND n >= 2
"""


def abbr_expand(spark: SparkSession, d: str) -> DataFrame:
    """The fifty most frequent words stand for abbreviations; their expansion is the word in capitals."""
    tokens = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.space_tokens("text")).alias("pos", "token"))
    top = tokens.groupBy(F.lower("token").alias("abbr")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "abbr").limit(50).select("abbr", F.upper("abbr").alias("expanded"))
    joined = tokens.join(top, F.lower("token") == top["abbr"], "left").withColumn("value", F.coalesce("expanded", "token"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), " ")
    return joined.groupBy("conv_id", "turn").agg(text.alias("expanded_text"), F.count("expanded").alias("n_expanded"))


ABBR_EXPAND = """
WITH s AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS w FROM conversations),
t AS (SELECT conv_id, turn, i AS pos, w[i] AS token FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM s)),
k AS (SELECT lower(token) AS abbr, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, abbr LIMIT 50)
SELECT conv_id, turn, string_agg(coalesce(upper(abbr), token), ' ' ORDER BY pos) AS expanded_text, count(abbr)::BIGINT AS n_expanded FROM t LEFT JOIN k ON lower(token) = abbr GROUP BY 1, 2
"""


def context_window5(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.space_tokens("text")).alias("pos", "token"))
    order = Window.partitionBy("conv_id", "turn").orderBy("pos")
    left = F.array_join(F.collect_list("token").over(order.rowsBetween(-5, -1)), " ")
    right = F.array_join(F.collect_list("token").over(order.rowsBetween(1, 5)), " ")
    return tokens.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), left.alias("left_context"), right.alias("right_context"))


CONTEXT_WINDOW = """
WITH s AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS w FROM conversations)
SELECT conv_id, turn, i - 1 AS pos, array_to_string(w[greatest(i - 5, 1):i - 1], ' ') AS left_context, array_to_string(w[i + 1:i + 5], ' ') AS right_context
FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM s)
"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    accented = _documents(spark, d).filter(F.col("lang").isin("fr", "es", "de"))
    rows = accented.select("doc_id", F.posexplode(T.clean_tokens("text")).alias("pos", "wd"))
    return rows.select("doc_id", "pos", T.strip_diacritics("wd").alias("bare"), F.lit(False).alias("mixed"))


def bigram_scored_choice(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each bare word of the accented texts, decided by bigram counts."""
    pairs = _pairs(spark, d)
    forms = mining.word_map(mining.word_forms(pairs), 5)
    listed = restore.listed_forms(forms)
    tokens = _tokens(spark, d).join(listed, "bare", "left").withColumn("override", F.lit(None).cast("string"))
    counted = mining.bigrams(pairs)
    return restore.score_candidates(tokens, counted, listed).select("doc_id", F.col("pos").cast("long").alias("pos"), "best")


_FORMS = f"""
p AS (SELECT doc_id, {_clean_all('nd')} AS a, {_clean_all('wd')} AS b FROM ({_PAIRS})),
said AS (SELECT nd, wd, count(*)::BIGINT AS cnt FROM (SELECT a[i] AS nd, b[i] AS wd FROM (SELECT a, b, unnest(range(1, len(a) + 1)) AS i FROM p WHERE len(a) = len(b))) WHERE nd <> '' AND wd <> '' GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER w AS r, max(cnt) OVER (PARTITION BY nd) AS top, first_value(wd) OVER w AS best FROM said WINDOW w AS (PARTITION BY nd ORDER BY cnt DESC, wd))
"""

BIGRAM_CHOICE = f"""
WITH {_FORMS},
forms AS (SELECT nd, list(wd ORDER BY r) AS cands FROM ranked WHERE best <> nd AND CASE WHEN top >= 2 THEN cnt >= 2 AND r <= 5 ELSE r = 1 END GROUP BY 1),
texts AS (SELECT doc_id, {_clean('wd')} AS w FROM ({_PAIRS})),
seen AS (SELECT doc_id, i - 1 AS pos, strip_accents(w[i]) AS bare FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts)),
offered AS (SELECT doc_id, pos, bare, cands, coalesce(cands, [bare]) AS own FROM seen LEFT JOIN forms ON bare = nd),
around AS (SELECT *, lag(own) OVER w AS prev, lead(own) OVER w AS next FROM offered WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
pairs AS (SELECT w1, w2, count(*) AS c FROM (SELECT w[i] AS w1, w[i + 1] AS w2 FROM (SELECT w, unnest(range(1, len(w))) AS i FROM texts)) GROUP BY 1, 2),
cell AS (SELECT doc_id, pos, prev, next, unnest(cands) AS cand, unnest(range(1, len(cands) + 1)) AS rank FROM around WHERE len(cands) > 1),
lft AS (SELECT doc_id, pos, rank, max(c) AS c FROM (SELECT doc_id, pos, rank, cand, unnest(prev) AS o FROM cell) JOIN pairs ON w1 = o AND w2 = cand GROUP BY 1, 2, 3),
rgt AS (SELECT doc_id, pos, rank, max(c) AS c FROM (SELECT doc_id, pos, rank, cand, unnest(next) AS o FROM cell) JOIN pairs ON w1 = cand AND w2 = o GROUP BY 1, 2, 3),
scored AS (SELECT doc_id, pos, cand, rank, coalesce(lft.c, 0) + coalesce(rgt.c, 0) AS score FROM cell LEFT JOIN lft USING (doc_id, pos, rank) LEFT JOIN rgt USING (doc_id, pos, rank))
SELECT doc_id, pos, first(cand ORDER BY score DESC, rank) AS best FROM scored GROUP BY 1, 2
"""


def _offered(spark: SparkSession, d: str) -> DataFrame:
    """Bare words of the accented texts with the forms that the texts themselves give them."""
    forms = kept(mining.word_map(mining.word_forms(_pairs(spark, d)), 5))
    return restore.with_candidates(_tokens(spark, d).withColumn("protected", F.lit(False)), forms)


def restore_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each text the word map settles, and how many of its words it leaves open."""
    offered = _offered(spark, d)
    open_words = restore.ambiguous(offered).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_open"))
    covered = restore.coverage(offered).join(open_words, "doc_id", "left")
    return covered.select("doc_id", "n_tokens", F.round("coverage", 6).alias("coverage"), F.coalesce("n_open", F.lit(0)).alias("n_open"))


_SHORT = "regexp_full_match(bare, '\\p{L}{2,3}') AND NOT regexp_matches(bare, '[aeiouy]')"
RESTORE_COVERAGE = f"""
WITH {_FORMS},
forms AS (SELECT nd, list(wd ORDER BY r) AS cands FROM ranked WHERE best <> nd AND CASE WHEN top >= 2 THEN cnt >= 2 AND r <= 5 ELSE r = 1 END GROUP BY 1),
texts AS (SELECT doc_id, {_clean('wd')} AS w FROM ({_PAIRS})),
seen AS (SELECT doc_id, replace(strip_accents(w[i]), 'đ', 'd') AS bare FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts)),
o AS (SELECT doc_id, bare, {_SHORT} AS short, CASE WHEN NOT ({_SHORT}) THEN cands END AS cands FROM seen LEFT JOIN forms ON bare = nd)
SELECT doc_id, count(*)::BIGINT AS n_tokens, round(avg((short OR cands IS NOT NULL)::INT), 6) AS coverage, count(DISTINCT bare) FILTER (len(cands) > 1)::BIGINT AS n_open FROM o GROUP BY 1
"""


def restore_documents(spark: SparkSession, d: str) -> DataFrame:
    """Word map, bigrams and phrases mined from the accented texts restore their bare side."""
    pairs = _pairs(spark, d)
    out = restore.restore(pairs, *_assets(spark, d), text="no_diacritics").withColumn("n_changed", F.size("changed")).drop("changed")
    judged = out.join(pairs.select("doc_id", "with_diacritics"), "doc_id")
    accuracy = evaluate.token_accuracy(T.space_tokens("with_diacritics"), T.space_tokens("restored"))
    return judged.select("doc_id", "restored", "n_changed", F.round("coverage", 4).alias("coverage"), F.round(accuracy, 4).alias("accuracy"))


def _snapshot(spark: SparkSession, d: str) -> dictionary.Snapshot:
    """Known words from the benchmark, phrases from frequent bigrams, names of parts as meanings of their first three letters."""
    words = table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("word")).distinct()
    pairs = mining.bigrams(table(spark, d, "conversations"), "text")
    frequent = pairs.orderBy(F.desc("cnt"), "w1", "w2").limit(100)
    phrases = dictionary.phrase_table([frequent.select(F.concat_ws(" ", "w1", "w2").alias("phrase"), F.upper(F.concat_ws(" ", "w1", "w2")).alias("expanded"), F.lit("mined").alias("source"), F.lit("1.0").alias("confidence"))])
    named = table(spark, d, "part").select(F.lower(F.substring("p_name", 1, 3)).alias("abbr"), "p_name")
    abbreviations = named.groupBy("abbr").agg(F.min("p_name").alias("expanded"))
    several = named.groupBy("abbr").agg(F.array_sort(F.collect_set("p_name")).alias("options")).filter(F.size("options") > 1)
    meanings = F.array(F.lit("công ty"), F.lit("chia tay"))
    details = several.select("abbr", F.when(F.substring("abbr", 1, 1) < "m", F.col("options")).otherwise(meanings).alias("options"))
    return dictionary.Snapshot(1, abbreviations, details, kept(words), kept(phrases))


TYPOS = {"teh": "the", "adn": "and", "recieve": "receive"}


def _assets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Word map, bigrams and context phrases of the accented texts, each kept once."""
    pairs = mining.kept_slots(_pairs(spark, d))
    phrases = mining.dominant_phrases(mining.phrase_variants(pairs, least=5), min_freq=5)
    phrases = phrases.select(F.split("nd_key", " ").alias("key"), F.split("wd_key", " ").alias("val"))
    return kept(mining.word_map(mining.word_forms(pairs))), kept(mining.bigrams(pairs)), kept(phrases)


def normalize_conversations(spark: SparkSession, d: str) -> DataFrame:
    """All turns with dictionaries, details, typos and the word map, bigrams and phrases of the accented texts."""
    turns = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    out = normalize.normalize(turns, _snapshot(spark, d), *_assets(spark, d), TYPOS, live=True)
    return out.select("doc_id.conv_id", "doc_id.turn", "normalized_text", F.array_join("error_types", ",").alias("error_types"), F.size("expanded_abbreviations").alias("n_expanded"), F.size("ambiguities").alias("n_ambiguities"), F.size("variants").alias("n_variants"), F.size("changes").alias("n_changes"), F.size("pending_keys").alias("n_pending"))


def normalize_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents by segments, with one budget of pending keys for each."""
    out = normalize.normalize_segmented(_documents(spark, d), _snapshot(spark, d), typos=TYPOS)
    return out.select("doc_id", F.sha2("normalized_text", 256).alias("sha256"), F.array_join("error_types", ",").alias("error_types"), F.size("expanded_abbreviations").alias("n_expanded"), F.size("ambiguities").alias("n_ambiguities"), F.size("changes").alias("n_changes"), F.size("pending_keys").alias("n_pending"))


def segment_budget(spark: SparkSession, d: str) -> DataFrame:
    """How many unknown words each segment of a document is the first to have, and how many the document's budget still takes."""
    parts = segments.explode_chunks(_documents(spark, d))
    tokens = parts.select("doc_id", F.col("chunk").alias("segment"), F.posexplode(T.space_tokens("text")).alias("first_pos", "token"))
    known = table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("key")).distinct()
    keys = tokens.withColumn("key", F.lower("token")).filter(F.col("key").rlike("^[a-z]+$")).join(known, "key", "left_anti")
    budget = normalize.within_budget(keys, segment="segment")
    return budget.groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("n_first_seen"), F.count_if("allowed").alias("n_allowed"))


def change_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Marked stretches of each document (accents, mixed words, names, double blanks, short forms of parts), merged."""
    listed = _documents(spark, d).select("doc_id", F.length("text").alias("size"), F.split("text", " ", -1).alias("w"), spans.blanks("text").alias("b"))
    # each word with the place of the blank before it and with the word after it, side by side before they become rows
    sides = F.arrays_zip("w", F.concat(F.array(F.lit(-1)), "b").alias("at"), F.slice("w", F.lit(2), F.size("w")).alias("next"))
    cut = listed.select("doc_id", "size", F.explode(sides).alias("z")).select("doc_id", "size", F.col("z.w").alias("w"), (F.col("z.at") + 1).alias("start"), F.col("z.next").alias("next"))
    words = cut.withColumn("end", F.col("start") + F.length("w"))
    short = table(spark, d, "part").select(F.lower(F.substring("p_name", 1, 3)).alias("_abbr")).distinct()
    words = words.join(F.broadcast(short), F.lower("w") == F.col("_abbr"), "left")  # three letters each
    both = lambda pattern: F.col("w").rlike(pattern) & F.col("next").rlike(pattern)
    two = F.col("end") + 1 + F.length("next")
    marks = [
        (both(r"[^\x00-\x7F]"), "diacritic", F.col("start"), two),
        (F.col("w").rlike("[0-9][A-Za-z]|[A-Za-z][0-9]"), "spelling", F.col("start"), F.col("end")),
        (both("^[A-Z][a-z]+$"), "case", F.col("start"), two),
        ((F.col("w") == "") & (F.col("start") > 0), "whitespace", F.col("start") - 1, F.least(F.col("start") + 1, F.col("size"))),
        (F.col("_abbr").isNotNull(), "teencode", F.col("start"), F.col("end")),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.array(F.lit(kind)).alias("kinds"), a.alias("start"), b.alias("end"), a.alias("output_start"), b.alias("output_end"))) for c, kind, a, b in marks)))
    rows = words.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")
    return diffs.merged(rows, ["doc_id"]).select("doc_id", "start", "end", F.array_join("kinds", ",").alias("kinds"))


CHANGE_INTERVALS = r"""
WITH cut AS (SELECT doc_id, length(text) AS size, string_split(text, ' ') AS ws FROM documents),
w AS (SELECT doc_id, size, i, ws[i] AS w, ws[i + 1] AS nxt FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM cut)),
p AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS s FROM w),
q AS (SELECT *, (s + length(w))::INT AS e, (s + length(w) + 1 + length(nxt))::INT AS e2 FROM p),
m AS (
  SELECT doc_id, s, e2 AS e, 'diacritic' AS kind FROM q WHERE regexp_matches(w, '[^\x00-\x7F]') AND regexp_matches(nxt, '[^\x00-\x7F]')
  UNION ALL SELECT doc_id, s, e, 'spelling' FROM q WHERE regexp_matches(w, '[0-9][A-Za-z]|[A-Za-z][0-9]')
  UNION ALL SELECT doc_id, s, e2, 'case' FROM q WHERE regexp_matches(w, '^[A-Z][a-z]+$') AND regexp_matches(nxt, '^[A-Z][a-z]+$')
  UNION ALL SELECT doc_id, s - 1, least(s + 1, size)::INT, 'whitespace' FROM q WHERE w = '' AND s > 0
  UNION ALL SELECT doc_id, s, e, 'teencode' FROM q WHERE lower(w) IN (SELECT lower(substr(p_name, 1, 3)) FROM part)),
n AS (SELECT *, 2 * count(*) FILTER (kind = 'teencode') OVER (PARTITION BY doc_id ORDER BY s, e, kind ROWS UNBOUNDED PRECEDING) - (kind = 'teencode')::INT AS part FROM m),
r AS (SELECT *, max(e) OVER (PARTITION BY doc_id, part ORDER BY s, e, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n),
g AS (SELECT *, sum((reach IS NULL OR s >= reach)::INT) OVER (PARTITION BY doc_id, part ORDER BY s, e, kind ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT doc_id, min(s) AS start, max(e) AS "end", array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM g GROUP BY doc_id, part, run
"""


def context_choice(spark: SparkSession, d: str) -> DataFrame:
    """Which of two meanings the neighbours of "la" and "en" speak for, within their sentence."""
    tokens = _documents(spark, d).select("doc_id", F.posexplode(T.space_tokens("text")).alias("pos", "token")).withColumn("alpha", F.col("token").rlike("^[A-Za-z]+$"))
    options = F.when(F.lower("token").isin("la", "en"), F.array(F.lit("công ty"), F.lit("chia tay")))
    chosen = normalize.contextual_choice(tokens.withColumn("expanded", F.lower("token")).withColumn("options", options))
    return chosen.select("doc_id", F.col("pos").cast("long").alias("pos"), "chosen", F.round("confidence", 4).alias("confidence"))


_SAID = lambda side, words: f"len(list_filter({side}, lambda x: x IN ({', '.join(repr(w) for w in words)}))) > 0"
CONTEXT_CHOICE = f"""
WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS w FROM documents),
t AS (SELECT doc_id, i, w[greatest(i - 5, 1):i - 1] AS l, w[i + 1:i + 5] AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM s) WHERE lower(w[i]) IN ('la', 'en')),
b AS (
  SELECT doc_id, i, l[coalesce(list_filter(range(1, len(l) + 1), lambda k: l[k] IN ('.', '!', '?', ';', '…'))[-1], 0) + 1:] AS l,
    r[:coalesce(list_filter(range(1, len(r) + 1), lambda k: r[k] IN ('.', '!', '?', ';', '…'))[1], len(r) + 1) - 1] AS r FROM t),
c AS (SELECT doc_id, i, list_transform(list_filter(l, lambda x: regexp_full_match(x, '[A-Za-z]+')), lambda x: lower(x)) AS l, list_transform(list_filter(r, lambda x: regexp_full_match(x, '[A-Za-z]+')), lambda x: lower(x)) AS r FROM b),
e AS (SELECT *, list_concat(l, r) AS near, coalesce(l[-1], '') AS last, (r[1:2] = ['nguoi', 'yeu']) OR coalesce(r[1], '') = 'ny' AS partner FROM c),
p AS (
  SELECT doc_id, i, (partner::INT * 9 + (last IN ({', '.join(repr(w) for w in normalize.RECENT)}))::INT * 3 + ({_SAID('near', normalize.ROMANCE)})::INT * 2 - ({_SAID('r[1:3]', normalize.BUSINESS)})::INT * 4) AS leaving,
    (({_SAID('near', normalize.BUSINESS)})::INT * 5 + (last IN ('o', 'tai', 'vao', 'den'))::INT * 2 - partner::INT * 7) AS company FROM e)
SELECT doc_id, i - 1 AS pos, CASE WHEN company >= leaving THEN 'công ty' ELSE 'chia tay' END AS chosen, round(least(0.98, 0.70 + 0.03 * abs(company - leaving)), 4)::DOUBLE AS confidence
FROM p WHERE greatest(company, leaving) >= 4 AND abs(company - leaving) >= 2
"""


def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segments.explode_chunks(_documents(spark, d)).select("doc_id", "chunk", "start_word", "end_word", F.length("text").alias("n_chars"))


SENTENCE_CHUNKS = r"""
WITH RECURSIVE cut AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w, regexp_extract_all(text, '\s+') AS gaps, regexp_matches(text, '^\s') AS led FROM documents),
t AS (
  SELECT doc_id, length(text) AS size, len(w) AS n, list_transform(w, lambda x: length(x)) AS ws, list_transform(CASE WHEN led THEN gaps ELSE list_prepend('', gaps) END, lambda x: length(x)) AS gs,
    list_filter(range(1, len(w) + 1), lambda i: regexp_matches(w[i], '[.!?…]["''”’)\]}]*$')) AS ends FROM cut WHERE len(w) > 0),
r AS (
  SELECT doc_id, 0 AS chunk, 0::BIGINT AS a, CASE WHEN n <= 120 THEN n ELSE coalesce(list_filter(ends, lambda e: e > 60 AND e <= 120)[-1], 120) END AS b FROM t
  UNION ALL
  SELECT r.doc_id, chunk + 1, b, coalesce(list_filter(ends, lambda e: e > b + 60 AND e <= least(b + 120, n))[-1], least(b + 120, n)) FROM r JOIN t USING (doc_id) WHERE b < n)
SELECT doc_id, chunk, a::INT AS start_word, b::INT AS end_word,
  (CASE WHEN n <= 120 THEN size ELSE list_sum(ws[a + 1:b]) + coalesce(list_sum(gs[a + 2:b]), 0) END)::INT AS n_chars FROM r JOIN t USING (doc_id)
"""


SEGMENT_BUDGET = SENTENCE_CHUNKS[: SENTENCE_CHUNKS.index("SELECT doc_id, chunk, a::INT")].rstrip() + f""",
k AS (SELECT DISTINCT unnest({_words('text')}) AS key FROM benchmark),
u AS (SELECT doc_id, chunk, lower(w[i]) AS key, i FROM (SELECT r.doc_id, chunk, w, unnest(range(a + 1, b + 1)) AS i FROM r JOIN cut USING (doc_id)) WHERE regexp_full_match(lower(w[i]), '[a-z]+')),
f AS (SELECT doc_id, key, min(i) AS i, arg_min(chunk, i) AS chunk FROM u WHERE key NOT IN (SELECT key FROM k) GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, key) <= 80 AS allowed FROM f)
SELECT doc_id, chunk AS segment, count(*)::BIGINT AS n_first_seen, count(*) FILTER (allowed)::BIGINT AS n_allowed FROM n GROUP BY 1, 2
"""


def segmented_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    joined = segments.join_chunks(segments.explode_chunks(_documents(spark, d)))
    return joined.select("doc_id", F.sha2("text", 256).alias("sha256"))


ROUNDTRIP = "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE regexp_matches(text, '\\S')"


def protected_literals(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).select("doc_id", "text", spans.protected_spans("text").alias("s"))
    return docs.select("doc_id", F.size("s").alias("n_spans"), F.array_join(F.transform("s", lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])), "|").alias("literals"))


def review_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document's bare side is reviewed against its accented side as the recorded proposal.

    German documents stand for those without a reply. The word map is mined from the pairs, the names of
    parts stand for the expansions of their first three letters, and the raw text has "dl" for "de la".
    """
    pairs = kept(_pairs(spark, d))
    bare = F.regexp_replace("no_diacritics", r"\bde la\b", "dl")
    sources = pairs.select("doc_id", bare.alias("raw"), F.col("no_diacritics").alias("normalized"))
    cut = kept(segments.explode_review_chunks(pairs, text="no_diacritics", pack=True))
    chunks = review.with_source(cut, sources)
    langs = _documents(spark, d).select("doc_id", "lang")
    replies = _same_cut(cut, pairs).join(langs, "doc_id").select("doc_id", "lang", "chunk", "proposed", F.lit(0.9).alias("confidence"), F.lit("ok").alias("status"))
    options = table(spark, d, "part").select(F.lower(F.substring("p_name", 1, 3)).alias("abbr"), "p_name").groupBy("abbr").agg(F.collect_set("p_name").alias("options"))
    forms = mining.word_map(mining.word_forms(pairs))
    return review.document_status(review.review(chunks, replies.filter("lang <> 'de'").drop("lang"), options, forms))


def _same_cut(cut: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, chunk, proposed: the accented texts cut at the same words as their bare sides."""
    words = cut.join(pairs.select("doc_id", T.space_tokens("with_diacritics").alias("w")), "doc_id")
    return words.select("doc_id", "chunk", F.array_join(F.slice("w", F.col("start_word") + 1, F.col("end_word") - F.col("start_word")), " ").alias("proposed"))


def review_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 400 words by paragraphs and sentences, of the texts in lower case (so none holds a literal with blanks)."""
    lowered = _documents(spark, d).select("doc_id", F.lower("text").alias("text"))
    return segments.explode_review_chunks(lowered, pack=True).select("doc_id", "chunk", "start_word", "end_word")


REVIEW_CUTS = r"""
WITH RECURSIVE cut AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS w, regexp_extract_all(lower(text), '\s+') AS gaps, regexp_matches(text, '^\s') AS led FROM documents),
t AS (
  SELECT doc_id, len(w) AS n, list_filter(range(1, len(w) + 1), lambda i: regexp_matches(w[i], '[.!?…]["''”’)\]}]*$')) AS ends,
    list_filter(range(1, len(w)), lambda i: contains(gaps[i + led::INT], chr(10))) AS breaks FROM cut WHERE len(w) > 0),
r AS (
  SELECT doc_id, -1 AS chunk, 0::BIGINT AS a, 0::BIGINT AS b FROM t
  UNION ALL
  SELECT r.doc_id, chunk + 1, b, CASE WHEN b + 400 >= n THEN n WHEN list_contains(breaks, b + 400) THEN b + 400
    ELSE coalesce(list_filter(breaks, lambda k: k > b AND k < b + 400)[-1], list_filter(ends, lambda e: e > b + 200 AND e <= b + 400)[-1], b + 400) END FROM r JOIN t USING (doc_id) WHERE b < n)
SELECT doc_id, chunk, a::INT AS start_word, b::INT AS end_word FROM r WHERE chunk >= 0
"""


def sequence_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of a benchmark word's first four letters, or of the whole word, in the documents: the longest at each place."""
    words = table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("w")).filter("length(w) >= 4")
    listed = patterns.listed(words.select("w").union(words.select(F.substring("w", 1, 4))), "w")
    found = _documents(spark, d).select("doc_id", patterns.matches("text", listed).alias("m"))
    return found.select("doc_id", F.size("m").cast("long").alias("n_matches"), F.sha2(F.array_join("m", "|"), 256).alias("sha256"))


SEQUENCE_MATCHES = f"""
WITH w AS (SELECT DISTINCT unnest({_words('text')}) AS w FROM benchmark),
s AS (SELECT w FROM w WHERE length(w) >= 4 UNION SELECT left(w, 4) FROM w WHERE length(w) >= 4),
p AS (SELECT string_agg(w, '|' ORDER BY length(w) DESC, w) AS p FROM s),
m AS (SELECT doc_id, regexp_extract_all(text, (SELECT p FROM p)) AS m FROM documents)
SELECT doc_id, len(m)::BIGINT AS n_matches, sha256(array_to_string(m, '|')) AS sha256 FROM m
"""


QUERIES = {
    "accent_ratio": accent_ratio,
    "missing_accents": missing_accents,
    "scan_tokens": scan_tokens,
    "unknown_words": unknown_words,
    "unknown_runs": unknown_runs,
    "abbr_expand": abbr_expand,
    "context_window5": context_window5,
    "bigram_scored_choice": bigram_scored_choice,
    "restore_coverage": restore_coverage,
    "restore_documents": restore_documents,
    "normalize_conversations": normalize_conversations,
    "normalize_documents": normalize_documents,
    "segment_budget": segment_budget,
    "change_intervals": change_intervals,
    "context_choice": context_choice,
    "sentence_chunks": sentence_chunks,
    "segmented_roundtrip": segmented_roundtrip,
    "protected_literals": protected_literals,
    "review_documents": review_documents,
    "review_cuts": review_cuts,
    "sequence_matches": sequence_matches,
}

SQL = {
    "accent_ratio": ACCENT_RATIO,
    "missing_accents": MISSING_ACCENTS,
    "scan_tokens": SCAN_TOKENS,
    "unknown_words": UNKNOWN_WORDS,
    "unknown_runs": UNKNOWN_RUNS,
    "abbr_expand": ABBR_EXPAND,
    "context_window5": CONTEXT_WINDOW,
    "segmented_roundtrip": ROUNDTRIP,
    "bigram_scored_choice": BIGRAM_CHOICE,
    "restore_coverage": RESTORE_COVERAGE,
    "sentence_chunks": SENTENCE_CHUNKS,
    "segment_budget": SEGMENT_BUDGET,
    "review_cuts": REVIEW_CUTS,
    "sequence_matches": SEQUENCE_MATCHES,
    "change_intervals": CHANGE_INTERVALS,
    "context_choice": CONTEXT_CHOICE,
}
