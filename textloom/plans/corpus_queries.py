"""Corpus mining and evaluation over ``documents``; the folded text stands for the bare side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import evaluate, mining
from textloom.session import table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    accented = _documents(spark, d).filter(F.col("lang").isin("fr", "es", "de"))
    return accented.select("doc_id", "lang", T.strip_diacritics("text").alias("no_diacritics"), F.col("text").alias("with_diacritics"))


#: DuckDB macros in place: cleaned tokens of a text, and accents off.
def _clean(text: str) -> str:
    return f"list_filter(list_transform(list_filter(regexp_split_to_array({text}, '\\s+'), lambda t: t <> ''), lambda t: trim(lower(t), '.,!?;:\"''()[]{{}}…“”‘’')), lambda t: regexp_full_match(t, '\\p{{L}}+'))"


def _clean_all(text: str) -> str:
    return f"list_transform(list_transform(list_filter(regexp_split_to_array({text}, '\\s+'), lambda t: t <> ''), lambda t: trim(lower(t), '.,!?;:\"''()[]{{}}…“”‘’')), lambda t: CASE WHEN regexp_full_match(t, '\\p{{L}}+') THEN t ELSE '' END)"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-zA-ZÀ-ỹ]+')"


_PAIRS = "SELECT doc_id, lang, strip_accents(text) AS nd, text AS wd FROM documents WHERE lang IN ('fr', 'es', 'de')"


def bigram_topk(spark: SparkSession, d: str) -> DataFrame:
    return mining.top_bigrams(mining.bigrams(_documents(spark, d), "text"), 200)


BIGRAM_TOPK = f"""
WITH w AS (SELECT {_clean('text')} AS w FROM documents)
SELECT w1, w2, count(*)::BIGINT AS cnt FROM (SELECT w[i] AS w1, w[i + 1] AS w2 FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w))
GROUP BY 1, 2 ORDER BY cnt DESC, w1, w2 LIMIT 200
"""


def bigrams_weighted(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).withColumn("weight", F.when(F.col("lang") == "en", 0.5).otherwise(2.0))
    return mining.top_bigrams(mining.bigrams(docs, "text"), 500, 2)


BIGRAMS_WEIGHTED = f"""
WITH w AS (SELECT {_clean('text')} AS w, CASE WHEN lang = 'en' THEN 0.5 ELSE 2.0 END::DOUBLE AS weight FROM documents)
SELECT * FROM (SELECT w1, w2, sum(weight) AS cnt FROM (SELECT w[i] AS w1, w[i + 1] AS w2, weight FROM (SELECT w, weight, unnest(range(1, len(w))) AS i FROM w))
GROUP BY 1, 2 ORDER BY cnt DESC, w1, w2 LIMIT 500) WHERE cnt >= 2
"""


def word_map_topk(spark: SparkSession, d: str) -> DataFrame:
    return mining.word_map(mining.word_forms(_pairs(spark, d)))


WORD_MAP = f"""
WITH p AS (SELECT list_filter(regexp_split_to_array(nd, '\\s+'), lambda t: t <> '') AS n, list_filter(regexp_split_to_array(wd, '\\s+'), lambda t: t <> '') AS w, nd AS nt, wd AS wt FROM ({_PAIRS})),
q AS (SELECT {_clean_all('nt')} AS a, {_clean_all('wt')} AS b FROM p WHERE len(n) = len(w)),
forms AS (SELECT nd, wd, count(*)::BIGINT AS cnt FROM (SELECT a[i] AS nd, b[i] AS wd FROM (SELECT a, b, unnest(range(1, len(a) + 1)) AS i FROM q)) WHERE nd <> '' AND wd <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY nd ORDER BY cnt DESC, wd) AS r, max(cnt) OVER (PARTITION BY nd) AS top,
  first_value(wd) OVER (PARTITION BY nd ORDER BY cnt DESC, wd) AS best FROM forms)
SELECT nd, r::INT AS rank, wd AS form, cnt FROM r
WHERE best <> nd AND CASE WHEN top >= 2 THEN cnt >= 2 AND r <= 8 ELSE r = 1 END
"""


def phrase_dominance(spark: SparkSession, d: str) -> DataFrame:
    return mining.dominant_phrases(mining.phrase_variants(_pairs(spark, d), least=5), min_freq=5, min_dominance=0.7)


PHRASE_DOMINANCE = f"""
WITH p AS (SELECT {_clean_all('nd')} AS a, {_clean_all('wd')} AS b FROM ({_PAIRS})),
g AS (
  SELECT a[i:i + 1] AS x, b[i:i + 1] AS y FROM (SELECT a, b, unnest(range(1, len(a))) AS i FROM p WHERE len(a) = len(b))
  UNION ALL SELECT a[i:i + 2], b[i:i + 2] FROM (SELECT a, b, unnest(range(1, len(a) - 1)) AS i FROM p WHERE len(a) = len(b))
  UNION ALL SELECT a[i:i + 3], b[i:i + 3] FROM (SELECT a, b, unnest(range(1, len(a) - 2)) AS i FROM p WHERE len(a) = len(b))),
v AS (
  SELECT array_to_string(x, ' ') AS nd_key, array_to_string(y, ' ') AS wd_key, count(*)::BIGINT AS cnt FROM g
  WHERE NOT list_contains(x, '') AND NOT list_contains(y, '') AND x <> y GROUP BY 1, 2),
r AS (SELECT *, sum(cnt) OVER (PARTITION BY nd_key)::BIGINT AS total, row_number() OVER (PARTITION BY nd_key ORDER BY cnt DESC, wd_key) AS r FROM v)
SELECT nd_key, wd_key, cnt AS top_count, total FROM r WHERE r = 1 AND total >= 5 AND cnt / total >= 0.7 ORDER BY cnt DESC, nd_key LIMIT 5000
"""


def ngram_pmi(spark: SparkSession, d: str) -> DataFrame:
    found = mining.mined_phrases(_documents(spark, d), min_freq=5, top_n=0)
    return found.withColumn("freq", F.col("freq").cast("long"))


NGRAM_PMI = f"""
WITH w AS (SELECT {_words('text')} AS w FROM documents),
u AS (SELECT w1, count(*) AS c FROM (SELECT unnest(w) AS w1 FROM w) GROUP BY 1),
n AS (SELECT sum(c)::DOUBLE AS t FROM u),
g AS (
  SELECT w[i:i + 1] AS g FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)
  UNION ALL SELECT w[i:i + 2] FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w)
  UNION ALL SELECT w[i:i + 3] FROM (SELECT w, unnest(range(1, len(w) - 2)) AS i FROM w)
  UNION ALL SELECT w[i:i + 4] FROM (SELECT w, unnest(range(1, len(w) - 3)) AS i FROM w)),
f AS (SELECT g, count(*)::BIGINT AS freq FROM g GROUP BY 1 HAVING count(*) >= 5),
s AS (SELECT g, freq, sum(log2(c / t)) AS parts FROM (SELECT g, freq, unnest(g) AS w1 FROM f) JOIN u USING (w1), n GROUP BY 1, 2),
p AS (SELECT g, freq, log2(freq / t) - parts AS pmi FROM s, n)
SELECT array_to_string(g, ' ') AS phrase, len(g)::INT AS ngram, freq, round_even(pmi, 6) AS pmi, round_even(1 / (1 + exp(-0.5 * pmi)), 4) AS confidence FROM p
"""


def few_shot_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return mining.few_shot_examples(_pairs(spark, d), "doc_id", count=50, max_chars=600)


FEW_SHOT = f"""
SELECT nd AS no_diacritics, arg_min(wd, doc_id) AS with_diacritics, min(doc_id) AS doc_id FROM ({_PAIRS})
WHERE length(nd) <= 600 AND length(wd) <= 600 GROUP BY 1 ORDER BY 3, 1 LIMIT 50
"""


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return mining.first_by_text(_documents(spark, d), "text", "doc_id", min_words=3).select("doc_id", "lang", "source")


DEDUPE_FIRST = """
WITH k AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS n FROM documents)
SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source FROM k WHERE n >= 3 GROUP BY k
"""


def chunk_windows_120(spark: SparkSession, d: str) -> DataFrame:
    return mining.word_windows(_documents(spark, d).select("doc_id", "text"), "text").select("doc_id", F.col("window").cast("long").alias("window"), "chunk")


CHUNK_WINDOWS = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS w FROM documents)
SELECT doc_id, i // 120 AS "window", array_to_string(w[i + 1:i + 120], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, len(w), 120)) AS i FROM w)
"""


def merge_word_maps(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    old = mining.word_map(mining.word_forms(pairs.filter("lang <> 'de'"))).select("nd", "rank", "form")
    new = mining.word_map(mining.word_forms(pairs)).select("nd", "rank", "form")
    return mining.merge_assets(old, new, ["nd"])


def _map_sql(where: str) -> str:
    head = WORD_MAP.replace(f"({_PAIRS})", f"({_PAIRS} AND {where})")
    return f"(SELECT nd, rank, form FROM ({head}))"


MERGE_WORD_MAPS = f"""
WITH old AS {_map_sql("lang <> 'de'")}, new AS {_map_sql('true')}
SELECT * FROM old UNION ALL SELECT * FROM new WHERE nd NOT IN (SELECT nd FROM old)
"""


def token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy_summary(_pairs(spark, d), "with_diacritics", "no_diacritics")


TOKEN_ACCURACY = f"""
WITH p AS (SELECT list_filter(regexp_split_to_array(wd, '\\s+'), lambda t: t <> '') AS r, list_filter(regexp_split_to_array(nd, '\\s+'), lambda t: t <> '') AS h FROM ({_PAIRS}))
SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN len(r) = 0 THEN 1.0 ELSE len(list_filter(range(1, len(r) + 1), lambda i: r[i] = h[i])) / len(r) END), 4) AS token_accuracy,
  round(avg(CASE WHEN r = h THEN 1.0 ELSE 0.0 END), 4) AS exact_rate FROM p
"""


def latency_percentiles_nearest(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.nearest_percentiles(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


LATENCY = """
SELECT event_type, count(*)::BIGINT AS n, list_sort(list(value))[least(floor(0.5 * count(*)), count(*) - 1)::BIGINT + 1] AS p50,
  list_sort(list(value))[least(floor(0.95 * count(*)), count(*) - 1)::BIGINT + 1] AS p95
FROM events WHERE value IS NOT NULL GROUP BY 1
"""


def wer_pairs(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", T.space_tokens("text").alias("said"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("said").alias("next"))
    return evaluate.wer_by_group(turns.join(after, ["conv_id", "turn"]), "role", "said", "next")


QUERIES = {
    "bigram_topk": bigram_topk,
    "bigrams_weighted": bigrams_weighted,
    "word_map_topk": word_map_topk,
    "phrase_dominance": phrase_dominance,
    "ngram_pmi": ngram_pmi,
    "few_shot_first_seen": few_shot_first_seen,
    "dedupe_first": dedupe_first,
    "chunk_windows_120": chunk_windows_120,
    "merge_word_maps": merge_word_maps,
    "token_accuracy": token_accuracy,
    "latency_percentiles_nearest": latency_percentiles_nearest,
    "wer_pairs": wer_pairs,
}

SQL = {
    "bigram_topk": BIGRAM_TOPK,
    "bigrams_weighted": BIGRAMS_WEIGHTED,
    "word_map_topk": WORD_MAP,
    "phrase_dominance": PHRASE_DOMINANCE,
    "ngram_pmi": NGRAM_PMI,
    "few_shot_first_seen": FEW_SHOT,
    "dedupe_first": DEDUPE_FIRST,
    "chunk_windows_120": CHUNK_WINDOWS,
    "merge_word_maps": MERGE_WORD_MAPS,
    "token_accuracy": TOKEN_ACCURACY,
    "latency_percentiles_nearest": LATENCY,
}
