"""Quality rules with verdicts on whole hosts.

Each document gets rule counts from one pass over its bytes. For each rule, the share of documents
that fail it is summed by host and shrunk towards the corpus with a beta prior fitted to the hosts
themselves; a host is judged by its worst rule, and the verdict is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from textloom.llm import _text
from textloom.llm._spark import durable, if_small

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host goes when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.6

#: More than one symbol for so many characters of words, or one repeated line for so many words.
CHARS_PER_SYMBOL, WORDS_PER_DUP_LINE = 10, 10

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry: whether its text has it twice or more, and whether the text had it before."""
    with np.errstate(over="ignore"):
        key = _text.mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    again, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order] = same
    same[:-1] |= same[1:]
    again[order] = same
    return again, before


def _measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    part, bounds = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    w = _text.words(data, offsets, lower=False)
    out = np.zeros((5, n), np.int64)
    out[0] = _text.counts_by(w.doc, n)
    characters = np.r_[0, np.cumsum(((part & 0xC0) != 0x80) & ~_text.IS_SPACE[part])]
    out[1] = characters[bounds[1:]] - characters[bounds[:-1]]
    symbols = np.r_[0, np.cumsum(_SYMBOL[part])]
    out[2] = symbols[bounds[1:]] - symbols[bounds[:-1]]
    rows = _text.lines(data, offsets)
    filled = np.r_[0, np.cumsum(~_text.IS_SPACE[part])]
    full = filled[rows.end] > filled[rows.start]
    _, before = _repeated(rows.doc[full], rows.hash[full])
    out[3] = _text.counts_by(rows.doc[full], n, before)
    grams, at = _text.windows(w.hash, w.doc, 3)
    again, _ = _repeated(w.doc[at], grams)
    covered = np.zeros(len(w.doc), bool)
    for j in range(3):
        covered[at[again] + j] = True
    out[4] = _text.counts_by(w.doc, n, covered)
    return out


@_text.frugal
def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _text.text_bytes(batch.column(2))
        parts = [_measure(data, offsets[lo : hi + 1]) for lo, hi in _text.chunks(offsets)]
        counts = np.concatenate(parts, 1) if parts else np.zeros((5, 0), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, counts)], names=["doc_id", "host", *COUNTS])


def rule_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the five counts of each text, in one pass without a shuffle."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    return rows.mapInArrow(_count_rows, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def rules() -> dict[str, Column]:
    """What a document may fail; the first two fail the document itself, all count for its host."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": CHARS_PER_SYMBOL * F.col("n_symbols") > F.col("word_chars"),
        "lines": WORDS_PER_DUP_LINE * F.col("n_dup_lines") > F.col("n_words"),
    }


def base_failed() -> Column:
    """Too short, or more than half of it in repeated three-word windows."""
    return rules()["short"] | rules()["repetitive"]


def host_verdicts(counted: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, host_docs, host_rule, host_rate, host_kept: one row per host that isn't null.

    Each rule has a prior Beta(mean * strength, (1 - mean) * strength). Its mean is the mean of the
    hosts' failure rates; its strength matches their variance (mean * (1 - mean) / variance - 1,
    between 1 and 10,000; 10,000 where the hosts don't differ). host_rate is the greatest of the
    posterior means and host_rule the rule it belongs to, of equal ones the first by name.
    """
    failed = {name: F.sum(rule.cast("long")).alias(name) for name, rule in rules().items()}
    hosts = counted.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), *failed.values())
    rate = {name: F.col(name) / F.col("host_docs") for name in failed}
    moments = [m for name, r in rate.items() for m in (F.avg(r).alias(f"{name}_mean"), F.coalesce(F.var_pop(r), F.lit(0.0)).alias(f"{name}_variance"))]
    prior = hosts.agg(*moments)  # one row
    mean, variance = (lambda n: F.col(f"{n}_mean")), (lambda n: F.col(f"{n}_variance"))
    strength = {n: F.least(F.greatest(F.when(variance(n) > 0, mean(n) * (1 - mean(n)) / variance(n) - 1).otherwise(10_000.0), F.lit(1.0)), F.lit(10_000.0)) for n in failed}
    fitted = prior.select(F.struct(*(F.struct(mean(n).alias("mean"), strength[n].alias("strength")).alias(n) for n in failed)).alias("p"))
    judged = hosts.withColumn("p", fitted.scalar())
    shrunk = {n: (F.col(n) + F.col(f"p.{n}.mean") * F.col(f"p.{n}.strength")) / (F.col("host_docs") + F.col(f"p.{n}.strength")) for n in failed}
    worst = F.array_sort(F.array(*(F.struct((-v).alias("loss"), F.lit(n).alias("rule")) for n, v in shrunk.items())))[0]
    return judged.withColumn("w", worst).select("host", "host_docs", F.col("w.rule").alias("host_rule"), (-F.col("w.loss")).alias("host_rate"), (-F.col("w.loss") <= max_rate).alias("host_kept"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, host_rule, host_rate and kept.

    A document is kept if it passes its own rules and its host isn't judged bad. Hosts are counted
    with partial sums, so one with a third of all rows costs no more than another; the join back
    lets Spark broadcast or split by size. Null texts have no words and fail; a null host gets no
    verdict (host_rule and host_rate are null) and doesn't reject; repeated rows stay repeated; an empty table
    gives no rows; other columns are ignored, whatever their names. Texts are measured whole, however
    long, each on its own where it is longer than a batch's share.
    """
    counted = durable(rule_counts(docs, doc_id, text, host))
    verdicts = host_verdicts(counted, max_rate).select("host", "host_rule", "host_rate", "host_kept")
    kept = ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))
    return (
        counted.withColumn("base_failed", base_failed())
        .join(verdicts, "host", "left")
        .select("doc_id", *COUNTS, "base_failed", "host_rule", "host_rate", kept.alias("kept"))
    )


def _fails(texts: pa.Array) -> pa.Array:
    data, offsets = _text.text_bytes(texts)
    parts = [_measure(data, offsets[lo : hi + 1]) for lo, hi in _text.chunks(offsets)]
    counts = np.concatenate(parts, 1) if parts else np.zeros((5, 0), np.int64)
    return pa.array((counts[0] < MIN_WORDS) | (100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    Rows are judged one by one, not by id, so repeated or null ids don't matter.
    """
    counted = durable(rule_counts(docs.withColumn("_row", F.lit(None).cast("long")), "_row", text, host))
    bad = if_small(durable(host_verdicts(counted, max_rate).filter("NOT host_kept").select(F.col("host").alias("_bad_host"))))
    fails = F.arrow_udf(_fails, BooleanType())
    return docs.filter(~fails(F.col(text))).join(bad, docs[host].cast("string") == bad["_bad_host"], "left_anti")
