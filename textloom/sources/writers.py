"""Writers. Spark's commit protocol takes the place of temporary files and renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asset(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A built table, replaced as a whole (SNK1, SNK2)."""
    df.write.mode("overwrite").format(kind).save(path)


def approved_export(abbreviations: DataFrame, path: str) -> None:
    """Approved abbreviations as JSON lines, sorted (SNK3)."""
    rows = abbreviations.select("abbr", "expanded", F.from_json("alternative_expansions_json", "array<string>").alias("alternative_expansions"), "domain", "source")
    rows.orderBy("abbr", "domain").write.mode("overwrite").json(path)


def corpus_csv(pairs: DataFrame, path: str) -> None:
    """Pairs as CSV with a header (SNK4)."""
    pairs.select("no_diacritics", "with_diacritics").write.mode("overwrite").option("header", True).csv(path)


def phrase_report(phrases: DataFrame, path: str) -> None:
    """Mined phrases as JSON lines (SNK5)."""
    phrases.orderBy(F.desc("freq"), F.desc("pmi"), "phrase").write.mode("overwrite").json(path)


def history_rows(results: DataFrame, as_of: str) -> DataFrame:
    """Rows for the history from normalized texts; the key is a digest, so a repeated run repeats it."""
    return results.select(
        F.sha2(F.concat_ws("\u0001", F.col("doc_id").cast("string"), F.lit(as_of)), 256).alias("id"),
        F.col("text").alias("input_text"),
        F.col("normalized_text").alias("output_text"),
        F.to_json("error_types").alias("error_types_json"),
        F.lit(as_of).cast("timestamp").alias("created_at"),
    )


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a history or an error log (SNK6, SNK7)."""
    rows.write.mode("append").parquet(path)


def error_types(column: str) -> Column:
    """A stored list of labels; malformed ones are empty (JSON3)."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))
