"""Readers: parallel CSVs, dictionaries and emoji lists, always with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIR = ["no_diacritics", "with_diacritics"]
ABBREVIATION = "id string, abbr string, expanded string, alternative_expansions array<string>, domain string, source string, approved boolean, created_at string, approved_by string"
PHRASE = "phrase string, expanded string, source string, confidence string"


def check_columns(df: DataFrame, columns: list[str], leading: bool = False) -> DataFrame:
    """``df`` if it has ``columns`` (as its first ones with ``leading``), else ValueError (SRC3)."""
    if (leading and df.columns[: len(columns)] != columns) or not set(columns) <= set(df.columns):
        raise ValueError(f"columns {columns} are needed; there are {df.columns}")
    return df


def pairs(spark: SparkSession, paths: str | list[str], strict: bool = False, weights: dict[str, float] | None = None) -> DataFrame:
    """no_diacritics, with_diacritics, path and, with ``weights`` by path ending, weight (SRC1, SRC2, UDF5).

    Headers are required; a byte-order mark is dropped; sides are trimmed and blank pairs left out.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    raw = raw.select(*(F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in raw.columns), F.input_file_name().alias("path"))
    check_columns(raw, PAIR, strict)
    rows = raw.select(*(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^[\s\x{FEFF}]+|\s+$", "").alias(c) for c in PAIR), "path")
    rows = rows.filter(" AND ".join(f"{c} <> ''" for c in PAIR))
    if not weights:
        return rows
    weight = F.lit(1.0)
    for ending, value in weights.items():
        weight = F.when(F.col("path").endswith(ending), value).otherwise(weight)
    return rows.withColumn("weight", weight)


def teencode(spark: SparkSession, path: str) -> DataFrame:
    """abbr, expanded from lines of two fields set apart by a tab or two spaces and more (SRC4)."""
    cut = spark.read.text(path).select(F.split(F.trim("value"), r"\t+| {2,}", 2).alias("f")).filter(F.size("f") == 2)
    return cut.select(F.trim(F.col("f")[0]).alias("abbr"), F.trim(F.col("f")[1]).alias("expanded")).filter("abbr <> '' AND expanded <> ''")


def word_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """word: one per line, trimmed (SRC5)."""
    return spark.read.text(paths).select(F.trim("value").alias("word")).filter("word <> ''")


def _code_points(c: Column) -> Column:
    """Characters of space-separated hexadecimal code points."""
    return F.array_join(F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""), lambda x: F.decode(F.unhex(F.lpad(x, 8, F.lit("0"))), "UTF-32")), "")


def emoji_test(spark: SparkSession, path: str) -> DataFrame:
    """emoji, status, group_name, subgroup_name of an emoji test file (SRC6, WIN7).

    A file is some thousand lines; it is read whole, so that lines keep their order, and exploded.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    order = Window.partitionBy(F.lit(0)).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = lambda name: F.last(F.nullif(F.regexp_extract("value", rf"^# {name}: (.*)$", 1), F.lit("")), ignorenulls=True).over(order)
    rows = lines.withColumn("group_name", carried("group")).withColumn("subgroup_name", carried("subgroup")).filter(F.col("value").rlike("^[0-9A-F]"))
    return rows.select(_code_points(F.split("value", ";")[0]).alias("emoji"), F.trim(F.regexp_extract("value", r";\s*([^#]*)", 1)).alias("status"), "group_name", "subgroup_name")


def emoji_sequences(spark: SparkSession, path: str) -> DataFrame:
    """kind, first, last (code point numbers) or emoji of a sequence file (SRC7)."""
    rows = spark.read.text(path).filter(F.col("value").rlike("^[0-9A-F]")).select(F.split("value", r"\s*;\s*").alias("f"))
    points, kind = F.trim(F.col("f")[0]), F.trim(F.col("f")[1])
    span = F.split(points, r"\.\.")
    ranged = F.size(span) == 2
    number = lambda x: F.conv(x, 16, 10).cast("int")
    return rows.select(kind.alias("kind"), F.when(ranged, number(span[0])).alias("first"), F.when(ranged, number(F.element_at(span, -1))).alias("last"), F.when(~ranged, _code_points(points)).alias("emoji"))


def file_header(spark: SparkSession, path: str) -> DataFrame:
    """name, value of the leading comment lines of a data file (SRC8)."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^#\s*(\w+):\s*(.*)$", 1).alias("name"), F.regexp_extract("value", r"^#\s*(\w+):\s*(.*)$", 2).alias("value")).filter("name <> ''")


def _records(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The records of a JSON object's array; a malformed file has none."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", f"{field} array<struct<{_struct(schema)}>>")[field]).alias("r")).select("r.*")


def _struct(schema: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, _, kind in (field.partition(" ") for field in schema.split(", ")))


def abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """Approved records of an abbreviation file, with defaults for what is missing (SRC9)."""
    rows = _records(spark, path, "abbreviations", ABBREVIATION)
    rows = rows.filter(F.coalesce("approved", F.lit(True)) & (F.trim(F.coalesce("abbr", F.lit(""))) != "") & (F.trim(F.coalesce("expanded", F.lit(""))) != ""))
    return rows.select(F.lower(F.trim("abbr")).alias("abbr"), F.trim("expanded").alias("expanded"), F.to_json(F.coalesce("alternative_expansions", F.array().cast("array<string>"))).alias("alternative_expansions_json"), F.coalesce("domain", F.lit("general")).alias("domain"), F.coalesce("source", F.lit("json_seed")).alias("source"))


def phrases(spark: SparkSession, path: str, source: str) -> DataFrame:
    """phrase, expanded, source, confidence; here a confidence of 0 counts as missing (SRC10)."""
    rows = _records(spark, path, "phrases", PHRASE)
    number = F.col("confidence").try_cast("double")
    return rows.select(F.lower(F.trim("phrase")).alias("phrase"), F.trim("expanded").alias("expanded"), F.coalesce("source", F.lit(source)).alias("source"), F.when(F.coalesce(number, F.lit(0.0)) == 0, 1.0).otherwise(number).cast("string").alias("confidence")).filter("phrase <> '' AND expanded <> ''")


#: Typos that a task may hold as one pattern.
MOST_TYPOS = 10_000


def typos(spark: SparkSession, path: str) -> dict[str, str]:
    """The typo table as a dictionary for ``spans.spelled`` (SRC12).

    It is a short, hand-kept list; ValueError is raised for one of more than ``MOST_TYPOS`` entries.
    """
    rows = _records(spark, path, "entries", "wrong string, correct string").filter("wrong <> '' AND correct <> ''")
    found = rows.limit(MOST_TYPOS + 1).collect()
    if len(found) > MOST_TYPOS:
        raise ValueError(f"more than {MOST_TYPOS} typos in {path}")
    return {r["wrong"]: r["correct"] for r in found}


def jdbc(spark: SparkSession, url: str, table: str, predicates: list[str] | None = None, **properties: str) -> DataFrame:
    """A database table, in parallel by ``predicates`` (SRC14)."""
    if predicates:
        return spark.read.jdbc(url, table, predicates=predicates, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def history(rows: DataFrame, limit: int = 200_000) -> DataFrame:
    """The newest texts of a history (SRC15)."""
    return rows.orderBy(F.desc("created_at"), "id").limit(limit)
