"""Restoration assets from JSON files, laid over what is built in (SRC13).

A missing file counts as empty. Files are read by Spark, so they may lie wherever the session can read;
what a job uses more than once it keeps (``session.kept``), and every task reads that snapshot.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Forms of bare words that a mined map may lack.
WORD_FORMS = {"met": ["mệt"], "thi": ["thì", "thị", "thí"], "trai": ["trái", "trai"], "vai": ["vài", "vai"], "nam": ["nằm", "năm", "nam"]}


def _entries(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key, value of a file's JSON object; none for a missing file or one without an object."""
    kind = f"map<string, {value}>"
    try:
        raw = spark.read.option("wholetext", True).text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], "value string")
    return raw.select(F.explode(F.from_json("value", kind)).alias("key", "value"))


def _listed(spark: SparkSession, forms: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame(list(forms.items()), "nd string, forms array<string>")


def word_map(spark: SparkSession, path: str, builtin: dict[str, list[str]] | None = None) -> DataFrame:
    """nd, rank, form: a file of one form or a list of them for each bare word; built-in forms where the file has none."""
    text = F.trim(F.col("value"))
    forms = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    file = _entries(spark, path, "string").select(F.col("key").alias("nd"), forms.alias("forms"))
    own = _listed(spark, WORD_FORMS if builtin is None else builtin).join(file.select("nd"), "nd", "left_anti")
    rows = file.unionByName(own).select("nd", F.posexplode("forms").alias("at", "form"))
    return rows.select("nd", (F.col("at") + 1).alias("rank"), "form")


def bigrams(spark: SparkSession, path: str) -> DataFrame:
    """w1, w2, cnt of a file of counts by ``first_second``."""
    rows = _entries(spark, path, "bigint").withColumn("w", F.split("key", "_", 2)).filter(F.size("w") == 2)
    return rows.select(F.col("w")[0].alias("w1"), F.col("w")[1].alias("w2"), F.col("value").alias("cnt"))


def context_phrases(spark: SparkSession, path: str, builtin: DataFrame | None = None) -> DataFrame:
    """key, val (arrays of words): a file's phrases of two words or more and of equal length; built-in ones win."""
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    file = _entries(spark, path, "string").select(words(F.lower("key")).alias("key"), words("value").alias("val"))
    file = file.filter((F.size("key") > 1) & (F.size("key") == F.size("val")))
    return file if builtin is None else builtin.select("key", "val").unionByName(file.join(builtin.select("key"), "key", "left_anti").select("key", "val"))


def few_shot(spark: SparkSession, path: str, count: int = 16) -> DataFrame:
    """no_diacritics, with_diacritics: the first ``count`` of a file's list of pairs."""
    kind = "array<struct<no_diacritics:string, with_diacritics:string>>"
    try:
        raw = spark.read.option("wholetext", True).text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], "value string")
    return raw.select(F.explode(F.slice(F.from_json("value", kind), 1, count)).alias("p")).select("p.*")
