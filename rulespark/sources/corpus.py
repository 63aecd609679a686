"""Corpora, rule graphs, checkpoints and logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are read as text.
TEXT_EXTENSIONS = ("txt", "md", "markdown", "csv", "tsv", "json")


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS) -> DataFrame:
    """(path, size) of every file below root with one of the extensions; hidden and underscored folders are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    below = F.replace("path", F.lit(root.rstrip("/")), F.lit(""))
    return found.where(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$")).where(~below.rlike(r"/[._]"))


def texts(spark: SparkSession, root: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS) -> DataFrame:
    """(path, text, sha256)."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    below = F.replace("path", F.lit(root.rstrip("/")), F.lit(""))
    return raw.where(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$")).where(~below.rlike(r"/[._]")).withColumn("sha256", F.sha2("text", 256))


RULE = "rule_id string, rule_name string, rule_type string, description string, condition_logic string, recommended_hit_policy string, related_rules array<string>"


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of JSON graphs: a list, an object with business_rules, rules or compliance_rules, or a single rule."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("j"))
    listed = lambda key: F.from_json(F.get_json_object("j", f"$.{key}"), f"array<struct<{RULE.replace(' ', ':').replace(',:', ',')}>>")
    whole = F.from_json("j", f"array<struct<{RULE.replace(' ', ':').replace(',:', ',')}>>")
    single = F.array(F.from_json("j", RULE))
    many = F.when(F.ltrim("j").startswith("["), whole).otherwise(F.coalesce(listed("business_rules"), listed("rules"), listed("compliance_rules"), single))
    return raw.select("path", F.posexplode(many).alias("ord", "r")).select("path", "ord", "r.*").where("rule_id is not null")


def latest(spark: SparkSession, path: str, key: str = "key", order: str = "seq") -> DataFrame:
    """Append-only JSON lines: the last write of each key."""
    df = spark.read.json(path)
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")


def cost_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """[LLM_COST] log lines as columns; other lines are left out, broken ones are null."""
    kind = "model string, prompt_tokens long, completion_tokens long, total_tokens long, cached_tokens long, cost double"
    return lines.where(F.startswith(F.col(col), F.lit("[LLM_COST]"))).select(F.from_json(F.trim(F.substring(col, 11, 2147483647)), kind).alias("r")).select("r.*")
