"""Language, toxicity, near duplicates, leaks, packing: documents to training sequences.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept.

Null and empty texts go in the first stage, for they are in no language.  Rows
without an id are judged like others, but none is a near duplicate.  Empty tables
give no sequences.  Further columns of documents are carried along whatever their
names; of the last stage's output they are no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulespark.llm import decontaminate, langid, ngram_join, packing, toxicity
from rulespark.llm.shared import free, written

#: A text whose best language has less than this share of its letters is in none.
LEAST_LANGUAGE = 0.3
MOST_TOXICITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters and texts in no learned language go."""
    lang, score = free("lang_pred", docs.columns), free("lang_score", docs.columns)
    out = langid.predict(docs, langid.train(docs), as_cols=(lang, score))
    return out.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE)).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic texts go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free("toxicity", docs.columns)
    return toxicity.predict(docs, model, as_col=score).where(F.col(score) < MOST_TOXICITY).select(*docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by links the one with the smallest id stays; rows without an id stay.

    Of rows with the same id and text the first in order of the other columns stays; rows with the same id but other texts are one document and stay together.
    """
    found = ngram_join.join(docs, 5, 80)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    place, others = free("place", docs.columns), [c for c in docs.columns if c not in ("doc_id", "text")]
    same = W.partitionBy("doc_id", F.xxhash64("text"), F.octet_length("text")).orderBy(*others or ["text"])
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn(place, F.row_number().over(same)).where(F.col(place) == 1)
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language), ("toxicity", clean), ("ngram_jaccard_join", unique), ("benchmark_decontamination", unleaked), ("packing", packed)]

#: Trained models and subword ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
