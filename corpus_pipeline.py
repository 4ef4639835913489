"""Corpus pipeline: toxic documents go, one of each group of near duplicates stays, personal data is masked, sources are mixed to target
weights, texts become tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; it is written as Parquet and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``. Null, empty and very long texts, repeated rows and empty tables are treated as the
operators' docstrings say; columns besides doc_id, text, source and n_chars are carried along unchanged.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewatch.llm.bpe import encode_documents
from tidewatch.llm.columns import free
from tidewatch.llm.jaccard import row_key, similar_rows
from tidewatch.llm.memory import small_batches
from tidewatch.llm.mixture import take_copies
from tidewatch.llm.pii import redact
from tidewatch.llm.toxicity import fit_toxicity, score_toxicity
from tidewatch.session import broadcast_if_small, run_dir

#: The whole of it cannot be said in SQL: it fits a model, and the last stage is compared with a tokenizer library in the tests.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5; the model is fitted on the texts of ``docs`` that the labels cover."""
    small_batches(spark)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, = free(docs, "toxicity_score")
    return score_toxicity(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles with a Jaccard coefficient of 0.8 or more the row with the smallest doc_id. Rows without words, or
    without doc_id, are in no group and stay; rows with equal doc_id and text stay once. Rows that share a doc_id but not their text are taken
    each for itself, so no text goes without another of its group that stays."""
    small_batches(spark)
    folder = run_dir(spark, "near-duplicates")
    similar_rows(docs, width=5, percent=80).where("row != first").select("row").distinct().write.parquet(f"{folder}/dropped")
    row, turn = free(docs, "row", "turn")
    keyed = docs.withColumn(row, row_key())
    keyed.where(F.col(row).isNotNull()).groupBy(row).count().where("count > 1").select(row).write.parquet(f"{folder}/repeated")
    dropped = broadcast_if_small(spark.read.parquet(f"{folder}/dropped").withColumnRenamed("row", row))
    repeated = broadcast_if_small(spark.read.parquet(f"{folder}/repeated"))
    kept = keyed.join(dropped, row, "left_anti")
    once = kept.join(repeated, row, "left_anti")
    first = F.row_number().over(Window.partitionBy(row).orderBy(*[c for c in docs.columns if docs.schema[c].dataType.typeName() != "map"]))
    again = kept.join(repeated, row, "left_semi").withColumn(turn, first).where(F.col(turn) == 1)
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the personal data in their texts masked and n_chars counted anew."""
    masked = redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them."""
    return take_copies(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of each document. Workers hold less than by default, as executors still have the memory of the stages before."""
    import public_tokenizers

    small_batches(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, group=1_000_000, kept=250_000, tokens=250_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixture", mix),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
