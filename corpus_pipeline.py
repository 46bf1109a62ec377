"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
back as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonlake.llm.bpe import bpe_decode, bpe_encode, digest
from reasonlake.llm.common import bounded_batches, read, stage_table
from reasonlake.llm.decontaminate import drop_contaminated
from reasonlake.llm.line_dedup import dedup_lines
from reasonlake.llm.near_dedup import keep_one
from reasonlake.llm.toxicity import model_for, score_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model learned from their own labels."""
    bounded_batches(spark)
    model = model_for(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return score_texts(docs, model).where("score < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten or more sources share but where they come first."""
    return dedup_lines(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (word 5-shingles, similarity 0.8 or more) the document with the smallest id."""
    bounded_batches(spark)
    return keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with fewer than a twentieth of their words in 13-word windows of the benchmark."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and digests of them and of their decoding."""
    bounded_batches(spark)
    return digest(bpe_decode(bpe_encode(docs.select("doc_id", "text")).select("doc_id", "token_ids", "n_tokens")))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: The toxicity model and the near-copy classes have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
