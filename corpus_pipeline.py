"""Training-data pipeline: quality, near-dedup, decontamination, secret redaction, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes and rereads as the next stage's docs.
Rows: the classifier drops those it rejects, near-dedup keeps one document of each group, decontamination drops documents that hold a
benchmark passage, the secret scan masks spans in ``text`` (and sets n_chars), the last stage returns token counts and digests.

In every stage rows are judged one by one or by groups of texts, whatever their source; columns beyond those of documents are
dropped, also where their names clash with an operator's; whole texts count, however long; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import bpe, decontaminate, minhash, quality, secrets
from corpuscle.llm.common import materialise

#: Least similarity, in percent, of near copies; op 7 alone has its own contract of 85.
NEAR_PERCENT = 80

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose tail probability of grade 2 reaches the threshold.

    Null text is empty text, which has only the constant part of the score; ties at the threshold and, without any
    usable label, all rows are kept; repeated rows are judged alike.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model).where("kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id.

    Null, empty and blank texts, and rows without doc_id, are in no group and kept. Rows of one doc_id are one document: if it is kept,
    all of them are (repeated rows stay repeated).
    """
    gone = minhash.near_dedup(docs, NEAR_PERCENT).where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that match no benchmark item; null and empty texts match nothing, repeated rows go or stay together."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked; n_chars is the length of what is left (null for null text); repeated rows are masked alike."""
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of each row; null text is empty text without tokens; repeated rows repeat."""
    return bpe.encode(docs, bpe.vocabulary_path())


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]

#: SQL can express neither the fitted classifier nor BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
