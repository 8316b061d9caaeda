"""From raw documents to encoded training documents, in stages. Each stage is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import bpe, decontam, neardup, pii, toxicity
from ledgerlark.llm.common import clear, mark, scratch_path, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model learns from the labels of the documents at hand. Without labels of both kinds
    nothing is learnt and all stay; a null text counts as empty; repeated rows share their fate; an empty table stays empty; other columns pass."""
    small_batches(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, below=toxicity.THRESHOLD) if len(model.terms) else docs


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id (null ids last). A null text counts as empty, and one
    of the empty ones stays; of rows equal in id and text one stays; an empty table stays empty; other columns pass."""
    small_batches(spark)
    return neardup.distinct(docs).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; without items all stay; rows equal in id and text share
    their fate; an empty table stays empty; other columns pass."""
    small_batches(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become the name of their kind in angle brackets; n_chars follows the text, where there is such a column. A null text
    stays null; every row stays; an empty table stays empty; other columns pass."""
    masked = pii.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast("long"))
    return masked.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and digests that show that they decode to it. A null text counts as empty and has no ids; every row stays; an
    empty table stays empty; of other columns lang and source pass."""
    import public_tokenizers as P

    small_batches(spark)
    return bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=["doc_id", "lang", "source"], outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: Factorization machines, sketches with alignment and merge queues have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. Scratch tables go once the stage that made them is written; the last stage's own table stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        clear(spark, (path,), before)
        docs = spark.read.parquet(path)
    return docs
