"""The operators applied to their whole tables with production parameters, one query each. Digest columns are derived here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fim, langid, lm, neardup, pii, quality, secrets, sharding, simhash, toxicity, whitening
from .common import crc_of_id, documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_digest(spans: Column, kinds) -> Column:
    return F.sha2(secrets.label(F.filter(spans, lambda s: s["kind"].isin(*kinds))), 256)


def op1_secrets(spark, sf_dir):
    s = F.col("spans")
    live = F.size(F.filter(s, lambda x: x["verdict"] == "live")).cast("long")
    out = secrets.scan(documents(spark, sf_dir))
    return out.select("doc_id", *[n_of(s, k).alias(f"n_{k}") for k in secrets.BASE], base_digest(s, secrets.BASE).alias("base_sha256"), secrets.label(s).alias("spans"), live.alias("n_live"), (F.size(s) - live).cast("long").alias("n_copied"), secrets.verdicts(s).alias("verdicts"))


def op2_sharding(spark, sf_dir):
    out = sharding.assign(documents(spark, sf_dir), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op3_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), train=crc_of_id() % 4 != 2)
    out = toxicity.score(docs.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_lm(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = crc_of_id() % 7 == 2
    out, model = lm.score(docs.select("doc_id", held.alias("held_out"), "text"), ~F.col("held_out"), keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_decontam(spark, sf_dir):
    return decontam.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_neardup(spark, sf_dir):
    return neardup.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_copies", "keeper")


def op7_quality(spark, sf_dir):
    out = quality.cascade(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_pii(spark, sf_dir):
    s = F.col("pii")
    out = pii.detect(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii")
    scores = F.array_join(F.transform(s, lambda x: F.format_number(x["score"], 1)), ",")
    return out.select("doc_id", *[n_of(s, k).alias(f"n_{k}") for k in pii.BASE], base_digest(s, pii.BASE).alias("base_sha256"), secrets.label(s).alias("spans"), scores.alias("scores"))


def op9_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "pages"), documents(spark, sf_dir))


def op10_bpe(spark, sf_dir):
    import public_tokenizers as P

    return bpe.encode(documents(spark, sf_dir), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op11_whitening(spark, sf_dir):
    out = whitening.transform(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_fim(spark, sf_dir):
    out = fim.transform(documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op13_simhash(spark, sf_dir):
    return simhash.classes(documents(spark, sf_dir)).select("doc_id", simhash.digits(F.col("fp")).alias("fingerprint"), F.col("class_id").alias("component_id"), "n_copies")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_sharding, op3_toxicity, op4_lm, op5_decontam, op6_neardup, op7_quality, op8_pii, op9_langid, op10_bpe, op11_whitening, op12_fim, op13_simhash, pipeline)}
