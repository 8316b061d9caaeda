"""Every stage of the corpus pipeline on odd rows and empty tables, and the whole on planted documents."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(rng, n, of=20_000):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Planted documents by ids: 0-19 toxic, 20-199 clean, 200-209 near copies of 20-29, 210-214 with an item, 300 and 301 odd."""
    rng, d = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    clean = [words(rng, 80) for _ in range(180)]
    items = [words(rng, 40) for _ in range(5)]
    texts = {i: words(rng, 60) + " insult group insult" for i in range(20)} | {20 + i: t for i, t in enumerate(clean)}
    texts |= {200 + i: clean[i].replace(clean[i].split()[9], "edited") for i in range(10)}
    texts |= {210 + i: f"{words(rng, 50)} {items[i]} {words(rng, 50)}" for i in range(5)}
    texts |= {300: None, 301: "write to someone@example.org"}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 20)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_whole(spark, folder):
    out = corpus_pipeline.run(spark, folder).toPandas().set_index("doc_id")
    assert sorted(out.index) == [*range(20, 200), 300, 301]
    ranks = __import__("ledgerlark.llm.bpe", fromlist=["x"]).load_ranks(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken"))
    back = {v: k for k, v in ranks.items()}
    assert b"".join(back[i] for i in out.ids[301]) == b"write to <EMAIL>" and out.n_tokens[300] == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, folder, odd, empty, name):
    """Odd rows (nulls, empty and very long texts, repeated rows) pass through; near_dedup keeps one of equal texts; empty tables stay
    empty; all but the last keep the columns, extra ones too."""
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = odd.withColumn("row", F.lit(1)).withColumn("id", F.lit("x")).withColumn("keep", F.lit(None).cast("int"))
    got = stage(spark, rows, folder)
    if name == "near_dedup":
        assert got.count() == rows.select(F.coalesce("text", F.lit(""))).distinct().count() and got.columns == rows.columns
    else:
        assert got.count() == rows.count()
    if name != "bpe":
        assert got.columns == rows.columns
    bare = empty.select(*COLUMNS)
    none = stage(spark, bare, folder)
    assert none.count() == 0 and (name == "bpe" or none.columns == COLUMNS)


def test_empty_side_tables(spark, folder, odd, tmp_path):
    """Without labels nothing is toxic, without items nothing leaks."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, odd, str(tmp_path)).count() == odd.count() and stages["decontamination"](spark, odd, str(tmp_path)).count() == odd.count()
