"""What redact leaves, and slot maps of any length."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import langid, lm, pii, quality, secrets, sharding


def texts(n=300):
    rng = random.Random(4)
    bits = ["ssn ", "123-45-6789", "4111 1111 1111 1111", "4111111111111111", " ", " ", "+33 1 23 45 67 89", "+", "(", ")", "10.0.0.1", "a.b@c.de", "GB82 WEST 1234 5698 7654 32", "12", "9", "-", ".", "é😀", "social ", "\n", "x"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_redact_leaves_nothing(spark, odd, empty):
    planted = ["ssn 123-45-6780 and 123-45-6789", "ssn 123-45-6789 4111111111111111", "+33 123456789(4111111111111111", "ssn 123-45-6789 +33 123456789(4111111111111111"]
    df = spark.createDataFrame(list(enumerate(planted + texts())), "doc_id long, text string").withColumn("__t", F.lit("stays")).withColumn("__email", F.lit(1))
    out = pii.redact(df)
    assert out.columns == df.columns
    left = pii.detect(out).where(F.size("pii") > 0).select("text").collect()
    assert left == []
    got = {r.doc_id: r.text for r in out.where(F.col("doc_id") < len(planted)).collect()}
    assert got == {0: "ssn <NATIONAL_ID> and <NATIONAL_ID>", 1: "ssn <NATIONAL_ID> <CARD>", 2: "<PHONE>(<CARD>", 3: "ssn <NATIONAL_ID> <PHONE>(<CARD>"}
    clean = pii.detect(df).where(F.size("pii") == 0).select("doc_id", "text")
    assert clean.exceptAll(out.select("doc_id", "text")).count() == 0  # texts without spans stay as they are
    assert pii.redact(odd).count() == odd.count() and pii.redact(empty).count() == 0
    assert {r[0] for r in out.select("__t").distinct().collect()} == {"stays"}


def test_any_stored_map(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(1000)], "size long, shard string")  # a key and a text with names of results
    path = str(tmp_path / "map")
    first = sharding.assign(df, 4, "size", "shard", slots=256, map_path=path)
    assert first.columns == ["size", "size_", "text_crc32", "virtual_slot", "shard", "slot"]
    again = sharding.assign(df, 9, "size", "shard", slots=8192, map_path=path)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) and again.count() == 1000
    for missing in (str(tmp_path / "none"), path):
        with pytest.raises(ValueError):
            sharding.assign(df, 4, "size", "shard", map_path=missing, version=7)


def test_lm_stops_where_held_texts_tell(spark):
    """More rounds are never worse for the texts that tell when to stop; copies of a text are on one side."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(50)]
    texts = ["the cat sat on the mat " * rng.randrange(1, 4) + " ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame([(i, texts[i % 200]) for i in range(400)], "doc_id long, text string")
    chunks = lm.chunked(df, F.lit(True), "text", ("doc_id",))
    like = []
    for rounds in (0, 1, 3, 8):
        model, _ = lm.token_counts(chunks)
        like.append(lm.summed(chunks, lm.trained(chunks, model, rounds), True)[1])
    assert like == sorted(like) and like[0] < like[-1] < 0
    held = {}
    for row in chunks.select("rows", *lm.PACKED).collect():
        chunk = lm.Chunk(row.asDict())
        for r, h in zip(row.rows, chunk.held()[chunk.first], strict=True):
            held.setdefault(texts[r.doc_id % 200], set()).add(bool(h))
    assert all(len(v) == 1 for v in held.values()) and {True, False} == set().union(*held.values())


def test_keys_with_names_of_results(spark):
    rows = spark.createDataFrame([(i, "token=abcdef1 and more words here " * 3, "en", "src") for i in range(5)], "owner long, text string, lang string, source string")
    for key in ("owner", "t", "row", "spans", "repo"):
        got = secrets.scan(rows.withColumnRenamed("owner", key), key=key, repo=key)
        assert got.columns == [key, "spans_" if key == "spans" else "spans"] and got.count() == 5
    got = quality.cascade(rows.withColumnsRenamed({"owner": "kept", "source": "n_words"}), keep=("kept", "n_words"), order=[r.name for r in quality.RULES])
    assert got.columns == ["kept", "n_words", "n_words_", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_", "failed_rule"] and sorted(r.kept for r in got.collect()) == [0, 1, 2, 3, 4]
    pages = spark.createDataFrame([(i, "http://a.example.org/x", "<html lang=en>more words here") for i in range(5)], "host long, url string, html string")
    for labelled in (rows, rows.limit(0)):
        got = langid.identify(pages, labelled, key="host")
        assert got.columns == ["host", "host_", "declared", "text_lang", "lang", "prob"] and sorted(r.host for r in got.collect()) == [0, 1, 2, 3, 4]
