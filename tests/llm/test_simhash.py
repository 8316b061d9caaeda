"""SimHash: fingerprints and components against brute force, with plain and with deep search."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlark.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    return {f: top(f) for f in fps}


def expected(rows):
    fps = {r: plain_fingerprint(r[1]) for r in set(rows)}
    root = components(set(fps.values()))
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return sorted((str(r[0]), f"{fps[r]:016x}", least.get(root[fps[r]])) for r in rows)


def corpus(n=400):
    draw = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(n):
        if rows and draw.random() < 0.7:
            text = rows[draw.randrange(len(rows))][1].split(" ")
            for _ in range(draw.choice((0, 1, 1, 2, 5))):
                text[draw.randrange(len(text))] = draw.choice(words)
            text = " ".join(text)
        else:
            text = " ".join(draw.choice(words) for _ in range(draw.choice((1, 2, 3, 5, 150, 400))))
        rows.append((i * 3, text.upper() if draw.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("limit", [simhash.LIMIT, 1, 0])
def test_corpus(spark, limit):
    rows = corpus()
    out = simhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit)
    got = sorted((str(r.doc_id), r.f, r.class_id) for r in out.withColumn("f", simhash.digits(F.col("fp"))).collect())
    assert got == expected(rows)
    assert len({g[2] for g in got}) < len({g[1] for g in got})  # some fingerprints that differ are linked


@pytest.mark.parametrize("limit", [simhash.LIMIT, 8, 0])
def test_all_links(spark, limit):
    draw = random.Random(3)
    fps = {0, (1 << 64) - 1, 1 << 63, 1 << 63 | 1 << 31, 3 << 30}
    for seed in [draw.getrandbits(64) for _ in range(40)]:
        near = [seed]
        for _ in range(12):
            near.append(draw.choice(near) ^ 1 << draw.randrange(64) ^ draw.choice((0, 1 << draw.randrange(64))))
        fps.update(near)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), limit).collect()
    want = {frozenset((signed(a), signed(b))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert {frozenset(r) for r in found} == want


def test_odd(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    df = odd.withColumns({"fp": F.lit(1), "hi": F.lit(2), "__row": F.lit(3)})
    got = sorted((str(r.doc_id), r.f, r.class_id) for r in simhash.classes(df).withColumn("f", simhash.digits(F.col("fp"))).collect())
    assert got == expected(rows)
    assert simhash.classes(empty).collect() == []
    clash = df.withColumnRenamed("doc_id", "class_id")
    assert simhash.classes(clash, key="class_id").columns == ["class_id", "fp", "class_id_", "n_copies"]
