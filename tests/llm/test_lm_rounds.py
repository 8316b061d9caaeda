"""The rounds of the language model's class weights: what they cost, and sums as by brute force."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from ledgerlark.llm import lm


def brute(model, f):
    """Class probabilities by the exponents of summed weights, a row for each token, in double precision."""
    z = sum(model.w.T.astype(float)[rows] for rows in f) + model.bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def small_model(scale):
    rng = np.random.default_rng(3)
    mass, kind = rng.integers(1, 100, lm.SLOTS).astype(float), np.arange(lm.SLOTS) % lm.CLASSES
    w = rng.normal(0, scale, (lm.CLASSES, lm.FEATURES * lm.BUCKETS)).astype(np.float32)
    return lm.Model(10, 5, lm.OWN, np.array([lm.END], np.uint64), np.array([0]), mass, kind, w)


def sorted_rows(n):
    rng = np.random.default_rng(4)
    f = rng.integers(0, lm.BUCKETS, (lm.FEATURES, n)) + lm.BUCKETS * np.arange(lm.FEATURES)[:, None]
    return f[:, np.argsort(f[0], kind="stable")]


def by_classes(model, f, n):
    """A round as it was before: for each class the weights of three features, an exponent, and three sums by feature row."""
    width = lm.FEATURES * lm.BUCKETS
    out = np.zeros((lm.CLASSES, width))
    for lo in range(0, len(n), lm.PART):
        part = f[:, lo : lo + lm.PART]
        z = np.empty((lm.CLASSES, part.shape[1]), np.float32)
        for c in range(lm.CLASSES):
            np.add(model.w[c][part[0]], model.w[c][part[1]], out=z[c])
            z[c] += model.w[c][part[2]]
            z[c] += np.float32(model.bias[c])
        z -= z.max(0)
        p = np.exp(z, out=z)
        p *= (n[lo : lo + lm.PART] / p.sum(0)).astype(np.float32)
        for k in range(lm.CLASSES):
            for rows in part:
                out[k] += np.bincount(rows, p[k], width)
    return out


def test_expectations():
    """Sums as by the older way, in well under its time."""
    model, f = small_model(0.5), sorted_rows(1 << 18)
    n = np.random.default_rng(5).integers(1, 9, f.shape[1]).astype(np.uint32)
    took = {by_classes: [], lm.expect: []}
    for _ in range(3):
        began = time.process_time()
        want = by_classes(model, f, n)
        took[by_classes].append(time.process_time() - began)
        began, got = time.process_time(), np.zeros_like(want)
        lm.expect(model, model.powers(), f, n, got)
        took[lm.expect].append(time.process_time() - began)
    assert np.allclose(got, want, rtol=1e-5, atol=1e-4) and np.isclose(got.sum(), lm.FEATURES * n.sum())
    assert min(took[lm.expect]) < 0.75 * min(took[by_classes])


def test_contradicting_weights():
    """Features whose products of powers vanish are still right."""
    model, f = small_model(60), sorted_rows(4000)
    log, y = brute(model, f), np.arange(4000) % lm.CLASSES
    p, total = model.odds(model.powers(), f)
    assert (total > 0).all() and np.allclose(p / total[:, None], np.exp(log), atol=1e-4)
    got = model.class_logs(model.powers(), f, y)
    assert np.isfinite(got).all() and np.allclose(got, log[np.arange(4000), y], rtol=1e-4, atol=1e-3) and got.min() < -200


def texts(spark):
    rng = random.Random(31)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, "the cat sat " * rng.randrange(4) + " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_rounds_read_histories(spark, monkeypatch):
    """One table of distinct histories whatever the number of rounds; merged or not, the sums are those of all tokens."""
    chunks = lm.chunked(texts(spark), F.col("doc_id") % 7 != 2, "text", ("doc_id",))
    made, make = [], lm.histories
    monkeypatch.setattr(lm, "histories", lambda *a: made.append(make(*a)) or made[-1])
    model, _ = lm.token_counts(chunks)
    lm.trained(chunks, model, 4)
    assert len(made) == 1
    one, two, y = [], [], []
    for row in chunks.select(*lm.PACKED).collect():
        chunk = lm.Chunk(row.asDict())
        on = chunk.on & ~chunk.held()
        for into, x in zip((one, two, y), (*chunk.histories(), model.kind[model.slots(chunk)][chunk.ids]), strict=True):
            into.append(x[on])
    f, y = model.features(np.concatenate(one), np.concatenate(two)), np.concatenate(y)
    rows = [(lm.unpacked_rows(r["rows"]), lm.unpack(r["n"], np.uint32)) for r in made[0].collect()]
    assert sum(int(n.sum()) for _, n in rows) == len(y) and sum(len(n) for _, n in rows) < len(y)
    for g, n in rows:
        assert len(np.unique(g, axis=1).T) == len(n) and (np.diff(g[0]) >= 0).all()
    shown, want = np.zeros((lm.CLASSES, lm.FEATURES * lm.BUCKETS)), np.zeros((lm.CLASSES, lm.FEATURES * lm.BUCKETS))
    p = np.exp(brute(model, f))
    for r in f:
        np.add.at(shown, (y, r), 1)
        np.add.at(want.T, r, p)
    assert np.array_equal(lm.summed(made[0], model, False)[0], shown)
    assert np.allclose(lm.summed(made[0], model, True)[0], want, rtol=1e-5, atol=1e-4)


def test_merged():
    keys = [np.array([5 << lm.NUMBER | 2, 1 << lm.NUMBER | 1], np.uint64), np.array([5 << lm.NUMBER | 7], np.uint64), np.zeros(0, np.uint64)]
    (got,) = lm.merged(keys)
    assert [(int(x) >> lm.NUMBER, int(x) & ((1 << lm.NUMBER) - 1)) for x in got] == [(1, 1), (5, 9)]
    assert len(lm.merged(keys[2:])[0]) == 0
