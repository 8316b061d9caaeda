"""Toxicity by a factorization machine over hashed terms.

Terms are folded words and their first 4 to 7 letters, each at three levels: present, twice or more, and twice or more with at least
one in RATE words; hashing gives each a number below SPACE. A bounded sample of labelled rows (SAMPLE, by hash order of the id) fits
the classifier: a first pass counts terms by label, the MODEL_TERMS that separate labels best stay, and the machine
w0 + sum w_i x_i + sum <v_i, v_j> x_i x_j learns weights and pairwise interactions of those by mini-batch gradient steps on the driver,
whose memory is bounded by SAMPLE and MODEL_TERMS. Scoring reads every whole text once.

Defined results: a null text counts as empty; an empty text scores as the intercept says; without labels of both kinds all scores are
the rate of label 1 (0 without labels); of several labels of an id the largest counts; repeated rows each get a score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, folded, tidy

SAMPLE = 12_000
SPACE, MODEL_TERMS, FACTORS = 1 << 20, 3072, 8
PREFIXES = (4, 5, 6, 7)
RATE, LEVELS = 150, 3
EPOCHS, BATCH, STEP, DECAY = 12, 256, 0.05, 2e-4
LEAST_STEPS = 300  # small samples get more epochs
THRESHOLD = 0.3


def bases(word: str) -> tuple[str, ...]:
    """The terms of a word: itself and its beginnings."""
    w = folded(word)
    return ("=" + w, *["^" + w[:k] for k in PREFIXES if len(w) >= k]) if w else ()


def numbered(base: str) -> int:
    """A term's number at its first level."""
    return xxhash.xxh32_intdigest(base) % (SPACE // LEVELS) * LEVELS


def levels(count: int, words: int) -> int:
    return 1 if count < 2 else 3 if count * RATE >= words else 2


def text_terms(text: str, of: Memo) -> np.ndarray:
    """Numbers of all terms of a text. of: token → the numbers of its bases (any subset)."""
    tokens = text.split()
    total: Counter = Counter()
    for token, c in Counter(tokens).items():
        for b in of[token]:
            total[b] += c
    n = len(tokens)
    return np.array([b + i for b, c in total.items() for i in range(levels(c, n))], np.int64)


def labelled(labels: DataFrame, key: str, label: str, train, rows: int) -> DataFrame:
    """At most `rows` ids with their label."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & train).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    return one.orderBy(F.xxhash64(key), key).limit(rows)


class Machine:
    """A fitted machine: term numbers, weights. Its size is fixed by MODEL_TERMS and FACTORS."""

    def __init__(self, terms: np.ndarray, rate: float):
        self.terms = terms
        self.w0 = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
        self.w = np.zeros(len(terms), np.float32)
        self.v = np.random.default_rng(7).normal(0, 0.02, (len(terms), FACTORS)).astype(np.float32)

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> Machine:
        """rows: places in self.terms. Adagrad on the logistic loss."""
        rng, m = np.random.default_rng(11), len(self.terms)
        gw, gv, g0 = np.full(m, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(rows) // BATCH)))
        for epoch in range(epochs):
            step = STEP if epoch < epochs * 2 // 3 else STEP / 4
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH]
                x = np.zeros((len(batch), m), np.float32)
                for i, r in enumerate(batch):
                    x[i, rows[r]] = 1
                s = x @ self.v
                z = self.w0 + x @ self.w + 0.5 * ((s * s).sum(1) - x @ (self.v * self.v).sum(1))
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]).astype(np.float32)
                seen = x.any(0)
                dw = e @ x / len(batch) + DECAY * self.w * seen
                dv = (x.T @ (e[:, None] * s) - (e @ x)[:, None] * self.v) / len(batch) + DECAY * self.v * seen[:, None]
                d0 = float(e.mean())
                gw += dw * dw
                gv += dv * dv
                g0 += d0 * d0
                self.w -= step * dw / np.sqrt(gw)
                self.v -= step * dv / np.sqrt(gv)
                self.w0 -= step * d0 / np.sqrt(g0)
        return self

    def score(self, rows: np.ndarray) -> float:
        v = self.v[rows]
        s = v.sum(0)
        z = self.w0 + float(self.w[rows].sum()) + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def learn(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train=None, rows: int = SAMPLE) -> Machine:
    """Fit on at most `rows` labelled rows for which `train` (a condition on the id) holds."""
    train = F.lit(True) if train is None else train
    sample = F.broadcast(labelled(labels, key, label, train, rows))  # `rows` narrow rows at most
    chosen = df.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(sample, key).select("t", "y")

    def count(batches):
        of = Memo(lambda w: tuple(map(numbered, bases(w))), 100_000)
        got = np.zeros((2, SPACE), np.int32)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got[int(y > 0), np.unique(text_terms(t, of))] += 1
                rows[int(y > 0)] += 1
        at = np.flatnonzero(got.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(got[0, at], rows[0]), pa.int64()), pa.array(np.append(got[1, at], rows[1]), pa.int64())], ["term", "n0", "n1"])

    counted = chosen.mapInArrow(tidy(count), "term int, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = counted.where("term < 0 or n0 + n1 >= 4").toPandas()  # SPACE rows at most
    total = counted[counted.term < 0]
    n0, n1 = (int(total.n0.sum()), int(total.n1.sum())) if len(total) else (0, 0)
    counted = counted[counted.term >= 0]
    if not n0 or not n1:
        return Machine(np.zeros(0, np.int64), n1 / max(1, n0 + n1))
    p = (counted.n0 + counted.n1) / (n0 + n1)
    z = (counted.n1 / n1 - counted.n0 / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-9)
    best = counted.assign(z=z.abs()).sort_values(["z", "term"], ascending=[False, True]).head(MODEL_TERMS)
    model = Machine(np.sort(best.term.to_numpy(np.int64)), n1 / (n0 + n1))
    terms = model.terms

    def places(batches):
        of = chosen_bases(terms)
        for batch in batches:
            at = [found(text_terms(t, of), terms).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.list_(pa.int32()))], ["y", "x"])

    got = chosen.mapInArrow(tidy(places), "y int, x array<int>").toPandas()  # `rows` rows of at most MODEL_TERMS places
    return model.fit([np.array(x, np.int64) for x in got.x], (got.y.to_numpy() > 0).astype(np.float32))


def chosen_bases(terms: np.ndarray) -> Memo:
    """Token → the numbers of those of its bases that the model uses at any level."""
    used = set((terms // LEVELS * LEVELS).tolist())
    return Memo(lambda w: tuple(b for b in map(numbered, bases(w)) if b in used))


def found(numbers: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Places of those numbers that are among the sorted terms."""
    if not len(numbers) or not len(terms):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, numbers), len(terms) - 1)
    return np.unique(at[terms[at] == numbers])


def score(df: DataFrame, model: Machine, text: str = "text", out: str = "score", below: float | None = None) -> DataFrame:
    """Add `out`, the probability of label 1; with `below`, keep only rows that score less and add nothing."""
    names = [c for c in df.columns if c != out] if below is None else df.columns
    inner = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"), *names)
    fields = inner.schema.fields[1:]
    schema = T.StructType(fields + ([T.StructField(out, T.DoubleType())] if below is None else []))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        of = chosen_bases(m.terms)
        for batch in batches:
            scores = np.array([m.score(found(text_terms(t, of), m.terms)) for t in batch.column(0).to_pylist()], np.float64)
            if below is None:
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], schema.names)
            else:
                yield pa.RecordBatch.from_arrays(batch.columns[1:], schema.names).filter(pa.array(scores < below))

    return inner.mapInArrow(tidy(run), schema)
