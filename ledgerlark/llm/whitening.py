"""Whitening of embeddings by TSQR.

Entries become whole numbers, so counts and sums are exact whatever the partitioning. Rows are centred by the exact sums (n*x - S in whole
numbers, then one division), each partition reduces its rows to an upper triangle by QR, a block at a time, and triangles merge by
QR in a tree. The right singular vectors of the last triangle are the components, its singular values their deviations; no covariance is
formed. The whitened rows are checked the same way: a triangle of (1, rows) holds their means and, below, their centred scatter.

Scale: all rows are read five times and never shuffled; what is shuffled are triangles, one a partition (dimensions squared, 32 kB at 64),
FAN to a task in each level of the tree. The driver holds one triangle and one row of sums, bounded by the dimensions alone.

Defined results: null vectors and those with null or non-finite entries are left out, empty ones and such as have entries of 2^43 or more
too. The dimensions are those of most vectors (of equals the larger); vectors of other lengths have no place in that space and are left
out. Repeated rows count each. Components whose eigenvalue is zero to double precision can't be whitened and have no rows, so one row or
equal rows alone give none; an empty table gives an empty result; a null id stays null; other columns, whatever their names, take no part; a
result that has the key's name gets an underscore behind it.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, tidy, written

SCALE, SHIFT = 64, 1_000_000
MOST = 32  # components returned
BLOCK = 4096  # rows of a QR
FAN = 16  # triangles that merge in one task
LARGE = 1 << 43  # the sum of a block of smaller entries is an exact long
TINY = 16 * np.finfo(float).eps  # of the largest singular value and the dimensions: what counts as zero


def vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """__key and __v: the vectors that are whole."""
    rows = df.select(F.col(key).alias("__key"), F.col(vector).alias("__v"))
    fit = F.forall("__v", lambda c: F.coalesce(F.abs(c) < LARGE, F.lit(False)))  # NaN is above all numbers
    return rows.where((F.size("__v") > 0) & fit)


def dimensions(rows: DataFrame) -> int | None:
    """The length of most vectors, of equals the larger."""
    top = rows.groupBy(F.size("__v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return None if top is None else top.d


def blocks(batch: pa.RecordBatch, d: int):
    """The vectors of a batch as whole numbers, BLOCK rows at a time, each block after its first row's number."""
    for at in range(0, batch.num_rows, BLOCK):
        flat = batch.column("__v").slice(at, BLOCK).flatten().to_numpy(zero_copy_only=False)
        yield at, np.floor(flat.astype(float).reshape(-1, d) * SCALE).astype(np.int64) + SHIFT


@dataclass
class Centre:
    """Number of vectors and their sums by dimension, exact."""

    n: int
    sums: list[int]

    @classmethod
    def of(cls, rows: DataFrame, d: int) -> Centre:
        def run(batches):
            n, sums = 0, np.zeros(d, object)
            for batch in batches:
                for _, x in blocks(batch, d):
                    n += len(x)
                    sums += x.sum(0).astype(object)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(str, sums), pa.string())], ["dim", "n", "s"])

        parts = rows.select("__v").mapInArrow(tidy(run), "dim int, n long, s string")
        total = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        found = {r.dim: r for r in total.collect()}  # as many rows as dimensions
        return cls(found[0].n, [int(found[k].s) for k in range(d)])

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n*x - S: longs where they fit, else whole numbers of any size."""
        s = np.array(self.sums, object)
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        return self.n * x - s.astype(np.int64) if most < 1 << 62 else self.n * x.astype(object) - s

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x).astype(float) / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        a = self.apart(x)
        fits = a.dtype != object and int(np.abs(a).max(initial=0)) ** 2 * a.shape[1] < 1 << 62
        return [int(v) for v in ((a if fits else a.astype(object)) ** 2).sum(1)]


TRIANGLE = "part long, height int, r array<double>"


def triangle(above: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The R of the rows below an R so far."""
    return np.linalg.qr(rows if above is None else np.vstack([above, rows]), mode="r")


def as_row(part: int, r: np.ndarray) -> pa.RecordBatch:
    values = pa.ListArray.from_arrays(pa.array([0, r.size], pa.int32()), pa.array(r.ravel()))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.shape[0]], pa.int32()), values], ["part", "height", "r"])


def tsqr(rows: DataFrame, prepare, name: str) -> np.ndarray | None:
    """The R of all rows, of which prepare(batch) makes blocks of doubles; None without rows."""

    def leaf(batches):
        r = None
        for batch in batches:
            for block in prepare(batch):
                r = triangle(r, block)
        if r is not None:
            yield as_row(0, r)

    def merge(batches):
        now, r = None, None
        for batch in batches:
            for group, height, flat in zip(*[batch.column(c) for c in ("group", "height", "r")], strict=True):
                group, more = group.as_py(), flat.values.to_numpy().reshape(height.as_py(), -1)
                if now is not None and group != now:
                    yield as_row(now, r)
                    r = None
                now, r = group, triangle(r, more)
        if now is not None:
            yield as_row(now, r)

    tree = written(rows.mapInArrow(tidy(leaf), TRIANGLE).withColumn("part", F.spark_partition_id().cast("long")), name)
    most = tree.agg(F.max("part")).first()[0]
    while most:
        groups = tree.withColumn("group", F.floor(F.col("part") / FAN)).repartition("group").sortWithinPartitions("group", "part")
        tree, most = written(groups.mapInArrow(tidy(merge), TRIANGLE), name), most // FAN
    last = tree.first()  # one row: dimensions squared
    return None if last is None else np.array(last.r).reshape(last.height, -1)


@dataclass
class Whitener:
    """A fitted basis. components: one a row, by falling eigenvalue; those with eigenvalue zero are not among them."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @classmethod
    def fit(cls, rows: DataFrame, d: int, most: int = MOST) -> Whitener:
        """rows: as vectors() gives them, all of length d, at least one."""
        centre, rows = Centre.of(rows, d), rows.select("__v")
        r = tsqr(rows, lambda batch: (centre.centred(x) for _, x in blocks(batch, d)), "triangles")
        _, s, right = np.linalg.svd(r)
        k = min(most, int((s > s[0] * d * TINY).sum()))
        out = cls(centre, right[:k], s[:k] ** 2 / centre.n, float((s**2).sum() / centre.n))
        if k:
            z = tsqr(rows, lambda batch: (np.column_stack([np.ones(len(x)), out.whiten(x)]) for _, x in blocks(batch, d)), "checks")[1:, 1:]
            out.identity_error = float(np.abs(z.T @ z / centre.n - np.eye(k)).max())
        return out

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)


def transform(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """A row for each whole vector and component: key, component (from 1), n, deviation (sum over dimensions of (n*x - S)^2, exact; null
    past 38 digits), whitened, explained, identity_error."""
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = vectors(df, key, vector)
    schema = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    d = dimensions(rows)
    if d is None:
        return rows.select("__key", *[F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in schema.split(", ")]).toDF(key, *free(names, [key]))
    rows = rows.where(F.size("__v") == d)
    basis = Whitener.fit(rows, d, most)
    k, explained = len(basis.components), basis.eigenvalues / (basis.trace or 1)

    def run(batches):
        for batch in batches:
            for at, x in blocks(batch, d):
                z, m = basis.whiten(x), len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                far = pa.array([Decimal(v) if v < 10**38 else None for v in basis.centre.deviation(x)], pa.decimal128(38, 0))
                columns = [batch.column("__key").slice(at, m).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, basis.centre.n)), far.take(each)]
                columns += [pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, basis.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, ["__key", *names])

    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"__key {kind}, {schema}").toDF(key, *free(names, [key]))
