"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's three-word shingles. Two fingerprints that differ in at most two of
64 bits differ in at most one of their upper half, or not at all in their lower half. So the upper halves are a table that is searched
with the Hamming ball of radius 1 around each half (set bits only: the other of a pair has the bit), the lower halves one that is searched
with the half itself, and each match's complete distance is verified. Components of the links are found by star contractions on tables.

Scale: equal fingerprints collapse first, with partial aggregation, so copies never meet in a table. Buckets of over LIMIT fingerprints
would pair all with all; a fingerprint in one is searched exactly instead: the whole ball of 2080 neighbours within two bits, by equality
of complete fingerprints, so that no match is false and a key has one row. Nothing is collected but two numbers a contraction round.

Defined results: a null text counts as empty; texts without words have fingerprint zero, which links like any other; a text of one or two
words is one shingle; repeated rows share fingerprint and component; a component is named by its smallest id, null ids last; an
empty table gives an empty result; other columns, whatever their names, take no part; a result
that has the key's name gets an underscore behind it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, spread, tidy, written
from .neardup import components

SHINGLE, SEED, BITS = 3, 42, 2
LIMIT = 4096
BLOCK = 1 << 16  # shingles at a time


def fingerprint(text: str | None) -> int:
    """64 bits: those that over half of the shingles' hashes have set."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z, and the six ASCII white spaces
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(SHINGLE, len(words))
    joined, n = b" ".join(words), len(words) - k + 1
    begin, end = (ends - size)[:n].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        some = list(zip(begin[at : at + BLOCK], end[at : at + BLOCK], strict=True))
        h = np.fromiter((xxhash.xxh64_intdigest(joined[b:e], SEED) for b, e in some), np.uint64, len(some))
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """__key, __row (a number for each row) and fp, the fingerprint as a signed long."""
    inner = df.select(F.col(text).cast("string").alias("__text"), F.col(key).alias("__key"), F.monotonically_increasing_id().alias("__row"))
    schema = T.StructType([*inner.schema.fields[1:], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(0)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], schema.names)

    return inner.mapInArrow(tidy(run), schema)


def upper(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def lower(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit((1 << 32) - 1))


def bit(k) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """fps: fp, each once. All pairs (u, v) within BITS bits, some of them twice or both ways round."""
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS
    rows = fps.select("fp", upper(F.col("fp")).alias("hi"), lower(F.col("fp")).alias("lo"))
    for half in ("hi", "lo"):
        size = written(rows.groupBy(half).agg(F.count(F.lit(1)).alias(f"n_{half}")), "buckets")
        rows = spread(rows, size, half, f"n_{half}", "fp")
    rows = written(rows, "halves")

    few = rows.where(F.col("n_hi") <= limit)
    ball = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.col("hi").bitwiseOR(bit(k)))
    probes = few.select(F.col("fp").alias("u"), F.explode(F.concat(F.array("hi"), F.filter(ball, lambda x: x != F.col("hi")))).alias("key"))
    once = (upper(F.col("u")) != F.col("key")) | (F.col("u") < F.col("v"))
    one = probes.join(few.select(F.col("hi").alias("key"), F.col("fp").alias("v")), "key").where(near & once).select("u", "v")

    few = rows.where(F.col("n_lo") <= limit)
    side = lambda name: few.select(F.col("lo").alias("key"), F.col("fp").alias(name))
    two = side("u").join(side("v"), "key").where(near & (F.col("u") < F.col("v"))).select("u", "v")

    up_to = F.sequence(F.lit(0), F.lit(63))
    whole = F.flatten(F.transform(up_to, lambda i: F.transform(F.sequence(i, F.lit(63)), lambda j: bit(i).bitwiseOR(bit(j)))))
    many = rows.where((F.col("n_hi") > limit) | (F.col("n_lo") > limit)).select(F.col("fp").alias("u"), F.explode(whole).alias("mask"))
    three = many.select("u", F.col("u").bitwiseXOR(F.col("mask")).alias("v")).join(rows.select(F.col("fp").alias("v")), "v", "left_semi").select("u", "v")
    return one.unionByName(two).unionByName(three)


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: key, fp (long), class_id (the smallest key of the component) and n_copies (rows with that fingerprint)."""
    rows = written(fingerprints(df, key, text), "fingerprints")
    first = F.min(F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key")))
    fps = written(rows.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n_copies")), "distinct")
    root = components(links(fps, limit))
    root = root.union(root.select("root", "root").distinct())  # fingerprints without a link take no further part
    linked = fps.select(F.col("fp").alias("id"), "first").join(root, "id")
    best = written(linked.groupBy("root").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("c")), "components")
    best = spread(linked.select("id", "root"), best, "root", "c", "id").select(F.col("id").alias("fp"), "best")
    named = written(fps.join(best, "fp", "left").select("fp", "n_copies", F.coalesce("best", "first").alias("best")), "named")
    out = spread(rows, named, "fp", "n_copies", "__row")
    return out.select("__key", "fp", "best.key", "n_copies").toDF(key, *free(("fp", "class_id", "n_copies"), [key]))


def digits(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
