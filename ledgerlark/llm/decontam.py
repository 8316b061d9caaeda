"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are put into size classes by their number of distinct 5-word shingles (class bounds grow by the square root of 2). For each
class a document is cut into windows of one and a half times the bound, half a bound apart, so that a passage of the class's size lies
whole in one of them and the Jaccard similarity of the two stays at 0.3 or more however long the document is. HASHES minima per window
are looked up among the items' minima of that class; equal ones make a candidate. A candidate's containment is then counted exactly:
the share of the item's distinct shingles that the whole document has; 0.8 or more is a leak.

Scale: documents are read once and never shuffled as text. What is broadcast are two Bloom filters of BITS bits, whatever the number
of items. Only documents with a hit leave the scan, with their hit keys and those of their shingles that the items' filter admits (a
superset of all that counts); candidates meet items by an equi-join on the key.

Defined results: null or empty texts match nothing; items of fewer than five words are one shingle of all their words and are sought
as a window of as many words; repeated items and documents each give their own pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, maybe, mix, shingles, tidy, token_hash, word_hashes, written

SHINGLE, LEAST = 5, 0.8
HASHES, BITS, PROBES = 32, 1 << 22, 3
ODD = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def bound(n: int) -> int:
    """The size class of n shingles: the least even bound that holds them."""
    b = 2.0
    while 2 * round(b / 2) < n:
        b *= 2**0.5
    return 2 * round(b / 2)


def keyed(least: np.ndarray, j: int, k: int, b: int) -> np.ndarray:
    """Bucket keys of minima under hash function j, apart for each word count and size class."""
    return mix(least ^ mix(np.array([j + 1000 * k + 1_000_000 * b], np.uint64)))


def read_items(items: DataFrame, item: str, text: str) -> DataFrame:
    """item id, word count of its shingles, size class, distinct shingles, bucket keys; items without words are left out."""
    inner = items.select(F.col(item).alias("__item"), F.monotonically_increasing_id().alias("at"), F.col(text).cast("string").alias("__text"))
    schema = T.StructType(inner.schema.fields[:2] + T._parse_datatype_string("k int, b int, n int, want array<long>, keys array<long>").fields)

    def run(batches):
        memo = Memo(token_hash)
        for batch in batches:
            ids, out = [], []
            for i, raw in enumerate(batch.column(2).to_pylist()):
                h = word_hashes(raw or "", memo)
                if len(h):
                    k = min(SHINGLE, len(h))
                    s = np.unique(shingles(h, k))
                    b = bound(len(s))
                    keys = np.concatenate([keyed((s * ODD[j]).min(keepdims=True), j, k, b) for j in range(HASHES)])
                    ids.append(i)
                    out.append((k, b, len(s), s.view(np.int64).tolist(), keys.view(np.int64).tolist()))
            left = batch.take(pa.array(ids, pa.int64()))
            columns = [pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([left.column(0), left.column(1), *columns], schema.names)

    return inner.mapInArrow(tidy(run), schema)


def places(x: np.ndarray) -> list[np.ndarray]:
    """PROBES bits of a 64-bit value."""
    out = []
    for _ in range(PROBES):
        x = mix(x + np.uint64(0x9E3779B97F4A7C15))
        out.append((x & np.uint64(BITS - 1)).astype(np.int64))
    return out


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of BITS bits over the values of an array column. Bits are found on the executors; at most BITS numbers come to
    the driver."""

    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(places(x))).astype(np.int32))], ["x"])

    at = df.select(column).mapInArrow(tidy(run), "x int").distinct().toPandas()["x"].to_numpy(np.int64)
    bits = np.zeros(BITS // 8, np.uint8)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def has(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which values the filter admits; later bits are looked up only for those that the earlier ones admit."""
    left = np.arange(len(x))
    y = x
    for _ in range(PROBES):
        y = mix(y + np.uint64(0x9E3779B97F4A7C15))
        at = y & np.uint64(BITS - 1)
        ok = bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0
        left, y = left[ok], y[ok]
    out = np.zeros(len(x), bool)
    out[left] = True
    return out


def window_keys(s: np.ndarray, length: np.ndarray, k: int, bounds: list[int], hits: np.ndarray):
    """s: shingles of many texts end to end, `length` of each. Yields (text numbers, keys) of the windows whose key `hits` admits."""
    docs = np.flatnonzero(length)
    if not len(docs):
        return
    ends = np.cumsum(length)[docs]
    begins = ends - length[docs]
    cuts = []
    for b in bounds:
        half = b // 2
        blocks = -(-length[docs] // half)
        doc = np.repeat(np.arange(len(docs)), blocks)
        first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
        at = begins[doc] + (np.arange(len(doc)) - first[doc]) * half
        one = np.append(doc[1:] == doc[:-1], False)
        two = np.append(doc[2:] == doc[:-2], [False] * min(2, len(doc)))
        cuts.append((b, doc, at, one, two))
    for j in range(HASHES):
        v = s * ODD[j]
        for b, doc, at, one, two in cuts:
            m = np.minimum.reduceat(v, at)
            w = m.copy()
            w[one] = np.minimum(w[one], m[1:][one[:-1]])
            w[two] = np.minimum(w[two], m[2:][two[:-2]])
            key = keyed(w, j, k, b)
            ok = has(hits, key)
            if ok.any():
                yield docs[doc[ok]], key[ok]


def known_only(each: list[np.ndarray], wanted: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per text: its shingles, none if the items' filter admits none of them, and those that it admits. A minimum that equals an
    item's is a shingle of that item, so a text without any has no candidate, and its windows need no minima."""
    ends = np.cumsum([len(x) for x in each])
    s = np.concatenate(each)
    ok = has(wanted, s)
    known = np.split(s[ok], np.searchsorted(np.flatnonzero(ok), ends[:-1]))
    return [x if len(y) else x[:0] for x, y in zip(each, known, strict=True)], known


def read_documents(df: DataFrame, key: str, text: str, shapes: dict[int, list[int]], wanted, hits) -> DataFrame:
    """Documents with a hit: id, row number, hit keys, shingles that the items' filter admits."""
    inner = df.select(F.col(key).alias("__key"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("__text"))
    schema = T.StructType(inner.schema.fields[:2] + T._parse_datatype_string("keys array<long>, have array<long>").fields)

    def run(batches):
        memo = Memo(token_hash)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                words = [word_hashes(t or "", memo) for t in part.column(2).to_pylist()]
                found: dict[int, set] = {}
                have: dict[int, list] = {}
                for k, bounds in shapes.items():
                    each = [shingles(w, k) if len(w) >= k else w[:0] for w in words]
                    each, known = known_only(each, wanted.value)
                    length = np.array([len(x) for x in each], np.int64)
                    here = set()
                    for docs, keys in window_keys(np.concatenate(each), length, k, bounds, hits.value):
                        for d, x in zip(docs.tolist(), keys.view(np.int64).tolist(), strict=True):
                            found.setdefault(d, set()).add(x)
                            here.add(d)
                    # shingles of another word count never equal an item's of this one, so they are only of use where k itself has a hit
                    for d in here:
                        have.setdefault(d, []).append(np.unique(known[d]).view(np.int64))
                order = sorted(found)
                left = part.take(pa.array(order, pa.int64()))
                columns = [pa.array([sorted(found[d]) for d in order], pa.list_(pa.int64())), pa.array([np.concatenate(have[d]) for d in order], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([left.column(0), left.column(1), *columns], schema.names)

    return inner.mapInArrow(tidy(run), schema)


def leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(item, key, containment) for every item of which a document holds `least` or more."""
    spark = df.sparkSession
    it = written(read_items(items, item, item_text), "items")
    shapes: dict[int, list[int]] = {}
    for r in it.select("k", "b").distinct().collect():  # at most five word counts and some sixty size classes
        shapes.setdefault(r.k, []).append(r.b)
    wanted, hits = spark.sparkContext.broadcast(bitmap(it, "want")), spark.sparkContext.broadcast(bitmap(it, "keys"))
    docs = written(read_documents(df, key, text, shapes, wanted, hits), "hits")
    near = docs.select("row", F.explode("keys").alias("x")).join(it.select("at", F.explode("keys").alias("x")), "x").select("row", "at").distinct()
    both = near.join(docs.select("row", "__key", "have"), "row").join(it.select("at", "__item", "n", "want"), "at")
    share = F.size(F.array_intersect("want", "have")) / F.col("n")
    return both.select(F.col("__item").alias(item), F.col("__key").alias(key), share.alias("containment")).where(F.col("containment") >= least)


def clean(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that hold no item. Rows are known by key and a digest of the text: rows equal in both share the verdict. A row that
    the bitmap of those with an item misses stays; only the few that it has are looked up, and shuffled with their text."""
    digest = F.xxhash64(F.col(text).cast("string"), F.lit(7))
    marked = df.withColumn("__mark", F.struct(F.col(key).alias("id"), digest.alias("digest")))
    bad = written(leaks(marked, items, "__mark", text).select("__mark").distinct(), "bad")
    marked = maybe(marked, "__mark", bad, "__bad")
    bad = bad.select(F.col("__mark.id").alias("__id"), F.col("__mark.digest").alias("__digest"))
    same = F.col("__mark.id").eqNullSafe(F.col("__id")) & (F.col("__mark.digest") == F.col("__digest"))
    doubt = marked.where("__bad").join(bad, same, "left_anti")
    return marked.where("not __bad").unionByName(doubt).drop("__mark", "__bad")
