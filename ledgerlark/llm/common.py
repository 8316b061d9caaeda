"""What the operators share: scratch tables in the cluster's shared folder, native span finding, token hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one of our own only where that is unset and the master is this machine (tests)."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if "dir" not in _local:
        import shutil

        _local["dir"] = tempfile.mkdtemp(prefix="ledgerlark-")
        atexit.register(shutil.rmtree, _local["dir"], True)
    return "file://" + _local["dir"]


_paths: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _paths.append(f"{shared_dir(spark)}/ledgerlark/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back. Survives the loss of any executor. Tables of large
    values that are compressed already are best written without: the codec's buffers lie outside the heap."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, keep: tuple[str, ...] = (), since: int = 0) -> None:
    """Delete the scratch tables that this process has written, all but `keep` and the first `since`. Results that still read one of them
    must have been written elsewhere before."""
    for path in [p for p in _paths[since:] if p not in keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _paths.remove(path)


def last() -> tuple[str]:
    """The scratch table written last, to keep."""
    return (_paths[-1],)


def mark() -> int:
    """How many scratch tables there are by now; clear(since=mark) keeps them."""
    return len(_paths)


SHARE, SALTS = 1000, 64


def spread(rows: DataFrame, small: DataFrame, key: str, weight: str, by: str) -> DataFrame:
    """rows joined with small on key (inner), without a task that gets all rows of a frequent key. small: a table with one row a key,
    whose `weight` is that key's number of rows. Keys with at least one in SHARE of all rows (SHARE of them at most, so they may be
    broadcast) are dealt over SALTS parts by a hash of the column `by`, and their row of small is repeated for each part."""
    total = small.agg(F.sum(weight)).first()[0] or 0
    often = F.col(weight) * SHARE >= F.lit(total)
    hot = small.where(often).select(key, F.lit(True).alias("__hot"))
    parts = small.withColumn("__salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).drop("__hot")
    return dealt.join(parts, [key, "__salt"]).drop("__salt")


WORDS = 1 << 20  # of 64 bits each, in the filter of ids


def place(id, seed: int = 0) -> tuple:
    """Word and bit of an id in a filter."""
    at = F.pmod(F.xxhash64(id, F.lit(seed)), F.lit(64 * WORDS))
    return F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")


def maybe(rows: DataFrame, id: str, ids: DataFrame, out: str, seed: int = 0) -> DataFrame:
    """Add the boolean `out`: true for rows whose id is in the one column of ids, and for few others, without a shuffle of rows: what is
    broadcast is a bitmap of at most WORDS words whatever the number of ids. Past some ten million ids it is true for more and more, and
    only the saving is lost."""
    word, bit = place(F.col(ids.columns[0]), seed)
    bitmap = ids.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    word, bit = place(F.col(id), seed)
    hit = F.coalesce(F.call_function("getbit", F.col("__bits"), bit) == 1, F.lit(False))
    return rows.join(F.broadcast(bitmap), word == F.col("__word"), "left").withColumn(out, hit).drop("__word", "__bits")


def let(value: Column, body) -> Column:
    """Bind value once, so that lambdas in body read the result instead of computing it again for each element."""
    return F.transform(F.array(value), body)[0]


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on a batch of texts that goes to Python has some BATCH_BYTES at most (one row where a row has more), not 10,000 texts of any
    length; it lies in the executor's memory twice."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free(results, taken) -> list[str]:
    """Names of results: as they are, with underscores behind them where a kept column has that name, which stays."""
    out = []
    for name in results:
        while name in taken:
            name += "_"
        out.append(name)
    return out


BLOCK = 64


def _starts(steps: Column) -> Column:
    """Running sums (exclusive) of an array of ints: sums by block first, so that long arrays stay far from quadratic."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def of(s):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(s, b * BLOCK + 1, F.lit(BLOCK))))
        before = lambda bl: F.transform(bl, lambda _, b: total(F.slice(bl, F.lit(1), b)))
        inside = lambda bb: F.transform(s, lambda _, k: bb[F.floor(k / BLOCK).cast("int")] + total(F.slice(s, F.floor(k / BLOCK).cast("int") * BLOCK + 1, k % BLOCK)))
        return let(blocks, lambda bl: let(before(bl), inside))

    return let(steps, of)


SPAN = "array<struct<start:int,end:int,hit:string>>"


def find_spans(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """All matches of pattern (a Java expression, leftmost, non-overlapping) as array<struct<start,end,hit>>, in code points,
    end exclusive. split() gives the gaps between the matches, regexp_extract_all() the matches; their lengths add up to the places.
    gate: a cheap condition that any text with a match meets. A null text has no matches."""

    def place(x):
        steps = F.zip_with(F.slice(x["g"], F.lit(1), F.size(x["m"])), x["m"], lambda g, m: F.length(g) + F.length(m))

        def each(at):
            return F.transform(
                x["m"],
                lambda m, k: F.struct((at[k] + F.length(x["g"][k])).alias("start"), (at[k] + F.length(x["g"][k]) + F.length(m)).alias("end"), m.alias("hit")),
            )

        return let(_starts(steps), each)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    some = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(some, let(both, place)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def tidy(run):
    """run (a function for mapInArrow) that gives the memory of a finished task back to the machine: workers live on between stages, and
    what they hold free counts all the same."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library

    return tidied


class Memo(dict):
    """A function's results by token, forgotten all at once when there are `most`, so memory is bounded."""

    def __init__(self, make, most: int = 150_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


_edge = re.compile(r"[\W_]+")


def folded(token: str) -> str:
    """Lower case, letters and digits only."""
    return _edge.sub("", token.lower())


def token_hash(token: str) -> int:
    """64 bits of the folded token; 0 for one without letters or digits, which shingles leave out."""
    t = folded(token)
    return (xxhash.xxh64_intdigest(t) | 1) if t else 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads differences over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, memo: Memo) -> np.ndarray:
    tokens = text.split()
    h = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    return h[h != 0]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words, in order; of all words together if there are fewer than k; none if there is no word."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    s = h[: n - k + 1].copy()
    for i in range(1, k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
    return mix(s + np.uint64(k))


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
