"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) P(slot | class, token before) P(token | slot). Every token has a slot, every slot a class: the end
of text is class 0, the HEADS most frequent tokens have classes of their own, other tokens the class of their last two letters' hash. A
token with at least one in OWN of all occurrences has a slot of its own, others share the slots of their class by hash.

- Class factor: three hashed features, the token before (bigram), the two before (trigram) and the one before the last (skip), each with
  a row of class weights; their sum and a bias go through a softmax. Weights are trained by up to ROUNDS rounds of full-batch gradient updates:
  tasks add up what their texts show and what the weights expect for each feature and class, the sums are added over all tasks, and
  each weight moves by STEP times the log of their ratio (iterative scaling: the gradient's sign and zero). A round stands for every training
  text, but reads a table that is made once: the distinct histories of some MERGED chunks' as rows of features, each with its number.
  One training text in HELD, by a hash of its tokens, is not learnt from here: the same passes add up its likelihood, and the weights of
  the round that it likes best are kept, which may be none. So more rounds never make it worse, and copies are on one side.
- Slot factor: weights of (token before, slot) under a prior of the slots' shares whose strength is the number of slots seen after the
  token in the class. One feature is active, so the update from zero ends at the maximum: (count + strength x share) / (sum + strength).
  There is a weight for every pair of the training texts, so the model grows with them. Its table is never in one place: pairs meet in
  buckets whose number grows with the input, and each chunk gets back the values of its own pairs only.
- Within a slot a token has its add-one share; shared slots keep one place for unknown tokens. All probabilities sum to 1.

Scale: texts are tokenized once into chunks of CHUNK tokens or so (a longer text is a chunk). Chunks send distinct tokens and distinct
pairs, packed, to buckets, and get values back. On the driver: the tokens with own slots (OWN at most), SLOTS masses, and class weights of
fixed size. All sums are over all texts, so the result does not depend on the partitioning. A bucket's memory grows with what the chunks send to it; followers of one
token in one class go to one bucket, SLOTS of them at most from each chunk.

Defined results: a null text counts as empty and has one token, the end; without training texts every class and token is equally
likely but for its places; repeated rows each get their scores; tokens are known by 64-bit hashes, pairs by 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, tidy, written

HEADS, ENDINGS = 7, 24
CLASSES = 1 + HEADS + ENDINGS
SLOTS, OWN = 1 << 16, 1 << 15
END = 1  # the end token's hash; its slot and class are 0
BUCKETS, FEATURES = 1 << 12, 3
CHUNK, STEP, SMOOTH, ROUNDS, HELD = 1 << 20, 0.5, 400.0, 8, 16
PART = 1 << 15  # tokens whose softmax is in memory at a time
BLOCK = 1 << 10  # feature rows that travel together
MERGED, NUMBER = 1 << 22, 28  # histories that are merged at a time, and bits for their numbers
LEAST = 1e-20  # smaller products of powers are not trusted


def pack(a: np.ndarray) -> bytes:
    """Bytes plane by plane, compressed: sorted and small numbers come to little."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


class Local(dict):
    """Word → number in order of first use; 0 is the end token."""

    def __missing__(self, word):
        n = self[word] = len(self) + 1
        return n


def chunked(df: DataFrame, train: Column, text: str, keep) -> DataFrame:
    """Chunks of tokenized texts: the columns `keep` of each text, its length in tokens, whether it trains, the distinct tokens' hashes and
    endings, and the tokens as numbers of those."""
    inner = df.select(F.col(text).cast("string").cast("binary").alias("__text"), F.coalesce(train, F.lit(False)).alias("__train"), *[F.col(c) for c in keep])
    each = T.StructType(inner.schema.fields[2:])
    schema = T.StructType([T.StructField("rows", T.ArrayType(each))] + T._parse_datatype_string("chunk long, n_train long, n_words long, length binary, train binary, vocab binary, ending binary, ids binary").fields)

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        local, ids, length, train, rows, n = Local(), [], [], [], [], 0

        def out():
            vocab = np.array([END, *[max(2, xxhash.xxh64_intdigest(w)) for w in local]], np.uint64)
            ending = np.array([0, *[xxhash.xxh32_intdigest(w[-2:]) % ENDINGS for w in local]], np.uint8)
            long, on, all_rows = np.array(length, np.uint32), np.array(train, bool), pa.concat_arrays(rows)
            lists = pa.ListArray.from_arrays(pa.array([0, len(all_rows)], pa.int32()), all_rows)
            numbers = [pa.array([x], pa.int64()) for x in (task << 32 | seq, int(long[on].sum()), len(vocab))]
            blobs = [pa.array([pack(x)], pa.binary()) for x in (long, on, vocab, ending, np.concatenate(ids))]
            return pa.RecordBatch.from_arrays([lists, *numbers, *blobs], schema.names)

        for batch in batches:
            flat, begin = pa.StructArray.from_arrays(batch.columns[2:], [f.name for f in each.fields]), 0
            for i, (t, on) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                words = (t.as_py() or b"").lower().split()  # of bytes: A-Z only, blanks \x20 and \x09-\x0D
                x = np.zeros(len(words) + 1, np.uint32)
                x[:-1] = np.fromiter(map(local.__getitem__, words), np.uint32, len(words))
                ids.append(x)
                length.append(len(x))
                train.append(on.as_py())
                n += len(x)
                if n >= CHUNK:
                    rows.append(flat.slice(begin, i + 1 - begin))
                    yield out()
                    local, ids, length, train, rows, n, seq, begin = Local(), [], [], [], [], 0, seq + 1, i + 1
            rows.append(flat.slice(begin))
        if ids:
            yield out()

    return written(inner.mapInArrow(tidy(run), schema), "chunks", "uncompressed")


PACKED = ["length", "train", "vocab", "ending", "ids"]


class Chunk:
    """One chunk's arrays."""

    def __init__(self, row: dict):
        self.length, self.train = unpack(row["length"], np.uint32).astype(np.int64), unpack(row["train"], np.bool_)
        self.vocab, self.ending, self.ids = unpack(row["vocab"], np.uint64), unpack(row["ending"], np.uint8), unpack(row["ids"], np.uint32)
        self.first = np.cumsum(self.length) - self.length
        self.on = np.repeat(self.train, self.length)

    def held(self) -> np.ndarray:
        """By token, whether its text is one of those that tell when to stop."""
        digest = mix(np.add.reduceat(mix(self.vocab)[self.ids], self.first)) if len(self.first) else np.zeros(0, np.uint64)
        return np.repeat(digest % np.uint64(HELD) == 0, self.length)

    def histories(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the token before and of the one before it; 0 before the text."""
        h = self.vocab[self.ids]
        one, two = np.zeros_like(h), np.zeros_like(h)
        one[1:], two[2:] = h[:-1], h[:-2]
        one[self.first], two[self.first] = 0, 0
        two[self.first[self.length > 1] + 1] = 0
        return one, two


def chunks_of(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield row, Chunk(row)


def exchange(messages: DataFrame, answer, buckets: int, extra: str = "") -> DataFrame:
    """messages: chunk, bucket, data. answer(all data of a bucket) → their answers in the same order, and a dict of extra columns, which
    come once a bucket (null elsewhere)."""
    rows = messages.repartition(min(buckets, 1 << 15), "bucket").sortWithinPartitions("bucket")
    schema = T._parse_datatype_string("chunk long, bucket long, data binary" + (", " + extra if extra else ""))
    arrow = [pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * (len(schema) - 3)]

    def run(batches):
        now, held = None, []

        def out():
            back, more = answer([d for _, d in held])
            columns = [[c for c, _ in held], [now] * len(held), back, *[[more[f]] + [None] * (len(held) - 1) for f in schema.names[3:]]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], schema.names)

        for batch in batches:
            for c, b, d in zip(*[batch.column(n).to_pylist() for n in ("chunk", "bucket", "data")], strict=True):
                if b != now:
                    if held:
                        yield out()
                    now, held = b, []
                held.append((c, d))
        if held:
            yield out()

    return written(rows.mapInArrow(tidy(run), schema), "answers", "uncompressed")


def send(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit keys → the buckets that get some (by ranges of the key), and the bounds of what each gets."""
    which = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(which) else np.zeros(0, np.int64)
    return which[cut], np.append(cut, len(which))


def messages_of(chunks: DataFrame, make, buckets: int) -> DataFrame:
    """make(chunk) → sorted keys and an array beside them; each bucket gets its stretch of both, packed."""

    def run(batches):
        for row, chunk in chunks_of(batches):
            both = make(chunk)
            which, cut = send(both[0], buckets)
            data = [pa.array([pack(a[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for a in both]
            joined = pa.StructArray.from_arrays(data, ["x0", "x1"])
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(which), pa.int64()), pa.array(which), joined], ["chunk", "bucket", "data"])

    return chunks.select("chunk", *PACKED).mapInArrow(tidy(run), "chunk long, bucket long, data struct<x0:binary,x1:binary>")


def tokens_of(chunk: Chunk):
    """Distinct tokens by hash, and their counts in training texts beside their endings."""
    c = np.bincount(chunk.ids[chunk.on], minlength=len(chunk.vocab)).astype(np.uint32)
    order = np.argsort(chunk.vocab)
    return chunk.vocab[order], np.stack([c, chunk.ending.astype(np.uint32)], 1)[order].copy().view(np.uint64).ravel()


def shared_slots(own: int) -> int:
    """Slots of each ending, if `own` are left for single tokens."""
    return (SLOTS - 1 - own) // ENDINGS


def shared_slot(h: np.ndarray, ending: np.ndarray, own: int) -> np.ndarray:
    n = shared_slots(own)
    return own + 1 + ending.astype(np.int64) * n + (mix(h) % np.uint64(n)).astype(np.int64)


@dataclass
class Model:
    """What every task needs; its size is fixed by OWN, SLOTS, BUCKETS and CLASSES."""

    total: int
    distinct: int
    most: int  # own slots there may be
    own: np.ndarray  # hashes of tokens with own slots, sorted
    own_slot: np.ndarray
    mass: np.ndarray  # by slot, add-one counts
    kind: np.ndarray  # class by slot
    w: np.ndarray = None
    buckets: int = 1

    def __post_init__(self):
        of = np.bincount(self.kind, self.mass, CLASSES)
        self.share = self.mass / np.maximum(of, 1e-300)[self.kind]
        self.bias = np.log(np.maximum(of, 1e-9) / of.sum())
        self.w = np.zeros((CLASSES, FEATURES * BUCKETS), np.float32) if self.w is None else self.w

    def slots(self, chunk: Chunk) -> np.ndarray:
        """The slot of each token of the chunk's vocabulary."""
        at = np.minimum(np.searchsorted(self.own, chunk.vocab), len(self.own) - 1)
        return np.where(self.own[at] == chunk.vocab, self.own_slot[at], shared_slot(chunk.vocab, chunk.ending, self.most))

    def features(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        low = np.uint64(BUCKETS - 1)
        return np.stack([mix(one + np.uint64(11)) & low, (mix(mix(one + np.uint64(13)) + two) & low) + np.uint64(BUCKETS), (mix(two + np.uint64(17)) & low) + np.uint64(2 * BUCKETS)]).astype(np.int64)

    def powers(self) -> np.ndarray:
        """e to the weights: for each feature row one number a class, the largest 1. The bias is in those of the first feature."""
        w = self.w.T.astype(np.float64, order="C")
        w[:BUCKETS] += self.bias
        return np.exp(w - w.max(1, keepdims=True)).astype(np.float32)

    def logits(self, f: np.ndarray) -> np.ndarray:
        """The summed weights and bias, for each token a row of classes, the largest 0."""
        z = self.w[:, f].sum(1, dtype=np.float64).T + self.bias
        return z - z.max(1, keepdims=True)

    def odds(self, powers: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token a row of numbers in proportion to its classes' probabilities, and their sum: products of powers, or by the logits
        where features contradict each other so much that products vanish."""
        p = powers.take(f[0], 0)
        for rows in f[1:]:
            p *= powers.take(rows, 0)
        total = np.einsum("tc->t", p)
        low = np.flatnonzero(total < LEAST)
        if len(low):
            p[low] = np.exp(self.logits(f[:, low]))
            total[low] = p[low].sum(1)
        return p, total

    def class_logs(self, powers: np.ndarray, f: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log P(class | history) of each token's class."""
        p, total = self.odds(powers, f)
        p = p[np.arange(len(y)), y]
        low = np.flatnonzero(p < LEAST)
        p[low] = 1
        log = np.log(p.astype(np.float64) / total)
        if len(low):
            z = self.logits(f[:, low])
            log[low] = z[np.arange(len(low)), y[low]] - np.log(np.exp(z).sum(1))
        return log

    def pairs(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """For each token a 64-bit key: 48 bits of (token before, class), 16 of the slot."""
        slot = self.slots(chunk)[chunk.ids]
        one, _ = chunk.histories()
        group = mix(one + self.kind[slot].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return group >> np.uint64(16) << np.uint64(16) | slot.astype(np.uint64), slot


def token_counts(chunks: DataFrame, most: int = OWN) -> tuple[Model, DataFrame]:
    """The model without weights, and for each chunk the counts of its tokens."""
    total, words = (x or 0 for x in chunks.agg(F.sum("n_train"), F.sum("n_words")).first())
    buckets = 1 + words // (2 * CHUNK)

    def answer(data):
        keys = [unpack(d["x0"], np.uint64) for d in data]
        both = [unpack(d["x1"], np.uint64).view(np.uint32).reshape(-1, 2) for d in data]
        h, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        flat = np.concatenate(both)
        c = np.bincount(at, flat[:, 0], len(h)).astype(np.int64)
        ending = flat[first, 1]
        known = c > 0
        own = known & (c * most >= total) & (h != END)
        cold = known & ~own & (h != END)
        slot = shared_slot(h[cold], ending[cold], most)
        mass = np.bincount(slot, c[cold] + 1, SLOTS).astype(np.int64)
        some = np.flatnonzero(mass)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        back = [pack(x) for x in np.split(c[at], ends)]
        lists = {"slot": some, "mass": mass[some], "h": h[own].view(np.int64), "c": c[own], "e": ending[own], "n": [int(known.sum()), int(c[h == END].sum())]}
        return back, {k: list(map(int, v)) for k, v in lists.items()}

    got = exchange(messages_of(chunks, tokens_of, buckets), answer, buckets, "slot array<long>, mass array<long>, h array<long>, c array<long>, e array<long>, n array<long>")
    more = got.where("n is not null")
    distinct, ends = (x or 0 for x in more.agg(F.sum(F.col("n")[0]), F.sum(F.col("n")[1])).first())
    masses = more.select(F.explode(F.arrays_zip("slot", "mass")).alias("x")).groupBy("x.slot").agg(F.sum("x.mass").alias("mass")).toPandas()  # SLOTS rows at most
    own = more.select(F.explode(F.arrays_zip("h", "c", "e")).alias("x")).select("x.*").toPandas().sort_values(["c", "h"], ascending=[False, True])  # OWN rows at most
    mass, kind = np.zeros(SLOTS), np.zeros(SLOTS, np.int64)
    rest = slice(most + 1, most + 1 + ENDINGS * shared_slots(most))
    kind[rest] = 1 + HEADS + np.arange(ENDINGS).repeat(shared_slots(most))
    mass[rest] = 1  # a place for unknown tokens
    mass[masses.slot.to_numpy(np.int64)] += masses["mass"].to_numpy(np.float64)
    mass[0] = ends + 1
    at = np.arange(1, 1 + len(own))
    mass[at] = own.c.to_numpy(np.float64) + 1
    kind[at] = np.where(at <= HEADS, at, 1 + HEADS + own.e.to_numpy(np.int64))
    h = np.append(own.h.to_numpy(np.int64).view(np.uint64), np.uint64(END))
    order = np.argsort(h)
    return Model(int(total), int(distinct), most, h[order], np.append(at, 0)[order], mass, kind, buckets=1 + total // CHUNK), got.select("chunk", "bucket", "data")


def packed_rows(f: np.ndarray) -> bytes:
    """Feature rows of tokens, each counted from its feature's first."""
    return pack((f - BUCKETS * np.arange(FEATURES)[:, None]).astype(np.uint16).ravel())


def unpacked_rows(b: bytes) -> np.ndarray:
    return unpack(b, np.uint16).reshape(FEATURES, -1).astype(np.int64) + BUCKETS * np.arange(FEATURES)[:, None]


def merged(keys: list[np.ndarray]) -> list[np.ndarray]:
    """Histories that each stand once: in the upper bits what tells them apart, in the lower ones numbers that are added up."""
    x = np.sort(np.concatenate(keys))
    which = x >> np.uint64(NUMBER)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), which[1:] != which[:-1])))
    n = np.add.reduceat(x & np.uint64((1 << NUMBER) - 1), first) if len(x) else x
    return [which[first] << np.uint64(NUMBER) | n]


def histories(chunks: DataFrame, model: Model) -> DataFrame:
    """What the rounds need of the training tokens, in rows for one chunk or more: the distinct histories of those that are learnt from, as
    feature rows sorted by the first feature's, the number of tokens of each, and how often each class follows each feature row; and all
    histories and classes of those that are not. In few partitions, as each adds up a model of its own in every round."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    size, bits = CLASSES * FEATURES * BUCKETS, BUCKETS.bit_length() - 1

    def run(batches):
        m = shared.value
        keys, shown, rest, ends, tokens = [], np.zeros(size, np.uint32), [], [], 0

        def out():
            key = merged(keys)[0]
            f = np.stack([(key >> np.uint64(NUMBER + bits * (FEATURES - 1 - k))).astype(np.int64) % BUCKETS + BUCKETS * k for k in range(FEATURES)])
            n = (key & np.uint64((1 << NUMBER) - 1)).astype(np.uint32)
            blobs = packed_rows(f), pack(n), pack(shown), packed_rows(np.concatenate(rest, 1)), pack(np.concatenate(ends))
            return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], HISTORIES)

        for _, chunk in chunks_of(batches):
            held, y = chunk.held()[chunk.on], m.kind[m.slots(chunk)][chunk.ids[chunk.on]]
            f = m.features(*(x[chunk.on] for x in chunk.histories()))
            rest.append(f[:, held])
            ends.append(y[held].astype(np.uint8))
            f, y = f[:, ~held], y[~held] * (FEATURES * BUCKETS)
            for rows in f:
                shown += np.bincount(y + rows, minlength=size).astype(np.uint32)
            low, key = f & (BUCKETS - 1), np.uint64(0)
            for rows in low:
                key = key << np.uint64(bits) | rows.astype(np.uint64)
            keys += merged([key << np.uint64(NUMBER) | np.uint64(1)])
            tokens += int(chunk.on.sum())
            if sum(map(len, keys)) >= MERGED or tokens >> NUMBER - 1:
                yield out()
                keys, shown, rest, ends, tokens = [], np.zeros(size, np.uint32), [], [], 0
        if keys:
            yield out()

    schema = ", ".join(f"{c} binary" for c in HISTORIES)
    out = written(chunks.select(*PACKED).mapInArrow(tidy(run), schema), "histories", "uncompressed")
    shared.unpersist()
    return out.coalesce(max(2 * chunks.sparkSession.sparkContext.defaultParallelism, -(-out.rdd.getNumPartitions() // 4)))


HISTORIES = ["rows", "n", "shown", "held", "ends"]


def expect(model: Model, powers: np.ndarray, f: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """Add to out (classes by feature rows) how often the weights expect each class. f: feature rows sorted by the first feature's; n: the
    number of tokens of each."""
    for lo in range(0, len(n), PART):
        part = f[:, lo : lo + PART]
        p, total = model.odds(powers, part)
        p = p.T.astype(np.float64, order="C")
        p *= n[lo : lo + PART] / total
        cut = np.flatnonzero(np.concatenate(([True], part[0, 1:] != part[0, :-1])))
        out[:, part[0, cut]] += np.add.reduceat(p, cut, 1)
        for k in range(1, FEATURES):
            here, rows = slice(k * BUCKETS, (k + 1) * BUCKETS), part[k] - k * BUCKETS
            for c in range(CLASSES):
                out[c, here] += np.bincount(rows, p[c], BUCKETS)


def summed(rows: DataFrame, model: Model, expected: bool) -> tuple[np.ndarray, float]:
    """For each feature row and class, over the training tokens that are learnt from: how often the class follows, or how often the weights
    expect it. And the log-likelihood of the classes of those that are not. rows: chunks, or their histories."""
    rows = rows if "shown" in rows.columns else histories(rows, model)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width, kind = FEATURES * BUCKETS, np.float32 if expected else np.float64

    def run(batches):
        m, out, like = shared.value, np.zeros((CLASSES, width)), 0.0
        powers = m.powers()
        for batch in batches:
            for row in batch.to_pylist():
                f, y = unpacked_rows(row["held"]), unpack(row["ends"], np.uint8)
                for lo in range(0, len(y), PART):
                    like += float(m.class_logs(powers, f[:, lo : lo + PART], y[lo : lo + PART]).sum())
                if expected:
                    expect(m, powers, unpacked_rows(row["rows"]), unpack(row["n"], np.uint32), out)
                else:
                    out += unpack(row["shown"], np.uint32).reshape(CLASSES, width)
        blocks = [out[:, lo : lo + BLOCK] for lo in range(0, width, BLOCK)]
        some = [i for i, b in enumerate(blocks) if b.any()]
        data = [pack(blocks[i].ravel().astype(kind)) for i in some] + [pack(np.array([like]))]
        yield pa.RecordBatch.from_arrays([pa.array([*some, len(blocks)], pa.int64()), pa.array(data, pa.binary())], ["block", "data"])

    def add(batches):
        held = {}
        for batch in batches:
            for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[i] = held.get(i, 0) + unpack(d, kind if i * BLOCK < width else np.float64).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([pack(x) for x in held.values()], pa.binary())], ["block", "data"])

    schema = "block long, data binary"
    need = ["held", "ends", *(["rows", "n"] if expected else ["shown"])]
    rows = rows.select(*need).mapInArrow(tidy(run), schema).repartition(width // BLOCK, "block").mapInArrow(tidy(add), schema).collect()  # FEATURES x BUCKETS x CLASSES numbers
    shared.unpersist()
    out, like = np.zeros((CLASSES, width)), 0.0
    for r in rows:
        data = unpack(bytes(r.data), np.float64)
        if r.block * BLOCK < width:
            out[:, r.block * BLOCK : (r.block + 1) * BLOCK] = data.reshape(CLASSES, -1)
        else:
            like = float(data[0])
    return out, like


def trained(chunks: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """The class weights after the round, of at most `rounds`, that the held texts like best; the search ends with the first that they like
    less. The first update needs no pass of its own: without weights a feature expects its share."""
    prior, rows = SMOOTH * np.exp(model.bias)[:, None], histories(chunks, model)
    shown, best = summed(rows, model, False)
    kept, expected = model.w, shown.sum(0) * np.exp(model.bias)[:, None]
    for _ in range(rounds):
        model.w = (model.w + STEP * np.log((shown + prior) / (expected + prior))).astype(np.float32)
        expected, like = summed(rows, model, True)
        if like <= best:
            break
        kept, best = model.w, like
    model.w = kept
    return model


def pair_values(chunks: DataFrame, model: Model) -> DataFrame:
    """For each chunk log10 P(slot | class, token before) of its distinct pairs, by bucket in the order of their keys."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    share = model.share.astype(np.float64)

    def make(chunk):
        keys, _ = shared.value.pairs(chunk)
        fresh, at = np.unique(keys, return_inverse=True)
        return fresh, np.bincount(at[chunk.on], minlength=len(fresh)).astype(np.uint32)

    def answer(data):
        keys = [unpack(d["x0"], np.uint64) for d in data]
        pair, at = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(at, np.concatenate([unpack(d["x1"], np.uint32) for d in data]), len(pair))
        group = pair >> np.uint64(16)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        width = np.diff(np.append(first, len(pair)))
        strength = np.maximum(1, np.add.reduceat((c > 0).astype(np.float64), first))
        total = np.add.reduceat(c, first)
        of = share[(pair & np.uint64(0xFFFF)).astype(np.int64)]
        value = np.log10((c + of * np.repeat(strength, width)) / np.repeat(total + strength, width)).astype(np.float32)
        value = (value.view(np.uint32) + np.uint32(64) & np.uint32(0xFFFFFF80)).view(np.float32)  # 16 bits of fraction
        return [pack(x) for x in np.split(value[at], np.cumsum([len(k) for k in keys])[:-1])], {}

    return exchange(messages_of(chunks, make, model.buckets), answer, model.buckets)


def score(df: DataFrame, train: Column, text: str = "text", keep=("doc_id",), own: int = OWN) -> tuple[DataFrame, Model]:
    """Learn from the rows for which `train` holds and score all rows. Per row: `keep`, n_tokens, n_known (tokens that the training texts
    have), base_score (add-one unigram) and score, both in log10; and the model."""
    chunks = chunked(df, train, text, keep)
    model, counts = token_counts(chunks, own)
    model = trained(chunks, model)
    values = pair_values(chunks, model)
    shared = df.sparkSession.sparkContext.broadcast(model)
    listed = lambda d, name: d.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "data"))).alias(name))
    rows = chunks.select("chunk", "rows", *PACKED).join(listed(counts, "counts"), "chunk").join(listed(values, "pairs"), "chunk")
    fields = chunks.schema["rows"].dataType.elementType.fields
    schema = T.StructType(fields + T._parse_datatype_string("n_tokens long, n_known long, base_score double, score double").fields)
    at = rows.columns.index("rows")

    def run(batches):
        m = shared.value
        powers = m.powers()
        for batch in batches:
            lists = batch.column(at)
            for i, row in enumerate(batch.select([c for c in batch.schema.names if c != "rows"]).to_pylist()):
                chunk = Chunk(row)
                c = np.empty(len(chunk.vocab))
                c[np.argsort(chunk.vocab)] = np.concatenate([unpack(x["data"], np.int64) for x in row["counts"]])
                keys, slot = m.pairs(chunk)
                place = np.unique(keys, return_inverse=True)[1]
                del keys
                log = np.concatenate([unpack(x["data"], np.float32) for x in row["pairs"]]).astype(np.float64)[place]
                log += np.where(slot > m.most, np.log10((c + 1)[chunk.ids] / np.maximum(m.mass, 1)[slot]), 0.0)
                one, two = chunk.histories()
                for lo in range(0, len(one), PART):
                    log[lo : lo + PART] += m.class_logs(powers, m.features(one[lo : lo + PART], two[lo : lo + PART]), m.kind[slot[lo : lo + PART]]) / np.log(10)
                known = (c > 0)[chunk.ids].astype(np.int64)
                base = np.log10((c + 1) / (m.total + m.distinct + 1))[chunk.ids]
                sums = [pa.array(chunk.length)] + [pa.array(np.add.reduceat(x, chunk.first)) for x in (known, base, log)]
                of = lists.slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([*[of.field(k) for k in range(len(fields))], *sums], schema.names)

    return rows.mapInArrow(tidy(run), schema), model
