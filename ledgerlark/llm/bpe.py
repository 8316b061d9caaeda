"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Defined results: a null text is an empty one; an empty text has no ids. Very long pre-tokens cost n log n. Repeated rows each get
their own result; other columns pass through. Python with Arrow batches, as a merge loop has no form in built-in functions.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidy


# Fixed value: the pattern under which a blank that stands alone between two other characters begins a pre-token, and none spans it.
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if b}


class RankQueue:
    """Positions by merge rank. Level 0: a bit per rank in words of 256; level 1: a bit per word that isn't empty. Find-first-set on
    both gives the lowest rank; each rank's bucket gives its leftmost position."""

    __slots__ = ("buckets", "words", "top")

    def __init__(self):
        self.buckets, self.words, self.top = {}, {}, 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [at]
            w = rank >> 8
            self.words[w] = self.words.get(w, 0) | 1 << (rank & 255)
            self.top |= 1 << w
        elif bucket[-1] <= at:
            bucket.append(at)
        else:
            heappush(bucket, at)

    def pop(self) -> tuple[int, int]:
        w = (self.top & -self.top).bit_length() - 1
        word = self.words[w]
        rank = w << 8 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[w] = word & (word - 1)
            if not self.words[w]:
                self.top &= self.top - 1
        return rank, at


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one pre-token: always the lowest-ranked pair, the leftmost of equals, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get, queue = len(piece), ranks.get, RankQueue()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    now = [-1] * n  # the rank of the pair that begins here; -1: none, or no part begins here any more
    push = queue.push
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            now[i] = r
            push(r, i)
    while queue.top:
        r, i = queue.pop()
        if now[i] != r:
            continue  # stale: a neighbour was merged meanwhile
        j = after[i]
        k = after[j]
        after[i] = k
        now[j] = -1
        if k < n:
            before[k] = i
            end = after[k]
            new = get(piece[i:end]) if end - i <= longest else None
        else:
            new = None
        if new is None:
            now[i] = -1
        else:
            now[i] = new
            push(new, i)
        p = before[i]
        if p >= 0:
            new = get(piece[p:k]) if k - p <= longest else None
            if new is None:
                now[p] = -1
            else:
                now[p] = new
                push(new, p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Vocabulary:
    """Ranks, and for every pair of tokens whose bytes together are a token that token's rank, as sorted arrays."""

    NONE = np.int32(1 << 30)

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.names = {i: str(i) for i in self.bytes_of}
        self.longest = max(map(len, self.ranks), default=1)
        keys, values, get = array("q"), array("q"), self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = get(token[:i]), get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.int64(2**62)), np.append(values[order], self.NONE).astype(np.int32)
        self.single = np.array([get(bytes([i]), -1) for i in range(256)], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], self.NONE)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """Made once in a worker, whose tasks share it."""
    return Vocabulary(path)


STRETCH = 100_000  # positions whose first ranks are looked up at a time


def once(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats; for many small arrays quicker than numpy.unique."""
    x = np.sort(x)
    fresh = np.empty(len(x), bool)
    fresh[:1] = True
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    return x[fresh]


def merge_all(pieces: list[bytes], voc: Vocabulary) -> list[list[int]]:
    """merge() for many pre-tokens through one rank queue: their positions stand end to end in one linked list, broken between
    pre-tokens, and a bucket's live positions are merged together. Of equal pairs that overlap the leftmost go first. A pre-token in
    which a merge makes a pair of lower rank than its own, so that the order inside a bucket could matter, is done again alone."""
    out: list = [None] * len(pieces)
    todo = []
    for i, p in enumerate(pieces):
        r = voc.ranks.get(p)
        if r is None:
            todo.append(i)
        else:
            out[i] = [r]
    if not todo:
        return out
    raw = np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)
    length = np.array([len(pieces[i]) for i in todo])
    ends = np.cumsum(length)
    n = len(raw)
    token = voc.single[raw]
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[ends - 1] = -1
    before[ends - length] = -1
    now = np.full(n, voc.NONE, np.int32)
    some = np.flatnonzero(after >= 0).astype(np.int32)
    for lo in range(0, len(some), STRETCH):
        at = some[lo : lo + STRETCH]
        now[at] = voc.pair_ranks(token[at], token[after[at]])
    queue, odd = BatchQueue(), []

    def push(at):
        r = now[at]
        at = at[np.argsort(r, kind="stable")]
        r = now[at]
        at = at[: np.searchsorted(r, voc.NONE)]
        if len(at):
            r = r[: len(at)]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            low = 0
            for rank, high in zip(r[np.append(0, cut)].tolist(), [*cut.tolist(), len(at)], strict=True):
                queue.push(rank, at[low:high])
                low = high

    push(some)
    while queue.top:
        rank, at, mixed = queue.pop()
        at = at[now[at] == rank]  # the rest is stale
        if len(at) > 1:
            if mixed:
                at = once(at)
            head = before[at]
            head = (head < 0) | (now[head] != rank)
            if not head.all():
                queue.push(rank, at[~head])
                at = at[head]
        if not len(at):
            continue
        gone = after[at]
        end = after[gone]
        token[at] = rank
        after[at] = end
        now[gone] = voc.NONE
        more = end >= 0
        before[end[more]] = at[more]
        left = before[at]
        left = left[left >= 0]
        fresh = once(np.concatenate((at, left)))
        follow = after[fresh]
        got = np.full(len(fresh), voc.NONE, np.int32)
        more = follow >= 0
        got[more] = voc.pair_ranks(token[fresh[more]], token[follow[more]])
        now[fresh] = got
        lower = got < rank
        if lower.any():
            odd.append(fresh[lower])
        push(fresh)
    starts = np.zeros(n, bool)  # of parts: what a walk from the pre-tokens' starts comes to
    at = ends - length
    while len(at):
        starts[at] = True
        at = after[at]
        at = at[at >= 0]
    ids = token[starts].tolist()
    counts = np.add.reduceat(starts, ends - length, dtype=np.int64).tolist()
    low = 0
    for i, c in zip(todo, counts, strict=True):
        out[i] = ids[low : low + c]
        low += c
    for k in set(np.searchsorted(ends, np.concatenate(odd), side="right").tolist()) if odd else ():
        out[todo[k]] = merge(pieces[todo[k]], voc.ranks, voc.longest)
    return out


class BatchQueue(RankQueue):
    """A rank queue whose buckets hold arrays of positions and are taken whole."""

    __slots__ = ()

    def push(self, rank: int, at: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [at]
            w = rank >> 8
            self.words[w] = self.words.get(w, 0) | 1 << (rank & 255)
            self.top |= 1 << w
        else:
            bucket.append(at)

    def pop(self) -> tuple[int, np.ndarray, bool]:
        """Rank, positions, and whether they come from several pushes: then they are out of order or repeated."""
        w = (self.top & -self.top).bit_length() - 1
        word = self.words[w]
        rank = w << 8 | (word & -word).bit_length() - 1
        self.words[w] = word & (word - 1)
        if not self.words[w]:
            self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        return (rank, bucket[0], False) if len(bucket) == 1 else (rank, np.concatenate(bucket), True)


def stretches(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches numbered `which` of a flat array end to end, and their lengths. Stretch i ends at ends[i + 1]."""
    length = ends[which + 1] - ends[which]
    to = np.cumsum(length)
    return flat[np.repeat(ends[which] - to + length, length) + np.arange(to[-1] if len(to) else 0)], length


class Shelf(dict):
    """Numbers of keys in order of first use; the ids of each number's key stand in one flat array once `put` has them."""

    def __init__(self):
        self.forget()

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def forget(self) -> None:
        self.clear()
        self.new, self.size, self.flat, self.ends = [], 0, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int32, len(keys))

    def put(self, flat: np.ndarray, length: np.ndarray) -> None:
        """The ids of the new keys, in their order."""
        self.size += sum(map(len, self.new))
        self.flat, self.ends, self.new = np.concatenate((self.flat, flat)), np.concatenate((self.ends, self.ends[-1] + np.cumsum(length))), []

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return stretches(self.flat, self.ends, numbers)

    def settle(self, most: int) -> None:
        """Forget all if there are more than `most` keys, or as many characters as so many keys of 16 have."""
        if len(self) > most or self.size > 16 * most:
            self.forget()


class Codec:
    """Encoder and decoder over one vocabulary. Ids of pre-tokens and words are remembered, up to `most` of each beyond what the texts at
    hand need."""

    SHORT, AT_ONCE = 64, 3_000_000
    MARK = "\x0b"  # white space, and so a pre-token of its own between a word and the blank before the next

    def __init__(self, path: str, pattern: str, most: int = 100_000):
        import regex

        self.voc, self.most = vocabulary(path), most
        self.wordwise = pattern == WORDWISE
        each = regex.compile(pattern).finditer
        self.find = regex.compile(pattern).findall if self.wordwise else lambda t: [m[0] for m in each(t)]
        self.pieces, self.words, self.odd = Shelf(), Shelf(), np.zeros(0, bool)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.voc.bytes_of.__getitem__, ids))

    def names(self, ids: list[int]) -> str:
        """Decimal ids joined by spaces."""
        return " ".join(map(self.voc.names.__getitem__, ids))

    def encode(self, texts: list[str]):
        """The ids of each text. Under the pattern WORDWISE, where each space stands alone between two other characters, a pre-token
        begins at each space and nowhere else across it, so the words between spaces can be looked up one by one; other texts, and all
        under other patterns, are searched as a whole."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < self.AT_ONCE):
                size += len(texts[end])
                end += 1
            yield from self._some(texts[at:end])
            at = end

    def _learn(self) -> None:
        """Ids of the new pre-tokens: short ones merged together, long ones each with its own queue."""
        new = self.pieces.new
        ids: list = [None] * len(new)
        short = [i for i, p in enumerate(new) if len(p) <= self.SHORT]
        for i, x in zip(short, merge_all([new[i].encode() for i in short], self.voc), strict=True):
            ids[i] = x
        for i, p in enumerate(new):
            if ids[i] is None:
                ids[i] = merge(p.encode(), self.voc.ranks, self.voc.longest)
        self.pieces.put(*flattened(ids))

    def _some(self, texts: list[str]):
        heads, tails = [], []
        for t in texts:
            head, *tail = t.split(" ") if self.wordwise else [t]
            heads.append(head)
            tails.append(self.words.numbers(tail))
        uneven = [not w or w[0].isspace() or w[-1].isspace() or self.MARK in w for w in self.words.new]
        self.odd = np.concatenate((self.odd, np.array(uneven, bool)))
        fresh = [w for w, no in zip(self.words.new, uneven, strict=True) if not no]
        mark = self.pieces[self.MARK]
        found = self.pieces.numbers(self.find((self.MARK + " ").join(["", *fresh])) if fresh else [])
        for i, (t, head, tail) in enumerate(zip(texts, heads, tails, strict=True)):
            if len(tail) and (not head or head[-1].isspace() or self.odd[tail].any()):
                head, tails[i] = t, tail[:0]
            heads[i] = self.pieces.numbers(self.find(head))
        self._learn()
        here = found == mark
        ids, length = self.pieces.ids(found[~here])
        word = np.flatnonzero(~np.array(uneven, bool))[np.cumsum(here)[~here] - 1]  # which new word each pre-token is of
        self.words.put(ids, np.bincount(word, length, len(uneven)).astype(np.int64))
        for head, tail in zip(heads, tails, strict=True):
            first = self.pieces.ids(head)[0]
            yield np.concatenate((first, self.words.ids(tail)[0])) if len(tail) else first
        self.words.settle(self.most)
        self.pieces.settle(self.most)
        self.odd = self.odd[: len(self.words)]


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))


ROWS = 1000  # encoded at a time, so that a task holds the ids of so many texts only
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType(), False),
    "decoded": T.BinaryType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, outputs=("n_tokens", "ids")) -> DataFrame:
    """Add `outputs` (names of OUTPUTS) to the columns `keep` (all if None): the ids of each text, the bytes they decode to, or
    digests of both (of the decimal ids joined by a space; of the decoded bytes). A kept column with an output's name is replaced."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in outputs]
    inner = df.select(df[text].cast("string").alias("__text"), *[df[c] for c in keep])
    schema = T.StructType([f for f in inner.schema.fields if f.name != "__text"] + [T.StructField(o, OUTPUTS[o], False) for o in outputs])

    def run(batches):
        codec = Codec(path, pattern)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            got: dict[str, list] = {o: [] for o in outputs}
            for e in codec.encode([t or "" for t in batch.column(0).to_pylist()]):
                ids = e.tolist()
                if "n_tokens" in got:
                    got["n_tokens"].append(len(ids))
                if "ids" in got:
                    got["ids"].append(e)
                if "ids_sha256" in got:
                    got["ids_sha256"].append(hashlib.sha256(codec.names(ids).encode()).hexdigest())
                if "decoded" in got or "decoded_sha256" in got:
                    raw = codec.decode(ids)
                    if "decoded" in got:
                        got["decoded"].append(raw)
                    if "decoded_sha256" in got:
                        got["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}
            columns = batch.columns[1:] + [pa.array(got[o], types.get(o, pa.string())) for o in outputs]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return inner.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that an array of ids stands for; null for a null array."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.BinaryType())])
    at, names = df.columns.index(ids), [f.name for f in schema.fields]
    kept = [i for i, c in enumerate(df.columns) if c != out]

    def run(batches):
        bytes_of = {v: k for k, v in load_ranks(path).items()}
        for batch in batches:
            raw = [None if x is None else b"".join(map(bytes_of.__getitem__, x)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [pa.array(raw, pa.binary())], names)

    return df.mapInArrow(tidy(run), schema)
