"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Candidates: each of SKETCHES hash functions picks the PICKS smallest of a text's 5-word shingles, labelled by occurrence, and keeps them
in text order; two texts with the same ordered picks share a bucket. Collisions become likelier with edit similarity, not only with
overlap. Verification: a banded alignment of the two texts' words; with L aligned equal words of n and m, similarity is
L / (n + m - L), and 0.8 or more links them (a tenth of the words of a text replaced gives 0.82). Classes are the connected components
of the links.

Scale: equal texts collapse first (only digests are shuffled), so copies never meet in a bucket. First each text of a bucket is paired
with two leaders, the one that shares most buckets overall (the hub of its group) and one drawn by a hash of the bucket. A leader with
many members is repeated over parts of at most PART_ROWS members or so, and each task streams members past one leader at a time. Then
all pairs of a bucket that the leaders left in different components are tested: pair by pair where a bucket has at most SMALL texts, and
by tiles, blocks of some PART_ROWS texts against blocks, in larger ones, where those of the most frequent component meet the others only;
a tile counts equal words first, which bounds the alignment from above. So texts that share a bucket are either linked by a chain or tested with each other. Joins on a digest, a bucket, a vertex
or a class spread frequent values over salts. Components are found by alternating star contractions on tables; nothing is collected but
two numbers a round.

Defined results: a null text counts as empty; texts without words are equal if their characters are; texts of fewer than five words
have one shingle; repeated rows are copies of each other; a class is named by the smallest id in it, null ids last.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, clear, last, mark, maybe, mix, shingles, spread, tidy, token_hash, word_hashes, written

SHINGLE = 5
SKETCHES, PICKS = 20, 2
PART_ROWS, SMALL = 512, 32
SEEN = 100_000  # rows that a task remembers at a time, to read repeated rows once
SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def occurrence(s: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    fresh = np.concatenate(([True], t[1:] != t[:-1]))
    if fresh.all():
        return np.zeros(len(s), np.uint64)
    at = np.arange(len(s))
    out = np.empty(len(s), np.uint64)
    out[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """One bucket key per hash function: the hash of the picked shingles in text order."""
    n = len(s)
    if n == 0:
        return s
    u = mix(s + occurrence(s) * np.uint64(0xD6E8FEB86659FD93))
    keys, step = [], max(1, 2_000_000 // n)
    for at in range(0, SKETCHES, step):
        v = (u[None, :] ^ SEEDS[at : at + step, None]) * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(29)
        if n > PICKS:
            picks = np.sort(np.argpartition(v, PICKS - 1, axis=1)[:, :PICKS], axis=1)
        else:
            picks = np.broadcast_to(np.arange(n), (len(v), n))
        key = SEEDS[at : at + step].copy()
        for j in range(picks.shape[1]):
            key = mix(key + s[picks[:, j]])
        keys.append(key)
    return np.concatenate(keys)


def hashed(text: str | None, memo: Memo) -> tuple[np.ndarray, bytes]:
    """The words of a text, and a digest of them."""
    h = word_hashes(text or "", memo)
    return h, xxhash.xxh3_128_digest(h.tobytes() if len(h) else b"\0" + (text or "").encode())


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32), pa.array(np.concatenate(parts) if parts else [], kind))


def sketches(df: DataFrame, key: str, text: str, carry=()) -> DataFrame:
    """Per row: a digest of its words, its length in words, and bucket keys."""
    inner = df.select(F.col(text).cast("string").alias("__text"), F.col(key).alias("__key"), F.monotonically_increasing_id().alias("__row"), *[F.col(c) for c in carry])
    kinds = {"__digest": T.BinaryType(), "__n": T.IntegerType(), "__keys": T.ArrayType(T.LongType())}
    schema = T.StructType(inner.schema.fields[1:] + [T.StructField(k, v) for k, v in kinds.items()])

    def run(batches):
        memo = Memo(token_hash)
        for batch in batches:
            digest, n, keys = [], [], []
            for raw in batch.column(0).to_pylist():
                h, d = hashed(raw, memo)
                digest.append(d)
                n.append(len(h))
                keys.append(sketch(shingles(h, SHINGLE)).view(np.int64))
            yield pa.RecordBatch.from_arrays(batch.columns[1:] + [pa.array(digest, pa.binary()), pa.array(n, pa.int32()), lists(keys, pa.int64())], [f.name for f in schema.fields])

    return inner.mapInArrow(tidy(run), schema)


def sequences(df: DataFrame, mark: str, text: str) -> DataFrame:
    """(mark, __digest, __seq): the words of each text as 32-bit numbers. Rows equal in mark and words mostly come once a task; who reads
    on must not mind repeats."""
    inner = df.select(F.col(text).cast("string").alias("__text"), F.col(mark))

    def run(batches):
        memo, seen = Memo(token_hash), set()
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            marks, digest, seq = [], [], []
            for raw, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s, d = hashed(raw, memo)
                if (m, d) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((m, d))
                marks.append(m)
                digest.append(d)
                seq.append((s >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(digest, pa.binary()), lists(seq, pa.int32())], [mark, "__digest", "__seq"])

    return inner.mapInArrow(tidy(run), f"`{mark}` long, __digest binary, __seq array<int>")


class Leader:
    """One sequence, ready to be aligned with others."""

    def __init__(self, seq: np.ndarray):
        self.seq, self.n = seq, len(seq)
        self.at: dict[int, list[int]] = {}
        for i, x in enumerate(seq.tolist()):
            self.at.setdefault(x, []).append(i)

    def aligned(self, other: np.ndarray, band: int, need: int = 0) -> int:
        """Longest common subsequence with partners at most `band` places apart, a bit per place of the band. Row by row the window
        slides by one; a zero bit is a place that lengthens the alignment, and those that leave the window are counted. Every 32 rows it
        gives up (-1) where the rows left cannot make up `need`."""
        n, m = self.n, len(other)
        width = 2 * band + 1
        full = (1 << width) - 1
        v, low, gone = full, -band, 0  # bit b of v stands for place low + b
        for i, x in enumerate(other.tolist()):
            if i:
                if not i & 31 and gone + width - v.bit_count() + m - i < need:
                    return -1
                gone += 1 - (v & 1)
                v = v >> 1 | 1 << (width - 1)
                low += 1
            places = self.at.get(x)
            if places is None:
                continue
            if len(places) == 1:
                b = places[0] - low
                hit = 1 << b if 0 <= b < width else 0
            else:
                hit = 0
                for p in places[bisect_left(places, low) :]:
                    if p - low >= width:
                        break
                    hit |= 1 << (p - low)
            if hit:
                u = v & hit
                v = (v + u | v - u) & full
        return gone + width - v.bit_count()

    def similar(self, other: np.ndarray) -> bool:
        n, m = self.n, len(other)
        if not n or 5 * min(n, m) < 4 * max(n, m):
            return False
        need = least(n, m)
        slack = n + m - 2 * need
        return self.aligned(other, slack, need) >= need


def least(n, m):
    """The least L with L / (n + m - L) >= 4/5, in whole numbers."""
    return -(-4 * (n + m) // 9)


def tested(ids: np.ndarray, roots: np.ndarray, sides: np.ndarray, seqs: list[np.ndarray]) -> list[tuple[int, int]]:
    """The links of a tile between rows of side 0 and rows of side 1 (side 2: both) with different roots. A link makes its roots one, so
    links that a chain already gives are left out; all else is tested."""
    n = np.array([len(s) for s in seqs])
    labelled = [mix(s.view(np.uint32).astype(np.uint64) + (occurrence(s) << np.uint64(32))) for s in seqs]
    at = np.unique(np.concatenate(labelled), return_inverse=True)[1]
    at = np.split(at, np.cumsum(n)[:-1])
    right = np.flatnonzero(sides > 0)
    flat, starts = np.concatenate([at[i] for i in right]), np.cumsum(n[right]) - n[right]
    mark = np.zeros(max(int(a.max()) for a in at) + 1, bool)
    roots, found = roots.copy(), []
    for i in np.flatnonzero(sides != 1):
        fit = (roots[right] != roots[i]) & (5 * np.minimum(n[right], n[i]) >= 4 * np.maximum(n[right], n[i]))
        if sides[i] == 2:
            fit &= ids[right] > ids[i]
        if not fit.any():
            continue
        mark[at[i]] = True
        fit &= np.add.reduceat(mark[flat], starts, dtype=np.int64) >= least(n[right], n[i])
        mark[at[i]] = False
        lead = Leader(seqs[i]) if fit.any() else None
        for j in right[fit]:
            if roots[j] != roots[i] and lead.similar(seqs[j]):
                found.append((int(ids[i]), int(ids[j])))
                roots[roots == roots[j]] = roots[i]
    return found


def dealt(roles: DataFrame, reps: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """roles: id and other columns; reps: id, __digest and key of one row of each distinct text of df. The other columns and seq, the
    sequence of the id's text. Sequences are made anew from the texts that have a role, so none are stored."""
    cols = [c for c in roles.columns if c != "id"]
    roles = written(roles.join(reps.select("id", "__digest", F.xxhash64("key").alias("__mark")), "id").drop("id"), "roles")
    some = maybe(df.select(F.col(text), F.xxhash64(F.col(key)).alias("__mark")), "__mark", roles.select("__mark"), "__in").where("__in")
    return sequences(some, "__mark", text).join(roles, ["__mark", "__digest"]).select(*cols, F.col("__seq").alias("seq"))


def links(pairs: DataFrame, reps: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """pairs: leader, member, parts. Those pairs whose alignment is similar enough, as (u, v)."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    leaders = pairs.select("leader", "parts", "part").distinct().withColumn("member", F.lit(-1).cast("long")).withColumn("id", F.col("leader"))
    cols = ["leader", "parts", "part", "member", "id"]
    roles = leaders.select(cols).unionByName(pairs.withColumn("id", F.col("member")).select(cols))
    rows = dealt(roles, reps, df, key, text).repartition("leader", "parts", "part").sortWithinPartitions("leader", "parts", "part", "member")

    def run(batches):
        now, lead, last = None, None, None
        for batch in batches:
            c = {n: batch.column(n) for n in ("leader", "parts", "part", "member")}
            c = {n: x.to_numpy(zero_copy_only=False) for n, x in c.items()}
            seqs = batch.column("seq")
            flat, ends = seqs.values.to_numpy(zero_copy_only=False), seqs.offsets.to_numpy()
            us, vs = [], []
            for i in range(batch.num_rows):
                s, member = flat[ends[i] : ends[i + 1]], int(c["member"][i])
                if member < 0:  # sorts before the members
                    if now != c["leader"][i]:
                        now, lead = c["leader"][i], Leader(s.copy())
                elif last != (now, member):
                    last = (now, member)
                    if lead.similar(s):
                        us.append(int(now))
                        vs.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return rows.mapInArrow(tidy(run), "u long, v long")


def buckets(reps: DataFrame) -> DataFrame:
    """reps: __row, __n, __keys, one row a distinct text. (key, id, n, c) for the buckets that more than one text shares."""
    at = reps.where("__n > 0").select(F.col("__row").alias("id"), F.col("__n").alias("n"), F.explode("__keys").alias("key"))
    shared = written(at.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    return written(spread(at, shared, "key", "c", "id"), "buckets")


def candidates(at: DataFrame) -> DataFrame:
    """Pairs (leader, member) of the buckets with the number of parts to deal the leader's over."""
    hub = at.groupBy("id").agg(F.sum("c").alias("hub"))
    ranked = at.join(hub, "id")
    one = F.struct("hub", (-F.col("id")).alias("id"), "n")
    other = F.struct(F.xxhash64("id", "key").alias("hub"), (-F.col("id")).alias("id"), "n")
    lead = ranked.groupBy("key").agg(F.max(one).alias("one"), F.max(other).alias("other"), F.max("c").alias("w"))
    pairs = spread(at, written(lead, "leaders"), "key", "w", "id").select("id", "n", "c", F.explode(F.array("one", "other")).alias("l")).select(F.col("id").alias("member"), "n", "c", (-F.col("l.id")).alias("leader"), F.col("l.n").alias("m"))
    pairs = pairs.where((F.col("leader") != F.col("member")) & (5 * F.least("n", "m") >= 4 * F.greatest("n", "m")))
    return pairs.groupBy("leader", "member").agg(F.ceil(F.max("c") / PART_ROWS).cast("int").alias("parts"))


def apart(at: DataFrame, root: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tiles that cover the pairs of the buckets whose texts have different roots, as rows (tile, i, j, side, id, root)."""
    at = at.drop("c").join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open = at.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    at = written(spread(at, written(open.select("key", "c"), "open"), "key", "c", "id"), "apart")
    side = lambda v: [F.col(f"{v}.{c}").alias(f"{v}_{c}") for c in ("id", "root")]
    few = at.where(F.col("c") <= SMALL)
    few = few.alias("u").join(few.alias("v"), "key").where("u.id < v.id and u.root != v.root and 5 * least(u.n, v.n) >= 4 * greatest(u.n, v.n)").select(*side("u"), *side("v")).distinct()
    done = pairs.select(F.least("leader", "member").alias("u_id"), F.greatest("leader", "member").alias("v_id"))
    few = few.join(done, ["u_id", "v_id"], "left_anti")
    none = [F.lit(-1).alias("i"), F.lit(-1).alias("j")]
    first = few.select(F.col("u_id").alias("tile"), *none, F.lit(0).alias("side"), F.col("u_id").alias("id"), F.col("u_root").alias("root")).distinct()
    second = few.select(F.col("u_id").alias("tile"), *none, F.lit(1).alias("side"), F.col("v_id").alias("id"), F.col("v_root").alias("root"))
    return first.unionByName(second).unionByName(crowded(at.where(F.col("c") > SMALL)))


def crowded(at: DataFrame) -> DataFrame:
    """Tiles for buckets of many texts: key, id, root. Texts of a bucket's most frequent root meet the rest alone, so rows grow with the
    square of what the leaders left apart, not of the bucket."""
    at = at.select(F.col("key").alias("tile"), "id", "root")
    roots = at.groupBy("tile", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("tile").agg(F.sum("k").alias("c"), F.max(F.struct("k", "root")).alias("most"))
    at = spread(at, written(roots, "roots"), "tile", "c", "id")
    parts = lambda n: F.ceil(n / PART_ROWS).cast("int")
    rest, main = parts(F.col("c") - F.col("most.k")), parts(F.col("most.k"))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    block = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cols = lambda side: ["tile", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), side.alias("side"), "id", "root"]
    which = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)
    left = at.where("root != most.root").withColumn("own", own(rest)).withColumn("with", block(rest + main)).select(*cols(which))
    right = at.where("root = most.root").withColumn("own", rest + own(main)).withColumn("with", block(rest)).select(*cols(F.lit(1)))
    return left.unionByName(right)


def missed(tiles: DataFrame, reps: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """The links in the tiles, as (u, v)."""
    tiles = tiles.withColumn("one", F.col("id"))
    rows = dealt(tiles, reps, df, key, text).repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")

    def run(batches):
        now, held = None, {}

        def out():
            rows = list(held.values())
            ids, roots, sides = (np.array([h[k] for h in rows]) for k in range(3))
            found = tested(ids, roots, sides, [h[3] for h in rows]) if (sides != 1).any() and (sides > 0).any() else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["u", "v"])

        for batch in batches:
            c = [batch.column(n).to_pylist() for n in ("tile", "i", "j", "one", "root", "side")]
            seqs = batch.column("seq")
            flat, ends = seqs.values.to_numpy(zero_copy_only=False), seqs.offsets.to_numpy()
            for k, (tile, i, j, *row) in enumerate(zip(*c, strict=True)):
                if now != (tile, i, j):
                    if held:
                        yield out()
                    now, held = (tile, i, j), {}
                held[row[0]] = (*row, flat[ends[k] : ends[k + 1]].copy())
        if held:
            yield out()

    return rows.mapInArrow(tidy(run), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) → (id, root): each vertex with the smallest of its component. Large-star and small-star by turns, each round a
    table, until the edges no longer change."""
    flat = lambda d: d.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    sign = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    spark = edges.sparkSession
    edges = written(flat(edges), "links")
    before = sign(edges)
    while before[0]:
        old = mark()
        both = edges.union(edges.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("c")), "least")
        edges = written(flat(spread(both.where("v > u"), least, "u", "c", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        least = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")), "least")
        small = spread(edges, least, "u", "c", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = written(flat(small), "links")
        clear(spark, last(), old)
        now = sign(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", carry=()) -> DataFrame:
    """One row per input row: `carry`, key, class_id (smallest key of the class), n_copies (rows with the same words), keeper (true for
    one row of each class: the first by key)."""
    rows = written(sketches(df, key, text, carry), "sketches")
    rank = F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key"), F.col("__row").alias("row"))
    same = written(rows.groupBy("__digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n_copies")).withColumn("id", F.col("first.row")), "copies")
    reps = rows.select("__row", "__n", "__keys").join(same.select(F.col("id").alias("__row")), "__row", "left_semi")
    known = same.select("id", "__digest", F.col("first.key").alias("key"))
    at = buckets(reps)
    pairs = written(candidates(at), "pairs")
    led = components(links(pairs, known, df, key, text))  # (id, root): a star, so the links of the second pass can be added to it
    root = led.union(led.select("root", "root").distinct())
    rest = missed(apart(at, root, pairs), known, df, key, text)
    root = components(led.toDF("u", "v").union(rest))
    root = root.union(root.select("root", "root").distinct())
    linked = same.select("id", "first").join(root, "id")  # texts without a link are their own class and take no further part
    best = written(linked.groupBy("root").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("c")), "classes")
    best = spread(linked.select("id", "root"), best, "root", "c", "id").select("id", "best")
    named = written(same.join(best, "id", "left").select("__digest", "n_copies", F.coalesce("best", "first").alias("best")), "named")
    out = spread(rows.select("__row", "__key", "__digest", *carry), named, "__digest", "n_copies", "__row")
    return out.select(*[c for c in carry if c != key], F.col("__key").alias(key), F.col("best.key").alias("class_id"), "n_copies", (F.col("__row") == F.col("best.row")).alias("keeper"))


def distinct(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df without near copies: one row of each class, with all its columns. Rows are known by key and a digest of the text,
    so the text is neither stored again nor carried through the search; of rows equal in both, one stays. A row that the bitmap of dropped
    rows misses stays; one that it has and the bitmap of spared rows misses goes; the few in both are looked up."""
    marked = df.withColumn("__mark", F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text).cast("string"), F.lit(7)).alias("digest")))
    found = classes(marked, key, text, carry=("__mark",)).groupBy("__mark").agg(F.max("keeper").alias("keeper"), F.count(F.lit(1)).alias("n"))
    found = written(found, "keepers")
    gone = found.where("not keeper or n > 1").select("__mark")
    spared = maybe(found.where("keeper"), "__mark", gone, "__gone").where("__gone").select("__mark")
    marked = maybe(maybe(marked, "__mark", gone, "__gone"), "__mark", spared, "__spared", seed=1)
    keep = found.where("keeper").select(F.col("__mark.id").alias("__id"), F.col("__mark.digest").alias("__digest"))
    same = F.col("__mark.id").eqNullSafe(F.col("__id")) & (F.col("__mark.digest") == F.col("__digest"))
    doubt = marked.where("__gone and __spared").join(keep, same, "left_semi").dropDuplicates(["__mark"])  # only these are shuffled with their text
    return marked.where("not __gone").unionByName(doubt).drop("__mark", "__gone", "__spared")
