"""Each operator against brute force, exact round trips or planted cases, on odd rows and on empty tables."""

import random
import re

import numpy as np
import pytest

from ledgerlark.llm import bpe, common, decontam, langid, lm, neardup, pii, quality, secrets, sharding, toxicity

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")
N_ODD = 15


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


SECRETS = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(SECRETS, t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark, odd, empty):
    rng = random.Random(1)
    bits = ["token=", 'secret: "', "PassWord :", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef01234567", " ", "é😀", "api-key=", "api_key='", "zz", "="]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)]
    got = {r.doc_id: [(s.start, s.rank, s.kind, s.end) for s in r.spans if s.kind != "owned"] for r in secrets.scan(docs(spark, texts)).collect()}
    assert got == {i: brute_secrets(t) for i, t in enumerate(texts)}
    assert secrets.scan(odd).count() == N_ODD and secrets.scan(empty).count() == 0


def test_secret_ownership(spark):
    rows = [(i, "token=copiedexample", f"o{i}") for i in range(5)] + [(9, "token=mineonly99", "o1"), (10, "Zx81" * 10, "o1")]
    got = {r.doc_id: [(s.kind, s.verdict) for s in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == [("assign", "copied")] and got[9] == [("assign", "live")] and got[10] == [("owned", "live")]
    rows = [(i, "token=onesource1", "o1") for i in range(20)] + [(30, "AWS_KEY=" + "Qx71" * 10 + " token=" + "Rx71" * 10, "o2")]
    got = {r.doc_id: [(s.kind, s.verdict, s.n_owners, s.n_repos) for s in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3] == [("assign", "copied", 1, 20)] and got[30] == [("owned", "live", 1, 1), ("assign", "live", 1, 1)]


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    def ok(k, h):
        d = re.sub("[^0-9]", "", h)
        return {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in h.split(".")), "card": 13 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[k]

    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, t) if ok(k, m[0])]


def test_pii(spark, odd, empty):
    rng = random.Random(2)
    bits = ["a.b", "@", "c-d.com", ".", "1.2.3.4", "255.", "4111 1111 1111 1111", "+33 6 12 34 56 78", "(0)", " ", "-", "é😀", "4242424242424242", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii if s.kind in pii.BASE] for r in pii.detect(docs(spark, texts)).collect()}
    assert got == {i: brute_pii(t) for i, t in enumerate(texts)}
    one = pii.detect(docs(spark, ["account GB82 WEST 1234 5698 7654 32, ssn 123-45-6789", "GB82 WEST 1234 5698 7654 33, no 123-45-6789"])).orderBy("doc_id").collect()
    assert [s.kind for s in one[0].pii] == ["iban", "national_id"] and not one[1].pii
    assert pii.redact(docs(spark, ["to a@b.com or 10.0.0.1"])).first().text == "to <EMAIL> or <IP>"
    assert pii.detect(odd).count() == N_ODD and pii.redact(odd).count() == N_ODD and pii.detect(empty).count() == 0


def test_sharding(spark, odd, empty, tmp_path):
    rng = random.Random(3)
    d = docs(spark, [words(rng, rng.randrange(300)) for _ in range(2000)])
    got = sharding.assign(d, 8, map_path=str(tmp_path / "map")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() < 1.02 * sizes.min() and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    old = sharding.SlotMap.stored(spark, str(tmp_path / "map"))
    new = old.rebalanced(9)
    moved = [s for s in old.owner if old.owner[s] != new.owner[s]]
    assert new.version == 2 and {new.owner[s] for s in moved} == {8} and len(moved) < 0.2 * len(old.owner)
    new.store(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.stored(spark, str(tmp_path / "map")).owner == new.owner
    again = sharding.assign(d, 8, map_path=str(tmp_path / "map")).toPandas().set_index("doc_id")  # the stored version decides
    assert again.shard.to_dict() == {r.doc_id: new.owner[r.virtual_slot] for r in got.itertuples()} and set(again.shard) == set(range(9))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in again.groupby("shard"))
    first = sharding.assign(d, map_path=str(tmp_path / "map"), version=1).toPandas().set_index("doc_id")
    assert first.shard.to_dict() == got.set_index("doc_id").shard.to_dict()
    assert sorted(sharding.assign(odd, 8).toPandas()["size"])[:2] == [1, 1] and sharding.assign(empty, 8).count() == 0


def test_toxicity(spark, odd, empty):
    rng = random.Random(4)
    texts = [words(rng, 60) + (" insult group insult" if i % 5 == 0 else "") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.learn(docs(spark, texts), labels)
    got = toxicity.score(docs(spark, texts), model).toPandas()
    held = got[got.doc_id >= 400]
    assert ((held.score >= toxicity.THRESHOLD) == (held.doc_id % 5 == 0)).all()
    scored = toxicity.score(odd, model)
    assert scored.count() == N_ODD and scored.columns.count("score") == 1
    none = toxicity.learn(docs(spark, texts), labels.limit(0))
    assert toxicity.score(empty, none).count() == 0 and toxicity.score(odd, none).count() == N_ODD


def test_toxicity_pair(spark):
    """Two of four pairings of two insults with two groups are toxic, crosswise, so every word stands in as many toxic as clean texts: no
    sum of weights tells them apart (three of four right at best), interactions do."""
    rng = random.Random(24)
    kinds = [" zorg vron", " blim quux", " zorg quux", " blim vron"]
    texts = [words(rng, 20, 200) + k for _ in range(600) for k in kinds]
    labels = spark.createDataFrame([(i, int(i % 4 > 1)) for i in range(2000)], "doc_id long, toxic int")
    model = toxicity.learn(docs(spark, texts), labels)
    got = toxicity.score(docs(spark, texts), model).toPandas()
    held = got[got.doc_id >= 2000]
    assert ((held.score >= 0.5) == (held.doc_id % 4 > 1)).mean() >= 0.9


def brute_lm(train, texts, m):
    """log10 probabilities by dicts, one token at a time, given the class weights; and for some histories the sum over all slots."""
    import xxhash

    hashed = lambda w: lm.END if w is None else max(2, xxhash.xxh64_intdigest(w.encode()))
    own = dict(zip(m.own.tolist(), m.own_slot.tolist(), strict=True))

    def slot(w):
        h = hashed(w)
        return own[h] if h in own else int(lm.shared_slot(np.array([h], np.uint64), np.array([xxhash.xxh32_intdigest(w.encode()[-2:]) % lm.ENDINGS]), m.most)[0])

    count, pairs = {}, {}
    for t in train:
        for a, w in zip([0, *map(hashed, t)], t, strict=False):
            count[w] = count.get(w, 0) + 1
            pairs[a, slot(w)] = pairs.get((a, slot(w)), 0) + 1
    mass = np.zeros(lm.SLOTS)
    mass[m.most + 1 : m.most + 1 + lm.ENDINGS * lm.shared_slots(m.most)] = 1
    for w, c in count.items():
        mass[slot(w)] += c + 1
    of = np.bincount(m.kind, mass, lm.CLASSES)

    def classes(h, at):
        one, two = np.uint64(h[at - 1] if at else 0), np.uint64(h[at - 2] if at > 1 else 0)
        x, low = lm.mix, np.uint64(lm.BUCKETS - 1)
        rows = [int((x(v) & low)[0]) + k * lm.BUCKETS for k, v in enumerate((np.array([one + np.uint64(11)]), x(np.array([one + np.uint64(13)])) + two, np.array([two + np.uint64(17)])))]
        z = m.w[:, rows].astype(float).sum(1) + np.log(of / of.sum())
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    out, sums = [], []
    with np.errstate(over="ignore"):
        for k, t in enumerate(texts):
            h, total = [hashed(w) for w in t], 0.0
            for at, w in enumerate(t):
                p, s, before = classes(h, at), slot(w), h[at - 1] if at else 0
                seen = {q: c for (a, q), c in pairs.items() if a == before and m.kind[q] == m.kind[s]}
                inside = lambda q: (seen.get(q, 0) + max(1, len(seen)) * mass[q] / of[m.kind[q]]) / (sum(seen.values()) + max(1, len(seen)))  # noqa: E731, B023
                if k < 3 and at < 3:
                    sums.append(sum(inside(q) for q in np.flatnonzero((m.kind == m.kind[s]) & (mass > 0))) * p.sum())
                total += np.log10(p[m.kind[s]] * inside(s) * ((count.get(w, 0) + 1) / mass[s] if s > m.most else 1))
            out.append(total)
    return out, sums


def test_lm(spark, odd, empty):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    texts = ["The cat " * rng.randrange(1, 30) + words(rng, rng.randrange(80)) for _ in range(60)] + ["new words only", "the new cat"]
    d, on = docs(spark, texts), F.col("doc_id") < 50
    out, model = lm.score(d, on)
    got = out.toPandas().sort_values("doc_id")
    each = [[w.lower() for w in t.split()] + [None] for t in texts]
    c = {}
    for t in each[:50]:
        for w in t:
            c[w] = c.get(w, 0) + 1
    n = sum(c.values())
    assert model.total == n and np.allclose(got.base_score, [sum(np.log10((c.get(w, 0) + 1) / (n + len(c) + 1)) for w in t) for t in each])
    assert got.n_known.tolist() == [sum(w in c for w in t) for t in each] and got.n_tokens.tolist() == [len(t) for t in each]
    want, sums = brute_lm(each[:50], each, model)
    assert np.allclose(got.score, want, atol=2e-3) and np.allclose(sums, 1) and got.score.sum() > got.base_score.sum() + 100
    many, _ = lm.score(d.repartition(7), on)
    assert np.allclose(many.toPandas().sort_values("doc_id").score, got.score, atol=1e-3)
    out = lm.score(odd, F.col("doc_id") > 3)[0].toPandas()
    assert len(out) == N_ODD and out.n_tokens.min() == 1 and np.isfinite(out.score).all()
    clash = odd.withColumn("chunk", F.lit(1)).withColumn("rows", F.lit("x")).withColumn("counts", F.lit(2))
    assert lm.score(clash, F.lit(False), keep=("chunk", "rows", "counts"))[0].where("chunk = 1 and rows = 'x' and counts = 2").count() == N_ODD
    assert lm.score(empty, F.lit(True))[0].count() == 0


def test_lm_own_slots(spark):
    """With room for few own slots, most tokens share slots: scores are still those of brute force."""
    from pyspark.sql import functions as F

    rng = random.Random(15)
    texts = [words(rng, rng.randrange(5, 60), 300) for _ in range(40)]
    out, model = lm.score(docs(spark, texts), F.col("doc_id") < 30, own=40)
    each = [[*t.split(), None] for t in texts]
    want, sums = brute_lm(each[:30], each, model)
    assert np.allclose(out.toPandas().sort_values("doc_id").score, want, atol=2e-3) and np.allclose(sums, 1)


def test_decontam(spark, odd, empty):
    rng = random.Random(6)
    items = [words(rng, n, 10_000) for n in (40, 60, 12, 3)]
    hidden = [words(rng, rng.randrange(1500), 10_000) + " " + items[i % 4].upper() + ". " + words(rng, rng.randrange(1500), 10_000) for i in range(40)]
    texts = hidden + [words(rng, 800, 10_000) for _ in range(20)] + [" ".join(items[0].split()[:25])]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in decontam.leaks(docs(spark, texts), bench).collect()}
    assert got == {(i % 4, i) for i in range(40)}
    assert sorted(r.doc_id for r in decontam.clean(docs(spark, texts), bench).collect()) == list(range(40, 61))
    assert decontam.leaks(odd, bench).count() == 0 and decontam.clean(odd, bench).count() == N_ODD and decontam.leaks(empty, bench).count() == 0
    assert decontam.leaks(odd, bench.limit(0)).count() == 0


def lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_alignment():
    rng = random.Random(7)
    for _ in range(200):
        a = np.array([rng.randrange(12) for _ in range(rng.randrange(1, 40))], np.int32)
        b = np.array([x for x in a if rng.random() > 0.1] + [3] * rng.randrange(4), np.int32)
        length = lcs(a, b)
        assert neardup.Leader(a).aligned(b, 80) == length
        assert neardup.Leader(a).similar(b) == (5 * length >= 4 * (len(a) + len(b) - length))


def test_neardup(spark, odd, empty):
    rng = random.Random(8)
    texts, want = [], []
    for g in range(60):
        base = words(rng, rng.randrange(80, 400), 50_000).split()
        for k in range(1 + g % 5):
            t = list(base)
            if k:
                t[rng.randrange(len(t))] = "edited"
            texts.append(" ".join(t) if k % 2 else " ".join(t).title())
            want.append(g)
    got = neardup.classes(docs(spark, texts)).toPandas().sort_values("doc_id")
    first = {g: want.index(g) for g in set(want)}
    assert got.class_id.tolist() == [first[g] for g in want] and got.keeper.sum() == 60
    assert sorted(r.doc_id for r in neardup.distinct(docs(spark, texts)).collect()) == sorted(first.values())
    out = neardup.classes(odd).toPandas()
    assert len(out) == N_ODD and out[out.keeper].shape[0] == neardup.distinct(odd).count()
    assert neardup.classes(empty).count() == 0


def test_neardup_crowd(spark):
    """300 shingles that all texts share and 50 of their own: 0.75 between any two, 0.81 in the planted pairs, which share 13 more."""
    rng = random.Random(11)
    frame, texts = words(rng, 304, 500_000), []
    for _ in range(60):
        pair = f"{frame} {words(rng, 13, 500_000)}"
        texts += [f"{pair} {words(rng, 37, 500_000)}" for _ in range(2)]
    got = neardup.classes(docs(spark, texts)).toPandas().sort_values("doc_id")
    assert got.class_id.tolist() == [i - i % 2 for i in range(len(texts))]


def test_neardup_crowded_rows(spark):
    """A crowd that the leaders made one, with a few others: each meets the few once, and every pair of two roots shares a tile."""
    from pyspark.sql import functions as F

    n, few = 4 * neardup.PART_ROWS, 3
    at = spark.range(n + few).select(F.lit(7).cast("long").alias("key"), "id", F.when(F.col("id") < n, 0).otherwise(F.col("id")).alias("root"))
    rows = neardup.crowded(at).toPandas()
    assert len(rows) <= n + few * 8
    met = {x: set(rows[rows.id == x][["i", "j"]].apply(tuple, axis=1)) for x in (*range(n, n + few), *range(0, n, 100))}
    assert all(met[x] & met[y] for x in range(n, n + few) for y in met)


def test_neardup_edits(spark):
    """Words replaced, dropped or added at 1 to 10 %: of the pairs at 0.8 or more by an unbanded alignment, at least 0.95 are found; of
    those below, none is linked."""
    rng = random.Random(12)
    texts, sim = [], []
    for rate in (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.2):
        for _ in range(20):
            a = words(rng, rng.randrange(60, 200), 50_000).split()
            b = []
            for w in a:
                x = rng.random() / rate
                b += [w] if x > 1 else [f"w{rng.randrange(50_000)}"] if x < 0.7 else [] if x < 0.85 else [w, "added"]
            ids = {w: i for i, w in enumerate({*a, *b})}
            n = lcs(np.array([ids[w] for w in a]), np.array([ids[w] for w in b]))
            sim.append(n / (len(a) + len(b) - n))
            texts += [" ".join(a), " ".join(b)]
    got = neardup.classes(docs(spark, texts)).toPandas().sort_values("doc_id").class_id.to_numpy()
    linked = got[1::2] == got[::2]
    sim = np.array(sim)
    assert linked[sim >= 0.8].mean() >= 0.95 and not linked[sim < 0.8].any() and (got[::2] == np.arange(0, len(texts), 2)).all()


def test_neardup_repeated_rows(spark):
    """Rows without an id, equal in all, among near copies: every row gets its class and one row of it is kept."""
    rng = random.Random(13)
    a = words(rng, 80, 50_000)
    b = a.replace(a.split()[40], "edited")
    d = spark.createDataFrame([(None, a)] * 30 + [(None, b)] * 30 + [(5, b), (5, b)], "doc_id long, text string")
    got = neardup.classes(d).toPandas()
    assert len(got) == 62 and (got.class_id == 5).all() and got.keeper.sum() == 1 and neardup.distinct(d).count() == 1


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    root = {r.id: r.root for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    assert all(root.get(i, i) == find(i) for i in range(300))


def test_quality(spark, odd, empty):
    rng = random.Random(10)
    texts = [words(rng, rng.randrange(60), rng.choice((5, 50, 5000))) + "\nsame line\nsame line\n \n" * (i % 3) + "#" * (i % 7) for i in range(200)]
    got = {r.doc_id: r for r in quality.cascade(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        rep = len({j + k for j, x in enumerate(win) if win.count(x) > 1 for k in range(5)})
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep)
        assert r.base_failed == (len(w) < 10 or 100 * rep > 20 * len(w)) and not (r.base_failed and r.kept)
    a, b = ([r.kept for r in quality.cascade(docs(spark, texts), order=o).orderBy("doc_id").collect()] for o in ([r.name for r in quality.RULES], [r.name for r in quality.RULES][::-1]))
    assert a == b
    assert quality.cascade(odd).count() == N_ODD and quality.cascade(empty).count() == 0


def test_langid(spark, odd, empty):
    texts = [("the cat and the dog of", "en"), ("le chat et le chien de la", "fr"), ("der hund und die katze", "de")] * 5
    labelled = spark.createDataFrame([(t, x) for t, x in texts] + [(None, None)], "text string, lang string")
    pages = spark.createDataFrame(
        [(1, "http://a.fr/x", "<html lang='fr'><p>le chat de la"), (2, "http://b.de/", "<p>und die katze"), (3, "http://a.fr/y", "<html lang=fr><p>"), (None, None, None), (2, "http://b.de/", "<p>und die katze")], "page_id long, url string, html string"
    )
    got = langid.identify(pages, labelled).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 5 and by[1].lang == "fr" and by[2].lang == "de" and by[3].lang == "fr" and by[3].text_lang is None
    assert langid.identify(pages, labelled.limit(0)).count() == 5 and langid.identify(pages.limit(0), labelled).count() == 0


def test_langid_many_and_own_text(spark):
    """A dozen languages; and a page whose text says another language than its host's other pages do."""
    codes = [a + b for a in "abc" for b in "klmn"]
    labelled = spark.createDataFrame([(f"{x}one {x}two {x}three", x.upper() + "-x") for x in codes] + [("?", "not a code")], "text string, lang string")
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", f"<p>{x}two {x}three {x}one") for i, x in enumerate(codes)], "page_id long, url string, html string")
    assert {r.page_id: r.lang for r in langid.identify(pages, labelled).collect()} == dict(enumerate(codes))
    two = labelled.where("lang in ('AK-x', 'BL-x')")
    rows = [(i, f"http://one.org/{i}", "<p>akone aktwo akthree") for i in range(30)] + [(99, "http://one.org/99", "<p>unknown")]
    got = {r.page_id: r for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), two).collect()}
    assert got[99].lang == "ak" and got[99].text_lang is None and got[0].lang == "ak"
    alone = langid.identify(spark.createDataFrame([(1, "http://solo.net/", "<html lang=bl><p>akone")], "page_id long, url string, html string"), two).first()
    assert alone.lang == "ak"  # its own text is the only evidence, and is not counted twice by its host, suffix or declaration


def test_bpe(spark, odd, empty):
    import tiktoken

    rng = random.Random(11)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    texts = ["".join(rng.choice("ab aé1'\n.tsre😀\x0b\x1c") for _ in range(rng.randrange(60))) for _ in range(400)] + ["a" * 3000, "", " ", " a", "a ", "a  b"]
    d = bpe.encode(docs(spark, texts), PATH, P.PATTERN, keep=["doc_id"])
    got = {r.doc_id: list(r.ids) for r in d.collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(d, PATH).collect()}
    assert back == {i: t.encode() for i, t in enumerate(texts)}
    assert bpe.encode(odd, PATH, P.PATTERN).count() == N_ODD and bpe.encode(empty, PATH, P.PATTERN).count() == 0


def test_bpe_other_pattern(spark):
    """A pattern with groups under which pre-tokens span blanks: whole texts are searched."""
    import tiktoken

    pattern = r"(\w+ \w+)|\s+|\S"
    enc = tiktoken.Encoding("own", pat_str=r"(?:\w+ \w+)|\s+|\S", mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    texts = ["one two three four", "a b  c d", "", "é è - x"]
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs(spark, texts), PATH, pattern, keep=["doc_id"]).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)} and bpe.WORDWISE == P.PATTERN


def test_find_spans_in_long_arrays(spark):
    d = spark.createDataFrame([("é1 " * 500,)], "t string").select(common.find_spans(__import__("pyspark").sql.functions.col("t"), "[0-9]").alias("s"))
    assert [x.start for x in d.first().s] == [3 * i + 1 for i in range(500)]
