"""The search index and its stored ranges, places on the sphere, entities, bands, histories, blocks from SQL."""

import html
import json
import math
import random
from html.entities import html5, name2codepoint

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions.text import ALL_NAMES, unescape
from ledgerlark.operators import classify, conform, index, state, status
from ledgerlark.sources import blocks, payloads, tables

SHOWS = "id long, date string, time string, is_music boolean, name string, venue string, area string, subgenres array<string>, genres array<string>"


def test_index(spark, tmp_path):
    rows = [
        (1, "2026-09-10", "21:00", True, "Éva Nova", "Le Bop", "10e", ["hard bop"], ["jazz"]),
        (2, "2026-09-05", None, True, "eva nova", "Le Bop", "11e", ["hard bop", "cool"], ["jazz", "soul"]),
        (3, "2026-09-05", "20:00", True, "Bop Trio", "Le Bop", "11e", [], ["jazz"]),
        (4, "2026-08-01", None, True, "Old Act", "Le Bop", "9e", ["swing"], ["jazz"]),
        (5, "2026-09-20", None, False, "A Talk", "Le Bop", "9e", ["talk"], ["jazz"]),
        (6, "2026-09-30", None, True, "Bop Trio", "Other Hall", None, [], []),
    ]
    e = spark.createDataFrame(rows, SHOWS)
    who, when = index.artists(e.select("id", "name"), e, "2026-09-01")
    assert {tuple(r) for r in who.select("key", "name", "n", "soonest").collect()} == {("eva nova", "eva nova", 2, "2026-09-05"), ("bop trio", "Bop Trio", 2, "2026-09-05")}
    assert [r.id for r in when.where("key = 'eva nova'").orderBy("date").collect()] == [2, 1]
    known = spark.createDataFrame([("Le Bop", None), ("Empty", "1er")], "name string, area string")
    v = index.venues(e, known, "2026-09-01")
    assert {tuple(r) for r in v.select("name", "n", "area").collect()} == {("Le Bop", 3, "11e"), ("Empty", 0, "1er"), ("Other Hall", 1, None)}
    s = index.styles(e, spark.createDataFrame([("bebop", "jazz"), ("swing", "")], "name string, genre string"), "2026-09-01")
    assert {tuple(r) for r in s.select("name", "n", "genre").collect()} == {("hard bop", 2, "jazz"), ("cool", 1, "jazz"), ("swing", 0, "jazz"), ("bebop", 0, "jazz")}
    g = index.genres(e, spark.createDataFrame([("jazz", "Jazz", "bop"), ("rock", "Rock", None)], "tag string, label string, aliases string"), "2026-09-01")
    assert {tuple(r) for r in g.select("name", "key", "n", "styles").collect()} == {("Jazz", "jazz jazz bop", 3, 3), ("Rock", "rock rock", 0, 0)}
    all_ = index.entries(artist=who, venue=v, style=s, genre=g)
    path = index.stored(all_, f"{tmp_path}/ends")
    ends = spark.read.parquet(path)
    got = [(r.group, r["rank"], r["name"], r.score) for r in index.suggest(ends, "  BOP ").orderBy("place", "rank").collect()]
    assert got == [("artists", 1, "Bop Trio", 0), ("venues", 1, "Le Bop", 1), ("styles", 1, "Jazz", 1), ("styles", 2, "hard bop", 1), ("styles", 3, "bebop", 2)]
    assert [r["name"] for r in index.suggest(ends, "bo tr").collect()] == ["Bop Trio"]
    assert [(r.group, r["name"]) for r in index.suggest(ends, "swi").collect()] == [("styles", "swing")]
    plan = index.suggest(ends, "bop")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(edge,bop)" in plan and "LessThan(edge,bop" in plan  # the range reaches the files
    assert index.suggest(ends, "zzz").collect() == []


def test_places_on_the_sphere(spark):
    """At the poles, across the 180th meridian and elsewhere: as by brute force."""
    rng = random.Random(2)
    near = lambda lat, lon, km: (lat + rng.uniform(-km, km) / 111, (lon + rng.uniform(-km, km) / max(1e-6, 111 * math.cos(math.radians(lat))) + 540) % 360 - 180)
    spots = [(90.0, 0.0), (89.999, 30.0), (-89.9999, -120.0), (0.0, 180.0), (10.0, -180.0), (60.0, 179.9999), (48.85, 2.35), (0.0, 0.0)]
    v = [(i, *near(*rng.choice(spots), 3)) for i in range(120)] + [(120 + i, *s) for i, s in enumerate(spots)]
    e = [(i, *near(*rng.choice(spots), 3)) for i in range(150)] + [(200, None, 1.0)]
    v, e = ([(i, a if a is None else max(-90.0, min(90.0, a)), o) for i, a, o in x] for x in (v, e))

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 12742 * math.asin(math.sqrt(s))

    for radius in (1.5, 400.0, 30_000.0):
        want = {x[0]: min(y[0] for y in v if km(x, y) <= radius) for x in e if x[1] is not None and any(km(x, y) <= radius for y in v)}
        got = conform.by_place(spark.createDataFrame(e, "id long, lat double, lon double"), spark.createDataFrame(v, "ord long, lat double, lon double").withColumn("venue", F.col("ord")), radius)
        assert {r.id: r.venue for r in got.collect()} == want and want


def test_entities(spark):
    """As the standard library has them, on 10,000 random texts."""
    rng = random.Random(9)
    names = list(html5)
    bits = ["&", "#", "x", ";", "amp", "&amp", "&notit;", "&#146;", "&#x80", "&#0;", "&#55296;", "&#1114112;", "&#99999999999;", "&#xfffe;", "&#11;", "&#x1F600;", "&#013;", "&CounterClockwiseContourIntegral;", "&ampfoo", "&copy2", " ", "<", "é", "a", "1", "\n"]
    texts = ["".join(rng.choice(bits) if rng.random() < 0.6 else "&" + rng.choice(names) for _ in range(rng.randrange(1, 8))) for _ in range(10_000)]
    texts += [f"&{n}" for n in names] + [f"&{n}x;" for n in names] + ["&#%d;" % n for n in range(0, 300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8).select("i", unescape(F.col("t"), ALL_NAMES).alias("u")).collect()
    wrong = [(texts[r.i], r.u, html.unescape(texts[r.i])) for r in got if r.u != html.unescape(texts[r.i])]
    assert wrong == []
    short = [t for t in texts[:10_000] if not any(f"&{n}" in t for n in names if n.endswith(";") and n[:-1] not in name2codepoint)] + [f"&{n}; &{n}" for n in name2codepoint]
    got = spark.createDataFrame(list(enumerate(short)), "i int, t string").repartition(8).select("i", unescape(F.col("t")).alias("u")).collect()
    assert [(short[r.i], r.u) for r in got if r.u != html.unescape(short[r.i])] == [] and len(short) > 1000


def test_band_pages(spark):
    hits = [{"type": "b", "name": "Echo", "url": "//echo.x.com/?from=a", "item_url_root": "root"}, {"type": "b", "name": "Foxtrot", "item_url_path": "foxtrot.x.com/a/", "url": "no"}, {"type": "b", "name": "Golf"}, {"type": "b", "name": "Golf", "item_url_root": "https://golf.x.com"}]
    rows = spark.createDataFrame([(json.dumps({"results": hits}), n) for n in ("echo", "Foxtrot", "golf", "Hotel")], "p string, n string")
    assert [r.x for r in rows.select(payloads.band(F.col("p"), F.col("n")).alias("x")).collect()] == ["https://echo.x.com", "https://foxtrot.x.com/a", "https://golf.x.com", None]
    page = '<li class="searchresult a"><div class="itemtype"> ALBUM </div><div class="heading"> <a href="https://no">Echo</a></div></li><li class="searchresult b"><div class="itemtype">ARTIST</div><div class="heading"><a class="q" href="https://echo.x.com?a=1&amp;b=2"> <b>Echo</b> </a></div></li>'
    assert spark.range(1).select(payloads.band_of_search(F.lit(page), F.lit("écho")).alias("x"), payloads.band_of_search(F.lit(page), F.lit("Other")).alias("y")).first() == ("https://echo.x.com", None)
    metas = ["<meta name=\"bc-page-properties\" content=\"{&quot;item_type&quot;:&quot;a&quot;,&quot;item_id&quot;:123}\">", "<meta content='{&quot;item_type&quot;:&quot;t&quot;,&quot;item_id&quot;:7}' name='bc-page-properties' />", '<meta name="bc-page-properties" content="null">', '<meta name="bc-page-properties" content="{&quot;item_type&quot;:&quot;a&quot;,&quot;item_id&quot;:&quot;9&quot;}">', '<meta name="bc-page-properties" content="{&quot;item_type&quot;:&quot;b&quot;,&quot;item_id&quot;:9}">', "nothing"]
    got = [r.x for r in spark.createDataFrame(list(enumerate(metas)), "i int, m string").orderBy("i").select(payloads.release(F.col("m")).alias("x")).collect()]
    assert [x and tuple(x) for x in got] == [("a", 123), ("t", 7), None, None, None, None]
    links = ['<a href="https://other.x.com/album/no"><a href="/track/one?x">', '<a href="https://echo.x.com/album/two#b">', '<a href="/music">']
    got = [r.x for r in spark.createDataFrame(list(enumerate(links)), "i int, m string").orderBy("i").select(payloads.first_release(F.col("m"), F.lit("https://echo.x.com/?q")).alias("x")).collect()]
    assert got == ["https://echo.x.com/track/one", "https://echo.x.com/album/two", None]


def test_status_order_and_values(spark, tmp_path):
    report = spark.createDataFrame([("a", 0, "html", None, True, 5, None), ("new", 1, "html", None, False, 0, "42")], "slug string, ord int, strategy string, low int, ok boolean, count int, error string").withColumns({"last_ok": F.lit("2026-09-01"), "prev_count": F.lit(9)})
    before = spark.createDataFrame([("z", "ok", None, None, 0, 7, None), ("a", "ok", None, None, 1, 7, None), ("gone", "failed", "2026-08-01", None, 2, 0, "x")], "slug string, status string, failing_since string, last_ok string, ord int, count int, error string")
    active = spark.createDataFrame([("a",), ("z",), ("new",)], "slug string")
    full = status.status(report, before, "2026-09-02", active=active)
    assert [r.slug for r in full.orderBy("place").collect()] == ["a", "new", "z"]
    part = status.status(report, before, "2026-09-02", active=active, partial=True)
    assert [r.slug for r in part.orderBy("place").collect()] == ["z", "a", "new"]
    values = status.day_values(full)
    values.write.parquet(f"{tmp_path}/values")
    back = spark.read.parquet(f"{tmp_path}/values").select("slug", status.counted(F.col("value")).alias("n"), status.failed_with(F.col("value")).alias("e"))
    assert {tuple(r) for r in back.collect()} == {("a", 5, None), ("new", None, "42"), ("z", 7, None)}
    head = {"today": "2026-09-02", "generated_at": "late", "duration_s": 9, "run_url": "p"}
    assert status.header(head, {"today": "2026-09-02", "generated_at": "early", "duration_s": 99}, True) == {"today": "2026-09-02", "generated_at": "early", "duration_s": 99, "run_url": None}
    assert status.header(head, {"today": "2026-09-01", "generated_at": "early"}, True) == head and status.header(head, {"today": "2026-09-02"}, False) == head


def test_ordinals_and_labels(spark):
    a, b = spark.range(0, 10, 1, 3), spark.range(10, 14, 1, 2)
    got = [r.id for r in state.in_order(a, b).orderBy("ord").collect()]
    assert got == list(range(14))
    with pytest.raises(ValueError):
        state.in_order(*[a] * 1025)
    one = spark.range(1).select(classify.merged_labels(F.array(F.lit("Post Punk"), F.lit("rock")), F.lit(None).cast("array<string>"), F.array(F.lit("post-punk"), F.lit("Synthpop"))).alias("x")).first()
    assert one.x == ["post-punk", "synth-pop"]


def test_blocks_from_sql(spark):
    blocks.register(spark)
    pages = spark.createDataFrame([(1, "x<li>a<li>b"), (2, "none"), (3, None), (4, "<li>" + "y" * 30_000)], "id int, html string")
    pages.createOrReplaceTempView("some_pages")
    got = {(r.id, r.pos, r.block) for r in spark.sql("SELECT id, b.pos, b.block FROM some_pages, LATERAL html_blocks(html, '<li>') b").collect()}
    want = {(r.id, r.pos, r.block) for r in pages.select("id", F.posexplode(tables.blocks(F.col("html"), "<li>")).alias("pos", "block")).collect()}
    assert got == want and len(got) == 3


def test_places_meet_once(spark, monkeypatch):
    """Many events and venues at few places: rows that any aggregation reads stay near the number given, and each event has its first venue."""
    read, first_by = [], conform.first_by
    monkeypatch.setattr(conform, "first_by", lambda df, *a: (read.append(df.count()), first_by(df, *a))[1])
    events = spark.range(400).select("id", (48.0 + F.col("id") % 2).alias("lat"), F.when(F.col("id") < 398, 2.0).alias("lon"))
    venues = spark.range(300).select((300 - F.col("id")).alias("ord"), F.col("id").alias("venue"), (48.0 + F.col("id") % 3).alias("lat"), F.lit(2.0005).alias("lon"))
    got = {r.id: r.venue for r in conform.by_place(events, venues, 0.1).collect()}
    assert got == {i: 298 if i % 2 else 297 for i in range(398)}
    assert max(read) <= 400
