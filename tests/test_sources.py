"""Sources, records, sites, sub-genres and what is asked outside, on own inputs."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import classify, conform, state, status
from ledgerlark.sources import fetching, records, registry, sites


def test_registry(spark):
    registry.strategy("good")(lambda spark, v, ctx: spark.createDataFrame([("a", "2026-01-01")], "title string, date string"))
    registry.strategy("bad")(lambda spark, v, ctx: (_ for _ in ()).throw(ValueError("no page")))
    venues = [{"slug": "x", "strategy": "good"}, {"slug": "y", "strategy": "bad"}, {"slug": "z", "strategy": "none"}, {"slug": "l", "strategy": "llm"}]
    assert [v["slug"] for v in registry.selected(venues, with_llm=False)] == ["x", "y"] and [v["slug"] for v in registry.selected(venues, {"llm", "x"})] == ["x", "l"]
    got = registry.run(spark, registry.selected(venues, with_llm=False), {})
    assert got.events.count() == 1 and got.events.first().lat is None and [(r["ok"], r["error"]) for r in got.report] == [(True, None), (False, "no page")]


def test_fetching(spark):
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return "ok"

    assert fetching.get("u", flaky, sleep=lambda s: None) == "ok" and len(calls) == 3
    with pytest.raises(fetching.Refused):
        fetching.get("u", lambda u: (_ for _ in ()).throw(fetching.Refused(404)), sleep=lambda s: None)
    assert fetching.get("u", lambda u: (_ for _ in ()).throw(fetching.Refused(403)), lambda u: "by curl") == "by curl"
    cache = spark.createDataFrame([("a", "old", "2026-01-01 00:00:00"), ("b", "new", "2026-01-01 11:00:00")], "url string, html string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = fetching.pages(spark.createDataFrame([("a",), ("b",), ("a",)], "url string"), cache, lambda u: "fetched " + u, "2026-01-01 12:00:00")
    assert {r.url: r.html for r in got.collect()} == {"a": "fetched a", "b": "new"} and got.count() == 2
    assert fetching.paged(lambda o: (list(range(o, min(o + 10, 25))), 25), 10, 3000) == list(range(25))
    asked = spark.createDataFrame([(str(i), f"t{i}") for i in range(5)], "id string, text string")
    known = spark.createDataFrame([("0", "kept", "2026-01-01")], "id string, answer string, at string")
    out = fetching.answers(asked.coalesce(1), known, lambda rows: {r["id"]: r["text"].upper() for r in rows if r["id"] != "3"}, "id", 2, "2026-02-01")
    assert {r.id: r.answer for r in out.collect()} == {"0": "kept", "1": "T1", "2": "T2", "3": None, "4": "T4"}

    def broken(name):
        raise OSError

    got = fetching.resolved(spark.createDataFrame([(str(i), f"n{i}") for i in range(9)], "key string, name string"), {"one": lambda n: n + "!", "two": broken}).collect()
    assert len(got) == 9 and {r.provider for r in got} == {"one"}
    assert fetching.batch_step(asked, lambda rows: f"job{len(rows)}", None, None)[0] == {"job": "job5", "n": 5}
    assert fetching.batch_step(asked, None, lambda job: {"1": "x"}, {"job": "j"}) == (None, {"1": "x"})


def test_records(spark):
    cols = "id int, ord int, title string, address_name string, address_street string, address_zipcode string, qfap_tags string, occurrences string, date_start string, price_type string, price_detail string, lead_text string"
    rows = [
        (1, 1, "A", "38 Club", "1 rue X", "75001", "Concert;Jazz", "2026-09-12T20:30:00_x;2026-09-12T22:00:00_y;2026-09-11T00:00:00_z;bad;2030-01-01T10:00:00_q", None, "payant", None, "<b>hi</b>"),
        (2, 2, "B", "38 Club Jazz", "1 Rue X", "75001", "Enfants", None, "2026-09-13T19:00:00", "gratuit", None, None),
        (3, 3, "C", "38 Club", "1 rue x", "75001", "Enfants;Concert", "short", "2026-09-13T19:00:00", "gratuit", "0 €", None),
        (4, 4, "D", None, None, None, None, None, "2026-09-13T19:00:00", None, None, None),
    ]
    d = spark.createDataFrame(rows, cols)
    assert [r.address_name for r in records.one_name_a_place(d).orderBy("id").collect()] == ["38 Club", "38 Club", "38 Club", None]
    got = sorted((r.id, r.date, r.time, r.price, r.free, r.raw_genre) for r in records.occurrences(d, "2026-09-10", 730).collect())
    assert got == [(1, "2026-09-11", None, "payant", False, "Jazz"), (1, "2026-09-12", "20:30", "payant", False, "Jazz"), (3, "2026-09-13", "19:00", "0 €", True, "Enfants")]
    assert records.occurrences(d, "2026-09-10", 730, most=1).where("id = 1").first().date == "2026-09-12"
    cal = spark.createDataFrame([(i, f"Show {i}", "2026-09-12 20:30:00", "Gratuit", ["Pop / Rock", "Folk"] if i else ["Pop / Rock"], ["The Hall", "Noise", "Show"], None, "u") for i in range(10)], "id int, title string, start_date string, cost string, categories array<string>, tags array<string>, excerpt string, url string")
    got = {r.id: (r.date, r.time, r.raw_genre, r.free) for r in records.calendar(cal, "the hall", ["noise"]).collect()}
    assert got[0] == ("2026-09-12", "20:30", None, True)
    ld = ['{"offers":[{"name":"P","price":"32","availability":"SoldOut"},{"name":"S","price":35.5,"availability":"x/SoldOut"},{"name":"E","price":0,"availability":"InStock"}]}', '{"isAccessibleForFree":true,"offers":[]}', '{"offers":[{"name":"Prix libre","price":"0","availability":"InStock"}]}']
    got = [tuple(r.o) for r in spark.createDataFrame(list(enumerate(ld)), "i int, x string").orderBy("i").select(records.offers(F.col("x")).alias("o")).collect()]
    assert got == [("32–35.50 €", False, True), (None, True, False), (None, True, False)]


def test_hints_summaries_players(spark):
    e = spark.createDataFrame([(1, 1, True, "see https://the-band.bandcamp.com/x", None, None), (2, 2, True, "https://other.bandcamp.com", None, None), (3, 3, False, "https://no.bandcamp.com", None, None)], "id int, ord int, is_music boolean, description string, url string, ticket_url string")
    acts = spark.createDataFrame([(1, "the band"), (1, "guest"), (2, "solo act"), (3, "no")], "id int, key string")
    assert {tuple(r) for r in records.band_hints(e, acts).collect()} == {("the band", "https://the-band.bandcamp.com"), ("solo act", "https://other.bandcamp.com")}
    rows = [(i, "shared", None, True) for i in range(4)] + [(5, "own", None, True), (6, "own2", "text", True), (7, "home", None, True), (8, "x", None, False)]
    ev = spark.createDataFrame(rows, "id int, url string, description string, is_music boolean")
    assert [r.id for r in records.without_summary(ev, spark.createDataFrame([("home",)], "url string")).collect()] == [5]
    one = spark.createDataFrame([("```json {\"summaries\": [{\"id\": \"a\", \"summary\": \"hi  you\"}, {\"summary\": \"x\"}, {\"id\": \"b\", \"summary\": null}]}```", "Error code: 400 - {'error': {'message': 'Too low', 'x': 1}}")], "a string, e string")
    r = one.select(records.summaries(F.col("a")).alias("s"), records.api_message(F.col("e")).alias("m")).first()
    assert r.s == {"a": "hi you", "b": ""} and r.m == "Too low"
    p = "map<string,struct<spotify:struct<id:string>,bandcamp:struct<url:string,embed:string>>>"
    d = spark.createDataFrame([({"Zoé": ({"id": "abcdefgh12"}, None)}, "zoe", None), ({"A": ({"id": "?"}, {"url": "https://a.bandcamp.com", "embed": "https://bandcamp.com/EmbeddedPlayer/x"})}, "A", "d"), ({}, "B", "d"), ({}, "B", None)], f"p {p}, n string, z string")
    assert [x.v for x in d.select(records.player(F.col("p"), F.col("n"), F.col("z")).alias("v")).collect()] == ["spotify", "bandcamp", "deezer", ""]


def test_sites(spark):
    page = '<ul><li class="event"><a href="/e/1"><h2>Nova - complet</h2><h3 class="date">sam. 12 septembre</h3><div class="time">20h30</div><li class="event"><a href="/e/1"><h2>Again</h2><h3 class="date">13/09</h3><li class="event"><a href="/e/2"><h2></h2>'
    got = sites.events(spark.createDataFrame([(page,)], "html string"), "maroquinerie", "La Salle", "2026-09-01").collect()
    assert [(r.title, r.date, r.time, r.url, r.sold_out, r.venue_slug) for r in got] == [("Nova", "2026-09-12", "20:30", "https://www.lamaroquinerie.fr/e/1", True, "la-salle")]


def test_labels(spark):
    said = ["Metal, Punk, Heavy Metal, Hard Rock et assimilés", "pop, indie, alt", "Coming Soon", "Post Punk / post-punk / Synthpop (club)", "Tribute pop, soirée électro, drum and bass", None]
    got = [r.s for r in spark.createDataFrame(list(enumerate(said)), "i int, x string").orderBy("i").select(classify.sub_genres(F.col("x")).alias("s")).collect()]
    assert got == [["heavy metal", "hard rock"], [], [], ["post-punk", "synth-pop"], ["drum & bass"], []]


def test_state_and_status(spark):
    report = spark.createDataFrame([("a", True, 0, None, 5), ("b", True, 0, None, 0), ("c", False, 0, "x", 5)], "source string, ok boolean, count int, error string, prev_count int")
    assert [(r.ok, r.error) for r in state.guarded(report).orderBy("source").collect()] == [(False, "0 events parsed (was 5)"), (True, None), (False, "x")]
    prev = spark.createDataFrame([("a", "2026-09-20", "2026-09-08"), ("a", "2026-09-01", None), ("a", "2026-09-25", None), ("b", "2026-09-20", None)], "source string, date string, stale_since string").select("source", F.to_date("date").alias("date"), F.to_date("stale_since").alias("stale_since"))
    failed = spark.createDataFrame([("a", None), ("b", "2026-08-01")], "source string, last_ok string").select("source", F.to_date("last_ok").alias("last_ok"))
    assert {(r.source, str(r.stale_since)) for r in state.carry_over(prev, failed, "2026-09-10", written_on="2026-09-09").collect()} == {("a", "2026-09-08")}
    assert state.patched(prev, prev.where("source = 'a'").limit(1), spark.createDataFrame([("a",)], "source string")).count() == 2
    days = spark.createDataFrame([("2026-09-09", 3, 3, 1.0, None), ("2026-09-10", 4, 2, 2.0, None)], "date string, sources int, ok int, usd double, first string")
    old = spark.createDataFrame([("2026-09-09", 9, 9, 9.0, None), ("2026-09-10", 1, 1, 0.0, "launch")], days.schema)
    cost = spark.createDataFrame([("2026-09-10", 5.0), ("2026-09-11", 0.5)], "date string, usd double")
    assert [tuple(r) for r in status.timeline(old, days, cost, "2026-09-10").orderBy("date").collect()] == [("2026-09-09", 9, 9, 9.0, None), ("2026-09-10", 4, 2, 2.0, "launch"), ("2026-09-11", None, None, 0.5, None)]
    f = spark.createDataFrame([("a", "x", "2026-09-01", ["2026-09-10"]), ("b", "x2", "2026-09-02", ["2026-08-01", "2026-08-02", "2026-08-03"]), ("c", "y", "2026-09-01", None), ("d", "z", "2026-09-10", None), ("e", "w", "2026-09-01", ["2026-09-02", "2026-09-03", "2026-09-04"]), ("g", "v", "2026-09-05", None)], "slug string, cause string, failing_since string, tried array<string>")
    got = status.triage(f, spark.createDataFrame([("y",)], "cause string"), "2026-09-10", most=1)
    assert {r.slug: r.reason for r in got.collect()} == {"a": "today", "b": "go", "d": "waiting", "e": "worn", "g": "over"}


def test_places(spark):
    v = spark.createDataFrame([("Big Hall", "big", 0, 48.0, 2.0, True), ("Small", "small", 1, 60.0, 10.0, True), ("Bar", "bar", 2, 48.0, 2.0, False)], "name string, slug string, ord int, lat double, lon double, geo_match boolean")
    far = conform.by_place(spark.createDataFrame([(1, 60.0, 10.08), (2, 48.05, 2.0)], "id int, lat double, lon double"), v.withColumn("venue", F.col("slug")), 5.0)
    assert {(r.id, r.venue) for r in far.collect()} == {(1, "small")}
    assert conform.by_place(spark.createDataFrame([(2, 48.04, 2.0)], "id int, lat double, lon double"), v.withColumn("venue", F.col("slug")), 5.0).first().venue == "big"
    e = spark.createDataFrame([(1, "opendata", "Le Small", "le-small", 48.0, 2.0), (2, "opendata", "Other", "other", 48.0005, 2.0), (3, "html", "Small", "x", 48.0, 2.0), (4, "opendata", "Far", "far", 0.0, 0.0)], "id int, source string, venue string, venue_slug string, lat double, lon double")
    assert {r.id: r.venue_slug for r in conform.canonical(e, v, 0.15).collect()} == {1: "small", 2: "big", 3: "x", 4: "far"}
