"""Links, displays and payload picks on small cases."""

import datetime as dt
import json

from pyspark.sql import functions as F

from ledgerlark.functions import links
from ledgerlark.sources import payloads


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_component_keeps_what_a_uri_component_keeps(spark):
    assert one(spark, x=links.component(F.lit("a b+c/é(d)!'~*#\n"))).x == "a%20b%2Bc%2F%C3%A9(d)!'~*%23%0A"


def test_agenda_dates(spark):
    rows = spark.createDataFrame([(dt.date(2026, 12, 31), t) for t in ("22:30", "9h", "20 h 15", None, "", "soon", "24:00")], "d date, t string")
    got = [r.x for r in rows.select(links.agenda_dates(F.col("d"), F.col("t")).alias("x")).collect()]
    whole = "20261231/20270101"
    assert got == ["20261231T223000/20270101T010000", "20261231T090000/20261231T113000", "20261231T201500/20261231T224500", whole, whole, whole, "20270101T000000/20270101T023000"]


def test_calendar_url(spark):
    x = one(spark, x=links.calendar_url(F.lit("s"), F.lit("A"), F.array(F.lit("B"), F.lit("C")), F.lit("2026-05-01").cast("date"), F.lit(None).cast("string"), F.lit("V"), F.lit(""), F.lit("11e"), F.lit(None).cast("string"), F.lit("5 €"))).x
    assert x.endswith("action=TEMPLATE&text=A%20with%20B%2C%20C%20%40%20V&dates=20260501%2F20260502&details=s%0A5%20%E2%82%AC&location=V%2C%2011e&ctz=Europe%2FParis")


def test_map_query(spark):
    no = F.lit(None).cast("string")
    row = one(spark, a=links.map_query(F.lit("V"), F.lit("1 rue X"), F.lit(1.5), F.lit(2.0)), b=links.map_query(no, no, F.lit(1.5), F.lit(2.0)), c=links.map_query(no, F.lit(""), F.lit(1.5), F.lit(None).cast("double")))
    assert tuple(row) == ("V%2C%201%20rue%20X", "1.5,2.0", "")


def test_displays(spark):
    times = spark.createDataFrame([("09h",), ("20:30",), ("late",), ("",), (None,)], "t string")
    assert [r.x for r in times.select(links.clock(F.col("t")).alias("x")).collect()] == ["9:00", "20:30", "late", "—", "—"]
    seen = spark.createDataFrame([("2026-05-03",), ("2026-05-02",), ("2026-05-01",), ("2026-04-01",), ("baseline",), (None,)], "s string")
    assert [r.x for r in seen.select(links.age(F.col("s"), F.lit("2026-05-02").cast("date")).alias("x")).collect()] == ["today", "today", "yesterday", "31 days ago", None, None]
    texts = spark.createDataFrame([("x " * 130,), ("word " * 60,), (None,)], "t string")
    short, long, none = [r.x for r in texts.select(links.blurb(F.col("t")).alias("x")).collect()]
    assert len(short) == 259 and long == " ".join(["word"] * 48) + "…" and none is None


def test_profile(spark):
    answer = json.dumps({"artists": {"items": [{"id": "1", "name": "Les Echos"}, {"id": "2", "name": "ÉCHO"}, {"id": "3", "name": "Echo"}]}})
    rows = spark.createDataFrame([(answer, "echo"), (answer, "nobody"), ("{", "echo"), (None, "echo"), ("null", None)], "p string, n string")
    got = [r.x for r in rows.select(payloads.profile(F.col("p"), F.col("n")).alias("x")).collect()]
    assert got[0].asDict() == {"id": "2", "url": "https://open.spotify.com/artist/2"} and got[1:] == [None] * 4


def test_video(spark):
    item = lambda i, title, channel="c": {"id": {"videoId": i}, "snippet": {"title": title, "channelTitle": channel, "publishedAt": "2026-01-02T03:04:05Z"}}
    both = json.dumps({"items": [item("a" * 11, "Écho - clip"), item("bad", "Echo live"), item("b" * 11, "ECHO en concert &amp; more")]})
    only = json.dumps({"items": [item("c" * 11, "Other", "Echo TV"), item("d" * 11, "Echo clip")]})
    rows = spark.createDataFrame([(both, "echo"), (only, "echo"), (only, "!"), ("[]", "echo")], "p string, n string")
    got = [r.x for r in rows.select(payloads.video(F.col("p"), F.col("n")).alias("x")).collect()]
    assert got[0].asDict() == {"videoId": "b" * 11, "title": "ECHO en concert & more", "publishedAt": "2026-01-02"}
    assert got[1].videoId == "c" * 11 and got[2:] == [None, None]


def test_band(spark):
    hits = [{"type": "a", "name": "Echo", "url": "u0"}, {"type": "b", "name": "Echo"}, {"type": "b", "name": "The Echo", "url": "u1"}]
    rows = spark.createDataFrame([(json.dumps({"auto": {"results": hits}}), "echo"), (json.dumps({"results": hits}), "Echo"), (json.dumps({"results": []}), "Echo")], "p string, n string")
    assert [r.x for r in rows.select(payloads.band(F.col("p"), F.col("n")).alias("x")).collect()] == ["https://u1", "https://u1", None]


def test_related_and_encyclopedia(spark):
    data = lambda *names: json.dumps({"data": [{"id": i, "name": n} for i, n in enumerate(names)]})
    rows = spark.createDataFrame([(data("Echo Park", "ÉCHO"), "echo"), (data("The Echo Band", "x"), "Echo Trio"), (data("Other"), "Echo"), (data(), "Echo"), ("bad", "Echo")], "p string, n string")
    assert [r.x for r in rows.select(payloads.related(F.col("p"), F.col("n"))["name"].alias("x")).collect()] == ["ÉCHO", "The Echo Band", None, None, None]
    found = json.dumps({"query": {"search": [{"title": "Sound"}, {"title": "Écho (groupe)"}]}})
    pages = [{"type": "standard", "extract": "Echo is a band. " * 40, "content_urls": {"desktop": {"page": "u"}}}, {"type": "disambiguation", "extract": "a band"}, {"extract": "A village in the hills."}]
    assert spark.range(1).select(payloads.article(F.lit(found), F.lit("Echo Nova"))).first()[0] == "Écho (groupe)"
    got = [r.x for r in spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(pages)], "i int, p string").orderBy("i").select(payloads.biography(F.col("p")).alias("x")).collect()]
    assert got[0].url == "u" and got[0].extract.endswith("band.…") and len(got[0].extract) <= 401 and got[1:] == [None, None]
