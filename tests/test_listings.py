"""Paged listings as data sources: pages once, filters in the address, totals and limits; runs that go on where they stopped."""

import json
import re
import sys
from urllib.parse import parse_qs, urlparse

from pyspark import cloudpickle

from ledgerlark.sources import fetching, listings, registry

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not import tests


class Service:
    """Answers like a paged service and writes down each address, for the executors are other processes."""

    def __init__(self, log, answer):
        self.log, self.answer = str(log), answer

    def __call__(self, url):
        with open(self.log, "a") as f:
            f.write(url + "\n")
        return json.dumps(self.answer({k: v[0] for k, v in parse_qs(urlparse(url).query).items()}))

    def asked(self):
        with open(self.log) as f:
            return f.read().split()


def records_of(n):
    def answer(q):
        rows = [{"id": str(i), "title": f"T{i}", "address_name": f"Hall {i % 7}", "date_start": "2026-09-10T20:00:00", "date_end": "2026-09-11", "qfap_tags": "Concert;Jazz", "lat_lon": {"lat": 48.0, "lon": 2.0}, "url": f"u{i}"} for i in range(n)]
        at = int(q["offset"])
        return {"total_count": n, "results": rows[at : at + int(q["limit"])]}

    return answer


def test_open_data(spark, tmp_path):
    web = Service(tmp_path / "log", records_of(250))
    df = listings.open_data(spark, "https://open/records", web, "2026-09-01")
    assert df.count() == 250 and df.select("id").distinct().count() == 250
    once = web.asked()
    first = parse_qs(urlparse(once[0]).query)
    assert first["where"] == ["qfap_tags like 'Concert' AND date_end>='2026-09-01'"] and first["order_by"] == ["date_start"]
    many = Service(tmp_path / "many", records_of(5000))
    assert listings.scan(spark, listings.OPEN_DATA, "https://open/records", many).count() == 3000  # the service's bound
    assert len(many.asked()) == len(set(many.asked())) == 30
    assert listings.scan(spark, listings.OPEN_DATA, "https://open/records", Service(tmp_path / "none", records_of(0))).count() == 0


def calendar_of(n):
    def answer(q):
        rows = [{"id": i, "title": f"T{i}", "start_date": "2026-09-12 20:30:00", "cost": "5 €", "categories": [{"name": "Jazz" if i % 2 else "Folk"}], "tags": [], "excerpt": "x", "url": f"u{i}", "image": {"url": "i.png"} if i else False} for i in range(n)]
        at, size = int(q["page"]) - 1, int(q["per_page"])
        return {"events": rows[at * size : (at + 1) * size], "total_pages": -(-n // size)}

    return answer


def test_runs_read_each_page_once_and_go_on(spark, tmp_path):
    """Two good sources and one that is down; the second run reads only what the first has not written."""
    open_, cal = Service(tmp_path / "open", records_of(230)), Service(tmp_path / "cal", calendar_of(620))
    up = []

    def fetch(url):
        if "open" in url:
            return open_(url)
        if "cal" in url:
            return cal(url)
        raise fetching.Refused(404)

    venues = [{"slug": "city", "name": "City", "strategy": "opendata", "url": "https://open"}, {"slug": "cal", "name": "Cal", "strategy": "tribe", "url": "https://cal/"}, {"slug": "down", "name": "D", "strategy": "trianon", "url": "https://down"}, {"slug": "hand", "name": "H", "strategy": "manual"}]
    (tmp_path / "manual.json").write_text('{"hand": [{"title": "By hand", "date": "2026-10-01"}], "other": []}')
    ctx = {"today": "2026-09-01", "horizon_days": 730, "fetch": fetch, "manual": str(tmp_path / "manual.json")}
    got = registry.run(spark, venues, ctx, f"{tmp_path}/run")
    assert {r["slug"]: (r["ok"], r["count"], r["error"]) for r in got.report} == {"city": (True, 230, None), "cal": (True, 500, None), "down": (False, 0, "HTTP 404"), "hand": (True, 1, None)}
    assert got.events.count() == 731
    assert len(open_.asked()) == len(set(open_.asked())) == 3 and len(cal.asked()) == len(set(cal.asked())) == 10
    assert all("start_date=2026-09-01" in u for u in cal.asked()) and re.search("page=10$", sorted(cal.asked(), key=len)[-1])
    again = registry.run(spark, venues, ctx, f"{tmp_path}/run")
    assert again.events.count() == 731 and len(open_.asked()) == 3 and len(cal.asked()) == 10 and not up
