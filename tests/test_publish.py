"""Publishing several tables at once, and extraction whose jobs survive."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import DataFrameWriter

from ledgerlark.sources import extraction
from ledgerlark.sources.publish import Publication, kept_timeline, update_timeline

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not import tests

EVENTS, REPORT = "source string, id string, n long", "source string, ok boolean"


def publish(spark, root, rows, header):
    p = Publication(spark, root)
    p.commit({"events": spark.createDataFrame(rows, EVENTS), "report": spark.createDataFrame([(r[0], True) for r in rows], REPORT)}, header)
    return p


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("die_at", [1, 2, "swap"])
def test_killed_between_writes(spark, tmp_path, monkeypatch, die_at):
    root = str(tmp_path / "pub")
    publish(spark, root, [("a", "1", 1), ("b", "2", 2)], {"today": "2026-09-01"})
    count, write = [0], DataFrameWriter.parquet

    def dying(self, *args, **kwargs):
        count[0] += 1
        if count[0] == die_at:
            raise KeyboardInterrupt
        return write(self, *args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", dying)
        if die_at == "swap":
            m.setattr(Publication, "swap", lambda self, manifest: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            publish(spark, root, [("a", "9", 9)], {"today": "2026-09-02"})
    p = Publication(spark, root)
    assert p.version == 1 and rows(p.table("events")) == [("a", "1", 1), ("b", "2", 2)] and p.header == {"today": "2026-09-01"}
    assert p.commit({"events": spark.createDataFrame([("c", "3", 3)], EVENTS)}, {"today": "2026-09-02"}) == 2
    assert rows(Publication(spark, root).table("events")) == [("c", "3", 3)] and rows(p.table("report")) == [("a", True), ("b", True)]
    assert Publication(spark, root).table("nothing") is None and len(p.prune(1)) == (die_at != 1)
    assert rows(Publication(spark, root).table("report")) == [("a", True), ("b", True)]


def test_two_runs_at_once(spark, tmp_path):
    one, two = Publication(spark, f"{tmp_path}/p"), Publication(spark, f"{tmp_path}/p")
    one.commit({"events": spark.createDataFrame([("a", "1", 1)], EVENTS)}, {})
    with pytest.raises(FileExistsError):
        two.commit({"events": spark.createDataFrame([("b", "2", 2)], EVENTS)}, {})
    two.refresh()
    assert rows(two.table("events")) == [("a", "1", 1)]


def test_patch(spark, tmp_path):
    root = str(tmp_path / "pub")
    some = spark.createDataFrame([("a",)], "source string")
    fresh = spark.createDataFrame([("a", "7", 7)], EVENTS)
    report = spark.createDataFrame([("a", False)], REPORT)
    with pytest.raises(FileNotFoundError):
        Publication(spark, root).patch(fresh, some, report, {})
    p = publish(spark, root, [("a", "1", 1), ("b", "2", 2)], {"today": "2026-09-01", "url": "full"})
    p.patch(fresh, some, report, {"today": "2026-09-01", "url": "part"})
    assert rows(p.table("events")) == [("a", "7", 7), ("b", "2", 2)] and rows(p.table("report")) == [("a", False), ("b", True)] and p.header["url"] == "full"
    p.patch(fresh, some, report, {"today": "2026-09-02", "url": "part"})
    assert p.header["url"] == "part"


def test_timeline(spark, tmp_path):
    path, schema = tmp_path / "timeline.json", "date string, ok int"
    path.write_text('{"date": "2026-09-01", "ok": 3}\n{"date": "2026-09-02", "ok": \n')
    add = lambda old: old.unionByName(spark.createDataFrame([("2026-09-03", 5)], schema))
    before = path.read_text()
    assert kept_timeline(spark, str(path), schema) is None and not update_timeline(spark, str(path), schema, add) and path.read_text() == before
    path.write_text('{"date": "2026-09-01", "ok": 3}\n')
    assert update_timeline(spark, str(path), schema, add)
    assert rows(kept_timeline(spark, str(path), schema)) == [("2026-09-01", 3), ("2026-09-03", 5)]
    assert update_timeline(spark, str(tmp_path / "new"), schema, add) and rows(kept_timeline(spark, str(tmp_path / "new"), schema)) == [("2026-09-03", 5)]


def page(parts):
    return "<html><body>" + "".join(f"<p>{x}</p>" for x in parts) + "</body></html>"


def service(log):
    """Takes chunks and answers each by its first line; every chunk that is handed in is a line in a file."""

    def send(id, rows):
        with open(log, "a") as f:
            for r in rows:
                f.write(json.dumps({"id": id, "first": r["chunk"].split("\n")[0], "key": r["key"]}) + "\n")

    def answer(keys):
        with open(log) as f:
            known = {x["key"]: x["first"] for x in map(json.loads, f)}
        title = lambda k: known[k].split(" ")[0]
        return {k: json.dumps({"events": [{"title": title(k), "date": "2026-10-01"}, {"title": "Shared", "date": "2026-10-02", "url": f"u-{title(k)}"}, {"title": "bad", "date": "soon"}]}) for k in keys if k in known}

    def asked():
        with open(log) as f:
            return [json.loads(x)["first"].split(" ")[0] for x in f]

    return send, answer, asked


def test_extraction_asks_for_what_changed(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "jobs")
    send, answer, asked = service(log)
    parts = [f"part{k} " + "x" * 20_000 for k in range(5)]
    schema = "slug string, ord int, url string, html string"
    venues = spark.createDataFrame([("v", "The Hall"), ("w", "Other")], "slug string, name string")
    df = spark.createDataFrame([("v", 0, "https://v", page(parts)), ("w", 0, "https://w", page(["w0 " + "y" * 100]))], schema)
    got, left = extraction.extract(spark, df, venues, root, send, answer, "2026-09-01")
    got = {(r.venue, r.title, r.date, r.url) for r in got.collect()}
    assert left == [] and sorted(asked()) == ["part0", "part1", "part2", "part3", "part4", "w0"]
    assert ("The Hall", "part3", "2026-10-01", "https://v") in got and ("The Hall", "Shared", "2026-10-02", "u-part0") in got and len(got) == 8
    extraction.extract(spark, df, venues, root, send, answer, "2026-09-02")
    assert len(asked()) == 6  # all remembered
    parts[3] = "changed " + "z" * 20_000
    df = spark.createDataFrame([("v", 0, "https://v", page(parts)), ("w", 0, "https://w", page(["w0 " + "y" * 100]))], schema)
    got, left = extraction.extract(spark, df, venues, root, send, answer, "2026-09-02")
    assert asked()[6:] == ["changed"] and "changed" in {r.title for r in got.collect()}
    extraction.extract(spark, df, venues, root, send, answer, "2026-09-16")
    assert sorted(asked()[7:]) == ["part0", "part1", "part2", "part4", "w0"]  # 15 days later all but the changed one have aged


def test_jobs_survive(spark, tmp_path):
    """A run that dies before it submits, and a service that is not done yet: the next run goes on with the same job."""
    log, root = str(tmp_path / "log"), str(tmp_path / "jobs")
    send, answer, asked = service(log)
    wanted = spark.createDataFrame([("k1", "one"), ("k2", "two")], "key string, chunk string")
    jobs = extraction.Jobs(spark, root)
    job = jobs.plan(wanted, "2026-09-01")
    assert jobs.open() == [job] and jobs.plan(wanted, "2026-09-01") is None  # in an open job
    jobs.submit(job, send)
    assert not jobs.collect(job, lambda keys: None, "2026-09-01") and jobs.open() == [job]
    ids = {json.loads(x)["id"] for x in open(log)}
    jobs.submit(job, send)
    assert {json.loads(x)["id"] for x in open(log)} == ids  # the same ids again
    assert jobs.collect(job, answer, "2026-09-02") and jobs.open() == []
    assert jobs.collect(job, answer, "2026-09-02") and jobs.cache().count() == 2
    assert jobs.plan(wanted, "2026-09-16") is None and jobs.plan(wanted, "2026-09-17") is not None
