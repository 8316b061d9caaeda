import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import state
from ledgerlark.sources.tables import json_map, or_empty, snapshot
from ledgerlark.streaming import first_seen as streams

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def run(spark, df, name, path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    seen = run(spark, streams.first_seen(stream, "user_id", "ts", "400 days"), "seen", tmp_path)
    assert seen.count() == events.select("user_id").distinct().count() == seen.select("user_id").distinct().count()
    per = run(spark, streams.windows(stream, "ts", "1 day", ["event_type"], "0 seconds"), "per", tmp_path).toPandas()
    want = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n")).toPandas()
    done = per.merge(want, on=["start", "event_type"], suffixes=("", "_w"))
    assert len(per) and len(done) == len(per) and (done.n == done.n_w).all()


def test_snapshots(spark, tmp_path):
    d = spark.createDataFrame([(1, "a")], "id int, t string")
    assert or_empty(spark, f"{tmp_path}/none", d.schema).count() == 0
    assert or_empty(spark, snapshot(d, str(tmp_path), "one"), d.schema).collect() == d.collect()
    (tmp_path / "m.json").write_text('{"x": [{"id": 1, "t": "a"}, {"id": 2}], "y": []}')
    assert sorted((r.key, r.id, r.t) for r in json_map(spark, f"{tmp_path}/m.json", d.schema).collect()) == [("x", 1, "a"), ("x", 2, None)]


def programme(rng, runs):
    """Runs as lists of (id, date, source, venue): shows that come, go, change their names and come back."""
    live, out = [], []
    for k in range(runs):
        day = DAYS[k]
        for _ in range(rng.randrange(1, 5)):
            venue, date = rng.choice("abc"), (None if rng.random() < 0.05 else DAYS[min(len(DAYS) - 1, k + rng.randrange(0, 9))])
            live.append((f"{venue}|{date}|{rng.randrange(10**6)}", date, rng.choice(["s1", "s2"]), venue))
        live = [e for e in live if rng.random() < 0.85 and (e[1] or "9") >= day or rng.random() < 0.1]
        for i, e in enumerate(live):
            if rng.random() < 0.15:
                live[i] = (f"{e[3]}|{e[1]}|{rng.randrange(10**6)}", *e[1:])  # renamed
        out.append(list({e[0]: e for e in live}.values()))
    return out


@pytest.fixture
def monkeypatch_conf(spark):
    """Settings for one test."""
    before = {}

    def put(k, v):
        before.setdefault(k, spark.conf.get(k, None))
        spark.conf.set(k, v)

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


DAYS = [f"2026-{9 + d // 30:02d}-{d % 30 + 1:02d}" for d in range(60)]
STATE = "id string, first_seen string, date string, venue string, last string"


def by_runs(spark, runs, held, known, horizon):
    """The same by the batch rule, run after run, with the rows that each run lists."""
    want = set()
    for k, now in enumerate(runs):
        df = spark.createDataFrame(now, "id string, date string, source string, venue string")
        old = spark.createDataFrame(held, STATE)
        after = state.first_seen(df, old, spark.createDataFrame([(x,) for x in known], "key string"), DAYS[k], horizon).collect()
        held = [tuple(r) for r in after]
        listed = {e[0] for e in now}
        want |= {(DAYS[k], r.id, r.first_seen, r.date, r.venue) for r in after if r.id in listed}
        known = known | {f"{e[2]}:{e[3]}" for e in now}
    return want


@pytest.mark.parametrize("seed, order", [(1, "in order"), (2, "shuffled")])
def test_listings_are_the_batch_rule(spark, tmp_path, monkeypatch_conf, seed, order):
    """Two starts from one checkpoint; rows of up to three runs in one file, out of order, within the watermark."""
    rng = random.Random(seed)
    for k, v in {**streams.STORE, "spark.sql.shuffle.partitions": "2"}.items():
        monkeypatch_conf(k, v)
    runs = programme(rng, 10)
    runs[2] += [("a|2026-09-05|0", "2026-09-05", "s1", "a"), ("c||1", None, "s2", "c")]  # known before the stream
    runs[3].append(("a|2026-09-05|new name", "2026-09-05", "s1", "a"))
    held = [("a|2026-09-05|0", "2026-08-01", "2026-09-05", "a", "2026-08-31"), ("b|2026-09-04|9", "baseline", "2026-09-04", "b", "2026-08-20"), ("c||1", "2026-07-01", None, "c", "2026-08-31")]
    known = {"s1:a", "s2:b"}
    since = {k: "2026-08-01" for k in known}
    rows = []
    for k, now in enumerate(runs):
        rows += [(DAYS[k], *e) for e in now]
        for e in now:
            since.setdefault(f"{e[2]}:{e[3]}", DAYS[k])
    batches = [rows[i : i + 7] for i in range(0, len(rows), 7)] if order == "shuffled" else [[r for r in rows if r[0] == DAYS[k]] for k in range(len(runs))]
    if order == "shuffled":
        for b in batches:
            rng.shuffle(b)
        for i in range(0, len(batches) - 1, 2):
            batches[i], batches[i + 1] = batches[i + 1], batches[i]
    end = [("2026-12-01", "end|x|1", "2026-12-30", "s1", "z")]
    schema = "run timestamp, id string, date string, source string, venue string"
    folder = tmp_path / "in"
    folder.mkdir()
    initial = spark.createDataFrame(held, STATE)
    for part, name in enumerate(("one", "two")):
        half = len(batches) // 2
        some = batches[:half] if part == 0 else [*batches[half:], end]
        for i, b in enumerate(some):
            lines = [json.dumps(dict(zip(("run", "id", "date", "source", "venue"), (f"{r[0]}T00:00:00Z", *r[1:]), strict=True))) for r in b]
            (folder / f"{name}-{i:03d}.json").write_text("\n".join(lines))
            os.utime(folder / f"{name}-{i:03d}.json", (1000 * part + 10 * i + 10**9,) * 2)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        side = spark.createDataFrame(list(since.items()), "key string, since string")
        out = streams.listings(stream, initial, side, 5, late="0 seconds" if order == "in order" else "6 days")
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = by_runs(spark, runs, held, known, 5)
    assert {g for g in got if g[0] < "2026-11"} == want
    firsts = {r[2] for r in want}
    assert {"baseline", "2026-08-01"} < firsts and len(firsts) > 4 and len(want) > 40
