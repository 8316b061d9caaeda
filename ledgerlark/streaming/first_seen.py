"""First-seen dates and windows as streams."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: Keyed state with timers lives in this store only.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def first_seen(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key's first row, as (key, first_ts). The state holds a key until the watermark is `late` past its first time, so it is bounded by
    the keys of that span; a key that comes again later is new again. A date that must last is kept by Listings."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]).select(key, F.col(ts).alias("first_ts"))


def windows(stream: DataFrame, ts: str, every: str, by: list[str], late: str = "1 day") -> DataFrame:
    """Counts by time window and key, complete once the watermark has passed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def text(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


def at(day: str) -> int | None:
    """Milliseconds at the beginning of a day; None for what is no day."""
    try:
        return int(datetime.combine(date.fromisoformat(day), datetime.min.time(), UTC).timestamp() * 1000)
    except (TypeError, ValueError):
        return None


class Listings(StatefulProcessor):
    """State of one venue's day: ids with the day on which each was first seen and the last that listed it.

    What a run lists waits until the watermark has reached that run, so runs are taken in their order however their rows arrive, and all
    rows of a run together: only then is it known which ids have gone and which are new. A second timer, the day after the events',
    drops the whole state. An id names its venue and date, so all that the rules compare is here."""

    def __init__(self, horizon: int, rename_days: int):
        self.horizon, self.rename_days = horizon, rename_days

    def init(self, handle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", text("id"), text("first_seen last"))
        self.waiting = handle.getMapState("waiting", text("run id"), T.StructType([T.StructField("known", T.BooleanType())]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if initialState["id"] is not None:
            self.ids.updateValue((initialState["id"],), (initialState["first_seen"], initialState["last"]))
        self.until_past(key)

    def until_past(self, key) -> None:
        day = at(key[1])
        if day is not None:
            self.handle.registerTimer(day + 86_400_000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        listed: dict[tuple[str, str], bool] = {}
        for r in rows:
            listed[r["run_day"], r["id"]] = listed.get((r["run_day"], r["id"]), False) or r["known"]
        for (run, id), known in listed.items():
            old = self.waiting.getValue((run, id)) if self.waiting.containsKey((run, id)) else None
            self.waiting.updateValue((run, id), (known or bool(old and old[0]),))
        for run in {r for r, _ in listed}:
            self.handle.registerTimer(at(run))
        self.until_past(key)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        runs: dict[str, dict[str, bool]] = {}
        for (run, id), (known,) in list(self.waiting.iterator()):
            if at(run) <= now:
                runs.setdefault(run, {})[id] = known
                self.waiting.removeKey((run, id))
        for run in sorted(runs):
            yield from self.run(key, run, runs[run])
        day = at(key[1])
        if day is not None and now >= day + 86_400_000:
            self.ids.clear()

    def run(self, key, run: str, listed: dict[str, bool]) -> Iterator[Row]:
        venue, day = key
        today = date.fromisoformat(run)
        if day is not None and day < run:
            return
        reach, recent = ((today + timedelta(n)).isoformat() for n in (self.horizon, -self.rename_days))
        held = {k[0]: tuple(v) for k, v in self.ids.iterator()}
        gone = [i for i, (_, last) in held.items() if i not in listed and venue is not None and (last or "") >= recent]
        added = [i for i in listed if i not in held]
        heir = held[gone[0]][0] if len(gone) == len(added) == 1 else None
        if heir is not None:
            self.ids.removeKey((gone[0],))
        for id, known in sorted(listed.items(), key=lambda x: str(x[0])):
            fresh = run if known and day is not None and day <= reach else "baseline"
            first = held[id][0] if id in held else heir or fresh
            self.ids.updateValue((id,), (first, run))
            yield Row(run=run, id=id, first_seen=first, date=day, venue=venue)


def listings(stream: DataFrame, state: DataFrame, known: DataFrame, horizon: int, rename_days: int = 3, late: str = "0 seconds") -> DataFrame:
    """First-seen days of a stream of runs, as operators.state.first_seen gives them run by run.

    stream: run (timestamp of the run's day), id, date, source, venue. state: what an earlier run has left (id, first_seen, date, venue,
    last), read in the first batch only. known: key ('source:venue') and since, the first day that listed it; a side table, read at each
    start, which the job that makes the runs appends to. Output (append): run, id, first_seen, date, venue, once the watermark (`late`
    behind the last run) has reached the run. Rows of a run that come after that are late and dropped. The state store must
    be the one in STORE."""
    day = F.date_format("run", "yyyy-MM-dd")
    rows = stream.withWatermark("run", late).withColumns({"run_day": day, "key": F.concat_ws(":", "source", "venue")})
    known = known.groupBy("key").agg(F.min("since").alias("since"))
    rows = rows.join(known, "key", "left").withColumn("known", F.coalesce(F.col("since") < F.col("run_day"), F.lit(False)))
    return (
        rows.select("run", "run_day", "id", "date", "venue", "known")
        .groupBy("venue", "date")
        .transformWithState(Listings(horizon, rename_days), "run string, id string, first_seen string, date string, venue string", "Append", "EventTime", state.select("venue", "date", "id", "first_seen", "last").groupBy("venue", "date"))
    )
