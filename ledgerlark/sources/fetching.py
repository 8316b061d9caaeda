"""Pages and answers by address. What goes over the network is an injected function; the engine brings cache, retries and batches."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRESH_HOURS = 6
GONE = (404, 406, 410)  # not asked again
OTHER_WAY = (403, 418)  # asked by the second function


class Refused(Exception):
    """An answer with an HTTP status."""

    def __init__(self, status: int):
        super().__init__(f"HTTP {status}")
        self.status = status


def get(url: str, fetch: Callable[[str], str], other: Callable[[str], str] | None = None, tries: int = 3, sleep=time.sleep) -> str:
    """One page: up to `tries` attempts with growing waits; none after a status of GONE; the other way after one of OTHER_WAY."""
    for i in range(tries):
        try:
            return fetch(url)
        except Refused as e:
            if e.status in GONE:
                raise
            if e.status in OTHER_WAY and other is not None:
                return other(url)
            last = e
        except OSError as e:
            last = e
        if i + 1 < tries:
            sleep(i + 1)
    raise last


def pages(urls: DataFrame, cache: DataFrame, fetch: Callable[[str], str], now, other=None, tries: int = 3, hours: float = FRESH_HOURS, most_errors: int | None = None) -> DataFrame:
    """urls: url; cache: url, html, at. (url, html, at, error): from the cache where it is fresh, else fetched by the executors, one
    request for each address. The result's rows without an error are the next cache. After most_errors errors in a row a task asks no more."""
    fresh = cache.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("at") <= hours * 3600)
    wanted = urls.select("url").distinct()
    held = fresh.join(wanted, "url", "left_semi").select("url", "html", "at", F.lit(None).cast("string").alias("error"))

    def run(batches):
        wrong = 0
        for b in batches:
            html, error = [], []
            for u in b["url"]:
                if most_errors is not None and wrong >= most_errors:
                    html.append(None)
                    error.append("not asked")
                    continue
                try:
                    html.append(get(u, fetch, other, tries))
                    error.append(None)
                    wrong = 0
                except (Refused, OSError) as e:
                    html.append(None)
                    error.append(str(e))
                    wrong += 1
            yield pd.DataFrame({"url": b["url"], "html": html, "error": error})

    asked = wanted.join(fresh, "url", "left_anti").mapInPandas(run, "url string, html string, error string")
    return held.unionByName(asked.select("url", "html", F.lit(now).cast("timestamp").alias("at"), "error"))


def paged(read: Callable[[int], tuple[list, int]], size: int, most: int) -> list:
    """Rows of a listing that comes in pages: read(offset) → rows and their total; to the least of the total and `most`, or an empty page."""
    out, offset, total = [], 0, None
    while total is None or offset < min(total, most):
        rows, total = read(offset)
        if not rows:
            break
        out += rows
        offset += size
    return out


def answers(asked: DataFrame, cache: DataFrame, ask: Callable[[list[dict]], dict[str, str]], key: str, size: int, today: str) -> DataFrame:
    """(key, answer, at): from the cache, else by batches of `size` rows given to `ask`, which returns answers by key. A batch that fails is
    left out and asked again next time; keys that a batch's answer lacks have a null answer."""
    left = asked.join(cache.select(key), key, "left_anti")

    def run(batches):
        for b in batches:
            rows = b.to_dict("records")
            for at in range(0, len(rows), size):
                part = rows[at : at + size]
                try:
                    got = ask(part)
                except (OSError, ValueError):
                    continue
                yield pd.DataFrame({key: [r[key] for r in part], "answer": [got.get(r[key]) for r in part]})

    found = left.mapInPandas(run, f"`{key}` string, answer string")
    return cache.select(key, "answer", "at").join(asked.select(key).distinct(), key, "left_semi").unionByName(found.withColumn("at", F.lit(today)))


def resolved(names: DataFrame, providers: dict[str, Callable[[str], str | None]], most_errors: int = 5) -> DataFrame:
    """names: key, name. (key, provider, answer): each provider's names are asked in one task, in order of the key; after most_errors errors
    in a row the provider is left alone and its other names have no row. The list is a work budget, not a corpus."""
    each = names.withColumn("provider", F.explode(F.array(*map(F.lit, providers))))

    def run(group):
        ask, wrong, out = providers[group["provider"].iloc[0]], 0, []
        for r in group.sort_values("key").itertuples():
            if wrong >= most_errors:
                break
            try:
                out.append((r.key, r.provider, ask(r.name)))
                wrong = 0
            except OSError:
                wrong += 1
        return pd.DataFrame(out, columns=["key", "provider", "answer"])

    return each.groupBy("provider").applyInPandas(run, "key string, provider string, answer string")


def batch_step(pending: DataFrame, submit: Callable[[list[dict]], str], collect: Callable[[str], dict[str, str] | None], state: dict | None) -> tuple[dict | None, dict[str, str]]:
    """One step of a batch job: without a state, hand the pending rows in (a work list, bounded by its budget) and remember the job; with
    one, collect it: its answers once it is done, else the state as it was."""
    if state is None:
        rows = [r.asDict() for r in pending.collect()]
        return ({"job": submit(rows), "n": len(rows)}, {}) if rows else (None, {})
    got = collect(state["job"])
    return (state, {}) if got is None else (None, got)


def pruned(cache: DataFrame, today: str, days: int, at: str = "at") -> DataFrame:
    """A cache to save, by key: entries past their age go."""
    return cache.where(F.datediff(F.lit(today).cast("date"), F.col(at).cast("date")) <= days).orderBy(cache.columns[0])
