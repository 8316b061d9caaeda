"""Sources by strategy: a strategy is a function (spark, venue, ctx) → DataFrame of events. ctx: today, horizon_days and what is injected."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from . import listings, records, sites
from .tables import json_map

STRATEGIES: dict[str, Callable] = {}
EVENT = (
    "id string, title string, date string, time string, venue string, venue_slug string, source string, url string, ticket_url string, price string, free boolean, raw_genre string, "
    "genres array<string>, genre_source string, subgenres array<string>, description string, image string, address string, area string, lat double, lon double, is_music boolean, sold_out boolean, cancelled boolean, headliner string, support array<string>"
)


def strategy(name: str):
    """Register a function under the name that venues call it by."""

    def add(f):
        STRATEGIES[name] = f
        return f

    return add


def selected(venues: list[dict], only: set[str] | None = None, with_llm: bool = True) -> list[dict]:
    """Venues to read: not those switched off ('none'), nor those that need a language model without one; `only` names slugs or strategies."""
    on = [v for v in venues if v["strategy"] != "none" and (with_llm or v["strategy"] != "llm")]
    return on if only is None else [v for v in on if v["slug"] in only or v["strategy"] in only]


@dataclass
class Run:
    """What a run of sources gives: a union of events and a report row for each source."""

    events: DataFrame | None = None
    report: list[dict] = field(default_factory=list)


def as_events(df: DataFrame) -> DataFrame:
    """The columns of an event, in order; those that a source lacks are null."""
    empty = df.sparkSession.createDataFrame([], EVENT)
    return empty.unionByName(df.select(*[c for c in empty.columns if c in df.columns]), allowMissingColumns=True)


def run(spark: SparkSession, venues: list[dict], ctx: dict, root: str | None = None) -> Run:
    """Read each venue by its strategy, once: its rows are written under root and counted and used from there, so no page is fetched and no
    model asked again. A source that root has whole is not read again, so a run that was cut off goes on where it stopped. Without a
    root the rows are checkpointed. A source that fails is reported and does not stop the others."""
    out = Run()
    for v in venues:
        path = f"{root}/{v['slug']}" if root else None
        try:
            if path and whole(spark, path):
                found = spark.read.schema(EVENT).parquet(path)
            else:
                found = as_events(STRATEGIES[v["strategy"]](spark, v, ctx))
                if path:
                    found.write.mode("overwrite").parquet(path)
                    found = spark.read.schema(EVENT).parquet(path)
                else:
                    found = cut(found)
            out.report.append({"slug": v["slug"], "ok": True, "count": found.count(), "error": None})
        except (PySparkException, OSError, KeyError, ValueError) as e:
            out.report.append({"slug": v["slug"], "ok": False, "count": 0, "error": reason(e)})
            continue
        out.events = found if out.events is None else out.events.unionByName(found)
    return out


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def reason(e: Exception) -> str:
    """The first line that says what was wrong; of an error inside a task, that of the task."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    raised = [x for x in lines if x.startswith(("OSError:", "ValueError:", "ledgerlark.sources.fetching.Refused:"))]
    return raised[-1].split(": ", 1)[1] if raised else lines[0] if lines else type(e).__name__


@strategy("opendata")
def open_data(spark: SparkSession, venue: dict, ctx: dict) -> DataFrame:
    rows = listings.open_data(spark, venue["url"], ctx["fetch"], ctx["today"])
    return records.occurrences(records.one_name_a_place(cut(rows)), ctx["today"], ctx["horizon_days"])


@strategy("tribe")
def calendar(spark: SparkSession, venue: dict, ctx: dict) -> DataFrame:
    rows = cut(listings.calendar(spark, venue["url"], ctx["fetch"], ctx["today"]))
    found = records.calendar(rows, venue["name"], records.NOISE)
    return found.withColumns({"venue_slug": F.lit(venue["slug"]), "source": F.lit("tribe")})


@strategy("manual")
def manual(spark: SparkSession, venue: dict, ctx: dict) -> DataFrame:
    row = spark.createDataFrame([], "title string, date string, time string, url string, price string, raw_genre string, description string").schema
    rows = json_map(spark, ctx["manual"], row).where(F.col("key") == venue["slug"]).drop("key")
    return rows.withColumns({"venue": F.lit(venue["name"]), "venue_slug": F.lit(venue["slug"]), "source": F.lit("manual")})


def by_site(name: str):
    """The strategy of a site's markup: its pages until its stop rule, then its parser."""

    def read(spark: SparkSession, venue: dict, ctx: dict) -> DataFrame:
        found = sites.read(spark, name, venue, ctx)
        return found.withColumn("venue_slug", F.when(F.col("venue") == venue["name"], F.lit(venue["slug"])).otherwise(F.col("venue_slug")))

    return read


for _name in [*sites.SITES, "dernierbar"]:
    STRATEGIES[_name] = by_site(_name)
