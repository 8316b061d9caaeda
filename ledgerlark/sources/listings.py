"""Listings that come in pages, as data sources: one partition a page, read by the executors, filters in the address.

The first page says how many there are; it is asked for once, when the scan is planned, and its answer travels with its partition, so no
page is read twice. Filters that the listing knows become part of its address; all others stay with Spark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThanOrEqual, InputPartition, StringContains

from .fetching import get

PUSHED = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class Listing:
    """A listing's name and schema, the address of a page (from 0) for pushed conditions, how many pages its first answer promises, the rows
    of an answer, and the condition that stands for a filter (None: none does)."""

    name: str
    schema: str
    address: Callable[[str, int, dict[str, str]], str]
    pages: Callable[[dict], int]
    rows: Callable[[dict], list[dict]]
    condition: Callable[[Filter], tuple[str, str] | None]


@dataclass
class Page(InputPartition):
    number: int
    body: str | None = None


class Pages(DataSourceReader):
    def __init__(self, listing: Listing, fetch, tries: int, base: str, fields: list[str]):
        self.listing, self.fetch, self.tries, self.base, self.fields = listing, fetch, tries, base, fields
        self.conditions: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            known = self.listing.condition(f)
            if known is None:
                yield f
            else:
                self.conditions[known[0]] = known[1]

    def ask(self, number: int) -> str:
        return get(self.listing.address(self.base, number, self.conditions), self.fetch, tries=self.tries)

    def partitions(self) -> list[Page]:
        body = self.ask(0)
        return [Page(0, body), *[Page(n) for n in range(1, self.listing.pages(json.loads(body)))]]

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in self.listing.rows(json.loads(partition.body or self.ask(partition.number))):
            yield tuple(row.get(c) for c in self.fields)


def scan(spark: SparkSession, listing: Listing, base: str, fetch, tries: int = 3) -> DataFrame:
    """The listing at base as a table that is read when it is used, through fetch(address) → text."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return listing.name

        def schema(self) -> str:
            return listing.schema

        def reader(self, schema) -> Pages:
            return Pages(listing, fetch, tries, self.options["base"], schema.names)

    spark.conf.set(PUSHED, "true")
    spark.dataSource.register(Source)
    return spark.read.format(listing.name).option("base", base).load()


# Addresses and limits of the listings.
OPEN_PAGE, OPEN_MOST = 100, 3000
CALENDAR_PAGE, CALENDAR_PAGES = 50, 10


def open_condition(f: Filter) -> tuple[str, str] | None:
    if isinstance(f, StringContains) and f.attribute == ("qfap_tags",):
        return "qfap_tags", f"qfap_tags like '{f.value}'"
    if isinstance(f, GreaterThanOrEqual) and f.attribute == ("date_end",):
        return "date_end", f"date_end>='{f.value}'"
    return None


def open_address(base: str, number: int, conditions: dict[str, str]) -> str:
    where = {"where": " AND ".join(conditions[k] for k in sorted(conditions, reverse=True))} if conditions else {}
    return f"{base}?{urlencode({**where, 'limit': OPEN_PAGE, 'offset': number * OPEN_PAGE, 'order_by': 'date_start'})}"


OPEN_DATA = Listing(
    "open_data",
    "id string, title string, address_name string, address_street string, address_zipcode string, address_city string, lat double, lon double, qfap_tags string, occurrences string, date_start string, date_end string, price_type string, price_detail string, lead_text string, description string, url string, access_link string, cover_url string",
    open_address,
    lambda answer: max(1, -(-min(answer.get("total_count") or 0, OPEN_MOST) // OPEN_PAGE)),
    lambda answer: [r | (r.get("lat_lon") or {}) for r in answer.get("results") or []],
    open_condition,
)


def calendar_rows(answer: dict) -> list[dict]:
    names = lambda r, k: [x.get("name") for x in r.get(k) or []]
    return [r | {"id": str(r.get("id")), "categories": names(r, "categories"), "tags": names(r, "tags"), "image": (r.get("image") or {}).get("url") if isinstance(r.get("image"), dict) else None} for r in answer.get("events") or []]


CALENDAR = Listing(
    "calendar",
    "id string, title string, start_date string, cost string, categories array<string>, tags array<string>, excerpt string, description string, url string, website string, image string",
    lambda base, number, conditions: f"{base.rstrip('/')}/wp-json/tribe/events/v1/events?{urlencode({'per_page': CALENDAR_PAGE, **conditions, 'page': number + 1})}",
    lambda answer: max(1, min(int(answer.get("total_pages") or 1), CALENDAR_PAGES)),
    calendar_rows,
    lambda f: ("start_date", str(f.value)) if isinstance(f, GreaterThanOrEqual) and f.attribute == ("start_date",) else None,
)


def open_data(spark: SparkSession, base: str, fetch, today: str) -> DataFrame:
    """Concerts that are not over by today; both conditions are asked of the service. Rows have the order `ord` in which they are listed."""
    rows = scan(spark, OPEN_DATA, base, fetch).where(F.col("date_end") >= today).where(F.contains("qfap_tags", F.lit("Concert")))
    return rows.withColumn("ord", F.monotonically_increasing_id())


def calendar(spark: SparkSession, base: str, fetch, today: str) -> DataFrame:
    """A calendar's events from today on."""
    return scan(spark, CALENDAR, base, fetch).where(F.col("start_date") >= today)
