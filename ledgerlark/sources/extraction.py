"""Pages to events by a model: text, chunks, answers that are remembered by content, jobs that survive a restart.

A chunk is known by the SHA-1 of its text, so a page that has changed in one place asks for the chunks there only. Chunks without a fresh
answer become a job: its rows are written before it is submitted, under an id made of its keys, and its answers after it is collected. A
run that dies between two of these steps finds the job again: submitting twice under one id is the service's to refuse, collecting
twice writes nothing new."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_lines, squeeze
from ..operators.chunks import chunks
from ..operators.state import fresh_chunk
from .publish import files

# The limits of a run.
CHUNK, MOST, AGE = 30_000, 120_000, 14
PENDING = "key string, chunk string"
ANSWERS = "key string, answer string, at string"
EVENT = "array<struct<title:string,date:string,time:string,price:string,genre:string,description:string,url:string>>"


def chunked(pages: DataFrame, size: int = CHUNK, most: int = MOST) -> DataFrame:
    """pages: slug, ord, url, html. (slug, ord, url, pos, key, chunk): each page's lines in chunks, of a source's pages in their order the
    first `most` characters, which is what a source may cost."""
    text = pages.select("slug", "ord", "url", F.array_join(page_lines(F.col("html")), "\n").alias("text"))
    before = text.select("slug", "ord", F.length("text").alias("n"))
    earlier = before.alias("a").join(before.alias("b"), (F.col("a.slug") == F.col("b.slug")) & (F.col("b.ord") < F.col("a.ord"))).groupBy("a.slug", "a.ord").agg(F.sum("b.n").alias("used"))  # a source has a handful of pages
    cut = text.join(earlier, ["slug", "ord"], "left").withColumn("text", F.substr("text", F.lit(1), F.greatest(F.lit(most) - F.coalesce("used", F.lit(0)), F.lit(0)).cast("int")))
    rows = cut.select("slug", "ord", "url", F.posexplode(chunks(F.col("text"), size)).alias("pos", "chunk")).where("chunk != ''")
    return rows.withColumn("key", F.sha1(F.col("chunk").cast("binary")))


class Jobs:
    """Jobs and answers under a root: pending/job=<id>, done/job=<id>. A folder counts once Spark has marked it whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def whole(self, kind: str) -> list[str]:
        folder, fs = files(self.spark, f"{self.root}/{kind}")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(n[4:] for n in names if n.startswith("job=") and fs.exists(files(self.spark, f"{self.root}/{kind}/{n}/_SUCCESS")[0]))

    def open(self) -> list[str]:
        """Jobs whose answers are not there yet."""
        return sorted(set(self.whole("pending")) - set(self.whole("done")))

    def read(self, kind: str, schema: str, jobs: list[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/{kind}/job={j}" for j in (self.whole(kind) if jobs is None else jobs)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def cache(self) -> DataFrame:
        """The last answer to each key."""
        return self.read("done", ANSWERS).groupBy("key").agg(F.max_by("answer", "at").alias("answer"), F.max("at").alias("at"))

    def plan(self, wanted: DataFrame, today: str) -> str | None:
        """Write down a job for the chunks that have no fresh answer and are in no open job; null if there are none."""
        held = self.cache().where(fresh_chunk(F.col("at"), today)).select("key").union(self.read("pending", PENDING, self.open()).select("key"))
        rows = wanted.groupBy("key").agg(F.min("chunk").alias("chunk")).join(held, "key", "left_anti")
        digest = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("key", 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.min("key").alias("a"), F.max("key").alias("b")).first()
        if not digest.n:
            return None
        job = hashlib.sha1(f"{today}:{digest.n}:{digest.s}:{digest.a}:{digest.b}".encode()).hexdigest()[:16]
        rows.write.mode("overwrite").parquet(f"{self.root}/pending/job={job}")
        return job

    def submit(self, job: str, send: Callable[[str, list[dict]], None], size: int = 100) -> None:
        """Hand a job's rows in, from the tasks that hold them, `size` at a time; send(id, rows) must take an id that it has as done."""

        def run(batches):
            for b in batches:
                for at in range(0, len(b), size):
                    part = b.iloc[at : at + size].to_dict("records")
                    name = hashlib.sha1("".join(r["key"] for r in part).encode()).hexdigest()[:8]
                    send(f"{job}-{name}", part)
                    yield pd.DataFrame({"n": [len(part)]})

        rows = self.read("pending", PENDING, [job]).repartitionByRange("key").sortWithinPartitions("key")
        rows.mapInPandas(run, "n long").write.format("noop").mode("overwrite").save()

    def collect(self, job: str, answer: Callable[[list[str]], dict[str, str] | None], today: str) -> bool:
        """Fetch a job's answers by key, in its tasks. answer(keys) is null while the service works: then nothing is written and the job stays
        open. Keys that it has no answer for stay without one and are asked in a later job."""

        def run(batches):
            for b in batches:
                got = answer(list(b["key"]))
                if got is None:
                    raise TimeoutError("not ready")
                found = [k for k in b["key"] if got.get(k) is not None]
                yield pd.DataFrame({"key": found, "answer": [got[k] for k in found]})

        try:
            self.read("pending", PENDING, [job]).select("key").mapInPandas(run, "key string, answer string").withColumn("at", F.lit(today)).write.mode("overwrite").parquet(f"{self.root}/done/job={job}")
        except Exception as e:  # noqa: BLE001  what a task raised comes wrapped in several ways
            if "not ready" in str(e):
                return False
            raise
        return True


def answered_events(answer: Column) -> Column:
    """The events of an answer: a list, or an object with a list named `events`; anything else gives none."""
    body = F.regexp_extract(answer, r"(?s)(\[.*\]|\{.*\})", 1)
    listed = F.when(F.ltrim(body).startswith("["), body).otherwise(F.get_json_object(body, "$.events"))
    rows = F.coalesce(F.from_json(listed, EVENT), F.array().cast(EVENT))
    return F.filter(rows, lambda e: (F.coalesce(e["title"], F.lit("")) != "") & e["date"].rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))


def events(chunks_: DataFrame, cache: DataFrame, venues: DataFrame) -> DataFrame:
    """Events of the chunks that have an answer; of one that several chunks of a source give (title and date) the first by page and place."""
    rows = chunks_.join(cache, "key").select("slug", "ord", "pos", "url", F.posexplode(answered_events(F.col("answer"))).alias("n", "e"))
    rows = rows.select("slug", F.struct("ord", "pos", "n").alias("at"), F.col("url").alias("page"), "e.*")
    key = F.lower(squeeze(F.col("title")))
    one = rows.groupBy("slug", "date", key.alias("__key")).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("slug", "date")]), "at").alias("r"))
    out = one.select("slug", "date", "r.*").withColumns({"url": F.coalesce("url", "page"), "raw_genre": F.col("genre"), "source": F.lit("llm"), "venue_slug": F.col("slug")})
    return out.drop("at", "page", "genre").join(venues.select("slug", F.col("name").alias("venue")), "slug").drop("slug")


def extract(spark: SparkSession, pages: DataFrame, venues: DataFrame, root: str, send, answer, today: str) -> tuple[DataFrame, list[str]]:
    """One run: open jobs first, then a job for what is still missing; events of all that has an answer, and the jobs that are still open."""
    jobs, parts = Jobs(spark, root), chunked(pages)
    for job in jobs.open():
        jobs.submit(job, send)
        jobs.collect(job, answer, today)
    job = jobs.plan(parts.select("key", "chunk"), today)
    if job:
        jobs.submit(job, send)
        jobs.collect(job, answer, today)
    return events(parts, jobs.cache(), venues), jobs.open()
