"""State between runs: first seen, renames, carry-over, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(now: DataFrame, state: DataFrame, known: DataFrame, today: str, horizon: int, rename_days: int = 3) -> DataFrame:
    """now: id, date, source, venue; state: id, first_seen, date, venue, last; known: key ('source:venue'). The next state: known ids keep
    their day; where exactly one id seen in the last rename_days has gone and exactly one is new at a venue and date, the new one inherits;
    other new ids get today if their source knows the venue and the date is within the old horizon, else 'baseline'. Dates, venues
    and `last` follow what is listed now; ids whose date is past go, those without a date stay. Days are yyyy-MM-dd text."""
    t = F.lit(today)
    reach = F.date_format(F.date_add(t.cast("date"), horizon), "yyyy-MM-dd")
    recent = F.date_format(F.date_sub(t.cast("date"), rename_days), "yyyy-MM-dd")
    gone = state.where(F.col("venue").isNotNull() & (F.coalesce("last", F.lit("")) >= recent)).join(now, "id", "left_anti").select("venue", "date", "id")
    added = now.join(state, "id", "left_anti").select("venue", "date", "id").distinct()
    heir = renames(gone, added, ["venue", "date"])
    heir = heir.join(state.select(F.col("id").alias("old_id"), F.col("first_seen").alias("inherited")), "old_id").select(F.col("new_id").alias("id"), "old_id", "inherited")
    old = state.select("id", F.col("first_seen").alias("old"), F.col("date").alias("old_date"), F.col("venue").alias("old_venue"), F.col("last").alias("old_last"))
    listed = now.withColumn("key", F.concat_ws(":", "source", "venue")).join(known.select("key", F.lit(True).alias("known")).distinct(), "key", "left")
    j = listed.join(old, "id", "full").join(heir.select("id", "inherited"), "id", "left").join(heir.select(F.col("old_id").alias("id"), F.lit(True).alias("left")), "id", "left")
    here = F.col("key").isNotNull()
    fresh = F.when(F.col("known") & (F.col("date") <= reach), t).otherwise(F.lit("baseline"))
    out = j.where("left is null").select("id", F.coalesce("old", "inherited", fresh).alias("first_seen"), F.coalesce("date", "old_date").alias("date"), F.coalesce("venue", "old_venue").alias("venue"), F.when(here, t).otherwise(F.col("old_last")).alias("last"))
    return out.where(F.col("date").isNull() | (F.col("date") >= t))


def known_venues(now: DataFrame, known: DataFrame) -> DataFrame:
    """The keys 'source:venue' that have ever been listed."""
    return known.select("key").union(now.select(F.concat_ws(":", "source", "venue"))).distinct()


def migrated(entries: DataFrame, old_horizon: int = 120) -> DataFrame:
    """entries: id, day (a bare date, from older states), first_seen, date, venue, last, horizon; of the first two one is null. A bare day
    becomes first_seen, without a date that could pass; a missing horizon is the old one."""
    bare = F.col("first_seen").isNull()
    return entries.select("id", F.coalesce("first_seen", "day").alias("first_seen"), F.when(bare, "9999-12-31").otherwise(F.col("date")).alias("date"), "venue", "last", F.coalesce("horizon", F.lit(old_horizon)).alias("horizon"))


def state_entries(text: Column) -> Column:
    """array of struct(id, day, first_seen, date, venue, last, horizon), for migrated(): a state file as it is or was. Each value is a variant,
    for it is a bare day in older states and an object in newer ones; the oldest have no `ids` around them."""
    whole = F.from_json(text, "map<string,variant>")
    inner = F.try_variant_get(whole["ids"], "$", "map<string,variant>")
    horizon = F.try_variant_get(whole["horizon"], "$", "int")
    part = lambda v, c: F.try_variant_get(v, f"$.{c}", "string")
    bare = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    rows = F.map_entries(F.when(F.map_contains_key(whole, "ids"), inner).otherwise(whole))
    one = lambda e: F.struct(e["key"].alias("id"), bare(e["value"]).alias("day"), *[part(e["value"], c).alias(c) for c in ("first_seen", "date", "venue", "last")], horizon.alias("horizon"))
    return F.transform(rows, one)


def renames(gone: DataFrame, added: DataFrame, bucket: list[str]) -> DataFrame:
    """Pairs of buckets in which exactly one id has gone and one was added."""
    one = lambda d, name: d.groupBy(*bucket).agg(F.min("id").alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return one(gone, "old_id").join(one(added, "new_id"), bucket)


def guarded(report: DataFrame) -> DataFrame:
    """report: source, ok, count, error, prev_count. A success without rows, where the last one had some, is a failure."""
    empty = F.col("ok") & (F.col("count") == 0) & (F.coalesce("prev_count", F.lit(0)) > 0)
    error = F.concat(F.lit("0 events parsed (was "), F.col("prev_count").cast("string"), F.lit(")"))
    return report.withColumns({"ok": F.col("ok") & ~empty, "error": F.when(empty, error).otherwise(F.col("error"))})


def carry_over(previous: DataFrame, failed: DataFrame, today: str, most_days: int = 14, written_on: str | None = None) -> DataFrame:
    """Upcoming rows of failed sources come back, marked with the day since which their source is stale: its last success, else the least
    of the marks that its rows have or the day on which the previous output was written. One day for all rows of a source; none come
    back after most_days."""
    t = F.lit(today).cast("date")
    mark = F.coalesce(F.col("stale_since"), F.lit(written_on or today).cast("date"))
    since = previous.join(failed.select("source"), "source", "left_semi").groupBy("source").agg(F.min(mark).alias("__least"))
    since = failed.join(since, "source").select("source", F.coalesce("last_ok", "__least").alias("__since")).where(F.datediff(t, F.col("__since")) <= most_days)
    rows = previous.where(F.col("date") >= t).join(since, "source")
    return rows.withColumn("stale_since", F.col("__since")).select(*previous.columns)


def patched(previous: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """A run of some sources: their rows are the fresh ones, all other rows stay. Columns that one side lacks are null there."""
    return previous.join(sources, "source", "left_anti").unionByName(fresh, allowMissingColumns=True)


def from_source(events: DataFrame, strategy: str, slug: str) -> DataFrame:
    """What one source has listed: of its strategy, and of its own venue unless it is open data."""
    same = F.col("source") == strategy
    return events.where(same if strategy == "opendata" else same & (F.col("source_slug") == slug))


def in_order(*parts: DataFrame) -> DataFrame:
    """Union of sources with an ordinal of arrival: first by part, then as each part has them. Up to 1024 sources of a million partitions
    each; more are an error, not an overlap."""
    if len(parts) > 1024:
        raise ValueError("over 1024 sources")
    out = None
    for i, p in enumerate(parts):
        place = F.when(F.spark_partition_id() < 1 << 20, F.monotonically_increasing_id()).otherwise(F.raise_error(F.lit("a source of over a million partitions")))
        p = p.withColumn("ord", F.lit(i << 53).cast("long") + place)
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def due(cache: DataFrame, today: str, found: str = "found", at: str = "at", no: int = 30, yes: int = 365) -> Column:
    """True for keys to ask again: never asked, asked in vain `no` days ago, answered `yes` days ago, or asked on no readable day."""
    age = F.datediff(F.lit(today).cast("date"), F.try_to_date(F.col(at), "yyyy-MM-dd"))
    return age.isNull() | (age >= F.when(F.coalesce(F.col(found), F.lit(False)), yes).otherwise(no))


def fresh_chunk(at: Column, today: str, days: int = 14) -> Column:
    """Answers that may be used again: at most `days` days old."""
    return F.coalesce(F.datediff(F.lit(today).cast("date"), F.try_to_date(at, "yyyy-MM-dd")) <= days, F.lit(False))


def streaks(df: DataFrame, key: str, day: str, bad: str) -> DataFrame:
    """Runs of consecutive bad days: key, start, end, days. A run breaks at a good day."""
    w = Window.partitionBy(key).orderBy(day)
    marked = df.withColumn("island", F.sum(F.when(F.col(bad), 0).otherwise(1)).over(w))
    return marked.where(F.col(bad)).groupBy(key, "island").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count(F.lit(1)).alias("days")).drop("island")


def upsert(old: DataFrame, new: DataFrame, key: str, today: str) -> DataFrame:
    """Today's row is replaced; older days are only added if missing."""
    cols = [c for c in old.columns if c != key]
    o, n = old.select(key, *[F.col(c).alias(f"o_{c}") for c in cols], F.lit(1).alias("__o")), new.select(key, *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(1).alias("__n"))
    j = o.join(n, key, "full")
    take_new = F.col("__o").isNull() | (F.col("__n").isNotNull() & (F.col(key) == F.lit(today).cast(old.schema[key].dataType)))
    held = [c for c in cols if c == "first"]  # a day's first time stays what it was
    return j.select(key, *[(F.coalesce(f"o_{c}", f"n_{c}") if c in held else F.when(take_new, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))).alias(c) for c in cols])
