"""How sources do: status rows, history, costs, budgets. The day is an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW = 3


def status(report: DataFrame, previous: DataFrame, today: str, low: int = LOW, active: DataFrame | None = None, partial: bool = False) -> DataFrame:
    """report: slug, ord, strategy, low, ok, count, error, last_ok, prev_count; previous: slug, status, failing_since, last_ok, ord, count,
    error. Successes are `low` under the venue's own bar (else `low`) unless open data, else `ok`. A failure goes on with the streak
    that it had; without an earlier report it began the day after the last success; else today. Sources of the report come first in
    their order, then earlier ones in theirs; after a partial run earlier ones keep their places and new ones follow. Earlier sources that
    are not in `active` (slug), where it is given, are gone for good."""
    t = F.lit(today)
    if active is not None:
        previous = previous.join(active.select("slug"), "slug", "left_semi")
    p = previous.select("slug", *[F.col(c).alias(f"was_{c}") for c in ("status", "failing_since", "last_ok", "ord", "count", "error")])
    j = report.withColumn("__here", F.lit(True)).join(p, "slug", "full")
    here, thin = F.col("__here").isNotNull(), (F.col("count") < F.coalesce("low", F.lit(low))) & (F.col("strategy") != "opendata")
    last = F.coalesce("last_ok", "was_last_ok")
    after = F.date_format(F.date_add(F.try_to_date(last, "yyyy-MM-dd"), 1), "yyyy-MM-dd")
    since = F.when((F.col("was_status") == "failed") & F.col("was_failing_since").isNotNull(), F.col("was_failing_since")).when(F.col("was_status").isNull() & last.isNotNull(), F.least(t, after)).otherwise(t)
    state = F.when(~here, F.col("was_status")).when(~F.col("ok"), "failed").when(thin, "low").otherwise("ok")
    return j.select(
        "slug",
        state.alias("status"),
        F.when(here, F.when(F.col("ok"), F.col("count"))).otherwise(F.col("was_count")).alias("count"),
        F.when(here, F.when(~F.col("ok"), F.col("error"))).otherwise(F.col("was_error")).alias("error"),
        F.when(here & F.col("ok"), t).otherwise(last).alias("last_ok"),
        F.when(here, F.when(~F.col("ok"), since)).otherwise(F.col("was_failing_since")).alias("failing_since"),
        (F.struct(F.col("was_ord").isNull().alias("later"), F.coalesce("was_ord", "ord").alias("ord")) if partial else F.struct((~here).alias("later"), F.when(here, F.col("ord")).otherwise(F.col("was_ord")).alias("ord"))).alias("place"),
    )


def header(new: dict, before: dict, partial: bool) -> dict:
    """What stands above the rows: a partial run on the day of a full one leaves its time, duration and address."""
    kept = ("generated_at", "duration_s", "run_url") if partial and before.get("today") == new["today"] else ()
    return new | {k: before.get(k) for k in kept}


def day_values(rows: DataFrame, keep=()) -> DataFrame:
    """(slug, value): what a day's history holds of each source, as a variant: the count, a number, of one that has answered, the error, a
    text, of one that failed."""
    value = F.when(F.col("status") != "failed", F.col("count").cast("long").cast("variant")).otherwise(F.coalesce("error", F.lit("")).cast("variant"))
    return rows.select(*keep, "slug", value.alias("value"))


def counted(value: Column) -> Column:
    """The count that a history value is; null for an error, also for one that reads like a number."""
    return F.when(F.schema_of_variant(value) != "STRING", F.try_variant_get(value, "$", "bigint"))


def failed_with(value: Column) -> Column:
    """The error that a history value is; null for a count."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def history(today_rows: DataFrame, past: DataFrame, today: str, days: int = 14) -> DataFrame:
    """(date, slug, value): today's values replace those of an earlier run of the day where they cover it; `days` days stay."""
    kept = past.where(F.col("date").between(F.date_format(F.date_sub(F.lit(today).cast("date"), days - 1), "yyyy-MM-dd"), today))
    fresh = today_rows.select(F.lit(today).alias("date"), "slug", "value")
    return kept.join(fresh, ["date", "slug"], "left_anti").select("date", "slug", "value").unionByName(fresh)


def timeline(old: DataFrame, days: DataFrame, cost: DataFrame, today: str) -> DataFrame:
    """old and days: date, sources, ok, usd, first; cost: date, usd. Today's row is replaced, older days are only added where they lack,
    `first` stays; a day with a cost but no row gets one without counts of successes."""
    from .state import upsert

    rows = upsert(old, days, "date", today)
    spent = cost.where("usd > 0").join(rows, "date", "left_anti").groupBy("date").agg(F.round(F.sum("usd"), 4).alias("usd"))
    return rows.unionByName(spent, allowMissingColumns=True)


def day_cost(steps: DataFrame, today: str) -> DataFrame:
    """steps: date, step, usd. Per step and in all what today has cost so far, rounded; other days do not count."""
    mine = steps.where(F.col("date") == today)
    each = mine.groupBy("step").agg(F.round(F.sum(F.coalesce("usd", F.lit(0.0))), 4).alias("usd"))
    return each.unionByName(each.agg(F.lit("total").alias("step"), F.round(F.sum("usd"), 4).alias("usd")))


def cost_by_step(steps: DataFrame, least: float = 0.005) -> DataFrame:
    """Steps that cost at least `least`, the dearest first."""
    return steps.groupBy("step").agg(F.sum("usd").alias("usd")).where(F.col("usd") >= least).orderBy(F.desc("usd"), "step")


def usage(calls: DataFrame, cost: Column, keys=("what", "model", "batch")) -> DataFrame:
    """Calls and rounded cost by keys, and a row of nulls that sums the rounded steps."""
    each = calls.withColumn("__usd", cost).groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("__usd"), 4).alias("usd"))
    total = each.agg(F.sum("calls").alias("calls"), F.round(F.sum("usd"), 4).alias("usd"))
    return each.unionByName(total, allowMissingColumns=True)


def health(rows: DataFrame) -> DataFrame:
    """How many sources are ok, low and failed: one row."""
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "low", "failed")])


def listed(rows: DataFrame) -> DataFrame:
    """Failed sources first, then low ones, then the rest, each in their order."""
    rank = F.when(F.col("status") == "failed", 0).when(F.col("status") == "low", 1).otherwise(2)
    return rows.orderBy(rank, "place")


def causes(failures: DataFrame, systemic: str, least: int = 3) -> DataFrame:
    """failures: slug, cause. Causes, none of them empty, that `least` sources share or that the expression names, with their sources' number."""
    n = failures.where(F.coalesce("cause", F.lit("")) != "").groupBy("cause").agg(F.count_distinct("slug").alias("n"))
    return n.where((F.col("n") >= least) | F.col("cause").rlike(systemic))


def triage(failing: DataFrame, shared: DataFrame, today: str, most: int = 5, tries: int = 3, waiting: int = 1) -> DataFrame:
    """failing: slug, cause, failing_since, tried (the days it was tried, as an array). Sources of a shared cause are left out. Reason, in
    this order: failing for under `waiting` days; tried today; tried on `tries` days of this streak; over the cap, which only eligible
    ones use up, the longest failing first; else go. Days before the streak do not count."""
    rows = failing.join(shared.select("cause"), "cause", "left_anti")
    streak = F.filter(F.coalesce("tried", F.array().cast("array<string>")), lambda x: x >= F.col("failing_since"))
    early = F.datediff(F.lit(today).cast("date"), F.to_date("failing_since")) < waiting
    first = F.when(early, "waiting").when(F.array_contains(streak, today), "today").when(F.size(F.array_distinct(streak)) >= tries, "worn")
    rows = rows.withColumn("reason", first)
    free = F.col("reason").isNull()
    place = F.row_number().over(Window.partitionBy(free).orderBy("failing_since", "slug"))  # as many rows as failing sources
    return rows.withColumn("place", place).withColumn("reason", F.coalesce("reason", F.when(F.col("place") > most, "over").otherwise("go"))).drop("place")


def within_budget(sessions: DataFrame, spent: float, cap: float) -> DataFrame:
    """sessions: ord, usd. `go` for those before which the day's spending is under the cap; one a row of a work list."""
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return sessions.withColumn("before", F.lit(spent) + F.coalesce(F.sum("usd").over(w), F.lit(0.0))).withColumn("go", F.col("before") < cap)


def isolated(days: DataFrame, value: str, day: str = "day") -> DataFrame:
    """Days with a value between two without."""
    w = Window.orderBy(day)  # a row a day
    sides = days.withColumns({"__a": F.lag(value).over(w), "__b": F.lead(value).over(w)})
    return sides.where(F.col(value).isNotNull() & F.col("__a").isNull() & F.col("__b").isNull()).drop("__a", "__b")


def last_days(days: DataFrame, today: str, n: int, day: str = "date") -> DataFrame:
    """The last n days, today among them."""
    return days.where(F.col(day).between(F.date_format(F.date_sub(F.lit(today).cast("date"), n - 1), "yyyy-MM-dd"), today))


def dry_run(events: DataFrame, sample: int = 5) -> tuple[DataFrame, DataFrame]:
    """How many events a source gives, and the first of them by date; nothing is written."""
    return events.agg(F.count(F.lit(1)).alias("n")), events.orderBy("date", "id").limit(sample)  # the sample is the feature
