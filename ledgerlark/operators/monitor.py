"""Calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(days: DataFrame, day: str, carried: list[str]) -> DataFrame:
    """One row per day from the first to the last; `carried` columns keep their last value over gaps, others are null there. The
    calendar has as many rows as days, so one ordered window is bounded by time, not by data."""
    ends = days.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    every = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(day))
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return every.join(days, day, "left").withColumns({c: F.last(c, True).over(w) for c in carried})
