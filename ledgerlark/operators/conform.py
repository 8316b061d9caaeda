"""Events meet configured venues: by name, then by place; the first in file order wins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import km
from ..functions.text import venue_key
from .search import first_by

EARTH = 6371.0  # km, the radius that distances are reckoned with


def by_name(events: DataFrame, venues: DataFrame, key: str = "key", venue_key: str = "venue_key", order: str = "ord", take=("venue",)) -> DataFrame:
    """First venue whose key equals the event's or is a word-wise beginning of it, or the other way round. All beginnings of either
    key become join keys, so the join is by equality however many venues there are."""
    heads = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, " "))), lambda i: F.array_join(F.slice(F.split(c, " "), F.lit(1), i), " "))
    e, v = events.select(key).distinct(), venues.select(venue_key, order, *take)
    one = e.withColumn("h", F.explode(heads(F.col(key)))).join(v.withColumn("h", F.col(venue_key)), "h")
    two = e.withColumn("h", F.col(key)).join(v.withColumn("h", F.explode(heads(F.col(venue_key)))), "h")
    return first_by(one.unionByName(two), [key], [F.col(order)], list(take))


def by_place(events: DataFrame, venues: DataFrame, radius_km: float, keys=("id",), order: str = "ord", take=("venue",)) -> DataFrame:
    """First venue within radius_km, in file order and not by distance; venues with geo_match false, where there is such a column, have
    none. Places are points on the unit sphere in cubes as wide as the chord that spans the radius, so two places within it lie in cubes that
    touch, at the poles and across the 180th meridian as elsewhere. A venue stands in its cube and the 26 around it. Of venues at one place
    only the first can be met, and events at one place meet the same one, so places meet, each once, however many rows stand there."""
    edge = 2 * math.sin(min(radius_km / EARTH, math.pi) / 2) * (1 + 1e-9) + 1e-12

    def cube(lat, lon):
        xyz = (F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat)))
        return [F.floor(c / F.lit(edge)) for c in xyz]

    if "geo_match" in venues.columns:
        venues = venues.where(F.coalesce("geo_match", F.lit(True)))
    v = first_by(venues.select(F.col("lat").alias("vlat"), F.col("lon").alias("vlon"), order, *take), ["vlat", "vlon"], [F.col(order)], [c for c in dict.fromkeys([order, *take])])
    for axis, c in zip("xyz", cube(F.col("vlat"), F.col("vlon")), strict=True):
        v = v.withColumn(f"c{axis}", F.explode(F.array(c - 1, c, c + 1)))
    e = events.select("lat", "lon").distinct().withColumns(dict(zip(("cx", "cy", "cz"), cube(F.col("lat"), F.col("lon")), strict=True)))
    near = e.join(v, ["cx", "cy", "cz"]).where(km(F.col("lat"), F.col("lon"), F.col("vlat"), F.col("vlon")) <= radius_km)
    at = first_by(near, ["lat", "lon"], [F.col(order)], [c for c in dict.fromkeys([order, *take])])
    return first_by(events.select(*keys, "lat", "lon").join(at, ["lat", "lon"]), list(keys), [F.col(order)], list(take))


def canonical(events: DataFrame, venues: DataFrame, radius_km: float, key: str = "id") -> DataFrame:
    """events: key, source, venue, venue_slug, lat, lon; venues: name, slug, ord, lat, lon, geo_match. Open-data events take name and slug of
    the first configured venue of that name, else of the first one near; all other events and columns stay as they are."""
    v = venues.select("ord", "lat", "lon", "geo_match", F.struct("name", "slug").alias("to"), venue_key(F.col("name")).alias("venue_key"))
    open_ = events.where(F.col("source") == "opendata").withColumn("key", venue_key(F.col("venue")))
    named = by_name(open_, v, take=("to",)).withColumnRenamed("to", "by_name")
    near = by_place(open_, v, radius_km, (key,), take=("to",)).withColumnRenamed("to", "by_place")
    matched = open_.select(key, "key").join(named, "key", "left").join(near, key, "left").select(key, F.coalesce("by_name", "by_place").alias("__to"))
    out = events.join(matched.where("__to is not null"), key, "left")
    return out.withColumns({"venue": F.coalesce("__to.name", "venue"), "venue_slug": F.coalesce("__to.slug", "venue_slug")}).drop("__to")


def with_venue(events: DataFrame, venues: DataFrame, own: str = "own_slug", slug: str = "venue_slug") -> DataFrame:
    """Each event beside its venue's row, or beside the row of the source that listed it where the venue is not configured."""
    cols = [c for c in venues.columns if c != "slug"]
    both = lambda at, name: venues.select(F.col("slug").alias(at), F.struct(*cols).alias(name))
    j = events.join(both(slug, "__a"), slug, "left").join(both(own, "__b"), own, "left")
    return j.select(*events.columns, F.coalesce("__a", "__b").alias("venue_row"))
