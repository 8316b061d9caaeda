"""The programme's query layer: filters, facets, suggestions, worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import artist_key, fuzzy, has_text


def any_pick(picks: dict[str, list]) -> Column:
    """One OR group over all non-empty pick lists; no picks, no restriction. A name that ends in [] is a column of arrays."""
    tests = [F.coalesce(F.arrays_overlap(F.col(c[:-2]), F.array(*map(F.lit, v))) if c.endswith("[]") else F.col(c).isin(v), F.lit(False)) for c, v in picks.items() if v]
    out = None
    for t in tests:
        out = t if out is None else out | t
    return F.lit(True) if out is None else out


def facets(df: DataFrame, columns: dict[str, str], weight: str | None = None) -> DataFrame:
    """facet, value, n for each column: one pass that expands each row once per facet and element, then one aggregation. Each element of
    an array counts; null arrays have none."""

    def elements(f, c):
        pair = lambda x: F.struct(F.lit(f).alias("facet"), x.cast("string").alias("value"))
        if isinstance(df.schema[c].dataType, T.ArrayType):
            return F.transform(F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)), pair)
        return F.array(pair(F.col(c)))

    pairs = F.explode(F.concat(*[elements(f, c) for f, c in columns.items()]))
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.select(pairs.alias("p"), *([weight] if weight else [])).groupBy("p.facet", "p.value").agg(n.alias("n"))


def top_with_pins(df: DataFrame, value: str, k: int, pins: list[str], by: str | None = None) -> DataFrame:
    """Counts of a value, the k most frequent and the pinned ones, which stay at 0 too; ties by value."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    zero = df.sparkSession.createDataFrame([(p, 0) for p in pins], f"{value} string, n long")
    ranked = counts.unionByName(zero).groupBy(value).agg(F.max("n").alias("n"))
    top = ranked.orderBy(F.desc("n"), value).limit(k)  # k is the feature: a top-k report
    return top.unionByName(ranked.where(F.col(value).isin(pins))).distinct()


def suggest(keys: DataFrame, query: str, caps: dict[str, int]) -> DataFrame:
    """keys: kind, name, key, weight. The best of each kind by score, then weight, then name, up to its cap; groups in order of their
    best score, then kind."""
    scored = keys.withColumn("score", fuzzy(F.col("key"), F.lit(query))).where("score >= 0")
    most = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("score", F.desc("weight"), "name"))).where(F.col("rank") <= most[F.col("kind")])
    best = scored.groupBy("kind").agg(F.min("score").alias("best"))  # as many rows as kinds
    place = best.withColumn("kind_rank", F.row_number().over(Window.orderBy("best", "kind"))).drop("best")
    return ranked.join(place, "kind").select("kind", "kind_rank", "rank", "name", "score")


def first_by(df: DataFrame, keys: list[str], order: list[Column], take: list[str]) -> DataFrame:
    """The first row of each key by an order: a min over a struct, so partial aggregation applies and no group is sorted."""
    return df.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *take)).alias("s")).select(*keys, *[f"s.{t}" for t in take])


def mode_first(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each key; of equals the one seen first."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("at"))
    return first_by(n, keys, [-F.col("n"), F.col("at")], [value, "n"])


def word_shingles(c: Column, longest: int | list[int]) -> Column:
    """All runs of 1 to `longest` words, or of the numbers of words given, for whole-word containment by an equi-join."""
    w = F.split(c, " ")
    sizes = F.sequence(F.lit(1), F.lit(longest)) if isinstance(longest, int) else F.array(*map(F.lit, longest)).cast("array<int>")
    runs = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.when(i + k - 1 <= F.size(w), F.array_join(F.slice(w, i, k), " ")))))
    return F.array_distinct(F.filter(runs, lambda x: x.isNotNull()))


FOREVER = "9999-12-31"
#: What the text query looks through.
SEARCHED = ("title", "venue", "area", "raw_genre", "subgenres", "description", "summary")


def framed(events: DataFrame, start: str, end: str = FOREVER, date: str = "date") -> DataFrame:
    """Events of the days from start to end, both included; days are yyyy-MM-dd text."""
    return events.where(F.col(date).between(start, end))


def is_new(first_seen: Column, now: Column, days: int = 7) -> Column:
    """First seen at most `days` days ago, in fractions of a day; false for null and for 'baseline'."""
    at = F.try_to_timestamp(first_seen)
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at)) / F.lit(86400.0)
    return F.coalesce(age.between(0, days), F.lit(False))


def pills(new: Column | None = None, mine: Column | None = None, favourite: Column | None = None, liked: Column | None = None) -> Column:
    """All toggles that are on; a toggle that is off (None) does not count."""
    out = F.lit(True)
    for p in (new, mine, favourite, liked):
        out = out if p is None else out & F.coalesce(p, F.lit(False))
    return out


def programme(events: DataFrame, picks: dict[str, list] | None = None, query: str = "", on: Column | None = None, start: str = "0000-01-01", end: str = FOREVER) -> DataFrame:
    """Concerts of the frame that pass the toggles `on`, any pick of the one OR group of genres, styles and venues, and the text query over
    SEARCHED without regard to case and accents."""
    out = framed(events.where("is_music"), start, end).where(F.lit(True) if on is None else on).where(any_pick(picks or {}))
    if query.strip():
        fields = [F.array_join(c, " ") if isinstance(events.schema[c].dataType, T.ArrayType) else F.col(c) for c in SEARCHED if c in events.columns]
        out = out.where(has_text(fields, query))
    return out


def scope_counts(events: DataFrame, on: Column | None = None, start: str = "0000-01-01", end: str = FOREVER) -> DataFrame:
    """Counts beside the choices: facets of the frame after the toggles, before picks and text."""
    scope = framed(events.where("is_music"), start, end).where(F.lit(True) if on is None else on)
    return facets(scope, {"genre": "genres", "style": "subgenres", "venue": "venue"})


# Liked names that are plain words of a bill match only when equal.
PLAIN_WORDS = [
    "live", "trio", "duo", "quartet", "quintet", "band", "club", "jazz", "blues", "night", "party", "session", "orchestra",
    "orchestre", "ensemble", "soir", "concert", "festival", "friends", "guests", "special", "music", "sound", "sounds", "paris", "release",
]


def liked_hits(events: DataFrame, liked: DataFrame, ids: DataFrame, id: str = "id", acts: str = "acts", profiles: str = "profiles") -> DataFrame:
    """events: id, acts (names), profiles (ids of their profiles); liked: name; ids: profile. (id, hit): acts whose key is a liked key;
    liked keys of five letters or two words, none of them a plain word, that stand as whole words inside an act's key that is no liked
    key itself; profiles that are liked. Runs of words meet liked keys by equality, so nothing is compared pair by pair; runs have the
    numbers of words that liked keys have, which the driver asks for: a handful of numbers."""
    keys = liked.select(artist_key(F.col("name")).alias("hit")).where("hit != ''").distinct()
    act = events.select(id, F.explode(acts).alias("a")).select(id, artist_key(F.col("a")).alias("key")).where("key != ''").distinct()
    exact = act.join(keys, act["key"] == keys["hit"], "left_semi").select(id, F.col("key").alias("hit"))
    long = keys.where(((F.length("hit") >= 5) | F.contains("hit", F.lit(" "))) & ~F.col("hit").isin(PLAIN_WORDS))
    rest = act.join(keys, act["key"] == keys["hit"], "left_anti")
    sizes = sorted(r.n for r in long.select(F.size(F.split("hit", " ")).alias("n")).distinct().collect())
    inside = rest.select(id, F.explode(word_shingles(F.col("key"), sizes)).alias("hit")).join(long, "hit").select(id, "hit")
    known = events.select(id, F.explode(profiles).alias("profile")).join(ids, "profile", "left_semi").select(id, F.concat(F.lit("id:"), "profile").alias("hit"))
    return exact.unionByName(inside).unionByName(known).distinct()


def liked_with_show(hits: DataFrame, events: DataFrame, today: str, id: str = "id") -> DataFrame:
    """One row: how many distinct liked artists have a concert from today on."""
    coming = events.where(F.col("is_music") & (F.col("date") >= today)).select(id)
    return hits.join(coming, id, "left_semi").agg(F.count_distinct("hit").alias("n"))


def top_of_frame(events: DataFrame, k: int = 6, genres: str = "genres") -> DataFrame:
    """What an empty query suggests: the k most frequent genres, ties by name."""
    n = events.select(F.explode(genres).alias("genre")).groupBy("genre").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "genre").limit(k)  # k is the feature


def style_genres(events: DataFrame) -> DataFrame:
    """style → its most frequent genre; of equals the smallest name. Events without a genre count for ''."""
    none = F.when(F.size("genres") > 0, F.col("genres")).otherwise(F.array(F.lit("")))
    pairs = events.select(F.explode("subgenres").alias("style"), none.alias("g")).select("style", F.explode("g").alias("genre"))
    return first_by(pairs.groupBy("style", "genre").agg(F.count(F.lit(1)).alias("n")), ["style"], [-F.col("n"), F.col("genre")], ["genre", "n"])


def acts_of(events: DataFrame, most: int = 5, id: str = "id") -> DataFrame:
    """(id, pos, name, key): headliner and support, or the title without them; cut to `most`, then the first of each key; no names of one
    character, of over 80 or of digits only."""
    names = F.when(F.coalesce(F.col("headliner"), F.lit("")) != "", F.concat(F.array("headliner"), F.coalesce("support", F.array().cast("array<string>")))).otherwise(F.array("title"))
    rows = events.select(id, F.posexplode(F.slice(names, 1, most)).alias("pos", "name")).withColumn("key", artist_key(F.col("name")))
    rows = rows.where((F.length("name") > 1) & (F.length("name") <= 80) & ~F.col("name").rlike("^[0-9]+$") & (F.col("key") != ""))
    return first_by(rows, [id, "key"], [F.col("pos")], ["pos", "name"]).select(id, "pos", "name", "key")
