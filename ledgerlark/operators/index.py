"""The search index: what can be found, how often and how soon, and a table of word ends that a query reads by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, fuzzy, squeeze
from .search import first_by, mode_first

GROUPS = {"artist": "artists", "venue": "venues", "genre": "styles", "style": "styles"}
CAPS = {"artists": 3, "venues": 3, "styles": 6}
#: Above every code point, so that a range from q to q + LAST holds all that begins with q.
LAST = "\U0010ffff"


def coming(events: DataFrame, today: str) -> DataFrame:
    return events.where(F.col("is_music") & (F.col("date") >= today))


def artists(acts: DataFrame, events: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """acts: id, name; events: id, date, time, is_music. The artists (name as it stands first, key, n, soonest), and their coming events as
    rows (key, date, time, id)."""
    when = F.struct("date", F.coalesce(F.nullif("time", F.lit("")), F.lit("99:99")).alias("time"), "id")
    rows = acts.withColumn("key", squeeze(folded(F.col("name")))).where(F.length("key") > 1).join(coming(events, today).select("id", when.alias("at")), "id")
    one = rows.groupBy("key").agg(F.min_by(F.trim("name"), F.struct("at", "name")).alias("name"), F.count_distinct("id").alias("n"), F.min("at.date").alias("soonest"))
    return one, rows.select("key", "at.date", "at.time", "id").distinct()


def venues(events: DataFrame, catalogue: DataFrame, today: str) -> DataFrame:
    """catalogue: name, area. Every venue with its coming concerts and the area that most of them have (of equals the one that comes first),
    else its own; a venue without any is found too."""
    rows = coming(events, today).select("venue", "area", F.struct("date", F.coalesce(F.nullif("time", F.lit("")), F.lit("99:99")).alias("time"), "id").alias("at"))
    n = rows.groupBy(F.col("venue").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    most = mode_first(rows.where(F.coalesce("area", F.lit("")) != ""), ["venue"], "area", "at").select(F.col("venue").alias("name"), F.col("area").alias("common"))
    out = catalogue.join(n, "name", "full").join(most, "name", "left")
    return out.select("name", squeeze(folded(F.col("name"))).alias("key"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("common", "area").alias("area"))


def styles(events: DataFrame, known: DataFrame, today: str) -> DataFrame:
    """known: name, genre: styles ever tagged. Every style with its coming concerts and its most frequent genre."""
    rows = events.where("is_music").select("id", (F.col("date") >= today).alias("on"), F.explode("subgenres").alias("name"), "genres")
    n = rows.groupBy("name").agg(F.count_if("on").alias("n"))
    pairs = rows.select("name", F.explode("genres").alias("genre")).groupBy("name", "genre").agg(F.count(F.lit(1)).alias("c"))
    top = first_by(pairs, ["name"], [-F.col("c"), F.col("genre")], ["genre"]).withColumnRenamed("genre", "top")
    out = known.join(n, "name", "full").join(top, "name", "left")
    return out.select("name", squeeze(folded(F.col("name"))).alias("key"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", F.nullif("genre", F.lit(""))).alias("genre"))


def genres(events: DataFrame, labels: DataFrame, today: str) -> DataFrame:
    """labels: tag, label, aliases (text). Every genre with its coming concerts and how many styles go with it."""
    tagged = events.where("is_music").select("id", (F.col("date") >= today).alias("on"), "subgenres", F.explode(F.array_distinct("genres")).alias("tag"))
    n = tagged.groupBy("tag").agg(F.count_if("on").alias("n"))
    own = tagged.select("tag", F.explode("subgenres").alias("s")).groupBy("tag").agg(F.count_distinct("s").alias("styles"))
    key = squeeze(folded(F.concat_ws(" ", "label", "tag", "aliases")))
    return labels.join(n, "tag", "left").join(own, "tag", "left").select(F.col("label").alias("name"), key.alias("key"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("styles", F.lit(0)).alias("styles"))


def entries(**parts: DataFrame) -> DataFrame:
    """Parts by kind as one table: kind, name, key, n, soonest (null but for artists)."""
    out = None
    for kind, df in parts.items():
        soonest = F.col("soonest") if "soonest" in df.columns else F.lit(None).cast("string")
        df = df.select(F.lit(kind).alias("kind"), "name", "key", F.col("n").cast("long").alias("n"), soonest.alias("soonest"))
        out = df if out is None else out.unionByName(df)
    return out


def word_ends(index: DataFrame) -> DataFrame:
    """Each entry once for each place in its key, with what follows from there: whatever a key contains begins one of its rows, so a query
    is a range of a table that is sorted by `edge`. Keys are names; the table has as many rows as they have letters."""
    return index.withColumn("edge", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substr("key", i))))


def stored(index: DataFrame, path: str) -> str:
    """The table of word ends, sorted over its files, so that a range reads the few row groups that hold it."""
    word_ends(index).repartitionByRange("edge").sortWithinPartitions("edge").write.parquet(path)
    return path


def suggest(ends: DataFrame, query: str, caps: dict[str, int] | None = None) -> DataFrame:
    """What a query finds: place of the group, group, rank, kind, name, score. Artists by score, then soonest, then events; all else by
    score, then number; up to each group's cap. Genres and styles lead where their best score beats the artists'. All that matches in any way
    contains the query's longest word, so that word's range holds every candidate."""
    caps = CAPS if caps is None else caps
    q = " ".join(query.lower().split())
    word = max(q.split(" "), key=len)
    rows = ends.where((F.col("edge") >= word) & (F.col("edge") < word + LAST)).dropDuplicates(["kind", "name", "key"]).withColumn("score", fuzzy(F.col("key"), F.lit(q))).where("score >= 0")
    group = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])[F.col("kind")]
    soonest = F.when(group == "artists", F.col("soonest"))
    w = Window.partitionBy("group").orderBy("score", F.asc_nulls_last("__soonest"), F.desc("n"), "name")
    rows = rows.withColumns({"group": group, "__soonest": soonest}).withColumn("rank", F.row_number().over(w))
    first = F.create_map(F.lit("artists"), F.lit(1), F.lit("venues"), F.lit(2), F.lit("styles"), F.lit(3))
    best = rows.groupBy("group").agg(F.min("score").alias("best"))  # a row a group
    lead = best.agg(F.min(F.when(F.col("group") == "styles", F.col("best"))).alias("s"), F.min(F.when(F.col("group") == "artists", F.col("best"))).alias("a"))
    ahead = lead.select(((F.col("s") < F.col("a")) | (F.col("a").isNull() & F.col("s").isNotNull())).alias("ahead"))
    rows = rows.join(F.broadcast(ahead), F.lit(True))  # one row
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("group")]
    place = F.when((F.col("group") == "styles") & F.coalesce("ahead", F.lit(False)), 0).otherwise(first[F.col("group")])
    return rows.where(F.col("rank") <= cap).select(place.alias("place"), "group", "rank", "kind", "name", "score")


def catalogue(events: DataFrame, venues_: DataFrame) -> DataFrame:
    """(name, area): every venue of the programme and of the configuration but open data, with its configured area."""
    own = venues_.where("strategy != 'opendata'")
    areas = own.where("coalesce(area, '') != ''").groupBy("name").agg(F.max("area").alias("area"))
    return events.select(F.col("venue").alias("name")).union(own.select("name")).distinct().join(areas, "name", "left")


def headline(events: DataFrame, today: str) -> DataFrame:
    """One row: concerts from today on, those to the end of today's week, and events first seen today."""
    sunday = F.date_format(F.date_add(F.date_trunc("week", F.lit(today).cast("date")).cast("date"), 6), "yyyy-MM-dd")
    on = F.col("is_music") & (F.col("date") >= today)
    return events.agg(F.count_if(on).alias("upcoming"), F.count_if(on & (F.col("date") <= sunday)).alias("this_week"), F.count_if(F.col("first_seen") == today).alias("fresh"))

