"""Records of open data, calendars and offers as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import is_free, price_text
from ..functions.text import clean_text, folded, slug, squeeze
from ..operators.classify import tag_noise
from ..operators.search import first_by

# Labels of calendars that say nothing about an event.
NOISE = ["concert", "promotion", "agenda", "sowprog"]
OFFERS = "`@type` string, isAccessibleForFree boolean, offers array<struct<name:string,price:string,availability:string>>"


def one_name_a_place(records: DataFrame, street: str = "address_street", code: str = "address_zipcode", name: str = "address_name", at: str = "ord") -> DataFrame:
    """Where one street address has several venue names, all its records take the most frequent one; of equals the one seen first."""
    rows = records.withColumns({"__street": F.lower(clean_text(F.coalesce(street, F.lit("")))), "__name": clean_text(F.coalesce(name, F.lit("")))})
    n = rows.where("__street != '' and __name != ''").groupBy("__street", code, "__name").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at"))
    best = first_by(n.withColumn(code, F.coalesce(code, F.lit(""))), ["__street", code], [-F.col("n"), F.col("at")], ["__name"]).withColumnsRenamed({"__name": "__best", code: "__code"})
    j = rows.join(best, (rows["__street"] == best["__street"]) & (F.coalesce(rows[code], F.lit("")) == best["__code"]), "left")
    return j.withColumn(name, F.when(F.col("__best").isNotNull() & (F.col("__name") != ""), F.col("__best")).otherwise(F.col(name))).select(*records.columns)


def occurrences(records: DataFrame, today: str, horizon: int, most: int = 40, id: str = "id") -> DataFrame:
    """records: id, title, address_name, qfap_tags, occurrences ('start_end;start_end'), date_start, price_type, price_detail, lead_text and
    others. One event per day of a record: starts of at least 16 characters, else date_start; the first time of a day counts; days from
    today to the horizon, the first `most` in the order given. Records without a name and those for children that are no concerts go."""
    tags = F.filter(F.split(F.coalesce("qfap_tags", F.lit("")), ";"), lambda x: x != "")
    rows = records.withColumns({"__tags": tags, "venue": clean_text(F.coalesce("address_name", F.lit("")))})
    rows = rows.where((F.col("venue") != "") & ~(F.array_contains("__tags", "Enfants") & ~F.array_contains("__tags", "Concert")))
    starts = F.filter(F.transform(F.split(F.coalesce("occurrences", F.lit("")), ";"), lambda o: F.substring_index(o, "_", 1)), lambda s: F.length(s) >= 16)
    starts = F.when(F.size(starts) > 0, starts).when(F.coalesce("date_start", F.lit("")) != "", F.array("date_start")).otherwise(F.array().cast("array<string>"))
    each = rows.select(id, F.posexplode(starts).alias("pos", "start")).select(id, "pos", F.substring("start", 1, 10).alias("date"), F.substring("start", 12, 5).alias("time"))
    day, t = F.try_to_date("date", "yyyy-MM-dd"), F.lit(today).cast("date")
    each = first_by(each.where(day.between(t, F.date_add(t, horizon))), [id, "date"], [F.col("pos")], ["pos", "time"])
    # the first `most` places of a record: a bounded sorted array, so that no record's days are sorted as rows
    top = each.groupBy(id).agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "date", "time"))), 1, most).alias("d")).select(id, F.explode("d").alias("d")).select(id, "d.date", F.nullif("d.time", F.lit("00:00")).alias("time"))
    kind = F.lower(F.coalesce("price_type", F.lit("")))
    price = F.coalesce(price_text(F.col("price_detail")), F.nullif(kind, F.lit("")))
    genre = F.nullif(F.array_join(F.filter("__tags", lambda x: x != "Concert"), ", "), F.lit(""))
    more = {"url": "url", "access_link": "ticket_url", "cover_url": "image", "lat": "lat", "lon": "lon"}
    more = [F.col(c).alias(name) for c, name in more.items() if c in records.columns]
    if "address_street" in records.columns:
        part = lambda c: F.nullif(F.col(c), F.lit("")) if c in records.columns else F.lit(None)
        more.append(F.nullif(F.concat_ws(", ", part("address_street"), part("address_zipcode"), part("address_city")), F.lit("")).alias("address"))
    told = rows.select(id, *more, "title", "venue", slug(F.col("venue")).alias("venue_slug"), price.alias("price"), (kind == "gratuit").alias("free"), genre.alias("raw_genre"), clean_text(F.coalesce("lead_text", F.lit(""))).alias("description"))
    return top.join(told, id).withColumn("source", F.lit("opendata"))


def calendar(records: DataFrame, venue: str, noise: list[str], share: float = 0.8) -> DataFrame:
    """records: id, title, start_date, cost, categories and tags (arrays of names), excerpt, url of one venue's calendar. Events whose label
    is the categories and tags that are not noise, not the venue's name, not in the title and not on over `share` of all events."""
    total = records.agg(F.count(F.lit(1)).alias("total"))
    often = records.select(F.explode("categories").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") > share * F.col("total"))  # one row
    often = often.agg(F.collect_set("c").alias("generic"))  # at most 1 / share of an event's categories are on so many events
    rows = records.crossJoin(F.broadcast(often)).withColumn("title", clean_text(F.coalesce("title", F.lit(""))))  # one row
    kept = tag_noise(F.concat(F.filter("categories", lambda c: ~F.array_contains("generic", c)), "tags"), F.col("title"), F.lit(venue), noise)
    told = [F.nullif(F.col(c), F.lit("")) for c in ("excerpt", "description") if c in records.columns]
    image = [F.col("image")] if "image" in records.columns else []
    start = F.substring("start_date", 1, 16)
    return rows.select(
        "id", "title", F.substring(start, 1, 10).alias("date"), F.nullif(F.substring(start, 12, 5), F.lit("")).alias("time"), F.lit(venue).alias("venue"), "url", price_text(F.col("cost")).alias("price"), is_free(F.col("cost")).alias("free"),
        F.nullif(F.array_join(kept, ", "), F.lit("")).alias("raw_genre"), clean_text(F.coalesce(*told, F.lit(""))).alias("description"), *image,
    )


def offers(ld: Column) -> Column:
    """Of one event's JSON-LD: struct(price, free, sold_out). The price runs from the least to the greatest paid offer; sold out if every
    paid offer is (every offer, where none is paid); free as it says itself, or where an offer's name says so and none is paid."""
    d = F.from_json(ld, OFFERS)
    none = F.array().cast("array<struct<name:string,price:double,availability:string>>")
    rows = F.coalesce(F.transform(d["offers"], lambda o: F.struct(o["name"].alias("name"), o["price"].try_cast("double").alias("price"), o["availability"].alias("availability"))), none)
    paid = F.filter(rows, lambda o: o["price"] > 0)
    amounts = F.array_sort(F.array_distinct(F.transform(paid, lambda o: o["price"])))
    show = lambda n: F.regexp_replace(F.format_string("%.2f", n), r"\.00$", "")
    lo, hi = F.array_min(amounts), F.array_max(amounts)
    price = F.when(lo == hi, F.concat(show(lo), F.lit(" €"))).when(lo < hi, F.concat(show(lo), F.lit("–"), show(hi), F.lit(" €")))
    named = F.filter(rows, lambda o: is_free(o["name"]))
    free = F.coalesce(d["isAccessibleForFree"], F.lit(False)) | ((F.size(paid) == 0) & (F.size(named) > 0))
    sold = F.when(F.size(paid) > 0, paid).otherwise(rows)
    return F.struct(price.alias("price"), free.alias("free"), ((F.size(sold) > 0) & F.forall(sold, lambda o: F.contains(o["availability"], F.lit("SoldOut")))).alias("sold_out"))


def band_hints(events: DataFrame, acts: DataFrame) -> DataFrame:
    """events: id, ord, is_music, description, url, ticket_url; acts: id, key. (key, url): the band's address that an event's text links, where
    the subdomain spells the act's name, or the event has one act and one link. The first event wins."""
    text = F.concat_ws(" ", "description", "url", "ticket_url")
    subs = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)https?://([a-z0-9-]+)\.bandcamp\.com\b"), F.lit(1)), F.lower))
    subs = F.filter(subs, lambda s: ~s.isin("www", "daily", "bandcamp", "get"))
    linked = events.where("is_music").select("id", "ord", F.array_sort(subs).alias("subs")).where(F.size("subs") > 0)
    n = acts.groupBy("id").agg(F.count(F.lit(1)).alias("n_acts"))
    pairs = linked.join(n, "id").join(acts, "id").select("ord", "key", "n_acts", "subs", F.posexplode("subs").alias("at", "sub"))
    fits = (F.replace("sub", F.lit("-"), F.lit("")) == F.replace("key", F.lit(" "), F.lit(""))) | ((F.col("n_acts") == 1) & (F.size("subs") == 1))
    return first_by(pairs.where(fits), ["key"], [F.col("ord"), F.col("at")], ["sub"]).select("key", F.concat(F.lit("https://"), "sub", F.lit(".bandcamp.com")).alias("url"))


def without_summary(events: DataFrame, generic: DataFrame, most: int = 3) -> DataFrame:
    """Concerts without a description whose page is their own: its address stands on at most `most` events and is no source's own page."""
    shared = events.where("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("url")
    return events.where(F.col("is_music") & (F.coalesce("url", F.lit("")) != "") & (F.coalesce("description", F.lit("")) == "")).join(shared.union(generic.select("url")), "url", "left_anti")


def summaries(answer: Column) -> Column:
    """map id → summary of an answer that holds an object with a `summaries` list; null where there is none; a summary that is no text is
    empty; texts are cut at a word."""
    from ..functions.text import cap

    body = F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))
    items = F.from_json(body, "summaries array<struct<id:string,summary:string>>")["summaries"]
    rows = F.filter(items, lambda x: x["id"].isNotNull())
    return F.map_from_entries(F.transform(rows, lambda x: F.struct(x["id"].alias("id"), cap(squeeze(F.coalesce(x["summary"], F.lit("")))).alias("summary"))))


def api_message(error: Column) -> Column:
    """The sentence of a service's error; the whole where none is marked."""
    said = F.regexp_extract(error, r"""['"]message['"]: (['"])(.+?)\1[,}]""", 2)
    return F.when(said != "", said).otherwise(F.coalesce(error, F.lit("")))


def player(players: Column, name: Column, deezer: Column) -> Column:
    """players: map of act → struct(spotify struct<id>, bandcamp struct<url,embed>). What to play an act by: 'spotify' with a well-formed id,
    else 'bandcamp' with an embed of its own, else 'deezer' where there is a match, else ''. Names match exactly, else without accents
    and case."""
    loose = F.get(F.map_values(F.map_filter(players, lambda k, _: folded(k) == folded(name))), F.lit(0))
    p = F.coalesce(F.try_element_at(players, name), loose)
    ok = p["spotify"]["id"].rlike("^[A-Za-z0-9]{8,64}$")
    embed = p["bandcamp"]["url"].rlike("^https?://") & p["bandcamp"]["embed"].rlike(r"^https://bandcamp\.com/EmbeddedPlayer/")
    return F.when(ok, "spotify").when(embed, "bandcamp").when(deezer.isNotNull(), "deezer").otherwise("")


def player_map(acts: DataFrame, cache: DataFrame) -> DataFrame:
    """acts: id, name, key; cache: key, player. (id, players): a map of the act's name to its player for each event that has one."""
    return acts.join(cache, "key").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "player")))).alias("players"))  # an event has a handful of acts
