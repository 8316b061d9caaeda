"""The search index, the catalogue, histories as variants, blocks from SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index, search, state, status
from ..sources import blocks
from ..sources.tables import first, table
from .registry import query

TODAY = "1997-01-01"
LINES = "(SELECT l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_shipdate) AS l_shipdate, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1)"
EVENTS = f"SELECT id, strftime(l_shipdate, '%Y-%m-%d') AS date, l_quantity > 2 AS is_music, p_name AS act, s_name AS venue, n_name AS area, p_type AS style, p_brand AS genre FROM {LINES} JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"


def shows(spark, d):
    """Order lines as concerts, one a number: parts play, suppliers house them."""
    line, part, supplier, nation = (table(spark, d, t) for t in ("lineitem", "part", "supplier", "nation"))
    line = line.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(*[f(c).alias(c) for f, c in ((F.min, "l_partkey"), (F.min, "l_suppkey"), (F.min, "l_shipdate"), (F.max, "l_quantity"))])
    j = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    one = lambda c: F.array(F.col(c))
    return j.select("id", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("time"), (F.col("l_quantity") > 2).alias("is_music"), F.col("p_name").alias("name"), F.col("s_name").alias("venue"), F.col("n_name").alias("area"), one("p_type").alias("subgenres"), one("p_brand").alias("genres"))


def entries(spark, d):
    e, s = shows(spark, d), table(spark, d, "supplier")
    known = e.sparkSession.createDataFrame([("never played", "")], "name string, genre string")
    who, _ = index.artists(e.select("id", "name"), e, TODAY)
    return index.entries(artist=who, venue=index.venues(e, s.select(F.col("s_name").alias("name"), F.lit(None).cast("string").alias("area")), TODAY), style=index.styles(e, known, TODAY))


INDEX = f"""e AS ({EVENTS}), c AS (SELECT * FROM e WHERE is_music AND date >= '{TODAY}'),
i AS (SELECT 'artist' AS kind, min(act) AS name, lower(act) AS key, count(DISTINCT id) AS n, min(date) AS soonest FROM c GROUP BY lower(act)
UNION ALL SELECT 'venue', s_name, lower(s_name), (SELECT count(*) FROM c WHERE venue = s_name), NULL FROM (SELECT DISTINCT s_name FROM supplier)
UNION ALL SELECT 'style', style, lower(style), count(*) FILTER (WHERE date >= '{TODAY}'), NULL FROM e WHERE is_music GROUP BY style UNION ALL SELECT 'style', 'never played', 'never played', 0, NULL)"""


@query(f"""WITH {INDEX} SELECT kind, name, key, n, soonest FROM i""")
def index_entries(spark, d):
    return entries(spark, d)


def suggested(q: str) -> str:
    words = " AND ".join(f"len(list_filter(string_split(key, ' '), lambda w: starts_with(w, '{w}'))) > 0" for w in q.split())
    return f"""WITH {INDEX}, s AS (SELECT *, CASE kind WHEN 'artist' THEN 'artists' WHEN 'venue' THEN 'venues' ELSE 'styles' END AS "group", CASE WHEN starts_with(key, '{q}') THEN 0 WHEN {words} THEN 1 WHEN contains(key, '{q}') THEN 2 ELSE -1 END AS score FROM i),
g AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score, soonest NULLS LAST, n DESC, name) AS rank FROM s WHERE score >= 0),
b AS (SELECT min(score) FILTER (WHERE "group" = 'styles') AS s, min(score) FILTER (WHERE "group" = 'artists') AS a FROM g)
SELECT CAST(CASE WHEN "group" = 'styles' AND (SELECT coalesce(s < a, s IS NOT NULL) FROM b) THEN 0 WHEN "group" = 'artists' THEN 1 WHEN "group" = 'venues' THEN 2 ELSE 3 END AS INTEGER) AS place, "group", CAST(rank AS INTEGER) AS rank, kind, name, score FROM g WHERE rank <= CASE "group" WHEN 'styles' THEN 6 ELSE 3 END"""


@query(suggested("ri"))
def suggest_soonest(spark, d):
    return index.suggest(index.word_ends(entries(spark, d)), "ri")


@query(suggested("p sm"))
def suggest_words(spark, d):
    return index.suggest(index.word_ends(entries(spark, d)), "p sm")


@query(f"""WITH e AS ({EVENTS}), c AS (SELECT *, row_number() OVER (PARTITION BY venue, area ORDER BY date, id) AS r FROM e WHERE is_music AND date >= '{TODAY}')
SELECT s_name AS name, (SELECT count(*) FROM c WHERE venue = s_name) AS n, coalesce(any_value(x.area), 'unknown') AS area FROM supplier LEFT JOIN (SELECT DISTINCT venue, area FROM c) x ON venue = s_name GROUP BY 1""")
def venue_areas(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("unknown").alias("area"))
    return index.venues(shows(spark, d), s, TODAY).select("name", "n", "area")


@query("""SELECT s_name AS name, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 5 > 0 THEN 'area ' || s_nationkey END AS area FROM supplier WHERE s_suppkey % 3 > 0 OR s_suppkey % 2 = 0""")
def venue_catalogue(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    configured = s.select(F.col("s_name").alias("name"), F.when(k % 5 > 0, F.concat(F.lit("area "), F.col("s_nationkey").cast("string"))).alias("area"), F.when(k % 3 == 0, "opendata").otherwise("html").alias("strategy"))
    return index.catalogue(s.where(k % 2 == 0).select(F.col("s_name").alias("venue")), configured)


@query(f"""SELECT count(*) FILTER (WHERE m AND d >= '{TODAY}') AS upcoming, count(*) FILTER (WHERE m AND d >= '{TODAY}' AND d <= '1997-01-05') AS this_week, count(*) FILTER (WHERE f = '{TODAY}') AS fresh
FROM (SELECT l_quantity > 2 AS m, strftime(l_shipdate, '%Y-%m-%d') AS d, strftime(l_commitdate, '%Y-%m-%d') AS f FROM (SELECT l_quantity, l_shipdate, l_shipdate - INTERVAL 7 DAY AS l_commitdate FROM lineitem))""")
def headline_counts(spark, d):
    line = table(spark, d, "lineitem")
    e = line.select((F.col("l_quantity") > 2).alias("is_music"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.date_format(F.date_sub(F.col("l_shipdate").cast("date"), 7), "yyyy-MM-dd").alias("first_seen"))
    return index.headline(e, TODAY)


@query("""WITH n AS (SELECT strftime(ts, '%Y-%m-%d') AS date, 's' || (user_id % 20) AS slug, count(*) AS n FROM events GROUP BY 1, 2)
SELECT date, slug, CASE WHEN n % 4 > 0 THEN n + CASE WHEN date = '2024-01-20' AND n % 3 = 0 THEN 1000 ELSE 0 END END AS count, CASE WHEN n % 4 = 0 THEN CAST(n AS VARCHAR) END AS error FROM n WHERE date BETWEEN '2024-01-07' AND '2024-01-20'""")
def source_history(spark, d):
    """Two runs of the last day: the second covers a third of the sources. Errors here read like numbers and stay errors."""
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("slug")).agg(F.count(F.lit(1)).alias("count"))
    rows = e.withColumns({"status": F.when(F.col("count") % 4 == 0, "failed").otherwise("ok"), "error": F.col("count").cast("string")})
    past = status.day_values(rows, keep=("date",))
    again = status.day_values(rows.where("date = '2024-01-20' and count % 3 = 0").withColumn("count", F.col("count") + 1000))
    h = status.history(again, past, "2024-01-20")
    return h.select("date", "slug", status.counted(F.col("value")).alias("count"), status.failed_with(F.col("value")).alias("error"))


@query("""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, links[i] AS link FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li>[^<]*<a href="([^"]*)">', 1) AS links FROM pages))""")
def blocks_from_sql(spark, d):
    name = blocks.register(spark)
    table(spark, d, "pages").createOrReplaceTempView("__pages")
    rows = spark.sql(f"SELECT page_id, b.pos, b.block FROM __pages, LATERAL {name}(html, '<li>') b")
    return rows.select("page_id", "pos", first(F.col("block"), '<a href="([^"]*)">').alias("link"))


@query("""WITH a AS (SELECT p_partkey, lower(p_name || ' of the ' || p_type || ' from a to z number ' || p_size) AS key FROM part), l AS (SELECT DISTINCT key AS hit FROM a WHERE p_partkey % 2 = 0)
SELECT p_partkey AS id, hit FROM a JOIN l ON key = hit UNION SELECT p_partkey + 1000000, hit FROM a JOIN l ON key = hit""")
def liked_long_names(spark, d):
    """Names of a dozen words, alone and inside a longer one."""
    part = table(spark, d, "part")
    name = F.concat("p_name", F.lit(" of the "), "p_type", F.lit(" from A to Z number "), F.col("p_size").cast("string"))
    liked = part.where("p_partkey % 2 = 0").select(name.alias("name"))
    alone = part.select(F.col("p_partkey").alias("id"), F.array(name).alias("acts"))
    within = part.select((F.col("p_partkey") + 1_000_000).alias("id"), F.array(F.concat(F.lit("zz "), name, F.lit(" live"))).alias("acts"))
    none = spark.createDataFrame([], "profile string")
    return search.liked_hits(alone.unionByName(within).withColumn("profiles", F.array().cast("array<string>")), liked, none)


@query("""SELECT 'u' || user_id AS id, CASE user_id % 3 WHEN 0 THEN '2024-01-05' ELSE '2024-01-02' END AS first_seen, CASE user_id % 3 WHEN 0 THEN '9999-12-31' ELSE '2024-02-01' END AS date, CASE WHEN user_id % 3 > 0 THEN 'v' END AS venue, CASE user_id % 2 WHEN 0 THEN 120 ELSE 90 END AS horizon FROM (SELECT DISTINCT user_id FROM events)""")
def state_migration(spark, d):
    """A state file a user, in the three forms that there have been: flat, bare days, objects."""
    u = table(spark, d, "events").select("user_id").distinct()
    k, id = F.col("user_id"), F.concat(F.lit('"u'), F.col("user_id").cast("string"), F.lit('":'))
    value = F.when(k % 3 == 0, '"2024-01-05"').otherwise('{"first_seen":"2024-01-02","date":"2024-02-01","venue":"v","last":"2024-01-10"}')
    body = F.when((k % 3 == 0) & (k % 2 == 0), F.concat(F.lit("{"), id, value, F.lit("}"))).otherwise(F.concat(F.lit('{"ids":{'), id, value, F.lit("}"), F.when(k % 2 > 0, ',"horizon":90').otherwise(""), F.lit("}")))
    rows = u.select(F.explode(state.state_entries(body)).alias("e")).select("e.*")
    return state.migrated(rows).select("id", "first_seen", "date", "venue", "horizon")
