"""The programme's operators on arrays, states and reports made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, search, state, status
from ..sources.tables import table
from .registry import query

SHOWS = """SELECT p_partkey AS id, p_name AS title, p_brand AS venue, string_split(p_type, ' ') AS genres, string_split(p_name, ' ') AS subgenres, p_size % 3 > 0 AS is_music, strftime(DATE '2024-01-01' + CAST(p_size AS INTEGER), '%Y-%m-%d') AS date FROM part"""


def shows(spark, d):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")), "yyyy-MM-dd")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("venue"), F.split("p_type", " ").alias("genres"), F.split("p_name", " ").alias("subgenres"), (F.col("p_size") % 3 > 0).alias("is_music"), day.alias("date"))


@query(f"""SELECT id, title, date FROM ({SHOWS}) WHERE is_music AND date BETWEEN '2024-01-05' AND '2024-02-10' AND (venue IN ('Brand#11') OR len(list_intersect(genres, ['STANDARD', 'PROMO'])) > 0 OR len(list_intersect(subgenres, ['small'])) > 0)
AND contains(lower(title || ' ' || venue || '   ' || array_to_string(subgenres, ' ')), 'r')""")
def programme_picks(spark, d):
    picks = {"venue": ["Brand#11"], "genres[]": ["STANDARD", "PROMO"], "subgenres[]": ["small"]}
    return search.programme(shows(spark, d), picks, "R", None, "2024-01-05", "2024-02-10").select("id", "title", "date")


@query(f"""WITH s AS (SELECT * FROM ({SHOWS}) WHERE is_music AND date <= '2024-01-20')
SELECT 'genre' AS facet, value, count(*) AS n FROM (SELECT unnest(genres) AS value FROM s) GROUP BY 2 UNION ALL SELECT 'style', value, count(*) FROM (SELECT unnest(subgenres) AS value FROM s) GROUP BY 2
UNION ALL SELECT 'venue', venue, count(*) FROM s GROUP BY 2""")
def scope_facets(spark, d):
    return search.scope_counts(shows(spark, d), end="2024-01-20")


@query(f"""WITH p AS (SELECT unnest(subgenres) AS style, genres FROM ({SHOWS})), g AS (SELECT style, unnest(genres) AS genre FROM p), n AS (SELECT style, genre, count(*) AS n FROM g GROUP BY 1, 2)
SELECT style, genre, n FROM (SELECT *, row_number() OVER (PARTITION BY style ORDER BY n DESC, genre) AS r FROM n) WHERE r = 1""")
def style_to_genre(spark, d):
    return search.style_genres(shows(spark, d))


@query(f"""SELECT genre, count(*) AS n FROM (SELECT unnest(genres) AS genre FROM ({SHOWS})) GROUP BY 1 ORDER BY n DESC, genre LIMIT 6""")
def empty_query_top(spark, d):
    return search.top_of_frame(shows(spark, d))


@query("""WITH a AS (SELECT c_custkey AS id, 'x' || c_custkey AS profile, lower(c_mktsegment) AS key FROM customer), l AS (SELECT DISTINCT lower(c_mktsegment) AS hit FROM customer WHERE c_custkey < 40)
SELECT id, key AS hit FROM a WHERE key IN (SELECT hit FROM l)
UNION SELECT id, 'id:' || profile FROM a WHERE id <= 5""")
def liked_artists(spark, d):
    c = table(spark, d, "customer")
    events = c.select(F.col("c_custkey").alias("id"), F.array("c_mktsegment").alias("acts"), F.array(F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).alias("profiles"))
    liked = c.where("c_custkey < 40").select(F.col("c_mktsegment").alias("name")).distinct()
    ids = c.where("c_custkey <= 5").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("profile"))
    return search.liked_hits(events, liked, ids)


SEEN = """a AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'), b AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-11'),
g AS (SELECT user_id % 40 AS v, min(user_id) AS old_id FROM (FROM a EXCEPT FROM b) GROUP BY 1 HAVING count(*) = 1), n AS (SELECT user_id % 40 AS v, min(user_id) AS new_id FROM (FROM b EXCEPT FROM a) GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT old_id, new_id FROM g JOIN n USING (v))"""


@query(f"""WITH {SEEN}
SELECT CAST(u AS VARCHAR) AS id, CASE WHEN in_a OR u IN (SELECT new_id FROM r) THEN '2024-01-10' WHEN u % 2 = 0 THEN '2024-01-11' ELSE 'baseline' END AS first_seen, '2024-02-01' AS date, CAST(u % 40 AS VARCHAR) AS venue, CASE WHEN in_b THEN '2024-01-11' ELSE '2024-01-10' END AS last
FROM (SELECT coalesce(a.user_id, b.user_id) AS u, a.user_id IS NOT NULL AS in_a, b.user_id IS NOT NULL AS in_b FROM a FULL JOIN b ON a.user_id = b.user_id) WHERE NOT (in_a AND NOT in_b AND u IN (SELECT old_id FROM r))""")
def seen_state(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    on = lambda x: e.where(F.col("day") == x).select("user_id").distinct().select(F.col("user_id").cast("string").alias("id"), F.lit("2024-02-01").alias("date"), (F.col("user_id") % 40).cast("string").alias("venue"), (F.col("user_id") % 2).cast("string").alias("source"))
    old = on("2024-01-10").select("id", F.lit("2024-01-10").alias("first_seen"), "date", "venue", F.lit("2024-01-10").alias("last"))
    known = on("2024-01-11").where("source = '0'").select(F.concat_ws(":", "source", "venue").alias("key"))
    return state.first_seen(on("2024-01-11"), old, known, "2024-01-11", 120)


@query("""WITH r AS (SELECT s_suppkey AS k, s_suppkey % 4 > 0 AS ok, s_suppkey % 6 AS c FROM supplier WHERE s_suppkey % 5 > 0), p AS (SELECT s_suppkey AS k, s_suppkey % 3 = 0 AS bad FROM supplier WHERE s_suppkey % 2 = 0)
SELECT 's' || coalesce(r.k, p.k) AS slug, CASE WHEN r.k IS NULL THEN CASE WHEN bad THEN 'failed' ELSE 'ok' END WHEN NOT ok THEN 'failed' WHEN c < 3 THEN 'low' ELSE 'ok' END AS status,
CASE WHEN r.k IS NOT NULL AND NOT ok THEN CASE WHEN bad THEN '2024-01-03' WHEN p.k IS NULL THEN '2024-01-06' ELSE '2024-01-11' END WHEN r.k IS NULL AND bad THEN '2024-01-03' END AS failing_since FROM r FULL JOIN p ON r.k = p.k""")
def status_rows(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    slug, none = F.concat(F.lit("s"), k.cast("string")).alias("slug"), F.lit(None).cast("string")
    report = s.where(k % 5 > 0).select(slug, k.alias("ord"), F.lit("html").alias("strategy"), F.lit(None).cast("int").alias("low"), (k % 4 > 0).alias("ok"), (k % 6).alias("count"), F.lit("down").alias("error"), F.lit("2024-01-05").alias("last_ok"), F.lit(9).alias("prev_count"))
    bad = k % 3 == 0
    before = s.where(k % 2 == 0).select(slug, F.when(bad, "failed").otherwise("ok").alias("status"), F.when(bad, "2024-01-03").alias("failing_since"), none.alias("last_ok"), k.alias("ord"), (k % 6).alias("count"), none.alias("error"))
    return status.status(report, before, "2024-01-11").select("slug", "status", "failing_since")


@query("""SELECT count(*) FILTER (WHERE s = 0) AS ok, count(*) FILTER (WHERE s = 1) AS low, count(*) FILTER (WHERE s = 2) AS failed FROM (SELECT o_orderkey % 3 AS s FROM orders)""")
def health_counts(spark, d):
    s = F.element_at(F.array(F.lit("ok"), F.lit("low"), F.lit("failed")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return status.health(table(spark, d, "orders").select(s.alias("status")))


DAYS = "SELECT CAST(ts AS DATE) AS day, CASE WHEN count(*) % 3 = 0 THEN count(*) END AS v FROM events GROUP BY 1"


@query(f"""SELECT day, v FROM (SELECT *, lag(v) OVER (ORDER BY day) AS a, lead(v) OVER (ORDER BY day) AS b FROM ({DAYS})) WHERE v IS NOT NULL AND a IS NULL AND b IS NULL""")
def isolated_points(spark, d):
    n = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return status.isolated(n.select("day", F.when(F.col("n") % 3 == 0, F.col("n")).alias("v")), "v")


@query("""SELECT o_orderpriority AS step, sum(CAST(o_totalprice AS DOUBLE)) / 1e6 AS usd FROM orders GROUP BY 1 HAVING sum(CAST(o_totalprice AS DOUBLE)) / 1e6 >= 0.005""")
def cost_by_step(spark, d):
    return status.cost_by_step(table(spark, d, "orders").select(F.col("o_orderpriority").alias("step"), (F.col("o_totalprice").cast("double") / 1e6).alias("usd")))


@query("""SELECT n_nationkey AS ord, 1.0 + coalesce(sum(n_nationkey * 0.25) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5 AS go FROM nation""")
def daily_budget(spark, d):
    return status.within_budget(table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") * 0.25).alias("usd")), 1.0, 5.0).select("ord", "go")


@query("""SELECT c_custkey FROM (SELECT c_custkey, c_custkey % 2 = 0 AS found, CASE WHEN c_custkey % 7 > 0 THEN (c_custkey * 5) % 500 END AS age FROM customer) WHERE age IS NULL OR age >= CASE WHEN found THEN 365 ELSE 30 END""")
def ttl_due(spark, d):
    k = F.col("c_custkey")
    at = F.when(k % 7 > 0, F.date_format(F.date_sub(F.lit("2024-01-20").cast("date"), ((k * 5) % 500).cast("int")), "yyyy-MM-dd")).otherwise("no day")
    c = table(spark, d, "customer").select(k, (k % 2 == 0).alias("found"), at.alias("at"))
    return c.where(state.due(c, "2024-01-20")).select("c_custkey")


@query("""SELECT p_partkey AS id, 0 AS pos, p_name AS name, p_name AS key FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 0, 'Nova', 'nova' FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, 2, p_name, p_name FROM part WHERE p_partkey % 3 > 0""")
def acts_of_event(spark, d):
    k = F.col("p_partkey")
    e = table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("title"), F.when(k % 3 > 0, "Nova").alias("headliner"), F.array(F.lit("the NOVA"), F.col("p_name"), F.lit("7"), F.lit("x"), F.lit("sixth")).alias("support"))
    return search.acts_of(e)


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'metal,rock' WHEN 1 THEN 'jazz' WHEN 2 THEN 'electro' WHEN 3 THEN 'folk' ELSE 'pop' END AS tags, CASE p_partkey % 5 WHEN 0 THEN 'site' WHEN 4 THEN 'venue' WHEN 3 THEN 'site' ELSE 'rules' END AS source, p_partkey % 5 <> 4 AS is_music FROM part""")
def genre_rules(spark, d):
    k = F.col("p_partkey") % 5
    site = F.when(k == 0, "Rock / Black Metal")
    title = F.when(k == 1, F.concat(F.lit("Quartet "), F.lit("Nova"))).when(k == 2, "Une nuit").when(k == 4, "Conférence au Club Théâtre").otherwise("Nova")
    g = classify.genres(F.when(k == 3, F.array(F.lit("folk"))).otherwise(F.array().cast("array<string>")), site, title, F.when(k == 2, "Techno, rave"), F.array(F.lit("pop")))
    p = table(spark, d, "part").select("p_partkey", g.alias("g"), classify.is_concert(F.lit(True), title, F.lit("Club Théâtre")).alias("is_music"))
    return p.select("p_partkey", F.array_join("g.tags", ",").alias("tags"), F.col("g.source").alias("source"), "is_music")


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '10 €' WHEN 1 THEN '6–9 €' WHEN 2 THEN NULL WHEN 3 THEN 'paid' WHEN 4 THEN '8.50–12 €' END AS price, CASE c_custkey % 4 WHEN 0 THEN '2024-09-08' WHEN 1 THEN '2024-02-03' WHEN 2 THEN NULL ELSE '2024-11-05' END AS day,
CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '20:30' ELSE '09:00' END AS time, CASE c_custkey % 5 WHEN 0 THEN '13e' WHEN 1 THEN 'Montreuil' WHEN 2 THEN '16e' WHEN 3 THEN NULL ELSE 'Ivry' END AS area FROM customer""")
def many_shapes(spark, d):
    """Prices, dates, times and addresses in as many shapes as the rules know."""
    from ..functions import dates, numbers

    k = F.col("c_custkey")
    of = lambda n, values: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    today = F.lit("2024-01-20").cast("date")
    return table(spark, d, "customer").select(
        "c_custkey",
        numbers.price_range(of(6, ["Tarif plein : 10 EUR", "De 6 à 9 euros", "12 rue Haute", "payant", "8,50€ / 12 €", "gratuit"])).alias("price"),
        dates.parse_date(of(4, ["45.99 € - 8 septembre 2024", "sam. 3 fevr.", "31 février 2024", "le 20241105 à 20h"]), today).alias("day"),
        dates.parse_time(of(3, ["12 hommes", "vers 20 h 30", "9H, porte B"])).alias("time"),
        text.area(of(5, ["7 quai X, 75013 Paris", "12345 rue Z, 93100 MONTREUIL CEDEX 3", "1 rue Y 75116 Paris", "75120 Paris", "94200 Ivry - Gare"])).alias("area"),
    )


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'AC/DC' WHEN 1 THEN 'Kokoro' WHEN 2 THEN 'Frank & The Sons' ELSE 'Anna' END AS headliner, CASE p_partkey % 4 WHEN 0 THEN 'Foo,Bar' WHEN 3 THEN 'Bob' ELSE '' END AS support FROM part""")
def lineup_shapes(spark, d):
    title = F.get(F.array(*map(F.lit, ["AC/DC feat. Foo - Bar", "Concert : Kokoro (1er soir)", "Frank &amp; The Sons + guests", "Anna en concert au Lieu • Bob x jam"])), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, d, "part").withColumn("l", text.lineup(title)).select("p_partkey", F.col("l.headliner").alias("headliner"), F.array_join("l.support", ",").alias("support"))
