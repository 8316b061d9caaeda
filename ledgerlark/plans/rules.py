"""Rules of state, costs, enrichment and choice over the driver's tables, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import cap
from ..operators import classify, conform, search, state, status
from ..sources import records
from ..sources.tables import table
from .registry import query


@query("""WITH s AS (SELECT l_returnflag AS what, l_linestatus AS model, l_quantity > 25 AS batch, count(*) AS calls, round(sum(CAST(l_quantity AS BIGINT)) / 1e6, 4) AS usd FROM lineitem GROUP BY 1, 2, 3)
SELECT what, model, batch, calls, usd FROM s UNION ALL SELECT NULL, NULL, NULL, CAST(sum(calls) AS BIGINT), round(sum(usd), 4) FROM s""")
def usage_totals(spark, d):
    calls = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("what"), F.col("l_linestatus").alias("model"), (F.col("l_quantity") > 25).alias("batch"), "l_quantity")
    return status.usage(calls, F.col("l_quantity").cast("long") / 1e6)


@query("""WITH s AS (SELECT o_orderpriority AS step, round(sum(o_custkey) / 1e4, 4) AS usd FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1996-03-03' GROUP BY 1)
SELECT step, usd FROM s UNION ALL SELECT 'total', round(sum(usd), 4) FROM s""")
def day_cost(spark, d):
    steps = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("step"), (F.col("o_custkey") / 1e4).alias("usd"))
    return status.day_cost(steps, "1996-03-03")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-07' AND DATE '2024-01-20' GROUP BY 1""")
def fortnight(spark, d):
    days = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return status.last_days(days, "2024-01-20", 14)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(v.s_name, o.s_name) AS venue FROM lineitem LEFT JOIN supplier v ON l_suppkey = v.s_suppkey AND v.s_suppkey % 3 > 0 LEFT JOIN supplier o ON l_suppkey % 7 = o.s_suppkey AND o.s_suppkey % 3 > 0""")
def venue_or_own(spark, d):
    venues = table(spark, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("slug"), "s_name")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("venue_slug"), (F.col("l_suppkey") % 7).alias("own_slug"))
    return conform.with_venue(lines, venues).select("l_orderkey", "l_linenumber", "l_partkey", F.col("venue_row.s_name").alias("venue"))


@query("""WITH c AS (SELECT p_name, min(p_brand) AS player FROM part GROUP BY 1 HAVING min(p_partkey) % 2 = 0),
a AS (SELECT DISTINCT l_orderkey AS id, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT id, string_agg(p_name || '=' || player, ',' ORDER BY p_name) AS players FROM a JOIN c USING (p_name) GROUP BY 1""")
def player_maps(spark, d):
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    cache = part.groupBy("p_name").agg(F.min("p_brand").alias("player"), F.min("p_partkey").alias("k")).where("k % 2 = 0").select(F.lower("p_name").alias("key"), "player")
    acts = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_name").alias("key")).distinct()
    acts = acts.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).distinct(), "id")
    pairs = F.transform(F.array_sort(F.map_entries("players")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return records.player_map(acts, cache).select("id", F.array_join(pairs, ",").alias("players"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 4 > 0 THEN 'folk' ELSE p_brand END AS genres, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 4 > 0 THEN 'llm' WHEN p_partkey % 3 = 0 THEN 'site' ELSE 'rules' END AS genre_source, NOT (p_partkey % 3 > 0 AND p_partkey % 5 = 0) AS is_music,
CASE WHEN p_partkey % 2 = 0 THEN 'shoegaze,dub techno' ELSE 'shoegaze' END AS subgenres FROM part""")
def enriched_parts(spark, d):
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    e = classify.enriched(F.array("p_brand"), F.when(k % 3 == 0, "site").otherwise("rules"), F.lit(True), F.array(F.lit("Shoegaze")), F.when(k % 4 > 0, F.array(F.lit("folk"))).otherwise(none), F.when(k % 5 == 0, False), F.when(k % 2 == 0, F.array(F.lit("shoegaze"), F.lit("Dub Techno"))))
    out = table(spark, d, "part").select("p_partkey", e.alias("e")).select("p_partkey", "e.*")
    return out.withColumns({"genres": F.array_join("genres", ","), "subgenres": F.array_join("subgenres", ",")})


@query("""SELECT p_partkey, array_to_string(list_filter([p_type, CASE WHEN p_partkey % 2 = 0 THEN 'jazz' END], lambda x: x IS NOT NULL AND NOT contains(lower(p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END), lower(x))), ',') AS tags FROM part""")
def noisy_tags(spark, d):
    k = F.col("p_partkey")
    title = F.concat_ws(" ", "p_name", F.when(k % 3 == 0, F.col("p_type")).otherwise(""))
    tags = F.array_compact(F.array("p_type", F.lit("Concert"), F.lit("The HALL"), F.when(k % 2 == 0, "jazz"), "p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(classify.tag_noise(tags, title, F.lit("the hall"), ["concert"]), ",").alias("tags"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND (o_orderkey % 4 > 1 OR o_orderkey % 3 = 0)""")
def wants_tags(spark, d):
    k = F.col("o_orderkey")
    source = F.get(F.array(F.lit("site"), F.lit("llm"), F.lit("rules"), F.lit(None).cast("string")), (k % 4).cast("int"))
    return table(spark, d, "orders").where(classify.needs_tags(F.col("o_orderstatus") != "F", source, F.when(k % 3 > 0, F.array(F.lit("x"))))).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-03-14') <= 14 AND o_orderkey % 5 > 0""")
def fresh_answers(spark, d):
    at = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    return table(spark, d, "orders").where(state.fresh_chunk(at, "1996-03-14")).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 3 = 0 AND l_suppkey = 3 OR l_partkey % 3 = 1""")
def of_sources(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.element_at(F.array(F.lit("html"), F.lit("opendata"), F.lit("llm")), (F.col("l_partkey") % 3 + 1).cast("int")).alias("source"), F.col("l_suppkey").cast("string").alias("source_slug"))
    return state.from_source(e, "html", "3").unionByName(state.from_source(e, "opendata", "none")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT count(DISTINCT c_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 = 0 AND o_orderstatus <> 'F' AND strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-01'""")
def liked_coming(spark, d):
    o = table(spark, d, "orders")
    hits = o.where("o_custkey % 3 = 0").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("hit"))
    e = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "F").alias("is_music"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return search.liked_with_show(hits, e, "1996-01-01")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND o_custkey % 5 = 0 AND strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01'""")
def my_programme(spark, d):
    """All toggles at once: what is marked, at favourite houses."""
    e = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "O").alias("is_music"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    on = search.pills(mine=F.col("o_orderkey") % 2 == 0, favourite=F.col("o_custkey") % 5 == 0)
    return search.programme(e, on=on, start="1995-01-01").select("o_orderkey")


@query(r"""SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE regexp_replace(substr(t, 1, 399), '\s+\S*$', '') || '…' END AS short FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents)""")
def capped_texts(spark, d):
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return table(spark, d, "documents").select("doc_id", cap(t).alias("short"))
