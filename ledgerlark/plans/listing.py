"""Programme queries: filters, facets, suggestions, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from ..sources.tables import table
from .registry import query


@query("""SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE (p_brand IN ('Brand#11','Brand#22') OR p_type IN ('STANDARD','PROMO')) AND contains(lower(p_name), 'r')""")
def programme_filter(spark, d):
    picks = search.any_pick({"p_brand": ["Brand#11", "Brand#22"], "p_type": ["STANDARD", "PROMO"], "p_size": []})
    return table(spark, d, "part").where(picks & F.contains(F.lower("p_name"), F.lit("r"))).select("p_partkey", "p_name", "p_brand", "p_type")


@query("""WITH j AS (SELECT p_brand, p_type, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 5)
SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM j GROUP BY 2
UNION ALL SELECT 'type', p_type, count(*) FROM j GROUP BY 2 UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM j GROUP BY 2""")
def facet_counts(spark, d):
    per = table(spark, d, "lineitem").where("l_quantity > 5").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("c"))  # before the join: one row a part
    j = per.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return search.facets(j, {"brand": "p_brand", "type": "p_type", "size": "p_size"}, weight="c")


@query("""WITH c AS (SELECT p_type, count(*) AS n FROM part WHERE p_brand IN (SELECT min(p_brand) FROM part) GROUP BY 1),
z AS (SELECT p_type, max(n) AS n FROM (SELECT * FROM c UNION ALL SELECT 'NONE SUCH', 0) GROUP BY 1)
SELECT p_type, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, p_type) AS r FROM z) WHERE r <= 12 OR p_type = 'NONE SUCH'""")
def facet_drilldown_topk(spark, d):
    part = table(spark, d, "part")
    least = part.agg(F.min("p_brand").alias("p_brand"))
    return search.top_with_pins(part.join(F.broadcast(least), "p_brand"), "p_type", 12, ["NONE SUCH"])  # one row is broadcast


KEYS = "SELECT 'part' AS kind, p_name AS name, count(*) AS weight FROM part GROUP BY 2 UNION ALL SELECT 'nation', n_name, n_nationkey FROM nation UNION ALL SELECT 'region', r_name, r_regionkey FROM region"


def search_keys(spark, d):
    part = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("weight")).select(F.lit("part").alias("kind"), "name", "weight")
    nation = table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("weight"))
    region = table(spark, d, "region").select(F.lit("region").alias("kind"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("weight"))
    return part.unionByName(nation).unionByName(region)


@query(f"""WITH k AS (SELECT kind, name, weight, lower(name) AS key FROM ({KEYS})),
s AS (SELECT *, CASE WHEN starts_with(key, 'r') THEN 0 WHEN len(list_filter(string_split(key, ' '), lambda w: starts_with(w, 'r'))) > 0 THEN 1 WHEN contains(key, 'r') THEN 2 ELSE -1 END AS score FROM k),
g AS (SELECT * FROM s WHERE score >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score, weight DESC, name) AS rank FROM g),
b AS (SELECT kind, row_number() OVER (ORDER BY min(score), kind) AS kind_rank FROM g GROUP BY kind)
SELECT kind, kind_rank, rank, name, score FROM r JOIN b USING (kind) WHERE rank <= CASE kind WHEN 'part' THEN 6 ELSE 3 END""")
def suggest_rank(spark, d):
    return search.suggest(search_keys(spark, d).withColumn("key", F.lower("name")), "r", {"part": 6, "nation": 3, "region": 3})


@query("""SELECT 'part' AS kind, p_name AS name, lower(p_name) AS key, count(*) AS n, arg_min(p_type, (-c, p_type)) AS top FROM
(SELECT p_name, p_type, count(*) OVER (PARTITION BY p_name, p_type) AS c FROM part) GROUP BY 2
UNION ALL SELECT 'nation', n_name, lower(n_name), count(s_suppkey), NULL FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 2
UNION ALL SELECT 'region', r_name, lower(r_name), count(n_nationkey), NULL FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 2""")
def search_index(spark, d):
    part = table(spark, d, "part").groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("c"))
    part = part.groupBy(F.col("p_name").alias("name")).agg(F.sum("c").alias("n"), F.min_by("p_type", F.struct(-F.col("c"), "p_type")).alias("top")).withColumn("kind", F.lit("part"))
    by = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nation = table(spark, d, "nation").join(by, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("string").alias("top"))
    per = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    region = table(spark, d, "region").join(per, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.lit("region").alias("kind"), F.col("r_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("string").alias("top"))
    return part.unionByName(nation).unionByName(region).withColumn("key", F.lower("name")).select("kind", "name", "key", "n", "top")


@query("""SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY CASE WHEN user_id % 3 = 0 THEN '99:99' ELSE strftime(ts, '%H:%M') END, event_type, event_id) AS place FROM events""")
def programme_sort_rank(spark, d):
    from pyspark.sql import Window

    t = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.date_format("ts", "HH:mm"))
    w = Window.partitionBy(F.col("ts").cast("date")).orderBy(F.coalesce(F.nullif(t, F.lit("")), F.lit("99:99")), "event_type", "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).alias("place"))


@query("""SELECT user_id, CAST(min(ts) AS DATE) AS first_day, CASE WHEN date_diff('second', min(ts), TIMESTAMP '2024-01-10 00:00:00') <= 7 * 86400 AND min(ts) <= TIMESTAMP '2024-01-10 00:00:00' THEN true ELSE false END AS is_new FROM events GROUP BY 1""")
def new_window(spark, d):
    first = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first"))
    return first.select("user_id", F.col("first").cast("date").alias("first_day"), search.is_new(F.col("first").cast("string"), F.lit("2024-01-10 00:00:00")).alias("is_new"))


@query("""SELECT n_nationkey, seg AS segment, n FROM (SELECT c_nationkey AS n_nationkey, c_mktsegment AS seg, count(*) AS n, min(c_custkey) AS p,
row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, min(c_custkey)) AS r FROM customer GROUP BY 1, 2) WHERE r = 1""")
def mode_first_tie(spark, d):
    return search.mode_first(table(spark, d, "customer").withColumnsRenamed({"c_nationkey": "n_nationkey", "c_mktsegment": "segment"}), ["n_nationkey"], "segment", "c_custkey")


@query("""SELECT user_id, event_type, count(*) * 1.0 / t AS share FROM events JOIN (SELECT user_id, count(*) AS t FROM events GROUP BY 1) USING (user_id) GROUP BY 1, 2, t HAVING count(*) * 1.0 / t > 0.25""")
def noise_share(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy("user_id").agg(F.sum("n").alias("t"))
    return n.join(t, "user_id").select("user_id", "event_type", (F.col("n") * 1.0 / F.col("t")).cast("double").alias("share")).where("share > 0.25")


@query("""SELECT p_brand, p_type AS top, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) WHERE r = 1""")
def argmax_tie(spark, d):
    n = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("p_brand").agg(F.min_by("p_type", F.struct(-F.col("n"), "p_type")).alias("top"), F.max("n").alias("n"))


@query("""SELECT s_suppkey, c FROM (SELECT s_suppkey, s_nationkey, count(l_suppkey) AS c FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2) WHERE c < coalesce(CASE WHEN s_nationkey % 2 = 0 THEN 620 END, 590)""")
def low_coverage(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("c"))
    s = table(spark, d, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return s.where(F.col("c") < F.coalesce(F.when(F.col("s_nationkey") % 2 == 0, 620), F.lit(590))).select("s_suppkey", "c")


@query("""WITH w AS (SELECT o_custkey, min(o_orderdate) AS soonest, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1)
SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY soonest, o_custkey) AS r FROM w) WHERE r <= 30
UNION SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY soonest, o_custkey) AS r FROM w WHERE urgent) WHERE r <= 8""")
def ttl_worklist(spark, d):
    cached = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    w = table(spark, d, "orders").join(cached, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.min("o_orderdate").alias("soonest"), F.max(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    top = lambda df, k: df.orderBy("soonest", "o_custkey").limit(k).select("o_custkey")  # noqa: E731  the work budgets
    return top(w, 30).union(top(w.where("urgent"), 8)).distinct()


@query("""SELECT p_partkey, w.word FROM part JOIN (SELECT DISTINCT p_name AS word FROM part) w ON contains(' ' || p_name || ' ', ' ' || w.word || ' ') WHERE w.word NOT IN ('small ring')""")
def artist_word_match(spark, d):
    part = table(spark, d, "part")
    liked = part.select(F.col("p_name").alias("word")).distinct().where(~F.col("word").isin("small ring"))
    return part.select("p_partkey", F.explode(search.word_shingles(F.col("p_name"), 3)).alias("word")).join(liked, "word").select("p_partkey", "word")


@query("""SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders EXCEPT SELECT s_suppkey FROM supplier""")
def set_ops(spark, d):
    c, o, s = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select("o_custkey"), table(spark, d, "supplier").select("s_suppkey")
    return c.intersect(o).exceptAll(s)
