"""Dates, states between runs, monitoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions.text import cause
from ..operators import monitor, state, status
from ..operators.merge import first_filled
from ..sources.tables import table
from .registry import query

TODAY = "2024-01-20"


@query("""SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, strftime(date_trunc('week', o_orderdate) + INTERVAL 3 DAY, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2""")
def week_month_bucket(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").groupBy(dates.week_start(day).alias("week"), dates.week_month(day).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-03-01' + 730""")
def horizon_valid(spark, d):
    lo = F.lit("1995-03-01").cast("date")
    return table(spark, d, "orders").where((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < F.date_add(lo, 731))).select("o_orderkey")  # on the bare column: pushed to the scan


@query("""SELECT user_id, day, first_id FROM (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS first_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS r FROM events GROUP BY 1, 2) WHERE r <= 40""")
def occurrence_explode(spark, d):
    listed = table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("_", F.date_format("ts", "yyyy-MM-dd"), F.lpad(F.col("event_id").cast("string"), 12, "0")))), ";").alias("occurrences"))
    one = listed.select("user_id", F.posexplode(F.split("occurrences", ";")).alias("pos", "o")).select("user_id", "pos", F.try_to_date(F.substring_index("o", "_", 1), "yyyy-MM-dd").alias("day"), F.substring_index("o", "_", -1).cast("long").alias("first_id"))
    firsts = one.where("day is not null").groupBy("user_id", "day").agg(F.min_by("first_id", "pos").alias("first_id"))
    return firsts.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("day"))).where("r <= 40").drop("r")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed FROM orders""")
def fr_date_roundtrip(spark, d):
    names = F.array(*[F.lit(m) for m in ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")])
    day = F.col("o_orderdate")
    text = F.concat_ws(" ", F.lit("samedi"), F.dayofmonth(day).cast("string"), F.get(names, F.month(day) - 1), F.year(day).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", dates.parse_date(text, F.lit(TODAY).cast("date")).alias("parsed"))


@query("""WITH t AS (SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS dd, DATE '2024-01-20' AS today FROM orders),
c AS (SELECT *, try_cast(printf('%04d-%02d-%02d', 2024, m, dd) AS DATE) AS a, try_cast(printf('%04d-%02d-%02d', 2025, m, dd) AS DATE) AS b FROM t)
SELECT o_orderkey, CASE WHEN a >= today - 45 THEN 2024 WHEN b <= today + 180 THEN 2025 ELSE 2024 END AS year FROM c""")
def year_inference(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.infer_year(F.month("o_orderdate"), F.dayofmonth("o_orderdate"), F.lit(TODAY).cast("date")).alias("year"))


@query("""SELECT event_id, strftime(ts, '%H:%M') AS time, CASE WHEN value < 1 OR value >= 1000 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' €' END AS price FROM events""")
def time_price_parse(spark, d):
    e = table(spark, d, "events")
    clock = F.concat(F.lit("à "), F.hour("ts").cast("string"), F.lit("h"), F.date_format("ts", "mm"))
    n = F.floor("value").cast("string")
    price = F.when((F.col("value") < 1) | (F.col("value") >= 1000), F.lit("")).otherwise(F.concat(F.lit("plein "), n, F.lit(" euros")))
    return e.select("event_id", dates.parse_time(clock).alias("time"), numbers.price_range(price).alias("price"))


EVENT_DAYS = "SELECT CAST(ts AS DATE) AS day, count(*) AS n, CASE WHEN count(*) % 3 <> 0 THEN sum(event_id % 7) END AS usd FROM events WHERE day(ts) % 5 <> 0 GROUP BY 1"


def event_days(spark, d):
    e = table(spark, d, "events").where(F.dayofmonth("ts") % 5 != 0).groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id") % 7).alias("s"))
    return e.select("day", "n", F.when(F.col("n") % 3 != 0, F.col("s")).alias("usd"))


@query(f"""WITH e AS ({EVENT_DAYS}), c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM e), (SELECT max(day) FROM e), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, last_value(n IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS n, CAST(usd AS BIGINT) AS usd FROM c LEFT JOIN e USING (day)""")
def calendar_locf(spark, d):
    return monitor.calendar(event_days(spark, d), "day", ["n"])


@query(f"""WITH e AS ({EVENT_DAYS}) SELECT day, CAST(sum(coalesce(usd, 0)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM e""")
def running_total(spark, d):
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    return event_days(spark, d).select("day", F.sum(F.coalesce("usd", F.lit(0))).over(w).alias("total"))


@query(f"""WITH e AS ({EVENT_DAYS}) SELECT strftime(day, '%Y-%m') AS month, CAST(sum(usd) AS BIGINT) AS usd, count(usd) AS measured, arg_max(n, day) AS last_n FROM e GROUP BY 1""")
def monthly_rollup(spark, d):
    return event_days(spark, d).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("usd").alias("usd"), F.count("usd").alias("measured"), F.max_by("n", "day").alias("last_n"))


@query(f"""WITH e AS ({EVENT_DAYS}) SELECT CAST(sum(usd) FILTER (WHERE day > DATE '{TODAY}' - 7 AND day <= DATE '{TODAY}') AS BIGINT) AS week, CAST(sum(usd) FILTER (WHERE day >= DATE '2024-01-01' AND day <= DATE '{TODAY}') AS BIGINT) AS month, CAST(sum(usd) AS BIGINT) AS ever, count(usd) AS days FROM e""")
def headline_stats(spark, d):
    t, day = F.lit(TODAY).cast("date"), F.col("day")
    e = event_days(spark, d)
    return e.agg(F.sum(F.when((day > F.date_sub(t, 7)) & (day <= t), F.col("usd"))).alias("week"), F.sum(F.when((day >= F.trunc(t, "MM")) & (day <= t), F.col("usd"))).alias("month"), F.sum("usd").alias("ever"), F.count("usd").alias("days"))


@query(f"""WITH e AS ({EVENT_DAYS}), b AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), f AS (SELECT *, n % 2 = 1 AS bad FROM b),
i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY day) AS g FROM f)
SELECT event_type, min(day) AS start, max(day) AS "end", count(*) AS days FROM i WHERE bad GROUP BY event_type, g""")
def failing_streak(spark, d):
    b = table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg((F.count(F.lit(1)) % 2 == 1).alias("bad"))
    return state.streaks(b, "event_type", "day", "bad")


@query("""WITH f AS (SELECT event_type, user_id, min(CAST(ts AS DATE)) AS day FROM events GROUP BY 1, 2), s AS (SELECT event_type, min(day) AS start FROM f GROUP BY 1)
SELECT event_type, user_id, CASE WHEN day = start THEN 'baseline' ELSE strftime(day, '%Y-%m-%d') END AS first_seen FROM f JOIN s USING (event_type)""")
def first_seen(spark, d):
    f = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("ts").cast("date").alias("day"))
    s = f.groupBy("event_type").agg(F.min("day").alias("start"))
    return f.join(s, "event_type").select("event_type", "user_id", F.when(F.col("day") == F.col("start"), "baseline").otherwise(F.date_format("day", "yyyy-MM-dd")).alias("first_seen"))


def two_days(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("user_id").alias("id"), F.col("ts").cast("date").alias("day"), (F.col("user_id") % 20).alias("bucket"))
    return [e.where(F.col("day") == F.lit(x).cast("date")).select("bucket", "id").distinct() for x in ("2024-01-10", "2024-01-11")]


@query("""WITH a AS (SELECT DISTINCT user_id % 20 AS bucket, user_id AS id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'), b AS (SELECT DISTINCT user_id % 20 AS bucket, user_id AS id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-11'),
g AS (SELECT bucket, min(id) AS old_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY 1 HAVING count(*) = 1), n AS (SELECT bucket, min(id) AS new_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY 1 HAVING count(*) = 1)
SELECT bucket, old_id, new_id FROM g JOIN n USING (bucket)""")
def rename_match(spark, d):
    a, b = two_days(spark, d)
    return state.renames(a.join(b, ["bucket", "id"], "left_anti"), b.join(a, ["bucket", "id"], "left_anti"), ["bucket"])


@query("""WITH p AS (SELECT event_type AS source, event_id, CAST(ts AS DATE) AS date FROM events), f AS (SELECT event_type AS source, max(CAST(ts AS DATE)) FILTER (WHERE CAST(ts AS DATE) <= DATE '2024-01-12') AS last_ok FROM events GROUP BY 1 HAVING count(*) % 2 = 0)
SELECT source, event_id, date, last_ok AS stale_since FROM p JOIN f USING (source) WHERE date >= DATE '2024-01-20' AND date_diff('day', last_ok, DATE '2024-01-20') <= 14""")
def carry_over(spark, d):
    e = table(spark, d, "events")
    day = F.col("ts").cast("date")
    failed = e.groupBy(F.col("event_type").alias("source")).agg(F.max(F.when(day <= F.lit("2024-01-12").cast("date"), day)).alias("last_ok"), F.count(F.lit(1)).alias("n")).where("n % 2 = 0").drop("n")
    rows = e.select(F.col("event_type").alias("source"), "event_id", day.alias("date"), F.lit(None).cast("date").alias("stale_since"))
    return state.carry_over(rows, failed, TODAY).select("source", "event_id", "date", "stale_since")


@query("""WITH a AS (SELECT user_id, count(*) AS prev_count FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-11' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, n, prev_count, CASE WHEN n IS NULL THEN 'failed' WHEN n < 2 THEN 'low' ELSE 'ok' END AS status FROM a FULL JOIN b ON a.user_id = b.user_id""")
def status_build(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    on = lambda x, c: e.where(F.col("day") == F.lit(x).cast("date")).groupBy("user_id").agg(F.count(F.lit(1)).alias(c))
    j = on("2024-01-10", "prev_count").join(on("2024-01-11", "n"), "user_id", "full")
    none = F.lit(None).cast("string")
    report = j.select(F.col("user_id").alias("slug"), F.col("user_id").alias("ord"), F.lit("html").alias("strategy"), F.lit(None).cast("int").alias("low"), F.col("n").isNotNull().alias("ok"), F.col("n").alias("count"), none.alias("error"), none.alias("last_ok"))
    before = report.limit(0).select("slug", none.alias("status"), none.alias("failing_since"), "last_ok", "ord", "count", "error")
    rows = status.status(report, before, "2024-01-11", low=2).select(F.col("slug").alias("user_id"), "status")
    return j.join(rows, "user_id").select("user_id", "n", "prev_count", "status")


@query(f"""WITH o AS ({EVENT_DAYS}), n AS (SELECT day, n + 1000 AS n, usd FROM o WHERE day(day) % 2 = 0), a AS (SELECT * FROM o WHERE day(day) % 3 <> 0)
SELECT day, CASE WHEN a.n IS NULL OR (n.n IS NOT NULL AND day = DATE '2024-01-16') THEN n.n ELSE a.n END AS n FROM a FULL JOIN n USING (day)""")
def timeline_upsert(spark, d):
    e = event_days(spark, d).select("day", "n")
    return state.upsert(e.where(F.dayofmonth("day") % 3 != 0), e.where(F.dayofmonth("day") % 2 == 0).withColumn("n", F.col("n") + 1000), "day", "2024-01-16")


@query("""WITH p(flag, price_in) AS (VALUES ('A', 3.0), ('N', 1.0)), u AS (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS calls, CAST(sum(l_quantity) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2)
SELECT flag, status, calls, round((n * coalesce(price_in, 2.0) + calls * 5 * 2.0) / 1e6 / CASE WHEN status = 'F' THEN 2 ELSE 1 END, 6) AS usd FROM u LEFT JOIN p USING (flag)""")
def usage_cost(spark, d):
    price = spark.createDataFrame([("A", 3.0), ("N", 1.0)], "flag string, price_in double")
    u = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("calls"), F.sum("l_quantity").alias("n"))
    u = u.join(F.broadcast(price), "flag", "left")  # a fixed table of two rows
    usd = numbers.token_cost(F.col("n"), F.col("calls") * 5, F.lit(0), F.lit(0), F.coalesce("price_in", F.lit(2.0)), F.lit(2.0), F.col("status") == "F")
    return u.select("flag", "status", "calls", F.round(usd, 6).alias("usd"))


@query("""WITH e AS (SELECT event_id, regexp_replace(regexp_replace('0 events parsed (was ' || (event_id % 9) || '): timeout ' || event_type || ' for https://x.example/' || user_id, '^0 events parsed \\(was [0-9]+\\): ', ''), ' for https?://\\S+', '') AS cause FROM events)
SELECT cause, count(*) AS n, min(event_id) AS first_id FROM e GROUP BY 1 HAVING count(*) >= 3""")
def cause_groups(spark, d):
    text = F.concat(F.lit("0 events parsed (was "), (F.col("event_id") % 9).cast("string"), F.lit("): timeout "), "event_type", F.lit(" for https://x.example/"), F.col("user_id").cast("string"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("slug"), cause(text).alias("cause"))
    return status.causes(rows, "no such cause").join(rows.groupBy("cause").agg(F.min("slug").alias("first_id")), "cause")


@query("""WITH t AS (SELECT s_suppkey AS key, s_nationkey AS since, s_suppkey % 7 = 0 AS tried_today, s_suppkey % 5 AS tries FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY NOT tried_today AND tries < 3 ORDER BY since, key) AS place FROM t)
SELECT key, CASE WHEN tried_today THEN 'today' WHEN tries >= 3 THEN 'worn' WHEN place > 5 THEN 'over' ELSE 'go' END AS reason FROM r""")
def triage_caps(spark, d):
    k, today = F.col("s_suppkey"), "2024-01-20"
    days = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("2023-12-0"), i.cast("string")))
    tried = F.concat(F.slice(days, F.lit(1), (k % 5).cast("int")), F.when(k % 7 == 0, F.array(F.lit(today))).otherwise(F.array().cast("array<string>")))
    since = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), F.col("s_nationkey").cast("int")), "yyyy-MM-dd")
    failing = table(spark, d, "supplier").select(F.lpad(k.cast("string"), 12, "0").alias("slug"), F.lit("own").alias("cause"), since.alias("failing_since"), tried.alias("tried"))
    got = status.triage(failing, spark.createDataFrame([], "cause string"), today)
    return got.select(F.col("slug").cast("long").alias("key"), "reason")


@query("""SELECT user_id, arg_min(props, event_id) FILTER (WHERE event_id % 3 = 0) AS props FROM events GROUP BY 1""")
def attribute_fill(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(first_filled(F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(""), F.col("event_id")).alias("props"))
