"""Weekly price history."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import history as hs
from offerloom.plans.registry import query, values
from offerloom.sources.tables import TODAY, offers

_WEEKLY = "w AS (SELECT chain || ':' || name AS key, strftime(valid_from, '%G-W%V') AS week, min(price_cents) AS cents, count(*) AS n FROM offers GROUP BY ALL)"
_STATS = f"""{_WEEKLY}, s AS (SELECT key, min(cents) AS least, median(cents) AS median, max(cents) AS most, arg_max(cents, week) AS last, count(*) AS weeks_seen, CAST(sum(n) AS BIGINT) AS appearances FROM w GROUP BY key)"""


def _key():
    return F.concat_ws(":", "chain", "name")


@query("a13_price_stats", f", {_STATS} SELECT * FROM s")
def price_stats(spark, sf_dir):
    return hs.stats(offers(spark, sf_dir), _key())


@query("s11_series_project", f""", {_WEEKLY}, k AS (SELECT DISTINCT chain || ':' || name AS key FROM offers WHERE source = 'clearance'),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY week DESC) AS rn FROM w WHERE key IN (SELECT key FROM k))
SELECT key, count(*) AS points, min(week) AS first_week, max(week) AS last_week, CAST(sum(cents) AS BIGINT) AS cents FROM n WHERE rn <= 8 GROUP BY key""")
def series(spark, sf_dir):
    rows = offers(spark, sf_dir)
    wanted = rows.where("source = 'clearance'").select(_key().alias("key"))
    out = hs.project(hs.weekly_series(rows, _key()), wanted)
    total = F.aggregate("series", F.lit(0).cast("long"), lambda a, p: a + p["cents"])
    return out.select("key", F.size("series").cast("long").alias("points"), F.col("series")[0]["week"].alias("first_week"), F.element_at("series", -1)["week"].alias("last_week"), total.alias("cents"))


@query("w11_series_change", f""", {_WEEKLY}, c AS (SELECT key, arg_min(cents, week) AS f, arg_max(cents, week) AS l, min(cents) AS low FROM w GROUP BY key)
SELECT key, l - f AS change, low, (SELECT min(week) FROM w WHERE w.key = c.key AND w.cents = c.low) AS low_week FROM c""")
def change(spark, sf_dir):
    rows = hs.weekly_series(offers(spark, sf_dir), _key())
    first, last = F.col("series")[0]["cents"], F.element_at("series", -1)["cents"]
    low = F.array_min(F.transform("series", lambda p: F.struct(p["cents"].alias("cents"), p["week"].alias("week"))))
    return rows.select("key", (last - first).alias("change"), low["cents"].alias("low"), low["week"].alias("low_week"))


@query("q14_trail", f""", {_STATS}, t AS (SELECT chain || ':' || name AS key, min(price_cents) AS cents FROM offers WHERE valid_from <= DATE '{TODAY}' AND valid_to >= DATE '{TODAY}' GROUP BY ALL
  UNION ALL SELECT 'nowhere:nothing', 100 UNION ALL SELECT 'north:once', NULL UNION ALL SELECT 'north:twice', 90),
x AS (SELECT * FROM w UNION ALL SELECT 'north:once', '1998-W09', 120, 1 UNION ALL SELECT 'north:twice', '1998-W09', 120, 1 UNION ALL SELECT 'north:twice', '1998-W11', 99, 2),
z AS (SELECT key, min(cents) AS least, median(cents) AS median, max(cents) AS most, count(*) AS weeks, arg_max(cents, week) AS last FROM x GROUP BY key),
w8 AS (SELECT key, arg_min(week, (cents, week)) AS low_week, min(cents) AS low, arg_min(cents, week) AS first, arg_max(week, week) AS last_week FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY week DESC) AS rn FROM x) WHERE rn <= 8 GROUP BY key),
j AS (SELECT t.key, cents, least AS lo, median AS mid, most AS hi, last, first, last_week, low, low_week, coalesce(weeks, 0) AS weeks, most >= 4 * least AS loud FROM t LEFT JOIN z USING (key) LEFT JOIN w8 USING (key))
SELECT key, CAST(CASE WHEN weeks > 3 THEN 3 ELSE weeks END AS INTEGER) AS tier, CASE WHEN weeks = 1 THEN last END AS seen_cents, CASE WHEN weeks = 1 THEN substr(last_week, 6) END AS seen_week,
  CASE WHEN weeks = 2 THEN first END AS first_cents, CASE WHEN weeks = 2 THEN last END AS last_cents, CASE WHEN weeks = 2 THEN CAST(floor((last - first) * 100 / first + 0.5) AS BIGINT) END AS delta_pct,
  CASE WHEN weeks > 2 THEN lo END AS least, CASE WHEN weeks > 2 THEN mid END AS median, CASE WHEN weeks > 2 THEN hi END AS most, CASE WHEN weeks > 2 AND low = lo THEN substr(low_week, 6) END AS min_week,
  CASE WHEN weeks > 2 THEN hi = lo END AS flat, CASE WHEN weeks > 2 THEN loud END AS noisy,
  CASE WHEN weeks > 2 AND NOT loud THEN CASE WHEN last = lo THEN 'true_low' WHEN last > mid THEN 'worse' ELSE 'typical' END END AS verdict,
  CASE WHEN weeks > 2 AND NOT loud THEN CAST(floor(cents * 100 / mid + 0.5) AS BIGINT) END AS pct_of_usual FROM j""")
def price_trail(spark, sf_dir):
    rows = offers(spark, sf_dir)
    day = F.lit(TODAY).cast("date")
    now = rows.where((F.col("valid_from") <= day) & (F.col("valid_to") >= day)).groupBy(_key().alias("key")).agg(F.min("price_cents").alias("cents"))
    now = now.unionByName(values(spark, [("nowhere:nothing", 100), ("north:once", None), ("north:twice", 90)], "key string, cents long"))
    made = values(spark, [("north:once", [("1998-W09", 120)], 1), ("north:twice", [("1998-W09", 120), ("1998-W11", 99)], 2)], "key string, series array<struct<week:string,cents:long>>, weeks_seen long")
    known = hs.facts(rows, _key())
    return hs.trail(known.unionByName(made, allowMissingColumns=True), now)
