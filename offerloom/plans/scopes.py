"""Sections, comparison scopes, places, saved records and the ingest run."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import places as pl
from offerloom.operators import rules as ru
from offerloom.operators import scopes as sc
from offerloom.operators import upsert as up
from offerloom.plans import recipes as rc
from offerloom.plans.baskets import _book, _priced, _roles
from offerloom.plans.classification import _HITS, _VERDICTS, BOOK, _joined, products
from offerloom.plans.registry import query, values
from offerloom.plans.sundry import _CLEARANCE, _COUPONS, _DIST, clearance_pages, coupon_pages, flyer_pages
from offerloom.sources import feeds as fd
from offerloom.sources.tables import offers, stores, table

_PLZ = ("10115", "14199", "14200", "10114", "abc", " 12000 ", "10115.5", "", "10999.0")


@query("f15_covered_plz", f"""WITH c AS (SELECT c_custkey, nullif(({list(_PLZ)!r})[c_custkey % {len(_PLZ)} + 1], '') AS plz FROM customer)
SELECT c_custkey, coalesce(try_cast(trim(plz) AS DOUBLE) BETWEEN 10115 AND 14199 AND try_cast(trim(plz) AS DOUBLE) = floor(try_cast(trim(plz) AS DOUBLE)), false) AS covered FROM c""", views=False)
def covered_customers(spark, sf_dir):
    plz = F.element_at(F.array(*map(F.lit, _PLZ)), (F.col("c_custkey") % len(_PLZ) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", sc.covered_plz(F.nullif(plz, F.lit(""))).alias("covered"))


@query("f18_landing", " SELECT plz, bool_or(category IN ('dairy', 'seeds')) AS lands FROM offers GROUP BY plz")
def landing(spark, sf_dir):
    return sc.lands_on(offers(spark, sf_dir), ["dairy", "seeds"], "plz")


_SECOND = "split_part(name, ' ', 2)"


@query("f19_comparison_scope", f""", p AS (SELECT DISTINCT chain FROM offers), s AS (SELECT chain FROM p WHERE chain IN ('north', 'west', 'nowhere')),
t AS (SELECT chain FROM p WHERE (SELECT count(*) FROM s) < 2 OR chain IN (SELECT chain FROM s)),
c AS (SELECT category, {_SECOND} AS g FROM offers WHERE chain IN (SELECT chain FROM t) GROUP BY ALL HAVING count(DISTINCT chain) >= 2)
SELECT 'chain' AS kind, chain AS value FROM t UNION ALL SELECT DISTINCT 'category', category FROM c UNION ALL SELECT 'active', min(category) FROM c HAVING count(*) > 0""")
def scope(spark, sf_dir):
    rows = offers(spark, sf_dir)
    chains = sc.comparison_scope(rows, ["north", "west", "nowhere"])
    categories = sc.comparable_categories(rows, chains, F.split_part("name", F.lit(" "), F.lit(2)))
    out = chains.select(F.lit("chain").alias("kind"), F.col("chain").alias("value")).unionByName(categories.select(F.lit("category").alias("kind"), F.col("category").alias("value")))
    return out.unionByName(sc.active_category(categories, "stale").select(F.lit("active").alias("kind"), F.col("category").alias("value")))


@query("u03_companion_sections", """ SELECT CASE WHEN category = 'drinks' THEN 'drinks' ELSE 'grocery' END AS section, category, count(*) AS n, min(ext) AS first FROM offers WHERE chain <> 'garden' GROUP BY ALL""")
def sections(spark, sf_dir):
    rows = sc.companion_sections(offers(spark, sf_dir), "grocery", "drinks")
    return rows.groupBy("section", "category").agg(F.count("*").alias("n"), F.min("ext").alias("first"))


_DIVISIONS = [("nord", ["nord", "#00000000"]), ("sued", ["süd", "sued", "#000000001"])]


@query("x32_division", """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 OR contains(lower(s_name), '#00000000') THEN 'nord' WHEN s_suppkey % 5 = 0 OR contains(lower(s_name), '#000000001') THEN 'sued' END AS division FROM supplier""", views=False)
def divisions(spark, sf_dir):
    key = F.col("s_suppkey")
    brand, operator = F.when(key % 7 == 0, "Markt NORD"), F.when(key % 5 == 0, "Handel Süd GmbH")
    return table(spark, sf_dir, "supplier").select("s_suppkey", sc.division_of([brand, F.col("s_name"), operator], _DIVISIONS).alias("division"))


@query("w10_nearest_tagged", f""" SELECT CASE WHEN store_id % 3 = 0 THEN 'nord' ELSE 'sued' END AS tag, store_id, CAST(round({_DIST}) AS BIGINT) AS metres FROM stores WHERE store_id % 4 > 1 ORDER BY {_DIST}, store_id LIMIT 1""")
def tagged(spark, sf_dir):
    tag = F.when(F.col("store_id") % 4 > 1, F.when(F.col("store_id") % 3 == 0, "nord").otherwise("sued"))
    return pl.nearest_tagged(stores(spark, sf_dir), 52.3, 13.4, tag).withColumn("metres", F.round("metres").cast("long"))


@query("s07_source_store", f""" SELECT store_id, CAST(round({_DIST}) AS BIGINT) AS metres FROM stores WHERE store_id % 2 = 0 ORDER BY {_DIST}, store_id LIMIT 1""")
def source(spark, sf_dir):
    rows = stores(spark, sf_dir).withColumn("lat", F.when(F.col("store_id") % 2 == 0, F.col("lat")))
    return pl.source_store(rows, 52.3, 13.4).select("store_id", F.round("metres").cast("long").alias("metres"))


@query("s10_centroids", """, c AS (SELECT plz, avg(lat) AS lat, avg(lng) AS lng FROM stores GROUP BY plz), u AS (SELECT c_custkey, CAST(10115 + c_nationkey AS VARCHAR) AS plz, CASE WHEN c_custkey % 3 = 0 THEN 52.5::DOUBLE END AS lat, CASE WHEN c_custkey % 6 < 4 THEN 13.5::DOUBLE END AS lng FROM customer)
SELECT c_custkey, round(CASE WHEN u.lat IS NOT NULL AND u.lng IS NOT NULL THEN u.lat ELSE c.lat END, 6) AS lat, round(CASE WHEN u.lat IS NOT NULL AND u.lng IS NOT NULL THEN u.lng ELSE c.lng END, 6) AS lng FROM u LEFT JOIN c USING (plz)""")
def customers_located(spark, sf_dir):
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.lit(10115) + F.col("c_nationkey")).cast("string").alias("plz"), F.when(key % 3 == 0, F.lit(52.5)).alias("lat"), F.when(key % 6 < 4, F.lit(13.5)).alias("lng"))
    return pl.located(rows, pl.centroids(stores(spark, sf_dir))).select("c_custkey", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def _json_sql(n: str) -> str:
    fields = {"slug": "slug", "table": "tab", "rule": "rule", "matched": "matched", "place": "place", "reason": "reason", "blocked_slug": "blocked"}
    value = lambda name, f: f"coalesce(',\"{name}\":' || {f if name == 'rule' else f"'\"' || {f} || '\"'"}, '')"
    own = {f: f"l{n}_{f}" for f in fields.values()} | {"place": f"CASE WHEN l{n}_status = 'decided' THEN l{n}_place END"}
    return f"""'{{{{"layer":"{n}","status":"' || l{n}_status || '"' || """ + " || ".join(value(name, own[f]) for name, f in fields.items()) + " || '}}'"


@query("p03_compact_trace", (f"""WITH {_HITS.replace("{", "{{").replace("}", "}}")} SELECT p_partkey, '{{{{"category":"' || final || '","inputs":{{{{' || CASE len(path) WHEN 0 THEN '' ELSE '"category_path":["' || array_to_string(path, '","') || '"]' END || '}}}},"layers":['
  || {" || ',' || ".join(map(_json_sql, _VERDICTS))} || ']' || CASE WHEN redirected THEN ',"redirect":{{{{"layer":"R","status":"decided","slug":"pantry","table":"preserved","matched":"' || preserved_token || '","place":"caption","blocked_slug":"' || won || '"}}}}' ELSE '' END || '}}}}' AS trace FROM w""").replace("{{", "{").replace("}}", "}"), views=False)
def compact_trace(spark, sf_dir):
    rows = products(spark, sf_dir)
    return _joined(rows, ru.compact(ru.explain(rows, BOOK)), ["trace"]).select("p_partkey", "trace")


@query("p04_saved_records", """SELECT event_id AS id, 'k' || user_id AS key, event_type AS name, CASE WHEN event_id % 2 = 0 THEN 'b' END AS brand, CASE WHEN event_id % 5 > 0 THEN user_id END AS cents, CASE WHEN event_id % 3 > 0 THEN event_id END AS added
FROM events WHERE event_id % 7 > 0""", views=False)
def saved(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    at = F.when(e % 3 == 0, "").when(e % 3 == 1, F.concat(F.lit(',"addedAt":'), e.cast("string"))).otherwise(F.concat(F.lit(',"addedAt":"soon","likedAt":'), e.cast("string")))
    record = F.concat(F.lit('{"key":"k'), u, F.lit('","name":"'), F.col("event_type"), F.when(e % 2 == 0, '","brand":"b"').otherwise('","brand":7'), F.when(e % 5 > 0, F.concat(F.lit(',"addedPriceCents":'), u)).otherwise(""), at, F.lit("}"))
    rows = table(spark, sf_dir, "events").select(e.alias("id"), F.when(e % 7 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('[null,5,{"key":3,"name":"x"},{"key":"y"},'), record, F.lit("]"))).alias("json"))
    return fd.history_records(rows)


@query("k08_saved_stores", """, o AS (SELECT chain, min(store_id) AS store_id FROM stores WHERE chain <> 'west' GROUP BY chain), n AS (SELECT chain, max(store_id) AS store_id FROM stores WHERE chain IN ('west', 'north') GROUP BY chain)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE chain NOT IN (SELECT chain FROM n)""")
def saved_stores(spark, sf_dir):
    rows = stores(spark, sf_dir)
    old = rows.where("chain <> 'west'").groupBy("chain").agg(F.min("store_id").alias("store_id"))
    return up.upsert(old, rows.where("chain in ('west', 'north')").select("chain", "store_id"), ["chain"], [F.desc("store_id")])


@query("a10_recipe_chains", f""", {_roles("true")}, c AS (SELECT recipe, chain, min(n) AS n FROM e WHERE role = 'on_sale' AND NOT staple GROUP BY ALL)
SELECT b.recipe, coalesce(string_agg(chain, ',' ORDER BY n), '') AS chains FROM (SELECT unnest(['bolt soup', 'ring pie', 'plate stew', 'empty pot']) AS recipe) b LEFT JOIN c USING (recipe) GROUP BY b.recipe""")
def recipe_chains(spark, sf_dir):
    return rc.chains_of(_book(spark), _priced(spark, sf_dir)).select("recipe", F.array_join("chains", ",").alias("chains"))


@query("o07_locale_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY translate(lower(p_name), 'äöü', 'aou'), p_partkey) AS position FROM part", views=False)
def locale_order(spark, sf_dir):
    from pyspark.sql.window import Window

    order = Window.partitionBy("p_brand").orderBy(F.collate("p_name", "de"), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(order).alias("position"))


_BATCH = f"""fl AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand || ' ' || p_name AS name, p_brand AS brand, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, CASE WHEN p_size % 6 IN (1, 3, 4) THEN 1 END AS reg, CASE WHEN p_size % 6 <> 1 THEN 1 END AS per FROM part WHERE p_size % 6 NOT IN (0, 5)),
{_COUPONS}, {_CLEARANCE},
b AS (SELECT 'flyer' AS source, id, name, brand, price_cents, reg IS NOT NULL AS reduced, per IS NOT NULL AS has_unit, false AS pictured FROM fl UNION ALL SELECT 'coupon', id, name, brand, price_cents, regular_cents IS NOT NULL, per_unit IS NOT NULL, image_url IS NOT NULL FROM co
  UNION ALL SELECT 'clearance', id, name, brand, price_cents, regular_cents IS NOT NULL, base_unit IS NOT NULL, image_url IS NOT NULL FROM cl)"""


def batch(spark, sf_dir):
    return fd.batch(fd.flyer_offers(flyer_pages(spark, sf_dir)), fd.coupon_offers(coupon_pages(spark, sf_dir)), fd.clearance_offers(clearance_pages(spark, sf_dir)))


@query("u02_source_batches", f"WITH {_BATCH} SELECT * FROM b", views=False)
def batches(spark, sf_dir):
    return batch(spark, sf_dir).select("source", "id", "name", "brand", "price_cents", F.col("regular_cents").isNotNull().alias("reduced"), F.col("per_unit").isNotNull().alias("has_unit"), F.col("image_url").isNotNull().alias("pictured"))




@query("q06_customers", """, c AS (SELECT plz, avg(lat) AS lat, avg(lng) AS lng FROM stores GROUP BY plz), u AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN CAST(10115 + c_nationkey AS VARCHAR) ELSE 'x' END AS plz, CASE WHEN c_custkey % 3 = 0 THEN 52.0::DOUBLE + (c_custkey * 17 % 1500) / 1000.0::DOUBLE END AS lat, CASE WHEN c_custkey % 6 < 4 THEN 13.0::DOUBLE + (c_custkey * 29 % 1700) / 1000.0::DOUBLE END AS lng FROM customer),
l AS (SELECT c_custkey, CASE WHEN u.lat IS NOT NULL AND u.lng IS NOT NULL THEN u.lat ELSE c.lat END AS x, CASE WHEN u.lat IS NOT NULL AND u.lng IS NOT NULL THEN u.lng ELSE c.lng END AS y FROM u LEFT JOIN c USING (plz)),
d AS (SELECT c_custkey, chain, store_id, 2 * 6371000 * asin(sqrt(pow(sin((radians(lat) - radians(x)) / 2), 2) + cos(radians(x)) * cos(radians(lat)) * pow(sin((radians(lng) - radians(y)) / 2), 2))) AS m FROM l, stores WHERE x IS NOT NULL)
SELECT c_custkey, chain, store_id, CAST(round(m) AS BIGINT) AS metres, row_number() OVER (PARTITION BY c_custkey, chain ORDER BY m, store_id) AS rank FROM d QUALIFY rank <= 2""")
def customers_nearest(spark, sf_dir):
    """The two nearest stores of each chain for every customer: by own coordinates, else the middle of the postal code; those with neither have none."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(key % 5 > 0, (F.lit(10115) + F.col("c_nationkey")).cast("string")).otherwise("x").alias("plz"),
        F.when(key % 3 == 0, F.lit(52.0) + (key * 17 % 1500) / 1000.0).alias("lat"), F.when(key % 6 < 4, F.lit(13.0) + (key * 29 % 1700) / 1000.0).alias("lng"))
    own = stores(spark, sf_dir)
    at = pl.located(rows, pl.kept(pl.centroids(own)))  # an average of other digits would meet no point
    near = pl.nearest_many(at, own, 2, "chain")
    return at.join(near, ["lat", "lng"]).select("c_custkey", "chain", "store_id", F.round("metres").cast("long").alias("metres"), "rank")


@query("s09_places", """SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'north_plus' WHEN 1 THEN 'north' ELSE 'south' END AS chain, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'North ' || s_name ELSE 'South X' END AS name, 52.0::DOUBLE + s_suppkey AS lat, 13.0::DOUBLE AS lng,
  CASE s_suppkey % 3 WHEN 0 THEN 'Weg ' || s_suppkey || ', 10115 B' WHEN 1 THEN 'B' END AS address, CASE WHEN s_suppkey % 5 = 0 THEN 2 WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS mirror FROM supplier WHERE s_suppkey % 4 <> 3 AND s_suppkey % 7 > 0""", views=False)
def mirrored_places(spark, sf_dir):
    """Places by area from three mirrors: the first fails with a remark or breaks off, the second isn't valid, some areas fail everywhere."""
    key, name = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    tags = F.concat(
        F.lit('{"brand":"'), F.when(key % 4 == 0, "North PLUS City").when(key % 4 == 1, "").when(key % 4 == 2, "South X").otherwise("Elsewhere"), F.lit('"'), F.when(key % 4 < 2, F.concat(F.lit(',"name":"'), F.when(key % 4 == 1, "North ").otherwise(""), F.col("s_name"), F.lit('"'))).otherwise(""),
        F.when(key % 3 == 0, F.concat(F.lit(',"addr:street":"Weg","addr:housenumber":"'), name, F.lit('","addr:postcode":"10115","addr:city":"B"'))).when(key % 3 == 1, F.lit(',"addr:city":"B"')).otherwise(""), F.lit("}"))
    where = F.when(key % 2 == 0, F.concat(F.lit('"lat":'), (key + 52).cast("string"), F.lit(',"lon":13'))).otherwise(F.concat(F.lit('"center":{"lat":'), (key + 52).cast("string"), F.lit(',"lon":13}')))
    body = F.concat(F.lit('{"elements":[{"type":"node","id":'), name, F.lit(","), where, F.lit(',"tags":'), tags, F.lit("}]"))
    remark = F.concat(body, F.lit(',"remark":"timed out"}'))
    good = F.concat(body, F.lit("}"))
    texts = [F.when(key % 7 == 0, remark).when(key % 3 == 0, remark).when(key % 5 == 0, body).otherwise(good), F.when((key % 7 == 0) | (key % 5 == 0), "<html>").otherwise(good), F.when(key % 7 == 0, '{"elements":{}}').otherwise(good)]
    rows = table(spark, sf_dir, "supplier").select(name.alias("area"), F.posexplode(F.array(*texts)).alias("mirror", "json"))
    chosen = pl.first_good(rows)
    mirror = chosen.select(F.col("area").cast("long").alias("id"), "mirror")
    return pl.elements(chosen).join(mirror, "id").select("id", "chain", "name", "lat", "lng", "address", "mirror")
