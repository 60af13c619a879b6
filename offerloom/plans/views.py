"""Lookups, suggestions, display texts and per-category orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions import display as dp
from offerloom.operators import lookups as lk
from offerloom.functions.text import name_key
from offerloom.operators import upsert as up
from offerloom.operators.filters import equal_to, served
from offerloom.operators.ranking import serve_dedup
from offerloom.plans.exports import candidates_json, manifest
from offerloom.plans.listings import _GROCERY, _VALID, _dedup
from offerloom.plans.registry import query, values
from offerloom.sources.tables import TODAY, offers, stores, table

_INDEX = "ix AS (SELECT lower(name) AS key, chain, min(price_cents) AS cents FROM offers WHERE chain <> 'east' GROUP BY ALL), it AS (SELECT DISTINCT lower(p_name) AS key, chain FROM part, (SELECT unnest(['west', 'east']) AS chain) UNION SELECT 'gone', 'west')"


def _index(spark, sf_dir):
    rows = offers(spark, sf_dir)
    index = rows.where("chain <> 'east'").groupBy(name_key("name").alias("key"), "chain").agg(F.min("price_cents").alias("cents"))
    names = table(spark, sf_dir, "part").select(name_key("p_name").alias("key")).union(spark.range(1).select(F.lit("gone")))
    items = names.distinct().withColumn("chain", F.explode(F.array(F.lit("west"), F.lit("east")))).where("key <> 'gone' or chain = 'west'")
    return items, index


@query("j10_price_lookup", f""", {_INDEX}, j AS (SELECT it.key, it.chain, ix.chain AS c, cents, row_number() OVER (PARTITION BY it.key, it.chain ORDER BY coalesce(ix.chain = it.chain, false) DESC, ix.chain, cents) AS rn FROM it LEFT JOIN ix ON it.key = ix.key)
SELECT key, chain, cents, c <> chain AS cross FROM j WHERE rn = 1""")
def lookup(spark, sf_dir):
    return lk.price_lookup(*_index(spark, sf_dir))


@query("j11_misses", f", {_INDEX} SELECT DISTINCT key FROM it WHERE key NOT IN (SELECT key FROM ix)")
def missed(spark, sf_dir):
    return lk.misses(*_index(spark, sf_dir))


_CATALOGUE = [
    (1, "bolts", "Bolt", "fruits", ["bolt", "screw"], ["old"]), (2, "rings", "Circle", "bakery", ["ring"], []), (3, "reds", "Rot", "dairy", ["red g", "red ring"], ["red gizmo"]), (4, "hots", "Hot", "fruits", ["hot", "gear"], None), (5, "gears", "Zahnräder", "bakery", ["gear"], []),
]
_RESOLVE = """o AS (SELECT DISTINCT p_name AS name, p_brand AS brand, CASE p_type WHEN 'STANDARD' THEN 'fruits' WHEN 'SMALL' THEN 'bakery' END AS category, CASE WHEN p_size % 3 = 0 THEN split_part(p_name, ' ', 2) END AS grp,
  CASE WHEN p_size % 3 = 0 AND p_name LIKE '%gear' THEN 'ZAHNRÄDER' END AS label FROM part),
c AS (SELECT * FROM (VALUES (1, 'bolts', 'bolt', 'fruits', ['bolt', 'screw'], ['old']), (2, 'rings', 'circle', 'bakery', ['ring'], []), (3, 'reds', 'rot', 'dairy', ['red g', 'red ring'], ['red gizmo']), (4, 'hots', 'hot', 'fruits', ['hot', 'gear'], []), (5, 'gears', 'zahnrader', 'bakery', ['gear'], [])) v(pos, item, lab, cat, keys, nots)),
p AS (SELECT o.*, replace(lower(coalesce(o.label, grp)), 'ä', 'a') AS want, lower(name || ' ' || brand) AS hay FROM o),
m AS (SELECT p.*, c.item, CASE WHEN grp IS NOT NULL THEN CASE WHEN lab = want THEN 0 ELSE 1 END ELSE -list_max([CASE WHEN contains(hay, k) THEN length(k) ELSE 0 END FOR k IN keys]) - CASE WHEN cat = category THEN 0.5 ELSE 0 END END AS score, pos
  FROM p JOIN c ON CASE WHEN grp IS NOT NULL THEN lab = want OR list_contains(keys, want) ELSE len([k FOR k IN keys IF contains(hay, k)]) > 0 AND len([k FOR k IN nots IF contains(hay, k)]) = 0 END),
b AS (SELECT name, brand, category, grp, label, arg_min(item, (score, pos)) AS item FROM m GROUP BY ALL),
r AS (SELECT p.name, p.brand, p.category, p.grp, p.label, coalesce(b.item, CASE WHEN p.grp IS NOT NULL THEN 'grp:' || p.grp ELSE 'ofr:' || lower(p.name) END) AS item, CASE WHEN b.item IS NULL THEN 'own' WHEN p.grp IS NOT NULL THEN 'group' ELSE 'name' END AS step
  FROM p LEFT JOIN b ON b.name = p.name AND b.brand = p.brand AND b.category IS NOT DISTINCT FROM p.category AND b.grp IS NOT DISTINCT FROM p.grp AND b.label IS NOT DISTINCT FROM p.label)"""


def _resolved(spark, sf_dir):
    group = F.when(F.col("p_size") % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(2)))
    category = F.when(F.col("p_type") == "STANDARD", "fruits").when(F.col("p_type") == "SMALL", "bakery")
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), category.alias("category"), group.alias("group"), F.when((F.col("p_size") % 3 == 0) & F.col("p_name").endswith("gear"), "ZAHNRÄDER").alias("label"))
    return lk.resolve_items(rows, values(spark, _CATALOGUE, "pos int, item string, label string, category string, keywords array<string>, exclude array<string>"))


@query("j15_resolve_items", f"WITH {_RESOLVE} SELECT name, brand, category, grp AS \"group\", label, item, step FROM r", views=False)
def resolved(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query("j18_in_basket_items", f"WITH {_RESOLVE} SELECT name, brand, item, item IN ('bolts', 'grp:rod') AS in_basket FROM r", views=False)
def in_basket_items(spark, sf_dir):
    """The marker by resolved items: an offer is in the basket if its item is."""
    basket = values(spark, [("bolts",), ("grp:rod",)], "item string").withColumn("_in", F.lit(True))
    return _resolved(spark, sf_dir).join(basket, "item", "left").select("name", "brand", "item", F.coalesce("_in", F.lit(False)).alias("in_basket"))


_GROUPS = """g AS (SELECT lower(name) AS key, arg_min(name, ext) AS label, arg_min(upper(category), ext) AS category_label FROM offers WHERE name NOT LIKE 'old%' GROUP BY 1)"""


def _groups(spark, sf_dir):
    rows = offers(spark, sf_dir).where("name not like 'old%'")
    return lk.groups_on_offer(rows, F.lower("name"), F.col("name"), F.upper("category"))


@query("j17_suggestions", f""", {_GROUPS}, c AS (SELECT *, 'item ' || split_part(key, ' ', 1) AS item_label, [key, 'Zahnrad'] AS keywords FROM g)
SELECT key, label, category_label FROM c WHERE key NOT IN ('red ring', 'new ring') AND key NOT IN ('blue ring') AND (contains(lower(label), 'ring') OR contains(item_label, 'ring')) ORDER BY category_label, label, key LIMIT 12""")
def suggested(spark, sf_dir):
    """Neither in the basket nor among the catalogue keys shown."""
    groups = _groups(spark, sf_dir).withColumns({"item_label": F.concat(F.lit("item "), F.split_part("key", F.lit(" "), F.lit(1))), "keywords": F.array(F.col("key"), F.lit("Zahnrad"))})
    basket, shown = values(spark, [("red ring",), ("new ring",)], "key string"), values(spark, [("blue ring",)], "key string")
    return lk.suggestions(groups, basket, shown, " RING").select("key", "label", "category_label")


_CATALOG = """c AS (SELECT p_partkey AS pos, p_name || ' ' || p_partkey AS key, upper(p_name) AS en, p_brand || ' Größe' AS de, [p_type, 'Käse ' || p_size] AS keywords FROM part),
f AS (SELECT *, [lower(en), replace(replace(lower(de), 'ö', 'o'), 'ß', 'ss'), key, lower(keywords[1]), replace(lower(keywords[2]), 'ä', 'a')] AS terms FROM c WHERE pos <> 7)"""


@query("o10_catalogue", f""", {_CATALOG}, a AS (SELECT 'de' AS asked, key, pos FROM f WHERE len([t FOR t IN terms IF contains(t, '3 grosse')]) > 0 UNION ALL SELECT 'keyword', key, pos FROM f WHERE len([t FOR t IN terms IF contains(t, 'kase 1')]) > 0
  UNION ALL SELECT 'letter', key, pos FROM f WHERE len([t FOR t IN terms IF contains(t, 'z')]) > 0 UNION ALL SELECT 'nothing', key, CASE pos WHEN 12 THEN 1 WHEN 3 THEN 2 END FROM f WHERE pos IN (3, 12))
SELECT asked, key, row_number() OVER (PARTITION BY asked ORDER BY pos, key) AS position FROM a QUALIFY position <= 12""")
def catalogue(spark, sf_dir):
    """What the catalogue suggests for a typed text in German, for a keyword, for one letter, and for none."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("key"), F.upper("p_name").alias("en"), F.concat(F.col("p_brand"), F.lit(" Größe")).alias("de"), F.array(F.col("p_type"), F.concat(F.lit("Käse "), F.col("p_size").cast("string"))).alias("keywords"))
    basket, popular = rows.where("pos = 7").select("key"), [r["key"] for r in rows.where("pos in (3, 7, 12)").orderBy(F.desc("pos")).select("key").collect()]
    asked = {"de": " 3 grösse", "keyword": "KASE 1", "letter": "z", "nothing": "  "}
    found = [lk.catalogue_suggestions(rows, basket, text, popular).withColumn("asked", F.lit(name)) for name, text in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("j18_in_basket", " SELECT ext, lower(name) IN ('red ring', 'old ring') AS in_basket FROM offers")
def in_basket(spark, sf_dir):
    basket = values(spark, [("red ring",), ("old ring",)], "key string").withColumn("_in", F.lit(True))
    rows = offers(spark, sf_dir)
    return rows.join(basket, F.lower(rows.name) == basket.key, "left").select("ext", F.coalesce("_in", F.lit(False)).alias("in_basket"))


@query("a16_groups_on_offer", f", {_GROUPS} SELECT *, row_number() OVER (ORDER BY category_label, label, key) AS position FROM g")
def groups(spark, sf_dir):
    return _groups(spark, sf_dir)


@query("a12_store_subtotals", """, p AS (SELECT name, arg_min(struct_pack(chain := chain, c := price_cents), (price_cents, ext)) AS b FROM offers GROUP BY name), s AS (SELECT b.chain AS chain, count(*) AS n, CAST(sum(b.c) AS BIGINT) AS subtotal FROM p GROUP BY 1)
SELECT chain, n, subtotal, row_number() OVER (ORDER BY subtotal DESC, chain) AS position FROM s""")
def subtotals(spark, sf_dir):
    picks = offers(spark, sf_dir).groupBy("name").agg(F.min_by(F.struct("chain", "price_cents"), F.struct("price_cents", "ext")).alias("_b"))
    out = picks.groupBy("_b.chain").agg(F.count("*").alias("n"), F.sum("_b.price_cents").alias("subtotal"))
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.desc("subtotal"), "chain")))  # a row for each chain


@query("a15_candidate_counts", " SELECT category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category) AS position FROM offers GROUP BY category")
def candidate_counts(spark, sf_dir):
    out = offers(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "category")))


@query("o06_chain_order", " SELECT chain, count(*) AS n, row_number() OVER (ORDER BY coalesce(nullif(list_position(['west', 'north'], chain), 0), 99), chain) AS position FROM offers GROUP BY chain")
def chain_order(spark, sf_dir):
    place = F.nullif(F.array_position(F.array(F.lit("west"), F.lit("north")), F.col("chain")), F.lit(0))
    out = offers(spark, sf_dir).groupBy("chain").agg(F.count("*").alias("n"))
    return out.withColumn("position", F.row_number().over(Window.orderBy(place.asc_nulls_last(), "chain")))


@query("o09_history_order", f""", h AS (SELECT store_id, name AS key, max(valid_from) AS last, max(CASE WHEN valid_to IS NULL OR valid_to >= DATE '{TODAY}' THEN 1 ELSE 0 END) AS live FROM offers GROUP BY ALL)
SELECT store_id, key, live = 1 AS on_sale, row_number() OVER (PARTITION BY store_id ORDER BY live DESC, last DESC, key) AS position FROM h""")
def history_order(spark, sf_dir):
    live = F.coalesce(F.col("valid_to") >= F.lit(TODAY).cast("date"), F.lit(True))
    out = offers(spark, sf_dir).groupBy("store_id", F.col("name").alias("key")).agg(F.max("valid_from").alias("_last"), F.bool_or(live).alias("on_sale"))
    return out.select("store_id", "key", "on_sale", F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc("on_sale"), F.desc("_last"), "key")).alias("position"))


@query("k06_manifest", """, p AS (SELECT lower(trim(name)) AS product, min(ext) AS ext FROM offers GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY product) - 1 AS k FROM p)
SELECT CAST(k // 20 + 1 AS INTEGER) AS sheet, CAST(k % 20 + 1 AS INTEGER) AS cell, product, ext FROM n""")
def sheets(spark, sf_dir):
    return manifest(offers(spark, sf_dir))


@query("k05_seed_json", """, r AS (SELECT *, row_number() OVER (PARTITION BY chain, category ORDER BY price_cents, ext) AS rn FROM offers), w AS (SELECT chain, unnest(['dairy', 'fruits', 'seeds']) AS category FROM (SELECT DISTINCT chain FROM offers)),
j AS (SELECT w.chain, w.category, coalesce(string_agg('{"_rank":' || rn || ',"ext":"' || ext || '","name":"' || name || '","price_cents":' || price_cents || '}', ',' ORDER BY rn), '') AS own FROM w LEFT JOIN r ON r.chain = w.chain AND r.category = w.category AND rn <= 3 GROUP BY ALL)
SELECT chain, '{' || string_agg('"' || category || '":[' || own || ']', ',' ORDER BY category) || '}' AS json FROM j GROUP BY chain""")
def seed_json(spark, sf_dir):
    return candidates_json(offers(spark, sf_dir), ["dairy", "fruits", "seeds"], 3)


_TEXTS = """t AS (SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'Je ' || p_size || ' g (Max. 3)' WHEN 1 THEN '(lose)' WHEN 2 THEN p_size || ' l (a) (b)' WHEN 3 THEN 'JE  Stück' WHEN 4 THEN '' WHEN 5 THEN 'jede Packung' END AS unit,
  CASE p_partkey % 8 WHEN 0 THEN '1 kg = ' || p_size || '.5' WHEN 1 THEN '100 g = ' || p_size || ',25/9.9' WHEN 2 THEN p_size || '.46 €/Stk.' WHEN 3 THEN p_size || ' / l' WHEN 4 THEN 'kg-Preis' WHEN 5 THEN '1 l =' WHEN 6 THEN '= 3' END AS per,
  CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name WHEN 2 THEN 'MÖWE-' || upper(p_name) WHEN 3 THEN '' WHEN 4 THEN 'Q&A 3' END AS brand, CASE WHEN p_size % 5 > 0 THEN p_size + CASE WHEN p_size % 2 = 0 THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END END AS pct, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part)"""
_TITLE = "upper({w}[1]) || substr({w}, 2)"


@query("x25_formats", f"""WITH {_TEXTS} SELECT k, c // 100 || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ' €' AS price, coalesce('-' || CAST(floor(pct + 0.5) AS BIGINT) || '%', '') AS off,
  CASE k % 7 WHEN 0 THEN regexp_extract(unit, '[0-9]+ g') WHEN 2 THEN regexp_extract(unit, '[0-9]+ l') WHEN 3 THEN 'Stück' WHEN 5 THEN 'jede Packung' END AS unit,
  CASE k % 8 WHEN 0 THEN regexp_extract(per, '= ([0-9]+)', 1) || ',5 €/kg' WHEN 1 THEN regexp_extract(per, '= ([0-9]+)', 1) || ',25 €/100 g' WHEN 2 THEN regexp_extract(per, '^[0-9]+') || ',46 €/Stk' WHEN 3 THEN regexp_extract(per, '^[0-9]+') || ' €/l' END AS per_unit,
  CASE k % 6 WHEN 0 THEN array_to_string([{_TITLE.format(w='w')} FOR w IN string_split(lower(brand), ' ')], ' ') WHEN 2 THEN 'Möwe-' || array_to_string([{_TITLE.format(w='w')} FOR w IN string_split(lower(substr(brand, 6)), ' ')], ' ') ELSE nullif(brand, '') END AS brand FROM t""", views=False)
def formats(spark, sf_dir):
    key, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    case = lambda n, *texts: F.element_at(F.array(*texts), (key % n + 1).cast("int"))
    none, say = F.lit(None).cast("string"), F.concat
    unit = case(7, say(F.lit("Je "), size, F.lit(" g (Max. 3)")), F.lit("(lose)"), say(size, F.lit(" l (a) (b)")), F.lit("JE  Stück"), F.lit(""), F.lit("jede Packung"), none)
    per = case(8, say(F.lit("1 kg = "), size, F.lit(".5")), say(F.lit("100 g = "), size, F.lit(",25/9.9")), say(size, F.lit(".46 €/Stk.")), say(size, F.lit(" / l")), F.lit("kg-Preis"), F.lit("1 l ="), F.lit("= 3"), none)
    brand = case(6, F.upper(name), name, say(F.lit("MÖWE-"), F.upper(name)), F.lit(""), F.lit("Q&A 3"), none)
    pct = F.when(F.col("p_size") % 5 > 0, F.col("p_size") + F.when(F.col("p_size") % 2 == 0, 0.5).otherwise(0.4))
    rows = table(spark, sf_dir, "part").select(key.alias("k"), F.round(F.col("p_retailprice") * 100).cast("long").alias("c"), unit.alias("unit"), per.alias("per"), brand.alias("brand"), pct.alias("pct"))
    return rows.select("k", dp.euro(F.col("c")).alias("price"), dp.percent(F.col("pct")).alias("off"), dp.clean_unit(F.col("unit")).alias("unit"), dp.per_unit_shown(F.col("per")).alias("per_unit"), dp.brand_title(F.col("brand")).alias("brand"))


@query("x25_as_of", """WITH e AS (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN TIMESTAMP '2024-01-30 12:00:00' - to_microseconds(CAST(power(10, event_id % 8) * 1000000 AS BIGINT)) - to_seconds(user_id % 60) END AS t FROM events), a AS (SELECT *, epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(t) AS s FROM e)
SELECT event_id, CASE WHEN t IS NULL THEN '' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN CAST(t AS DATE) = DATE '2024-01-30' THEN strftime(t, '%-H:%M') WHEN s < 604800 THEN strftime(t, '%a %-H:%M') ELSE strftime(t, '%-d %b') END AS label FROM a""", views=False)
def ages(spark, sf_dir):
    """Labels of times from a second to months before now."""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    before = (F.unix_micros(now) - (F.pow(F.lit(10), F.col("event_id") % 8) * 1_000_000).cast("long") - (F.col("user_id") % 60) * 1_000_000).cast("long")
    at = F.when(F.col("event_id") % 11 > 0, F.timestamp_micros(before))
    return table(spark, sf_dir, "events").select("event_id", dp.as_of(at, now).alias("label"))


@query("x26_staleness", f"SELECT o_orderkey, DATE '{TODAY}' > CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS stale, o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 OR o_orderkey % 5 = 1 OR DATE '{TODAY}' > CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS again FROM orders", views=False)
def staleness(spark, sf_dir):
    """Whether the week is over, and whether a copy kept then, some by another version, some not at all, must be fetched again."""
    key, day, now = F.col("o_orderkey"), F.to_date("o_orderdate"), F.lit(TODAY).cast("date")
    version = F.when(key % 3 == 0, 6).when(key % 4 > 0, 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", dp.deals_stale(day, now).alias("stale"), dp.cache_stale(F.when(key % 5 != 1, day), version, now, 7).alias("again"))


@query("x27_delta", "SELECT p_partkey, CASE WHEN p_size > 25 THEN (p_size - 25) || ' new' WHEN p_size < 25 THEN (25 - p_size) || ' removed' END AS message FROM part", views=False)
def deltas(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", dp.delta_message(F.lit(25), F.col("p_size")).alias("message"))


@query("x30_host_groups", "SELECT page_id, CASE WHEN contains(url, 'shop') THEN 'shop' WHEN contains(url, 'blog') THEN 'blog' ELSE 'other' END AS source FROM pages", views=False)
def hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", dp.first_containing(F.col("url"), [("shop", "shop"), ("blog", "blog")], "other").alias("source"))


@query("s15_payload_map", f""", b AS (SELECT * FROM offers WHERE plz = '10130' AND {_GROCERY} AND {_VALID}), d AS {_dedup('b')} SELECT ext AS key, '{{"name":"' || name || '","brand":"' || brand || '","price_cents":' || price_cents || '}}' AS payload FROM d""")
def payloads(spark, sf_dir):
    """The map from key to payload of exactly what a place is served, as rows."""
    rows = serve_dedup(served(offers(spark, sf_dir), TODAY, plz="10130"), name_key("name"))
    return rows.select(F.col("ext").alias("key"), F.to_json(F.struct("name", "brand", "price_cents")).alias("payload"))


@query("k07_toggles", """, p AS (SELECT DISTINCT chain FROM offers WHERE store_id % 6 < 3), o AS (SELECT chain FROM p ORDER BY chain DESC OFFSET 1), l AS (SELECT max(chain) AS c FROM p)
SELECT 'hide' AS what, key AS value FROM (VALUES ('c'), ('d')) v(key) UNION ALL SELECT 'unhide', 'a' UNION ALL SELECT 'last', chain FROM o UNION ALL SELECT 'other', chain FROM o UNION ALL SELECT 'other', 'nowhere' UNION ALL SELECT 'first', chain FROM o WHERE chain <> (SELECT min(chain) FROM o)""")
def toggles(spark, sf_dir):
    """Hides toggled with those run out gone; of the chains present all but one hidden: the last stays, one that isn't there may go, a hidden one comes back."""
    hides = values(spark, [("a", "1998-06-15"), ("b", "1998-06-07"), ("c", "1998-06-16")], "key string, since string").select("key", F.to_date("since").alias("since"))
    since = F.lit(TODAY)
    out = [up.toggled_hide(up.toggled_hide(hides, "d", since, TODAY), "a", since, TODAY).select(F.lit("hide").alias("what"), F.col("key").alias("value")), up.toggled_hide(hides, "c", since, TODAY).select(F.lit("unhide").alias("what"), F.col("key").alias("value"))]
    present = offers(spark, sf_dir).where("store_id % 6 < 3").select("chain").distinct()
    names = sorted(r["chain"] for r in present.collect())  # a few chains
    hidden = values(spark, [(c,) for c in names[:-1]], "value string")
    out += [up.toggled_store(hidden, c, present).select(F.lit(what).alias("what"), "value") for what, c in (("last", names[-1]), ("other", "nowhere"), ("first", names[0]))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query("s14_point_lookup", " SELECT store_id, chain, store_name, plz FROM stores WHERE store_id = 3")
def point(spark, sf_dir):
    return equal_to(stores(spark, sf_dir), store_id=3).select("store_id", "chain", "store_name", "plz")


@query("u06_missing_chains", " SELECT unnest(['north', 'nowhere']) AS chain EXCEPT SELECT chain FROM offers")
def absent(spark, sf_dir):
    return lk.missing_chains(offers(spark, sf_dir), ["north", "nowhere"])
