"""Optimiser, comparisons, keyword and history matches, recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions.pricing import unit_price_cents
from offerloom.functions.text import norm_name
from offerloom.operators import matching as mt
from offerloom.plans import optimise as op
from offerloom.plans import recipes as rc
from offerloom.plans.registry import query, values
from offerloom.sources.tables import TODAY, offers, table

_KEY = "trim(regexp_replace(lower(name), '[^a-z0-9äöüß]+', ' ', 'g'))"
_WANT = ["dairy", "fruits", "bakery", "seeds"]
_CELLS = f"""v AS (SELECT * FROM offers WHERE (valid_to IS NULL OR valid_to >= DATE '{TODAY}') AND {{plz}}),
cells AS (SELECT store_id, chain, category, ext, price_cents FROM v WHERE category IN ('dairy','fruits','bakery','seeds') QUALIFY row_number() OVER (PARTITION BY store_id, category ORDER BY price_cents, ext) = 1),
totals AS (SELECT store_id, count(*) AS covered, CAST(sum(price_cents) AS BIGINT) AS single_total FROM cells GROUP BY store_id ORDER BY covered DESC, single_total, store_id LIMIT 1)"""
_PICKS = f"""{_CELLS}, picks AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY category ORDER BY price_cents, store_id) = 1),
t AS (SELECT CAST(sum(price_cents) AS BIGINT) AS total, count(DISTINCT store_id) AS n_stores FROM picks),
lack AS (SELECT coalesce(string_agg(c, ',' ORDER BY n), '') AS missing FROM (SELECT unnest(['dairy','fruits','bakery','seeds']) AS c, unnest([1, 2, 3, 4]) AS n) WHERE c NOT IN (SELECT category FROM {{own}}))"""


def _told(df):
    return df.withColumn("missing", F.array_join("missing", ","))


@query("q03_optimize_single", f""", {_PICKS.format(plz="plz = '10130'", own="cells JOIN totals USING (store_id)")}
SELECT store_id, chain, category, ext, price_cents, covered, single_total AS total, missing FROM cells JOIN totals USING (store_id), lack""")
def one_store(spark, sf_dir):
    return _told(op.single_store(offers(spark, sf_dir), _WANT, TODAY, plz="10130"))


@query("q04_optimize_multi", f""", {_PICKS.format(plz="true", own="picks")}
SELECT category, picks.store_id, chain, ext, price_cents, CAST(sum(price_cents) OVER (PARTITION BY picks.store_id) AS BIGINT) AS subtotal, t.total, n_stores, single_total, greatest(single_total - t.total, 0) AS savings, missing FROM picks, t, totals, lack""")
def many(spark, sf_dir):
    return _told(op.many_stores(offers(spark, sf_dir), _WANT, TODAY))


@query("q04_response", f""", {_PICKS.format(plz="plz = '10130'", own="picks")}, b AS (SELECT store_id, chain, CAST(sum(price_cents) AS BIGINT) AS subtotal, string_agg(category || '=' || ext || '@' || price_cents, ' ' ORDER BY category) AS items FROM picks GROUP BY ALL)
SELECT CAST(count(*) AS INTEGER) AS store_count, string_agg(b.store_id || ' ' || chain || ' ' || subtotal || ': ' || items, '; ' ORDER BY b.store_id) AS baskets, any_value(t.total) AS total, any_value(single_total) AS single_total, greatest(any_value(single_total) - any_value(t.total), 0) AS savings, any_value(missing) AS missing FROM b, t, totals, lack""")
def whole_response(spark, sf_dir):
    out = _told(op.response(offers(spark, sf_dir), _WANT, 2, TODAY, plz="10130"))
    items = lambda b: F.array_join(F.transform(b["items"], lambda i: F.concat(i["category"], F.lit("="), i["ext"], F.lit("@"), i["price_cents"].cast("string"))), " ")
    said = F.array_join(F.transform("baskets", lambda b: F.concat(b["store_id"].cast("string"), F.lit(" "), b["chain"], F.lit(" "), b["subtotal"].cast("string"), F.lit(": "), items(b))), "; ")
    return out.withColumn("baskets", said)


_CHEAP = "SELECT k, price_cents FROM (SELECT {key} AS k, price_cents, row_number() OVER (PARTITION BY {key} ORDER BY price_cents, ext) AS rn FROM offers WHERE chain = '{c}') WHERE rn = 1 AND k <> ''"


@query("q12_two_chain_diff", f""", a AS ({_CHEAP.format(key=_KEY, c='north')}), b AS ({_CHEAP.format(key=_KEY, c='harbor')})
SELECT CASE WHEN a.k IS NULL THEN 'only_b' ELSE 'differs' END AS kind, b.k AS key, a.price_cents AS a_cents, b.price_cents AS b_cents,
  abs(a.price_cents - b.price_cents) AS gap, CASE WHEN a.price_cents < b.price_cents THEN 'north' WHEN a.price_cents > b.price_cents THEN 'harbor' END AS cheaper
FROM b LEFT JOIN a ON a.k = b.k WHERE a.k IS NULL OR a.price_cents <> b.price_cents""")
def chain_diff(spark, sf_dir):
    return mt.two_chains(offers(spark, sf_dir), "north", "harbor")


@query("q11_compare_pivot", """, o AS (SELECT split_part(name, ' ', 2) AS "group", upper(split_part(name, ' ', 2)) || '!' AS l, chain, ext, price_cents FROM offers WHERE chain IN ('south', 'north', 'west', 'nowhere') AND category = 'dairy'),
c AS (SELECT "group", chain, min(price_cents) AS price_cents, arg_min(ext, (price_cents, ext)) AS ext FROM o GROUP BY ALL), n AS (SELECT "group", arg_min(l, ext) AS label FROM o GROUP BY ALL),
r AS (SELECT *, max(price_cents) OVER w - min(price_cents) OVER w AS spread, row_number() OVER (PARTITION BY "group" ORDER BY price_cents, list_position(['south', 'north', 'west', 'nowhere'], chain)) = 1 AS cheapest FROM c JOIN n USING ("group") WINDOW w AS (PARTITION BY "group") QUALIFY count(*) OVER w >= 2)
SELECT *, CAST(dense_rank() OVER (ORDER BY spread DESC, label) AS INTEGER) AS position FROM r""")
def comparison(spark, sf_dir):
    second = F.split_part("name", F.lit(" "), F.lit(2))
    rows = offers(spark, sf_dir).withColumn("group_label", F.concat(F.upper(second), F.lit("!")))
    return mt.compare_chains(rows, second, ["south", "north", "west", "nowhere"], "dairy")


_ITEMS = [("bolts", ["bolt", "rod"], ["old"]), ("rings", ["ring"], []), ("reds", ["RED "], ["red bolt"]), ("none", ["zzz"], [])]
_MATCH = """m AS (SELECT 'bolts' AS item, * FROM offers WHERE (contains(h, 'bolt') OR contains(h, 'rod')) AND NOT contains(h, 'old')
  UNION ALL SELECT 'rings', * FROM offers WHERE contains(h, 'ring') UNION ALL SELECT 'reds', * FROM offers WHERE contains(h, 'red ') AND NOT contains(h, 'red bolt'))"""
_MATCHES = "o AS (SELECT *, lower(name || ' ' || brand) AS h FROM offers), " + _MATCH.replace("FROM offers", "FROM o")


def _items(spark):
    return values(spark, _ITEMS, "item string, keywords array<string>, exclude array<string>")


@query("j04_keyword_join", f", {_MATCHES} SELECT item, chain, count(*) AS n, min(price_cents) AS least_cents FROM m GROUP BY ALL")
def keywords(spark, sf_dir):
    out = mt.keyword_matches(offers(spark, sf_dir), _items(spark))
    return out.groupBy("item", "chain").agg(F.count("*").alias("n"), F.min("price_cents").alias("least_cents"))


@query("j05_all_matches", f""", {_MATCHES} SELECT item, ext, row_number() OVER (PARTITION BY item ORDER BY price_cents, ext) AS rank FROM m""")
def all_matches(spark, sf_dir):
    rows = offers(spark, sf_dir).select("ext", "name", "brand", "price_cents")
    return mt.ranked_matches(rows, _items(spark)).select("item", "ext", "rank")


@query("q10_basket_plan", f""", {_MATCHES}, h AS (SELECT max(ext) AS by_hand FROM o WHERE contains(h, 'ring')), picks AS (SELECT item, ext, chain, price_cents, count(*) OVER (PARTITION BY item) AS matches FROM m, h
  QUALIFY row_number() OVER (PARTITION BY item ORDER BY item = 'rings' AND ext = by_hand DESC, price_cents, ext) = 1),
legs AS (SELECT *, CAST(sum(price_cents) OVER (PARTITION BY chain) AS BIGINT) AS subtotal FROM picks), own AS (SELECT *, CAST(dense_rank() OVER (ORDER BY subtotal DESC, chain) AS INTEGER) AS leg FROM legs),
plan AS (SELECT count(*) AS matched, CAST(sum(price_cents) AS BIGINT) AS total FROM picks),
alone AS (SELECT chain AS single_chain, count(*) AS single_items, CAST(sum(least) AS BIGINT) AS single_total FROM (SELECT chain, item, min(price_cents) AS least FROM m GROUP BY ALL)
  GROUP BY chain ORDER BY 2 DESC, 3, 1 LIMIT 1),
legged AS (SELECT own.*, plan.*, alone.*, CASE WHEN single_items = matched THEN single_total - total END AS savings FROM own, plan, alone)
SELECT item, ext, chain, price_cents, coalesce(matches, 0) AS matches, matched, total, subtotal, leg, single_chain, single_items, single_total, savings FROM (SELECT unnest(['bolts', 'rings', 'reds', 'none']) AS item) LEFT JOIN legged USING (item)""")
def basket(spark, sf_dir):
    """One item has a pick by hand that matches, one a pick that doesn't, one no match at all."""
    rows = offers(spark, sf_dir)
    chosen = rows.where(F.contains(F.lower(F.concat_ws(" ", "name", "brand")), F.lit("ring"))).agg(F.max("ext").alias("_e"))
    items = _items(spark).crossJoin(F.broadcast(chosen)).withColumn("pick", F.when(F.col("item") == "rings", F.col("_e")).when(F.col("item") == "reds", "gone")).drop("_e")  # one row
    return op.basket_plan(rows, items)


_HISTORY = [
    ("red bolt", "Brand#2", "dairy", ["red", "bolt"]), ("gone thing", "BRAND 7", "fruits", ["gone", "gear"]), ("lost ring", None, "bakery", ["lost", "ring"]), ("void", "NoBrand", "dairy", ["void"]),
    ("old part", "7 brand", None, ["old", "plate"]), ("no letters", "!!", "fruits", ["no"]), ("empty", "", "fruits", ["hot"]),
]
_HROWS = ", ".join(f"('{k}', {'NULL' if b is None else repr(b)}, {'NULL' if g is None else repr(g)}, {t})" for k, b, g, t in _HISTORY)
_BKEY = "trim(regexp_replace(lower({c}), '[^a-z0-9äöüß]+', ' ', 'g'))"


@query("q13_history_tiers", f""", h AS (SELECT *, list_filter(string_split({_BKEY.format(c='brand')}, ' '), lambda x: x <> '') AS want FROM (VALUES {_HROWS}) v(key, brand, "group", tokens)),
n AS (SELECT ext, price_cents, {_KEY} AS k, {_BKEY.format(c='brand')} AS b, category, string_split({_KEY}, ' ') AS t FROM offers),
m AS (SELECT h.key, CASE WHEN n.k = h.key THEN 1 WHEN coalesce(h.brand, '') <> '' THEN 2 ELSE 3 END AS tier, ext, price_cents, len(list_filter(n.t, lambda x: list_contains(h.tokens, x))) AS shared
  FROM h JOIN n ON n.k = h.key OR (coalesce(h.brand, '') <> '' AND len(want) > 0 AND list_has_all(CASE WHEN n.b <> '' THEN string_split(n.b, ' ') ELSE n.t END, want)) OR (coalesce(h.brand, '') = '' AND n.category = h."group")),
b AS (SELECT * FROM m QUALIFY tier = min(tier) OVER (PARTITION BY key))
SELECT key, tier, ext, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN tier = 1 THEN 0 ELSE shared END DESC, price_cents, ext) AS rank FROM b QUALIFY tier = 1 OR rank <= 8""")
def tiers(spark, sf_dir):
    history = values(spark, _HISTORY, "key string, brand string, group string, tokens array<string>")
    return mt.history_tiers(history, offers(spark, sf_dir))


@query("j09_on_sale_count", f""", h AS (SELECT DISTINCT 'new ' || lower(c_mktsegment) AS k FROM customer UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT 'gone ' || p_name FROM part)
SELECT count(*) AS recorded, count(*) FILTER (WHERE k IN (SELECT {_KEY} FROM offers WHERE valid_to IS NULL OR valid_to >= DATE '{TODAY}')) AS on_sale FROM h""")
def on_sale(spark, sf_dir):
    recorded = table(spark, sf_dir, "customer").select(F.concat(F.lit("new "), F.lower("c_mktsegment")).alias("k"))
    names = table(spark, sf_dir, "part").select("p_name")
    recorded = recorded.union(names).union(names.select(F.concat(F.lit("gone "), "p_name"))).distinct()
    live = offers(spark, sf_dir).where(F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(TODAY).cast("date")))
    keys = live.select(norm_name("name").alias("k")).distinct().withColumn("on", F.lit(True))
    return recorded.join(keys, "k", "left").agg(F.count("*").alias("recorded"), F.count_if("on").alias("on_sale"))


_RECIPES = [
    (0, "bolt soup", ["vegan", "asian"], [("Bolts", ["bolt", "BOLTS"], ["old"], False), ("Gizmo", ["gizmo"], None, False), ("Salt", ["salt"], [], True), ("Hot water", ["hot"], ["hot plate", "hot r"], True)]),
    (1, "ring pie", ["pork"], [("Ring", ["ring"], [], False), ("Flour", ["zzz"], [], False)]),
    (2, "plate stew", ["vegetarian", "asian"], [("Plate", ["plate"], ["cold"], False), ("Hot rod", ["hot rod"], [], False), ("Anvil", ["anvil"], ["new", "red", "brand#1"], False)]),
    (3, "empty pot", ["vegan"], []),
]
_INGREDIENTS = ", ".join(f"({p}, '{r}', {i}, '{label}', {k}, {x or []}, {staple})" for p, r, _, parts in _RECIPES for i, (label, k, x, staple) in enumerate(parts))
#: Every ingredient with its cheapest offer, chosen among the offers of `pool`.
_ROLES = """i AS (SELECT * FROM (VALUES {rows}) v(pos, recipe, n, label, keys, nots, staple)),
o AS (SELECT *, lower(name || ' ' || brand) AS h, CASE WHEN p IS NOT NULL THEN CAST(round(CAST(replace(p, ',', '.') AS DECIMAL(18,4)) * 100) AS BIGINT) END AS ucents FROM (SELECT *, coalesce(nullif(regexp_extract(per_unit, '^1 ?kg = ([0-9]+[.,][0-9]+)', 1), ''), nullif(regexp_extract(per_unit, '^([0-9.]+) €/kg', 1), '')) AS p FROM offers) WHERE {pool}),
b AS (SELECT i.pos, recipe, n, label, staple, arg_min(ext, (price_cents, ext)) AS ext, arg_min(chain, (price_cents, ext)) AS chain, min(price_cents) AS price_cents, arg_min(struct_pack(u := ucents), (price_cents, ext)).u AS ucents FROM i LEFT JOIN o
  ON len([k FOR k IN keys IF contains(h, lower(k))]) > 0 AND len([k FOR k IN nots IF contains(h, lower(k))]) = 0 GROUP BY ALL),
e AS (SELECT b.*, CASE WHEN b.ext IS NOT NULL THEN 'on_sale' WHEN staple OR {home} THEN 'have' ELSE 'buy' END AS role FROM b),
s AS (SELECT c.pos, c.recipe, count(*) FILTER (WHERE role = 'on_sale') AS on_sale, count(*) FILTER (WHERE role = 'buy') AS to_buy, CAST(sum(price_cents) AS BIGINT) AS cost, CAST(sum(ucents) AS BIGINT) AS unit_sum FROM (SELECT unnest([0, 1, 2, 3]) AS pos, unnest(['bolt soup', 'ring pie', 'plate stew', 'empty pot']) AS recipe) c LEFT JOIN e ON e.recipe = c.recipe GROUP BY ALL)"""


def _roles(pool: str, home: str = "false") -> str:
    return _ROLES.format(rows=_INGREDIENTS, pool=pool, home=home)


def _book(spark):
    return values(spark, _RECIPES, rc.RECIPES)


def _priced(spark, sf_dir):
    return offers(spark, sf_dir).withColumn("unit_cents", unit_price_cents("per_unit"))


@query("j12_ingredients", f", {_roles('true', home="label IN ('Flour')")} SELECT recipe, n AS pos, label, staple, role, ext, chain, price_cents, ucents AS unit_cents FROM e")
def ingredients(spark, sf_dir):
    return rc.resolved(_book(spark), _priced(spark, sf_dir), ["zz"])


@query("q15_recipes", f", {_roles("chain IN ('north', 'south')")} SELECT recipe, on_sale, to_buy, cost, unit_sum, row_number() OVER (ORDER BY on_sale DESC, pos) AS rank FROM s WHERE recipe <> 'ring pie' QUALIFY rank <= 2")
def recipe_list(spark, sf_dir):
    """Without pork, at two stores of which one more has no offers, the first two."""
    return rc.ranked(_book(spark), _priced(spark, sf_dir), rc.Wishes(stores=("north", "south", "nowhere"), diet="no-pork", count=2))


@query("o08_recipes_by_unit_price", f", {_roles("true")} SELECT recipe, on_sale, to_buy, cost, unit_sum, row_number() OVER (ORDER BY unit_sum NULLS LAST, pos) AS rank FROM s")
def recipes_by_unit(spark, sf_dir):
    """By the sum of unit prices; the store asked for has no offers, so all stores count."""
    return rc.ranked(_book(spark), _priced(spark, sf_dir), rc.Wishes(stores=("nowhere",), cheapest_kg=True))


@query("j13_pantry", f", {_roles("(chain = 'harbor' OR NOT EXISTS (SELECT 1 FROM offers WHERE chain = 'harbor' AND name NOT LIKE '%anvil')) AND name NOT LIKE '%anvil'", home="label IN ('Anvil', 'Flour')")} SELECT recipe, on_sale, to_buy, cost, unit_sum, row_number() OVER (ORDER BY on_sale DESC, pos) AS rank FROM s WHERE to_buy = 0")
def with_pantry(spark, sf_dir):
    """What is at home, under a longer or a shorter name, needn't be bought, but an offer of it comes first; recipes that leave nothing to buy."""
    rows = _priced(spark, sf_dir).where("name not like '%anvil'")
    return rc.ranked(_book(spark), rows, rc.Wishes(stores=("harbor",), only_on_sale=True), ["ANVILS", "z", "hot"])


@query("f16_diets", """, t AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ['vegan'] WHEN 1 THEN ['vegetarian', 'quick'] WHEN 2 THEN ['pork', p_brand] WHEN 3 THEN ['gluten-free', 'vegan'] ELSE [] END AS tags FROM part)
SELECT p_partkey, list_contains(tags, 'vegetarian') OR list_contains(tags, 'vegan') AS vegetarian, NOT list_contains(tags, 'pork') AS no_pork, list_contains(tags, 'gluten-free') AS gluten_free, list_contains(tags, 'vegan') AS vegan FROM t""")
def diets(spark, sf_dir):
    size = F.col("p_size") % 5
    tags = F.when(size == 0, F.array(F.lit("vegan"))).when(size == 1, F.array(F.lit("vegetarian"), F.lit("quick"))).when(size == 2, F.array(F.lit("pork"), F.col("p_brand"))).when(size == 3, F.array(F.lit("gluten-free"), F.lit("vegan"))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = table(spark, sf_dir, "part").select("p_partkey", tags.alias("tags"))
    return rows.select("p_partkey", *[rc.suits(F.col("tags"), d).alias(d.replace("-", "_")) for d in ("vegetarian", "no-pork", "gluten-free", "vegan")])
