"""Scalars, feeds, places, upserts, throttles and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import pricing as pr
from offerloom.functions import text as tx
from offerloom.functions.validity import instant, local_day, offer_window
from offerloom.operators import gates as gt
from offerloom.operators import places as pl
from offerloom.operators import upsert as up
from offerloom.plans.registry import query, values
from offerloom.sources import feeds as fd
from offerloom.sources.tables import offers, stores, table
from offerloom.streaming import throttle as th


def _he(top: str, bottom: str) -> str:
    return f"(({top}) // ({bottom}) + CASE WHEN 2 * (({top}) % ({bottom})) > ({bottom}) OR (2 * (({top}) % ({bottom})) = ({bottom}) AND (({top}) // ({bottom})) % 2 = 1) THEN 1 ELSE 0 END)"


def _eu(cents: str) -> str:
    return f"(({cents}) // 100 || '.' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0'))"


_PART = "(SELECT p_partkey, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part)"


def _parts(spark, sf_dir):
    """Parts with the texts of the offer view, priced at retail."""
    size = F.col("p_size")
    text = size.cast("string")
    stated = F.when(size % 7 == 0, F.concat(F.lit("1 kg = "), text, F.lit(".95"))).when(size % 7 == 1, "kg-Preis").when(size % 7 == 2, "100-g-Preis").when(size % 7 == 3, F.concat(F.lit("(1 kg = "), text, F.lit(".05)"))).when(size % 7 == 4, F.concat(text, F.lit(".79 €/kg"))).when(size % 7 == 5, F.concat(F.lit("1kg = "), text, F.lit(",90")))
    unit = F.when(size % 5 == 0, F.concat(text, F.lit("0 g"))).when(size % 5 == 1, F.concat(text, F.lit("x400 ml"))).when(size % 5 == 2, F.concat(F.lit("Ca. "), text, F.lit(" kg"))).when(size % 5 == 3, F.concat(F.lit("Je "), text, F.lit(",5 l")))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"), stated.alias("stated"), unit.alias("unit"))


@query("x01_discount", " SELECT ext, price_cents, regular_cents, discount_pct FROM offers")
def discounts(spark, sf_dir):
    return offers(spark, sf_dir).select("ext", "price_cents", "regular_cents", "discount_pct")


@query("x02_unit_price", f"SELECT p_partkey, CAST(CASE p_size % 7 WHEN 0 THEN p_size * 100 + 95 WHEN 4 THEN p_size * 100 + 79 WHEN 5 THEN p_size * 100 + 90 END AS BIGINT) AS unit_cents FROM {_PART}", views=False)
def unit_prices(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", pr.unit_price_cents("stated").alias("unit_cents"))


@query("x03_normalise", f"""SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN '1 kg = ' || p_size || '.95' WHEN 1 THEN '1 kg = ' || {_eu('c')} WHEN 2 THEN '1 kg = ' || {_eu('c * 10')}
  WHEN 3 THEN '1 kg = ' || p_size || '.05' WHEN 4 THEN p_size || '.79 €/kg' WHEN 5 THEN '1 kg = ' || p_size || ',90' END AS per_unit FROM {_PART}""", views=False)
def normal(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", pr.normal_per_unit("stated", "cents").alias("per_unit"))


@query("x04_derive", f"""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '1 kg = ' || {_eu(_he('c * 100', 'p_size'))} WHEN 3 THEN '1 l = ' || {_eu(_he('c * 10', '10 * p_size + 5'))} END AS per_unit FROM {_PART}""", views=False)
def derived(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", pr.derived_per_unit("unit", "cents").alias("per_unit"))


@query("x09_offer_window", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 9 - 2 AS INTEGER) AS s, CAST(o_orderkey % 4 + 1 AS INTEGER) AS n FROM orders)
SELECT o_orderkey, CAST(CASE WHEN s > 6 THEN d WHEN s < 0 THEN d ELSE d + s END AS VARCHAR) AS valid_from,
  CAST(CASE WHEN s > 6 THEN d + 6 WHEN s + n > 6 THEN d + 6 WHEN s + n < 0 THEN d + 6 ELSE d + s + n END AS VARCHAR) AS valid_to FROM o""", views=False)
def windows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumns({"d": F.to_date("o_orderdate"), "s": (F.col("o_orderkey") % 9 - 2).cast("int"), "n": (F.col("o_orderkey") % 4 + 1).cast("int")})
    at = lambda day: (day.cast("timestamp") + F.expr("interval 10 hours"))
    one = F.struct(at(F.date_add("d", F.col("s"))).alias("start"), at(F.date_add("d", F.col("s") + F.col("n"))).alias("end"))
    w = offer_window(F.array(one), F.col("d"), F.date_add("d", 6))
    return rows.select("o_orderkey", w["valid_from"].cast("string").alias("valid_from"), w["valid_to"].cast("string").alias("valid_to"))


@query("x16_money", "SELECT s_suppkey, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS cents FROM supplier", views=False)
def money(spark, sf_dir):
    text = F.concat(F.translate(F.format_number(F.abs("s_acctbal"), 2), ",.", ".,"), F.lit(" €"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", pr.money_cents(text).alias("cents"))


@query("x18_normname", f"SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9äöüß]+', ' ', 'g')) AS key FROM documents", views=False)
def norm_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.norm_name("text").alias("key"))


@query("x17_namekey", f"SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(text), '’‘`´''', ''), '[^\\pL\\pN_]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM documents", views=False)
def name_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.name_key("text").alias("key"))


@query("x20_fold", f"SELECT doc_id, replace(translate(lower(text), 'äöüéèê', 'aoueee'), 'ß', 'ss') AS folded FROM documents", views=False)
def folded(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.fold("text").alias("folded"))


@query("x21_slug", f"SELECT doc_id, regexp_replace(regexp_replace(replace(translate(lower(text), 'äöü', 'aou'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents", views=False)
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.slug("text").alias("slug"))


@query("x24_app_price", """, a AS (SELECT ext, price_cents AS p, regular_cents AS r, discount_pct AS d, CASE WHEN store_id % 3 = 0 THEN price_cents - 50 WHEN store_id % 3 = 1 THEN price_cents + 50 END AS app FROM offers),
b AS (SELECT *, coalesce(app < p, false) AS has FROM a), c AS (SELECT *, CASE WHEN has THEN app ELSE p END AS head, CASE WHEN has THEN coalesce(r, p) ELSE r END AS strike FROM b)
SELECT ext, has AS has_deal, head AS headline_cents, strike AS strike_cents, CASE WHEN NOT has THEN d WHEN strike > head THEN floor((strike - head) * 100 / strike + 0.5) END AS headline_pct FROM c""")
def app_prices(spark, sf_dir):
    app = F.when(F.col("store_id") % 3 == 0, F.col("price_cents") - 50).when(F.col("store_id") % 3 == 1, F.col("price_cents") + 50)
    return offers(spark, sf_dir).select("ext", pr.app_deal(F.col("price_cents"), F.col("regular_cents"), app, F.col("discount_pct")).alias("a")).select("ext", "a.*")


@query("x31_json_paths", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN [event_type] WHEN 1 THEN [] WHEN 5 THEN ['a "b"', 'ü', event_type] END AS strings, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""", views=False)
def json_paths(spark, sf_dir):
    """Arrays with and without texts; objects, numbers, broken JSON and nothing at all have none."""
    kind = F.col("event_type")
    text = F.element_at(F.array(
        F.concat(F.lit('[1, "'), kind, F.lit('", null, {"a": 2}, ["x"]]')), F.lit("[]"), F.concat(F.lit('{"a": "'), kind, F.lit('"}')), F.concat(F.lit('["'), kind), F.lit("7"), F.concat(F.lit('["a \\"b\\"", true, "\\u00fc", "'), kind, F.lit('"]')), F.lit(None).cast("string"),
    ), (F.col("event_id") % 7 + 1).cast("int"))
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").select("event_id", tx.json_strings(text).alias("strings"), k.alias("k"))


@query("x08_local_days", """SELECT event_id, CAST(CAST(ts + INTERVAL 1 HOUR AS DATE) AS VARCHAR) AS day, CASE event_id % 5 WHEN 4 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS instant FROM events""", views=False)
def local_days(spark, sf_dir):
    """The date in Berlin of every event, in winter an hour ahead, and the moments of ISO texts with offsets of several forms, or with none; one form isn't a time."""
    at, e = F.col("ts").cast("timestamp"), F.col("event_id") % 5
    text = lambda hours, tail: F.concat(F.date_format(at + F.expr(f"interval {hours} hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(tail))
    iso = F.when(e == 0, text(0, "Z")).when(e == 1, text(0, "+0000")).when(e == 2, text(2, "+02:00")).when(e == 3, text(0, "")).otherwise(F.concat(F.lit("am "), text(0, "")))
    return table(spark, sf_dir, "events").select("event_id", local_day(at).cast("string").alias("day"), F.unix_micros(instant(iso)).alias("instant"))


_DIST = "2 * 6371000 * asin(sqrt(pow(sin((radians(lat) - radians(52.3)) / 2), 2) + cos(radians(52.3)) * cos(radians(lat)) * pow(sin((radians(lng) - radians(13.4)) / 2), 2)))"


@query("q06_nearest", f", d AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY {_DIST}, store_id) AS rn FROM stores) SELECT chain, store_id, CAST(round({_DIST}) AS BIGINT) AS metres FROM d WHERE rn = 1")
def nearest(spark, sf_dir):
    return pl.nearest_per_chain(stores(spark, sf_dir), 52.3, 13.4).select("chain", "store_id", F.round("metres").cast("long").alias("metres"))


@query("w09_branches", f""", d AS (SELECT *, row_number() OVER (PARTITION BY chain, round(lat, 4), round(lng, 4) ORDER BY {_DIST}, store_id) AS rn FROM stores)
SELECT store_id, chain, CAST(round({_DIST}) AS BIGINT) AS metres FROM d WHERE rn = 1 AND chain = 'north' ORDER BY {_DIST}, store_id LIMIT 12""")
def branch_list(spark, sf_dir):
    return pl.branches(stores(spark, sf_dir), 52.3, 13.4, "north").select("store_id", "chain", F.round("metres").cast("long").alias("metres"))


def _deal(kind: str, euros, more: str = "") -> F.Column:
    return F.concat(F.lit('{"type":"%s","max":' % kind), euros.cast("string"), F.lit(more + "}"))


_KILO = ',"conditions":[{"other":"Festpreis"},{"other":" kg-Preis* "}]'


def flyer_pages(spark, sf_dir):
    """Parts as flyer pages, one part a page; their size says which prices are given and which parts are malformed."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    sale, bonus = _deal("SALES_PRICE", price, _KILO), '{"type":"OTHER","description":"mit Karte\\njetzt 1,00 € Bonus sichern","conditions":[7]}'
    deals = (
        F.when(size % 6 == 0, _deal("OTHER", price, _KILO)).when(size % 6 == 1, F.concat_ws(",", _deal("SALES_PRICE", price, ',"conditions":[{"other":"Reise zum kg-Preis"}]'), _deal("REGULAR_PRICE", price + 1, _KILO)))
        .when(size % 6 == 2, F.concat_ws(",", sale, _deal("RECOMMENDED_RETAIL_PRICE", price - 1), F.lit(bonus))).when(size % 6 == 3, F.concat_ws(",", sale, F.lit('{"type":"OTHER","conditions":[{"other":"x 0.50 €  bonus!"}]}'), _deal("SPECIAL_PRICE", price - 2, ',"conditions":[{"other":"ab 2 Stück"}]'), _deal("SPECIAL_PRICE", price - 1, ',"conditions":[3,{"other":"Preis mit APP"}]')))
        .otherwise(_deal("SALES_PRICE", price, ',"priceByBaseUnit":" 1 l = 3.33 "' + _KILO))
    )
    badge = F.when(size % 6 == 3, '{"type":"DISCOUNT_AMOUNT","value":"0,50"}').when(size % 6 == 4, '{"type":"DISCOUNT_PERCENTAGE","value":"20"}').otherwise("null")
    content = F.concat(F.lit('{"id":"'), F.col("p_partkey").cast("string"), F.lit('","discountLabel":'), badge, F.lit(',"products":[{"name":"'), F.col("p_name"), F.lit('","brandName":"'), F.col("p_brand"), F.lit('","description":[{"paragraph":"500 g"}],"categoryPaths":[{"id":"1","name":"food"}]}],"deals":['), deals, F.lit("]}"))
    page = F.concat(F.lit('{"contents":[7,{"number":1,"offers":["x",{"content":'), content, F.lit("}]}]}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.when(size % 6 == 5, F.lit('{"contents":"none"}')).otherwise(page).alias("json"))


@query("s02_flyer_offers", """WITH p AS (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part WHERE p_size % 6 NOT IN (0, 5))
SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand || ' ' || p_name AS name, c AS price_cents, '500 g' AS unit,
  CASE p_size % 6 WHEN 1 THEN c + 100 WHEN 3 THEN c + 50 WHEN 4 THEN CAST(round(c / 0.8) AS BIGINT) END AS regular_cents,
  CASE p_size % 6 WHEN 4 THEN '1 l = 3.33' WHEN 1 THEN NULL ELSE '1 kg = ' || c // 100 || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END AS base_unit,
  CASE p_size % 6 WHEN 2 THEN '1,00 € Bonus' WHEN 3 THEN '0.50 €  bonus' END AS note, CASE p_size % 6 WHEN 3 THEN c - 100 END AS app_cents FROM p""", views=False)
def flyer(spark, sf_dir):
    return fd.flyer_offers(flyer_pages(spark, sf_dir)).select("id", "name", "price_cents", "unit", "regular_cents", "base_unit", "note", "app_cents")


_COUPONS = """c AS (SELECT p_partkey, p_partkey AS key, p_size % 12 AS m, p_name, p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part),
co AS (SELECT CASE WHEN m = 5 AND m % 4 <> 0 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS id, CASE WHEN m % 4 = 0 THEN 'Coupon' ELSE p_name END AS name, CASE WHEN m % 2 = 0 THEN p_brand END AS brand, cents AS price_cents,
  CASE WHEN m % 3 = 1 THEN cents + 150 END AS regular_cents, CASE WHEN m < 6 THEN 'a bag' WHEN m < 9 THEN '1 kg = 1.93' END AS unit, CASE WHEN m < 9 THEN '1 kg = 1.93' END AS per_unit, CASE WHEN m > 3 THEN 'http://i/' || p_partkey END AS image_url, key FROM c WHERE m % 3 <> 0)"""


@query("s05_coupon_offers", f"WITH {_COUPONS} SELECT * EXCLUDE (key), '1998-06-01' AS valid_from, CAST(NULL AS VARCHAR) AS valid_to FROM co", views=False)
def coupons(spark, sf_dir):
    return fd.coupon_offers(coupon_pages(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_to")})


def coupon_pages(spark, sf_dir):
    """Parts as coupons: without a price but with the one before, without a title, an id, a brand, packaging or an image."""
    m, price = F.col("p_size") % 12, F.col("p_retailprice")
    small = F.concat(F.lit('"smallPartNumeric":'), (F.round(price + 1.5, 2)).cast("string"))
    box = F.when(m % 3 == 0, F.concat(F.lit("{"), small, F.lit("}"))).when(m % 3 == 1, F.concat(F.lit('{"largePartNumeric":'), price.cast("string"), F.lit(","), small, F.lit("}"))).otherwise(F.concat(F.lit('{"largePartNumeric":'), price.cast("string"), F.lit(',"smallPartNumeric":null}')))
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), F.coalesce(F.concat(F.lit('"'), value, F.lit('"')), F.lit("null")))
    parts = [
        field("id", F.when(m != 5, F.col("p_partkey").cast("string"))), field("title", F.when(m % 4 == 0, " ").otherwise(F.col("p_name"))), field("brand", F.when(m % 2 == 0, F.col("p_brand"))), field("packaging", F.when(m < 6, " a bag\\r\\nof it").when(m < 8, "  \\nlater")),
        field("pricePerUnit", F.when(m < 9, " 1 kg = 1.93 ")), field("imageUrl", F.when(m > 3, F.concat(F.lit("http://i/"), F.col("p_partkey").cast("string")))), F.lit('"startValidityDate":"1998-06-01T00:00:00Z","endValidityDate":"soon"'), F.concat(F.lit('"priceBox":'), box),
    ]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit('{"offers":[{'), F.concat_ws(",", *parts), F.lit('},3,{"title":"no box"}]}')).alias("json"))


_CLEARANCE = """s AS (SELECT *, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS c FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 11 <> 0),
cl AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 't' ELSE '' END || s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'Ausverkauf' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 <> 1 THEN 'B' END AS brand, c AS price_cents, CASE WHEN s_suppkey % 2 = 0 THEN c + 100 END AS regular_cents,
  CASE WHEN s_suppkey % 3 = 0 THEN '1 l = 20.00' END AS base_unit, CASE WHEN s_suppkey % 4 > 0 THEN 'i' || s_suppkey END AS image_url, CASE WHEN s_suppkey % 4 = 1 THEN ['Pflege', 'Haar'] ELSE [] END AS category_path, s_suppkey AS key FROM s)"""


@query("s06_clearance_offers", f"WITH {_CLEARANCE} SELECT * EXCLUDE (key) FROM cl", views=False)
def clearance(spark, sf_dir):
    return fd.clearance_offers(clearance_pages(spark, sf_dir))


def clearance_pages(spark, sf_dir):
    """Suppliers as articles: some sold online only, without an article number, a title or a brand; one of two has its number in the tile."""
    money = lambda x: F.concat(F.translate(F.format_number(x, 2), ",.", ".,"), F.lit(" €"))
    now, key = F.abs("s_acctbal"), F.col("s_suppkey")
    name = key.cast("string")
    price = F.concat(F.lit('{"price":{"current":{"value":"'), money(now), F.lit('"},"previous":{"value":"'), F.when(key % 2 == 0, money(now + 1)).otherwise(money(now)), F.lit('"}},"tileInfos":['), F.when(key % 3 == 0, '"75 ml (0,02 € je 1 ml)"').otherwise("null"), F.lit("]}"))
    mark = F.when(key % 5 == 0, '[null,{"alt":"Nur Online Grafik"}]').otherwise('[{"alt":"Nur Online"}]')
    number = F.when(key % 11 == 0, F.lit("")).when(key % 2 == 1, F.concat(F.lit('"dan":'), name, F.lit(",")))
    tile = F.concat(F.lit('"tileData":{'), F.when((key % 11 != 0) & (key % 2 == 0), F.concat(F.lit('"dan":"t'), name, F.lit('",'))).otherwise(""), F.lit('"eyecatchers":'), mark, F.when(key % 4 > 0, F.concat(F.lit(',"images":[{"tileSrc":"i'), name, F.lit('"}]'))).otherwise(""),
        F.when(key % 4 == 1, ',"trackingData":{"categories":["Pflege",3," ","Haar"]}').otherwise(""), F.lit(',"netPrice":{"price":{"current":{"value":"1,00 €"}}},"price":'), price, F.lit("}"))
    page = F.concat(F.lit('{"products":[{'), F.coalesce(number, F.lit("")), F.lit('"gtin":99,"brandName":'), F.when(key % 3 == 1, F.lit('" "')).otherwise(F.lit('"B"')), F.lit(',"title":'), F.when(key % 7 == 0, F.lit('" "')).otherwise(F.concat(F.lit('"'), F.col("s_name"), F.lit('"'))), F.lit(","), tile, F.lit('},{"dan":1},{"dan":2,"tileData":7}]}'))
    return table(spark, sf_dir, "supplier").select(key.alias("key"), page.alias("json"))


@query("s03_discover", "SELECT p_partkey AS page_id, 'b' || p_partkey AS id, p_size AS pages, '1998-07-01' AS valid_until FROM part WHERE p_size % 2 = 1", views=False)
def discovered(spark, sf_dir):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    node = F.concat(F.lit('{"id":"b'), key, F.lit('","pageCount":'), size, F.lit(',"validUntil":"1998-07-01","publisher":"P"}'))
    blob = F.concat(F.lit('<html><script>window.data = {"a":[{"x":'), node, F.lit('},'), node, F.lit(',{"id":"q","pageCount":3}]};</script>'))
    html = F.when(F.col("p_size") % 2 == 1, blob).otherwise("<html><script>{broken}</script>")
    return fd.brochures(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")), "P")


@query("s04_brochure_selection", """WITH b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INTEGER) AS t FROM orders)
SELECT o_orderkey FROM b WHERE t - f <= 14 AND t >= DATE '1998-06-15' AND f <= DATE '1998-06-16'""", views=False)
def selected(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("valid_from"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 20).cast("int")).alias("valid_to"))
    return fd.current_brochures(rows, F.lit("1998-06-15").cast("date")).select("o_orderkey")


@query("k01_upsert", """WITH o AS (SELECT o_custkey AS k, o_orderkey AS v, 1 AS age, o_totalprice AS p FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_custkey, o_orderkey, 0, o_totalprice FROM orders WHERE o_orderkey % 5 = 1 OR o_orderkey % 2 = 1),
u AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY age, v DESC) AS rn FROM (SELECT * FROM o UNION ALL SELECT * FROM n)) SELECT k, v, p FROM u WHERE rn = 1""", views=False)
def upserted(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("p"))
    return up.upsert(rows.where("v % 2 = 0"), rows.where("v % 5 = 1 or v % 2 = 1"), ["k"], [F.desc("v")])


@query("k02_get_or_create", """SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, coalesce(n.bal, o.s_acctbal) AS balance
FROM (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) o FULL JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 END AS bal FROM supplier WHERE s_suppkey % 4 <> 1 OR s_suppkey % 3 = 0) n ON o.s_suppkey = n.s_suppkey""", views=False)
def created(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"))
    new = rows.where("s_suppkey % 4 <> 1 or s_suppkey % 3 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("balance") + 1).alias("balance"))
    return up.get_or_create(rows.where("s_suppkey % 3 <> 0"), new, ["s_suppkey"], ["balance"])


_REFILL = "(1.0::DOUBLE / 21600.0::DOUBLE)"


@query("t01_token_bucket", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, t, 2.0::DOUBLE AS tokens, true AS allowed FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, t, x - CASE WHEN x >= 1 THEN 1 ELSE 0 END, x >= 1 FROM (
    SELECT e.user_id, e.event_id, e.n, e.t, least(3.0::DOUBLE, r.tokens + greatest(0.0::DOUBLE, e.t - r.t) * {_REFILL}) AS x FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, allowed FROM r""", views=False)
def bucket(spark, sf_dir):
    return th.token_bucket(table(spark, sf_dir, "events"), "user_id", 3, 1 / 21600)


@query("t02_cooldown", """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, ts AS last, true AS allowed FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.n, CASE WHEN e.ts >= r.last + INTERVAL 12 HOURS THEN e.ts ELSE r.last END, e.ts >= r.last + INTERVAL 12 HOURS FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, allowed FROM r""", views=False)
def cooled(spark, sf_dir):
    return th.cooldown(table(spark, sf_dir, "events"), "user_id", 12 * 3600)


_GATED = f"""WITH RECURSIVE c AS (SELECT event_id, CASE event_type WHEN 'signup' THEN '' WHEN 'view' THEN NULL ELSE event_type END AS key, epoch_us(ts) AS t, event_id % 7 > 0 AND event_type NOT IN ('signup', 'view') AS has, epoch_us(ts) // {{width}} AS slot FROM events),
s AS (SELECT slot, slot - row_number() OVER (ORDER BY slot) AS run FROM (SELECT DISTINCT slot FROM c)), e AS (SELECT c.*, run, row_number() OVER (PARTITION BY run ORDER BY t, event_id) AS n FROM c JOIN s USING (slot)),
r AS (SELECT run, n, event_id, key, true AS allowed, t AS last, MAP {{{{coalesce(key, '?'): t}}}} AS own FROM e WHERE n = 1
  UNION ALL SELECT run, n, event_id, key, ok, CASE WHEN ok THEN t ELSE last END, CASE WHEN ok THEN map_concat(own, MAP {{{{coalesce(key, '?'): t}}}}) ELSE own END FROM (
    SELECT e.run, e.n, e.event_id, e.key, e.t, r.last, r.own, NOT e.has OR NOT (coalesce(e.t - r.own[e.key] < {{cooldown}}, false) OR e.t - r.last < {{gap}}) AS ok FROM r JOIN e ON e.run = r.run AND e.n = r.n + 1))
SELECT event_id, key, allowed FROM r"""


def _gated_calls(spark, sf_dir):
    """Events as calls: of some the key is empty or null, of some it has no rows yet."""
    key = F.when(F.col("event_type") == "signup", "").when(F.col("event_type") != "view", F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", "ts", key.alias("key"), (F.col("event_id") % 7 > 0).alias("has_rows"))


@query("t02_scrape_throttle", _GATED.format(width=600_000_000, cooldown=600_000_000, gap=60_000_000), views=False)
def scrapes(spark, sf_dir):
    """A cooldown of ten minutes for each key, and a minute between any two calls."""
    return th.scrape_throttle(_gated_calls(spark, sf_dir), "key", 600, 60)


_HOSTS = ("api.lists.example", "flyer.example", "maps.example", "FLYER.example.net")
_CALLS = f"""c AS (SELECT ({list(_HOSTS)!r})[user_id % {len(_HOSTS)} + 1] AS host, CASE event_type WHEN 'error' THEN 429 WHEN 'click' THEN 403 WHEN 'view' THEN 404 ELSE 200 END AS status, CASE WHEN event_id % 3 > 0 THEN 'chain ' || event_id % 5 END AS chain, event_type = 'error' AND event_id % 2 = 0 AS failed FROM events),
d AS (SELECT CASE WHEN chain = 'chain 4' THEN NULL ELSE host END AS host, status, chain, failed FROM c)"""


def calls(df):
    """Events as outbound calls; some are failures without a call."""
    chain = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("chain "), (F.col("event_id") % 5).cast("string")))
    host = F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("user_id") % len(_HOSTS) + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "click", 403).when(F.col("event_type") == "view", 404).otherwise(200)
    rows = df.select("event_id", "ts", host.alias("host"), status.alias("status"), chain.alias("chain"), ((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)).alias("failed"))
    return rows.withColumn("host", F.when(F.coalesce(F.col("chain") == "chain 4", F.lit(False)), None).otherwise(F.col("host")))


def call_source():
    """The source that a host belongs to, by a part of its name; else the host."""
    low = F.lower("host")
    return F.when(F.contains(low, F.lit("flyer")), "flyers").when(F.contains(low, F.lit("maps")), "places").otherwise(F.col("host"))


@query("a11_call_counters", f"""WITH {_CALLS}, x AS (SELECT *, status IN (403, 429) AND host IS NOT NULL AS thr, CASE WHEN contains(lower(host), 'flyer') THEN 'flyers' WHEN contains(lower(host), 'maps') THEN 'places' ELSE host END AS src FROM d)
SELECT 'calls' AS kind, NULL AS name, count(*) AS n FROM x WHERE host IS NOT NULL UNION ALL SELECT 'host', host, count(*) FROM x WHERE host IS NOT NULL GROUP BY host UNION ALL SELECT 'source', src, count(*) FROM x WHERE host IS NOT NULL GROUP BY src
UNION ALL SELECT 'throttles', NULL, count(*) FROM x WHERE thr UNION ALL SELECT 'throttled_host', host, count(*) FROM x WHERE thr GROUP BY host UNION ALL SELECT 'failures', NULL, count(*) FROM x WHERE failed UNION ALL SELECT 'failed_chain', chain, count(*) FROM x WHERE failed GROUP BY chain""", views=False)
def call_counts(spark, sf_dir):
    return th.call_counters(calls(table(spark, sf_dir, "events")), call_source())


@query("t04_counters", "SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY event_type", views=False)
def counted(spark, sf_dir):
    return th.counters(table(spark, sf_dir, "events"), "event_type").drop("last_ts")


@query("w12_recent_n", "SELECT event_id, user_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rank FROM events ORDER BY ts DESC, event_id DESC LIMIT 20", views=False)
def recent_calls(spark, sf_dir):
    return th.recent(table(spark, sf_dir, "events")).select("event_id", "user_id", "rank")


@query("g01_total_floor", " SELECT count(*) AS n, count(*) >= 1000 AS enough, count(*) = 2000 AS truncated FROM offers")
def totals(spark, sf_dir):
    return gt.total_floor(offers(spark, sf_dir), 1000)


@query("g02_chain_floor", " SELECT chain, count(*) AS n, count(*) >= 900 AS passes FROM offers GROUP BY chain")
def floors(spark, sf_dir):
    return gt.chain_floors(offers(spark, sf_dir), 900, True)


@query("g04_coverage", " SELECT category, round(avg(CASE WHEN per_unit IS NOT NULL THEN 1 ELSE 0 END) * 100, 4) AS pct, round(avg(CASE WHEN per_unit IS NOT NULL THEN 1 ELSE 0 END) * 100, 4) >= 86 AS passes FROM offers GROUP BY category")
def covered(spark, sf_dir):
    return gt.coverage(offers(spark, sf_dir), F.col("per_unit"), 86, "category")


@query("g05_self_disagreement", ", n AS (SELECT lower(name) AS k, count(DISTINCT category) AS c FROM offers GROUP BY 1 HAVING count(*) >= 2) SELECT count(*) AS names, count(*) FILTER (WHERE c > 1) AS disagreeing FROM n")
def disagreement(spark, sf_dir):
    return gt.self_disagreement(offers(spark, sf_dir), F.lower("name"))


@query("g08_payload_audit", "SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 7 = 0) AS defective FROM events", views=False)
def audited(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "long") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    return gt.payload_audit(rows, F.col("props"), "$.k", "k")
