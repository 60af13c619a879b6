"""Listings, counts, filters, duplicates and shelves."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions.pricing import served_per_unit, unit_price_cents
from offerloom.functions.text import name_key
from offerloom.functions.validity import day_limited, valid_days, valid_on
from offerloom.operators import filters as fl
from offerloom.operators import ranking as rk
from offerloom.plans.registry import query, values
from offerloom.sources.tables import TODAY, offers, table

_GROCERY = "chain IN ('north','south','east','west','harbor') AND category NOT IN ('drinks')"
_VALID = f"(valid_to IS NULL OR valid_to >= DATE '{TODAY}')"
_KEY = "trim(regexp_replace(lower(name), '[^a-z0-9_]+', ' ', 'g'))"
_SERVE = "per_unit IS NOT NULL DESC, coalesce(discount_pct, -1) DESC, source = 'flyer' DESC, image_url IS NOT NULL DESC, ext"


def _eu(cents: str) -> str:
    return f"(({cents}) // 100 || '.' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0'))"


def _dedup(src: str, keys: str = "store_id, k, price_cents") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {_SERVE}) AS rn FROM (SELECT *, {_KEY} AS k FROM {src})) WHERE rn = 1)"


def _shown(df):
    """The served columns that are computed on the way out."""
    return df.withColumns({"days": valid_days(F.col("valid_from"), F.col("valid_to")), "limited": day_limited(F.col("valid_from"), F.col("valid_to")), "shown_per_unit": served_per_unit("per_unit", "unit", "price_cents")}).withColumn("unit_cents", unit_price_cents("shown_per_unit"))


_COLUMNS = ["ext", "store_id", "chain", "name", "category", "price_cents", "discount_pct", "rank"]


def _list_sql(where: str, order: str, limit: int) -> str:
    return f""", base AS (SELECT * FROM offers WHERE {_GROCERY} AND {_VALID} AND {where}), d AS {_dedup('base')}
SELECT ext, store_id, chain, name, category, price_cents, discount_pct, row_number() OVER (ORDER BY {order}) AS rank
FROM d ORDER BY {order} LIMIT {limit}"""


@query("q01_offers_list", _list_sql("plz = '10130'", "coalesce(discount_pct, -1) DESC, ext", 200))
def offers_list(spark, sf_dir):
    base = fl.served(offers(spark, sf_dir), TODAY, plz="10130")
    return rk.listing(rk.serve_dedup(base, name_key("name")), rk.by_discount(), 200).select(*_COLUMNS)


@query("q01_price_sort", _list_sql("source = 'flyer'", "price_cents, ext", 100))
def price_sort(spark, sf_dir):
    base = fl.served(offers(spark, sf_dir), TODAY, source="flyer")
    return rk.listing(rk.serve_dedup(base, name_key("name")), rk.by_price(), 100).select(*_COLUMNS)


@query("q01_min_discount", _list_sql("discount_pct >= 8.0 AND category = 'dairy'", "coalesce(discount_pct, -1) DESC, ext", 2000))
def least_discount(spark, sf_dir):
    base = fl.served(offers(spark, sf_dir), TODAY, min_discount=8.0, category="dairy")
    return rk.listing(rk.serve_dedup(base, name_key("name")), rk.by_discount()).select(*_COLUMNS)


@query("q02_category_counts", f""", base AS (SELECT * FROM offers WHERE {_GROCERY} AND {_VALID}), d AS {_dedup('base')},
c AS (SELECT category, count(*) AS n FROM d GROUP BY category)
SELECT category, n, list_position(['bakery','dairy','fruits','pantry','drinks','household'], category) AS position FROM c""")
def category_counts(spark, sf_dir):
    base = rk.serve_dedup(fl.served(offers(spark, sf_dir), TODAY), name_key("name"))
    order = F.array(*map(F.lit, ("bakery", "dairy", "fruits", "pantry", "drinks", "household")))
    return base.groupBy("category").agg(F.count("*").alias("n")).withColumn("position", F.array_position(order, F.col("category")).cast("int"))


@query("f04_vertical_partition", """ SELECT count(*) FILTER (WHERE g) AS grocery, count(*) FILTER (WHERE d) AS drinks, count(*) FILTER (WHERE g AND d) AS both,
  count(*) FILTER (WHERE NOT g AND NOT d AND chain <> 'garden') AS neither
FROM (SELECT chain, chain <> 'garden' AND category <> 'drinks' AS g, chain <> 'garden' AND category = 'drinks' AS d FROM offers)""")
def vertical_partition(spark, sf_dir):
    g, d = fl.in_vertical("grocery"), fl.in_vertical("drinks")
    rest = F.col("chain") != "garden"
    return offers(spark, sf_dir).agg(F.count_if(g).alias("grocery"), F.count_if(d).alias("drinks"), F.count_if(g & d).alias("both"), F.count_if(~g & ~d & rest).alias("neither"))


@query("f03_validity_windows", f""" SELECT category, count(*) AS n, count(*) FILTER (WHERE valid_to IS NULL) AS endless,
  count(*) FILTER (WHERE valid_to >= valid_from AND valid_to - valid_from + 1 < 6) AS limited FROM offers WHERE {_VALID} GROUP BY category""")
def validity_windows(spark, sf_dir):
    live = offers(spark, sf_dir).where(valid_on(F.col("valid_to"), TODAY))
    return live.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("valid_to").isNull()).alias("endless"), F.count_if(day_limited(F.col("valid_from"), F.col("valid_to"))).alias("limited"))


_WEEKDAYS = "(['Mo','Di','Mi','Do','Fr','Sa','So'])"
_SHOWN_SQL = f"""s AS (SELECT *, valid_to >= valid_from AND valid_to - valid_from + 1 < 6 AS lim, {_eu('price_cents')} AS euro, {_eu('price_cents * 10')} AS ten, CAST(split_part(unit, ' ', 1) AS VARCHAR) AS first FROM offers WHERE {_VALID}),
n AS (SELECT *, CASE WHEN per_unit = 'kg-Preis' THEN '1 kg = ' || euro WHEN per_unit = '100-g-Preis' THEN '1 kg = ' || ten WHEN per_unit LIKE '(%' THEN substr(per_unit, 2, length(per_unit) - 2) WHEN per_unit LIKE '1kg%' THEN '1 kg' || substr(per_unit, 4) ELSE per_unit END AS stated,
  CASE WHEN unit LIKE '%0 g' THEN CAST(first AS BIGINT) WHEN unit LIKE 'Je %' THEN CAST(split_part(split_part(unit, ' ', 2), ',', 1) AS BIGINT) * 1000 + 500 END AS amount FROM s),
a AS (SELECT *, price_cents * 1000 // amount + CASE WHEN 2 * (price_cents * 1000 % amount) > amount OR (2 * (price_cents * 1000 % amount) = amount AND (price_cents * 1000 // amount) % 2 = 1) THEN 1 ELSE 0 END AS per FROM n),
q AS (SELECT *, coalesce(stated, CASE WHEN per > 0 THEN CASE WHEN unit LIKE 'Je %' THEN '1 l = ' ELSE '1 kg = ' END || {_eu('per')} END) AS shown FROM a)"""


@query("p01_served_columns", f""", {_SHOWN_SQL}
SELECT ext, coalesce(lim, false) AS limited, CASE WHEN lim THEN {_WEEKDAYS}[isodow(valid_from)] || CASE WHEN valid_from = valid_to THEN '' ELSE '–' || {_WEEKDAYS}[isodow(valid_to)] END END AS days, CASE chain WHEN 'north' THEN 'Nord' WHEN 'south' THEN 'Süd' ELSE 'Other' END AS chain_label,
  CASE category WHEN 'dairy' THEN 'Milch' WHEN 'bakery' THEN 'Brot' ELSE 'Other' END AS category_label, CASE WHEN category = 'dairy' AND contains(name, 'ring') THEN 'rings' WHEN category = 'dairy' AND contains(name, 'r') THEN 'rs' END AS "group",
  CASE WHEN category = 'dairy' AND contains(name, 'ring') THEN 'Ringe' WHEN category = 'dairy' AND contains(name, 'r') THEN 'Mit R' END AS group_label, shown AS shown_per_unit,
  CAST(round(CAST(replace(regexp_extract(shown, '[0-9]+[.,][0-9]+'), ',', '.') AS DECIMAL(18,2)) * 100) AS BIGINT) AS unit_cents, name LIKE 'red%' AS organic FROM q""")
def served_columns(spark, sf_dir):
    """Everything that a served offer is told with, beside what is stored."""
    from offerloom.functions.display import label_of
    from offerloom.operators.rules import organic, sub_group

    live = _shown(offers(spark, sf_dir).where(valid_on(F.col("valid_to"), TODAY)))
    group = sub_group(F.col("name"), F.col("category"), {"dairy": [("rings", "Ringe", ["ring"]), ("rs", "Mit R", ["r"])]})
    return live.withColumn("_g", group).select(
        "ext", "limited", "days", label_of(F.col("chain"), {"north": "Nord", "south": "Süd"}, "Other").alias("chain_label"), label_of(F.col("category"), {"dairy": "Milch", "bakery": "Brot"}, "Other").alias("category_label"),
        F.col("_g.slug").alias("group"), F.col("_g.label").alias("group_label"), "shown_per_unit", "unit_cents", organic(F.col("name"), F.col("brand"), ("red",)).alias("organic"),
    )


_HIDDEN = [("north:red bolt", "1998-06-15"), ("north:old plate", "1998-06-07"), ("east:hot gear", "1998-06-10"), ("west:new rod", "1998-06-21")]
_HIDE_ROWS = ", ".join(f"('{k}', DATE '{d}')" for k, d in _HIDDEN)
_HIDE_KEY = "chain || ':' || trim(regexp_replace(lower(name), '[^a-z0-9äöüß]+', ' ', 'g'))"


def _hidden(spark):
    return values(spark, _HIDDEN, "key string, since string").select("key", F.to_date("since").alias("since"))


@query("f07_hidden_anti", f" SELECT chain, count(*) AS n FROM offers WHERE {_HIDE_KEY} NOT IN (SELECT k FROM (VALUES {_HIDE_ROWS}) h(k, d)) GROUP BY chain")
def hidden_anti(spark, sf_dir):
    return fl.without_hidden(offers(spark, sf_dir), _hidden(spark)).groupBy("chain").agg(F.count("*").alias("n"))


@query("f07_hidden_semi", f" SELECT ext, chain, name FROM offers WHERE {_HIDE_KEY} IN (SELECT k FROM (VALUES {_HIDE_ROWS}) h(k, d))")
def hidden_semi(spark, sf_dir):
    return fl.without_hidden(offers(spark, sf_dir), _hidden(spark), invert=True).select("ext", "chain", "name")


@query("f08_hide_expiry", f"""SELECT o_orderkey, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS VARCHAR) AS until,
  DATE '{TODAY}' <= CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS live FROM orders""", views=False)
def hide_expiry(spark, sf_dir):
    from offerloom.functions.validity import week_end

    until = week_end(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", until.cast("string").alias("until"), (F.lit(TODAY).cast("date") <= until).alias("live"))


@query("f10_lens_guard", """, p AS (SELECT ['north','nowhere'] AS want, ['nowhere'] AS none)
SELECT category, count(*) FILTER (WHERE chain = 'north') AS lens, count(*) AS untouched FROM offers GROUP BY category""")
def lens_guard(spark, sf_dir):
    rows = offers(spark, sf_dir)
    a = fl.chain_lens(rows, ["north", "nowhere"]).groupBy("category").agg(F.count("*").alias("lens"))
    b = fl.chain_lens(rows, ["nowhere"]).groupBy("category").agg(F.count("*").alias("untouched"))
    return b.join(a, "category", "left").select("category", F.coalesce("lens", F.lit(0)).alias("lens"), "untouched")


@query("f12_search", " SELECT ext, name, brand FROM offers WHERE contains(lower(name), 'gizmo') OR contains(lower(brand), 'gizmo')")
def text_search(spark, sf_dir):
    return offers(spark, sf_dir).where(fl.search("Gízmo".replace("í", "i"))).select("ext", "name", "brand")


_SUPPRESS = "(SELECT s.* FROM {src} s LEFT JOIN (SELECT {key} AS k, min(price_cents) AS least FROM {src} WHERE chain = 'north' AND {key} <> '' GROUP BY ALL) n ON {skey} = n.k WHERE s.chain <> 'south' OR n.k IS NULL OR s.price_cents < n.least)"
_NORM = "trim(regexp_replace(lower(name), '[^a-z0-9äöüß]+', ' ', 'g'))"


def _suppress(src: str) -> str:
    return _SUPPRESS.format(src=src, key=_NORM, skey=_NORM.replace("name", "s.name"))


def _stack(name: str, choice: fl.Choice) -> str:
    """The whole stack of filters as tables whose names begin with `name`, the last one `name`; raw: the offers with their flags."""
    hides = f"(SELECT k FROM (VALUES {_HIDE_ROWS}) h(k, d) WHERE DATE '{TODAY}' <= CAST(date_trunc('week', d) AS DATE) + 6)"
    stores = ", ".join(f"'{c}'" for c in choice.hidden_stores) or "''"
    lens = ", ".join(f"'{c}'" for c in choice.lens) or "''"
    text = (choice.text or "").strip().lower()
    found = f"contains(lower(name), '{text}') OR contains(lower(brand), '{text}')" if text else f"category = '{choice.category}'" if choice.category else "true"
    return f"""{name}_a AS (SELECT * FROM raw WHERE ({choice.show_non_food} OR category <> 'household') AND {_HIDE_KEY} {"" if choice.show_hidden else "NOT"} IN {hides} AND chain NOT IN ({stores})),
{name}_b AS {_suppress(f"{name}_a")}, {name}_c AS (SELECT * FROM {name}_b WHERE chain IN ({lens}) OR (SELECT count(*) FROM {name}_b WHERE chain IN ({lens})) = 0),
{name} AS (SELECT * FROM {name}_c WHERE (NOT {choice.limited} OR lim OR NOT (SELECT bool_or(lim) FROM raw)) AND (NOT {choice.organic} OR red OR NOT (SELECT bool_or(red) FROM raw)) AND ({found}))"""


_RAW = "raw AS (SELECT *, coalesce(valid_to >= valid_from AND valid_to - valid_from + 1 < 6, false) AS lim, name LIKE '{mark}%' AS red FROM offers)"


def _marked(name: str = "red"):
    return F.col("name").startswith(name)


_WHOLE = fl.Choice(hidden_stores=("west",), lens=("north", "south", "harbor"), limited=True, text="Ring", category="dairy")


@query("f14_filter_stack", f", {_RAW.format(mark='red')}, {_stack('f', _WHOLE)} SELECT ext, chain, name, price_cents FROM f")
def whole_stack(spark, sf_dir):
    return fl.filter_stack(offers(spark, sf_dir), TODAY, _hidden(spark), _WHOLE, _marked()).select("ext", "chain", "name", "price_cents")


_HIDDEN_ONLY = fl.Choice(show_hidden=True, show_non_food=True)


@query("f14_hidden_only", f", {_RAW.format(mark='red')}, {_stack('f', _HIDDEN_ONLY)} SELECT ext, chain, name, price_cents FROM f")
def hidden_stack(spark, sf_dir):
    """Only what is hidden, food or not."""
    return fl.filter_stack(offers(spark, sf_dir), TODAY, _hidden(spark), _HIDDEN_ONLY, _marked()).select("ext", "chain", "name", "price_cents")


_BY_CATEGORY = fl.Choice(lens=("nowhere",), organic=True, category="dairy")


@query("f13_category_filter", f", {_RAW.format(mark='zzz')}, {_stack('f', _BY_CATEGORY)} SELECT ext, chain, name, price_cents FROM f")
def category_filter(spark, sf_dir):
    """The stack without a search text: the category decides, and lenses that nothing meets change nothing."""
    return fl.filter_stack(offers(spark, sf_dir), TODAY, _hidden(spark), _BY_CATEGORY, _marked("zzz")).select("ext", "chain", "name", "price_cents")


@query("f11_organic_lens", """, o AS (SELECT chain, regexp_matches(lower(name), '(^|[^0-9a-zäöüß])red') AS own FROM offers)
SELECT 'red' AS lens, chain, count(*) AS n FROM o WHERE own GROUP BY chain UNION ALL SELECT 'zzz', chain, count(*) FROM o GROUP BY chain""")
def organic_lens(spark, sf_dir):
    """The lens of a mark that some offers bear, and of one that none does, which changes nothing."""
    from offerloom.operators.rules import organic

    rows = offers(spark, sf_dir)
    of = lambda mark: organic(F.col("name"), F.lit(None).cast("string"), (mark,))
    lens = [fl.flag_lens(rows, of(m), rows, of(m)).groupBy("chain").agg(F.count("*").alias("n")).select(F.lit(m).alias("lens"), "chain", "n") for m in ("red", "zzz")]
    return lens[0].unionByName(lens[1])


@query("j02_suppress_duplicates", f", d AS {_suppress('offers')} SELECT chain, category, count(*) AS n, CAST(sum(price_cents) AS BIGINT) AS cents FROM d GROUP BY ALL")
def suppressed(spark, sf_dir):
    return fl.suppress_duplicates(offers(spark, sf_dir), "north", "south").groupBy("chain", "category").agg(F.count("*").alias("n"), F.sum("price_cents").alias("cents"))


def _facets(choice: fl.Choice) -> str:
    """Four runs of the whole stack, each without one filter."""
    return f"""{_stack('c', choice._replace(lens=()))}, {_stack('l', choice._replace(limited=False))}, {_stack('o', choice._replace(organic=False))}, {_stack('n', choice._replace(show_non_food=True))}
SELECT 'chain' AS facet, chain AS value, count(*) AS rows FROM c GROUP BY chain UNION ALL SELECT 'limited', NULL, count(*) FROM l WHERE lim UNION ALL SELECT 'organic', NULL, count(*) FROM o WHERE red UNION ALL SELECT 'non_food', NULL, count(*) FROM n WHERE category = 'household'"""


_FACETS = fl.Choice(hidden_stores=("west",), lens=("south", "harbor"), limited=True, organic=True, text="new", category="dairy")


@query("a05_facets", f", {_RAW.format(mark='new')}, {_facets(_FACETS)}")
def facets(spark, sf_dir):
    return fl.facet_counts(offers(spark, sf_dir), TODAY, _hidden(spark), _FACETS, _marked("new"))


_NO_FACETS = fl.Choice(show_non_food=True, lens=("nowhere", "east"), organic=True)


@query("q08_facet_sheet", f", {_RAW.format(mark='zzz')}, {_facets(_NO_FACETS)}")
def facet_sheet(spark, sf_dir):
    """Non-food shown, a lens with one chain that isn't there, and an organic filter that nothing bears."""
    return fl.facet_counts(offers(spark, sf_dir), TODAY, _hidden(spark), _NO_FACETS, _marked("zzz"))


@query("w01_dedup_serve", f", d AS {_dedup('offers')} SELECT ext, store_id, name, price_cents FROM d")
def dedup_serve(spark, sf_dir):
    return rk.serve_dedup(offers(spark, sf_dir), name_key("name")).select("ext", "store_id", "name", "price_cents")


@query("w02_dedup_scrape", f""", d AS (SELECT *, row_number() OVER (PARTITION BY {_KEY}, price_cents ORDER BY per_unit IS NOT NULL DESC, coalesce(regular_cents > price_cents, false) DESC,
  image_url IS NOT NULL DESC, ext DESC) AS rn FROM offers) SELECT ext, name, price_cents FROM d WHERE rn = 1""")
def dedup_scrape(spark, sf_dir):
    return rk.scrape_dedup(offers(spark, sf_dir), name_key("name")).select("ext", "name", "price_cents")


@query("w03_last_wins", """SELECT l_orderkey, l_shipdate, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""", views=False)
def last_row(spark, sf_dir):
    order = [F.desc(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")]
    return rk.last_wins(table(spark, sf_dir, "lineitem"), "l_orderkey", order).select("l_orderkey", "l_shipdate", "l_partkey")


@query("w04_topk", """, r AS (SELECT *, row_number() OVER (PARTITION BY chain, category ORDER BY price_cents, ext) AS rank FROM offers)
SELECT chain, category, ext, price_cents, rank FROM r WHERE rank <= 12""")
def topk(spark, sf_dir):
    return rk.first_of(offers(spark, sf_dir), ["chain", "category"], rk.by_price(), 12, "rank").select("chain", "category", "ext", "price_cents", "rank")


#: Offers with unit and app prices, and what they are ordered by in each mode.
_SORTED = """u AS (SELECT *, CAST(round(CAST(replace(coalesce(nullif(regexp_extract(per_unit, '^1 ?kg = ([0-9]+[.,][0-9]+)', 1), ''), nullif(regexp_extract(per_unit, '^([0-9.]+) €/kg', 1), '')), ',', '.') AS DECIMAL(18,4)) * 100) AS BIGINT) AS ucents,
  CASE WHEN store_id % 5 = 0 THEN price_cents - 77 WHEN store_id % 5 = 1 THEN price_cents END AS app FROM offers),
h AS (SELECT *, CASE WHEN app < price_cents THEN floor((coalesce(regular_cents, price_cents) - app) * 100 / coalesce(regular_cents, price_cents) + 0.5) ELSE discount_pct END AS pct,
  CASE WHEN category = 'household' THEN 'discount' WHEN category = 'bakery' THEN 'price' ELSE 'unit' END AS mode FROM u),
v AS (SELECT *, CASE mode WHEN 'unit' THEN ucents WHEN 'price' THEN price_cents ELSE -pct END AS value FROM h)"""


def _sortable(spark, sf_dir):
    app = F.when(F.col("store_id") % 5 == 0, F.col("price_cents") - 77).when(F.col("store_id") % 5 == 1, F.col("price_cents"))
    return offers(spark, sf_dir).withColumns({"unit_cents": unit_price_cents("per_unit"), "app_cents": app, "category_label": F.initcap("category")})


_WANTED, _LABELS, _CHOSEN = ["household", "nothing", "bakery", "dairy"], {"dairy": "Milch"}, {"bakery": "price"}
_PLACED = "CASE category WHEN 'household' THEN 1 WHEN 'bakery' THEN 3 WHEN 'dairy' THEN 4 END AS position, category, CASE category WHEN 'dairy' THEN 'Milch' WHEN 'bakery' THEN 'Bakery' ELSE 'Household' END AS label"


@query("w05_shelves", f""", {_SORTED} SELECT {_PLACED}, count(*) OVER (PARTITION BY category) AS total, ext, row_number() OVER (PARTITION BY category ORDER BY value NULLS LAST, ext) AS rank FROM v
WHERE category IN ('household', 'bakery', 'dairy') QUALIFY rank <= 5""")
def shelf(spark, sf_dir):
    """Shelves by discount, by price and by unit price at once, in the shopper's order."""
    return rk.shelves(_sortable(spark, sf_dir), _WANTED, _LABELS, _CHOSEN).select("position", "category", "label", "total", "ext", "rank")


@query("w06_cards", f""", {_SORTED} SELECT {_PLACED}, count(*) OVER (PARTITION BY category) AS total, ext, row_number() OVER (PARTITION BY category ORDER BY pct IS NOT NULL DESC, pct DESC NULLS LAST, CASE WHEN pct IS NULL THEN value END NULLS LAST, ext) AS rank
FROM v WHERE category IN ('household', 'bakery', 'dairy') AND (ext LIKE '1%' OR pct IS NULL) AND name LIKE 'red a%' QUALIFY rank <= 100""")
def card(spark, sf_dir):
    """Cards so long that every category runs out of discounts and is filled by its own mode."""
    rows = _sortable(spark, sf_dir).where(F.col("name").like("red a%")).withColumn("_shown", F.explode(F.array(rk.headline_discount())))  # no filter is copied to before an explode, so each row's discount is computed once, after the joins
    rows = rows.where(F.col("ext").like("1%") | F.col("_shown").isNull()).drop("_shown")
    return rk.cards(rows, _WANTED, _LABELS, _CHOSEN, 100).select("position", "category", "label", "total", "ext", "rank")


_SECTIONS = """g AS (SELECT *, CASE WHEN name LIKE 'old%' THEN NULL WHEN name LIKE 'new%' THEN '' ELSE split_part(name, ' ', 2) END AS grp FROM v WHERE category = 'dairy'),
r AS (SELECT *, nullif(grp, '') AS k, upper(split_part(name, ' ', 1)) AS own, row_number() OVER (PARTITION BY nullif(grp, '') ORDER BY ucents NULLS LAST, ext) AS rank FROM g),
s AS (SELECT k, count(*) AS n, min(price_cents) AS least, arg_min(own, rank) AS label FROM r GROUP BY k), p AS (SELECT *, CAST(row_number() OVER (ORDER BY k IS NULL, n DESC, label, k) AS INTEGER) AS position FROM s)
SELECT position, p.k AS "group", CASE WHEN p.k IS NULL THEN 'More' ELSE label END AS label, n, CASE WHEN p.k IS NOT NULL THEN least END AS from_cents, p.k IS NULL AS muted, ext, rank FROM r JOIN p ON r.k IS NOT DISTINCT FROM p.k"""


@query("w07_sections", f", {_SORTED}, {_SECTIONS}")
def group_sections(spark, sf_dir):
    second = F.when(F.col("name").startswith("new"), "").when(~F.col("name").startswith("old"), F.split_part("name", F.lit(" "), F.lit(2)))
    rows = _sortable(spark, sf_dir).where("category = 'dairy'").withColumns({"group": second, "group_label": F.upper(F.split_part("name", F.lit(" "), F.lit(1)))})
    return rk.sections(rows, "unit").select("position", "group", "label", "n", "from_cents", "muted", "ext", "rank")


@query("o05_category_sorts", f", {_SORTED} SELECT category, mode, ext, row_number() OVER (PARTITION BY category ORDER BY value NULLS LAST, ext) AS rank FROM v")
def category_sorts(spark, sf_dir):
    """Every offer's place in its category: one category's order is chosen, one starts by discount, all others by unit price."""
    mode = rk.mode_of(F.col("category"), _CHOSEN)
    value = rk.sort_value(mode, F.col("unit_cents"), rk.headline_discount())
    rows = _sortable(spark, sf_dir).select("category", mode.alias("mode"), "ext", value.alias("_value"))
    return rk.numbered(rows, ["category"], [F.col("_value").asc_nulls_last(), F.col("ext").asc()]).drop("_value")


@query("q07_deals_list", f", {_RAW.format(mark='red')}, {_stack('f', fl.Choice(hidden_stores=('west',), category='bakery'))}, {_SORTED.replace('FROM offers', 'FROM f').replace('h AS', 'hh AS').replace('FROM h)', 'FROM hh)')} SELECT ext, row_number() OVER (ORDER BY value NULLS LAST, ext) AS rank FROM v")
def deals_list(spark, sf_dir):
    """The filtered list of a category in the order chosen for it."""
    from pyspark.sql.window import Window

    rows = fl.filter_stack(_sortable(spark, sf_dir), TODAY, _hidden(spark), fl.Choice(hidden_stores=("west",), category="bakery"), _marked())
    order = [rk.sort_value(rk.mode_of(F.col("category"), _CHOSEN), F.col("unit_cents"), rk.headline_discount()).asc_nulls_last(), F.col("ext").asc()]
    return rows.select("ext", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # one category's list


@query("o04_sort_modes", """, u AS (SELECT store_id, ext, price_cents, discount_pct, CAST(nullif(regexp_extract(per_unit, '^1 ?kg = ([0-9]+[.,][0-9]+)', 1), '') AS VARCHAR) AS a, nullif(regexp_extract(per_unit, '^([0-9.]+) €/kg', 1), '') AS b FROM offers),
v AS (SELECT *, CAST(replace(coalesce(a, b), ',', '.') AS DECIMAL(18,2)) AS unit FROM u)
SELECT store_id, ext, row_number() OVER (PARTITION BY store_id ORDER BY price_cents NULLS LAST, ext) AS by_price, row_number() OVER (PARTITION BY store_id ORDER BY discount_pct DESC NULLS LAST, ext) AS by_discount,
  row_number() OVER (PARTITION BY store_id ORDER BY unit NULLS LAST, ext) AS by_unit FROM v""")
def sort_modes(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = offers(spark, sf_dir).withColumn("unit_cents", unit_price_cents("per_unit"))
    place = lambda mode: F.row_number().over(Window.partitionBy("store_id").orderBy(*rk.sort_key(mode, F.col("unit_cents"))))
    return rows.select("store_id", "ext", *[place(m).alias(f"by_{m}") for m in ("price", "discount", "unit")])


@query("k05_seed", """, r AS (SELECT chain, category, name, price_cents, ext, row_number() OVER (PARTITION BY chain, category ORDER BY price_cents, ext) AS rank FROM offers),
c AS (SELECT chain, category, count(*) FILTER (WHERE rank <= 12) AS n, min(price_cents) AS least FROM r GROUP BY ALL),
k AS (SELECT DISTINCT chain FROM stores), w AS (SELECT unnest(['dairy', 'fruits', 'pantry', 'seeds']) AS category)
SELECT k.chain, w.category, coalesce(n, 0) AS n, least AS least_cents FROM k CROSS JOIN w LEFT JOIN c ON k.chain = c.chain AND w.category = c.category""")
def seed(spark, sf_dir):
    from offerloom.plans.exports import candidates

    out = candidates(offers(spark, sf_dir), ["dairy", "fruits", "pantry", "seeds"], 12)
    return out.select("chain", "category", F.size("offers").cast("long").alias("n"), F.array_min(F.transform("offers", lambda o: o["price_cents"])).alias("least_cents"))
