"""The ingest run over pages made from parts and suppliers: two batches into versioned tables, and the gates over what was counted on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from offerloom.operators import gates as gt
from offerloom.operators.rules import Book
from offerloom.plans.registry import query
from offerloom.plans.sundry import _CLEARANCE, _COUPONS, clearance_pages, coupon_pages, flyer_pages
from offerloom.sources.ingest import Plan, Versions, ingest, shared_folder
from offerloom.sources.tables import CHAINS, TODAY, table

BOOK = Book({"aisle_node": [("hair", ["haar"])], "form": [("drinks", [" bolt"])], "caption": [("snacks", [" bag "])], "keyword": [("dairy", ["ring", "rod"])]}, vegan=("red g",))
PLAN = Plan(BOOK, "north", TODAY, {"east": "nord", "west": "sued"})
_FLYER_CHAINS = ("south", "east", "west", "harbor")


def raw_pages(spark, sf_dir):
    """All pages with chain, place and batch. Flyers of some parts come in both batches, the second time under another brand; one postal code has no coordinates before the second batch, one never."""
    key = F.col("key")
    place = lambda n: F.concat(F.lit("1010"), (key % n).cast("string"))
    chain = F.element_at(F.array(*map(F.lit, _FLYER_CHAINS)), (key % 4 + 1).cast("int"))
    first = F.when(key % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    fly = flyer_pages(spark, sf_dir).withColumn("batch", F.explode(first)).select(
        F.lit("flyer").alias("feed"), chain.alias("chain"), place(7).alias("plz"), F.lit(None).cast("double").alias("lat"), "batch", F.when(F.col("batch") == 2, F.replace("json", F.lit('"brandName":"'), F.lit('"brandName":"Neu '))).otherwise(F.col("json")).alias("json"))
    coupon_batch = (key % 2 + 1).cast("int")
    lat = F.when((key % 7 == 6) | ((key % 7 == 5) & (coupon_batch == 1)), None).otherwise(F.lit(52.0) + key % 7)
    coupon = coupon_pages(spark, sf_dir).select(F.lit("coupon").alias("feed"), F.lit("north").alias("chain"), place(7).alias("plz"), lat.alias("lat"), coupon_batch.alias("batch"), "json")
    clear = clearance_pages(spark, sf_dir).select(F.lit("clearance").alias("feed"), F.lit("garden").alias("chain"), place(7).alias("plz"), F.lit(None).cast("double").alias("lat"), (key % 2 + 1).cast("int").alias("batch"), "json")
    rows = fly.unionByName(coupon).unionByName(clear)
    return rows.withColumns({"store_name": F.concat_ws(" ", "chain", F.col("batch").cast("string")), "market_code": F.lit(None).cast("string"), "lng": F.col("lat") - 39})


def divisions(spark):
    """Where which division is at home; one postal code is unknown."""
    return spark.createDataFrame([(f"1010{i}", "nord" if i % 2 else "sued") for i in range(6)], "plz string, division string")


def filled(spark, sf_dir, sent=(1, 2)) -> Versions:
    """The batches, as often as they are sent."""
    tables = Versions(spark, f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}")
    pages, homes = raw_pages(spark, sf_dir), divisions(spark)
    for n in sent:
        ingest(tables, pages.where(F.col("batch") == n).drop("batch"), homes, PLAN, f"batch-{n}")
    return tables


_PCT = "(CASE WHEN 2 * (1000 * ({r} - {p}) % {r}) > {r} OR (2 * (1000 * ({r} - {p}) % {r}) = {r} AND (1000 * ({r} - {p}) // {r}) % 2 = 1) THEN 1 ELSE 0 END + 1000 * ({r} - {p}) // {r}) / 10.0::DOUBLE"
_CLASS = """CASE WHEN regexp_matches(lower(name || ' ' || coalesce(brand, '')), '(^|[^a-zäöüß])red g') THEN 'vegan' WHEN len(path) > 0 AND lower(path[1]) <> 'food' THEN CASE WHEN list_contains(path, 'Haar') THEN 'hair' ELSE 'household' END
  WHEN contains(' ' || lower(name) || ' ' || lower(coalesce(brand, '')) || ' ', ' bolt') THEN 'drinks' WHEN contains(' ' || lower(unit) || ' ', ' bag ') THEN 'snacks' WHEN contains(lower(name || ' ' || coalesce(brand, '')), 'ring') OR contains(lower(name || ' ' || coalesce(brand, '')), 'rod') THEN 'dairy' ELSE 'other' END"""
_INGEST = f"""WITH fl AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS c, p_size % 6 AS m, p_partkey AS key FROM part WHERE p_size % 6 NOT IN (0, 5)),
{_COUPONS}, {_CLEARANCE},
n AS (SELECT unnest([1, 2]) AS batch),
b AS (SELECT 'flyer' AS source, (['south','east','west','harbor'])[key % 4 + 1] AS chain, '1010' || key % 7 AS plz, batch, id, CASE WHEN batch = 2 THEN 'Neu ' ELSE '' END || p_brand || ' ' || p_name AS name, CASE WHEN batch = 2 THEN 'Neu ' ELSE '' END || p_brand AS brand, c AS price_cents,
    CASE m WHEN 1 THEN c + 100 WHEN 3 THEN c + 50 WHEN 4 THEN CAST(round(c / 0.8) AS BIGINT) END AS regular_cents, '500 g' AS unit, CASE WHEN m <> 1 THEN 'x' END AS per_unit, NULL AS image_url, ['food'] AS path FROM fl, n WHERE batch = 2 OR key % 2 = 0
  UNION ALL SELECT 'coupon', 'north', '1010' || key % 7, key % 2 + 1, id, name, brand, price_cents, regular_cents, unit, per_unit, image_url, [] FROM co
  UNION ALL SELECT 'clearance', 'garden', '1010' || key % 7, key % 2 + 1, id, name, brand, price_cents, regular_cents, NULL, base_unit, image_url, category_path FROM cl),
a AS (SELECT *, source || ':' || id AS ext FROM b WHERE source <> 'flyer' OR (plz <> '10106' AND (plz <> '10105' OR batch = 2) AND (chain <> 'east' OR plz IN ('10101', '10103', '10105')) AND (chain <> 'west' OR plz IN ('10100', '10102', '10104')))),
d AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY batch, chain, plz, source, trim(regexp_replace(lower(name), '[^a-z0-9_]+', ' ', 'g')), price_cents ORDER BY per_unit IS NOT NULL DESC, coalesce(regular_cents > price_cents, false) DESC, image_url IS NOT NULL DESC, ext DESC) = 1),
u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY chain, plz, ext ORDER BY batch DESC, price_cents, name) = 1),
o AS (SELECT chain, plz, ext, source, name, brand, {_CLASS} AS category, price_cents, regular_cents, CASE WHEN regular_cents > price_cents THEN {_PCT.format(p='price_cents', r='regular_cents')} END AS discount_pct, unit, per_unit, CAST(batch AS BIGINT) AS version FROM u)"""


@query("q17_ingest", f"{_INGEST} SELECT * EXCLUDE (per_unit, unit, regular_cents) FROM o", views=False)
def ingested(spark, sf_dir):
    """What is stored after two batches, the second of which was sent twice: guarded, routed, freed of duplicates, classified, put over what was there."""
    rows = filled(spark, sf_dir, (1, 2, 2)).read("offers")
    return rows.select("chain", "plz", "ext", "source", "name", "brand", "category", "price_cents", "discount_pct", "version")


@query("q17_stores", f"""{_INGEST}, w AS (SELECT 'north' AS chain, '1010' || p_partkey % 7 AS plz, p_partkey % 2 + 1 AS batch, CASE WHEN p_partkey % 7 = 6 OR (p_partkey % 7 = 5 AND p_partkey % 2 = 0) THEN NULL ELSE 52.0::DOUBLE + p_partkey % 7 END AS lat FROM part
  UNION ALL SELECT 'garden', '1010' || s_suppkey % 7, s_suppkey % 2 + 1, NULL FROM supplier UNION ALL SELECT (['south','east','west','harbor'])[p_partkey % 4 + 1], '1010' || p_partkey % 7, batch, NULL FROM part, n WHERE batch = 2 OR p_partkey % 2 = 0)
SELECT chain, plz, chain || ' ' || min(batch) AS store_name, max(lat) AS lat, max(lat) - 39 AS lng FROM w GROUP BY chain, plz""", views=False)
def stored_stores(spark, sf_dir):
    return filled(spark, sf_dir).read("stores").select("chain", "plz", "store_name", "lat", "lng")


PROFILES = {"grocery": gt.Profile(900, 100, 5, 60, 40.0), "drinks": gt.Profile(100, 50, 6, 30, 99.0), "drugstore": gt.Profile(60, 60, 1, 100, None)}


@query("g01_gates", f"""{_INGEST}, sec AS (SELECT CASE WHEN chain = 'garden' THEN 'drugstore' WHEN category = 'drinks' THEN 'drinks' ELSE 'grocery' END AS section, chain, count(*) AS offers, count(*) FILTER (WHERE per_unit IS NOT NULL OR source <> 'clearance' AND (unit = '500 g' OR unit LIKE '1 kg%')) AS with_unit FROM o GROUP BY ALL),
tot AS (SELECT section, CAST(sum(offers) AS DOUBLE) AS n, count(*) AS chains, round(sum(with_unit) * 100.0 / sum(offers), 4) AS pct FROM sec GROUP BY section),
prof AS (SELECT * FROM (VALUES ('grocery', 900, 5, 60, 40.0), ('drinks', 100, 6, 30, 99.0), ('drugstore', 60, 1, 100, NULL)) v(section, offers, chains_floor, chain_floor, pct_floor))
SELECT section, 'offers' AS gate, NULL AS chain, n AS value, CAST(offers AS DOUBLE) AS floor, n >= offers AS passes FROM tot JOIN prof USING (section) UNION ALL SELECT section, 'chains', NULL, CAST(chains AS DOUBLE), CAST(chains_floor AS DOUBLE), chains >= chains_floor FROM tot JOIN prof USING (section)
UNION ALL SELECT section, 'truncated', NULL, n, 2000.0, n <> 2000 FROM tot UNION ALL SELECT section, 'unit_pct', NULL, CAST(pct AS DOUBLE), CAST(pct_floor AS DOUBLE), pct >= pct_floor FROM tot JOIN prof USING (section) WHERE pct_floor IS NOT NULL
UNION ALL SELECT section, 'chain_offers', chain, CAST(sec.offers AS DOUBLE), CAST(chain_floor AS DOUBLE), sec.offers >= chain_floor FROM sec JOIN prof USING (section)""", views=False)
def gates(spark, sf_dir):
    """The gates after the reset, over what was counted while the last version was written."""
    tables = filled(spark, sf_dir)
    counts = tables.commits().where(F.col("version") == tables.current()).select(F.inline("counts"))
    return gt.judged(counts, PROFILES, after_reset=True)
