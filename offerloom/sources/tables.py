"""The offer model as a view over a star schema: stores from suppliers, offers from order lines and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHAINS = ("north", "south", "east", "west", "harbor", "garden")
CATEGORIES = {"ECONOMY": "pantry", "SMALL": "bakery", "MEDIUM": "dairy", "PROMO": "drinks", "STANDARD": "fruits", "LARGE": "household"}
#: The day that queries take for today.
TODAY = "1998-06-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_id, chain, store_name, plz, lat, lng."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("store_id"), _pick(CHAINS, F.col("s_nationkey")).alias("chain"), F.col("s_name").alias("store_name"),
        (F.lit(10115) + F.col("s_nationkey")).cast("string").alias("plz"),
        (F.lit(52.0) + (key * 37 % 1000) / 1000.0).alias("lat"), (F.lit(13.0) + (key * 91 % 1000) / 1000.0).alias("lng"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers joined with their stores (J01). ext is unique, and the last tie-break of every order."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    off = F.round(F.abs("l_discount") * 100).cast("long")
    regular = F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long")
    size = F.col("p_size")
    unit = (
        F.when(size % 5 == 0, F.concat(size.cast("string"), F.lit("0 g"))).when(size % 5 == 1, F.concat(size.cast("string"), F.lit("x400 ml")))
        .when(size % 5 == 2, F.concat(F.lit("Ca. "), size.cast("string"), F.lit(" kg"))).when(size % 5 == 3, F.concat(F.lit("Je "), size.cast("string"), F.lit(",5 l")))
    )
    stated = (
        F.when(size % 7 == 0, F.concat(F.lit("1 kg = "), size.cast("string"), F.lit(".95"))).when(size % 7 == 1, "kg-Preis").when(size % 7 == 2, "100-g-Preis")
        .when(size % 7 == 3, F.concat(F.lit("(1 kg = "), size.cast("string"), F.lit(".05)"))).when(size % 7 == 4, F.concat(size.cast("string"), F.lit(".79 €/kg")))
        .when(size % 7 == 5, F.concat(F.lit("1kg = "), size.cast("string"), F.lit(",90")))
    )
    number, day = F.col("l_linenumber"), F.to_date("l_shipdate")
    rows = line.join(part, line.l_partkey == part.p_partkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("ext"),
        F.col("l_suppkey").alias("store_id"),
        F.when(number == 7, "clearance").when(F.col("l_linestatus") == "F", "flyer").otherwise("coupon").alias("source"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair]), F.col("p_type")).alias("category"),
        regular.alias("_reg"), off.alias("_off"), unit.alias("unit"), stated.alias("per_unit"),
        F.when(number % 3 != 0, F.concat(F.lit("img/"), F.col("l_partkey").cast("string"))).alias("image_url"),
        day.alias("valid_from"), F.when(number != 5, F.date_add(day, (number % 7).cast("int"))).alias("valid_to"),
    )
    cut = F.col("_reg") * F.col("_off")
    price = F.col("_reg") - F.floor(cut / 100).cast("long")
    rows = rows.withColumns({"price_cents": price, "regular_cents": F.when(F.col("_off") > 0, F.col("_reg"))}).drop("_reg", "_off")
    own = stores(spark, sf_dir).select("store_id", "chain", "store_name", "plz")
    from offerloom.functions.pricing import discount_pct

    return rows.join(own, "store_id").withColumn("discount_pct", discount_pct(F.col("price_cents"), F.col("regular_cents")))


_CHAIN_LIST = ", ".join(f"'{c}'" for c in CHAINS)
_CATEGORY_CASE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items()) + " END"

#: The same two views in SQL, to stand before a query: WITH stores AS (...), offers AS (...)
VIEWS = f"""
stores AS (SELECT s_suppkey AS store_id, ([{_CHAIN_LIST}])[s_nationkey % 6 + 1] AS chain, s_name AS store_name,
  CAST(10115 + s_nationkey AS VARCHAR) AS plz, 52.0::DOUBLE + (s_suppkey * 37 % 1000) / 1000.0::DOUBLE AS lat,
  13.0::DOUBLE + (s_suppkey * 91 % 1000) / 1000.0::DOUBLE AS lng FROM supplier),
lines AS (SELECT *, CAST(round(abs(l_discount) * 100) AS BIGINT) AS off, CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS reg
  FROM lineitem JOIN part ON l_partkey = p_partkey),
priced AS (SELECT *, reg - (reg * off - reg * off % 100) // 100 AS price_cents, CASE WHEN off > 0 THEN reg END AS regular_cents FROM lines),
offers AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS ext,
  store_id, CASE WHEN l_linenumber = 7 THEN 'clearance' WHEN l_linestatus = 'F' THEN 'flyer' ELSE 'coupon' END AS source,
  p_name AS name, p_brand AS brand, {_CATEGORY_CASE} AS category,
  CASE p_size % 5 WHEN 0 THEN p_size || '0 g' WHEN 1 THEN p_size || 'x400 ml' WHEN 2 THEN 'Ca. ' || p_size || ' kg' WHEN 3 THEN 'Je ' || p_size || ',5 l' END AS unit,
  CASE p_size % 7 WHEN 0 THEN '1 kg = ' || p_size || '.95' WHEN 1 THEN 'kg-Preis' WHEN 2 THEN '100-g-Preis' WHEN 3 THEN '(1 kg = ' || p_size || '.05)'
    WHEN 4 THEN p_size || '.79 €/kg' WHEN 5 THEN '1kg = ' || p_size || ',90' END AS per_unit,
  CASE WHEN l_linenumber % 3 <> 0 THEN 'img/' || l_partkey END AS image_url, CAST(l_shipdate AS DATE) AS valid_from,
  CASE WHEN l_linenumber <> 5 THEN CAST(l_shipdate AS DATE) + CAST(l_linenumber % 7 AS INTEGER) END AS valid_to,
  price_cents, regular_cents, chain, store_name, plz,
  CASE WHEN regular_cents > 0 AND price_cents < regular_cents THEN
    (CASE WHEN 2 * (1000 * (regular_cents - price_cents) % regular_cents) > regular_cents
            OR (2 * (1000 * (regular_cents - price_cents) % regular_cents) = regular_cents AND (1000 * (regular_cents - price_cents) // regular_cents) % 2 = 1)
          THEN 1 ELSE 0 END + 1000 * (regular_cents - price_cents) // regular_cents) / 10.0::DOUBLE END AS discount_pct
  FROM priced JOIN stores ON l_suppkey = store_id)"""
