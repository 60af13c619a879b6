"""Semi-structured feeds to offers. Malformed parts yield no rows and never raise: everything goes through VARIANT with try_ functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from offerloom.functions.pricing import base_unit_price, euros, money_cents


#: Fixed value: how a bonus is written.
BONUS = r"(?i)\d+[.,]\d{2}\s*€\s*Bonus"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _list(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def cents(euros: Column) -> Column:
    """Cents of a number of euros; null for anything not finite."""
    return F.round(euros.try_cast("decimal(18,4)") * 100).try_cast("long")


def _deal(deals: Column, kind: str) -> Column:
    """The first number `max` of a deal of this type, in cents."""
    own = F.filter(deals, lambda d: _get(d, "$.type", "string") == kind)
    return F.get(F.filter(F.transform(own, lambda d: cents(_get(d, "$.max", "double"))), lambda x: x.isNotNull()), F.lit(0))


def regular_from_badge(price: Column, kind: Column, value: Column) -> Column:
    """The strike price that a badge implies: an amount off, or per cent below 100; only if it comes out above the price."""
    number = F.replace(value, F.lit(","), F.lit(".")).try_cast("decimal(12,4)")
    amount = price + F.round(number * 100)
    percent = F.when((number > 0) & (number < 100), F.round(price / (1 - number / 100)))
    out = F.when(kind == "DISCOUNT_AMOUNT", amount).when(kind == "DISCOUNT_PERCENTAGE", percent).cast("long")
    return F.when(out > price, out)


def flyer_offers(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, name, brand, price_cents, regular_cents, unit, base_unit, note, app_cents, category_path) of flyer pages (column json).

    contents[].offers[].content is unnested twice; an offer without a positive sales price is dropped. base_unit is what the sales price states, else the
    price itself if a condition of the sales price says that it is that of a kilogram; note is the bonus amount that another deal names. keep: columns of the page that its offers keep.
    """
    page = pages.select(*keep, F.try_parse_json("json").alias("_p"))
    content = page.select(*keep, F.explode(_list(F.col("_p"), "$.contents")).alias("_c"))
    c = content.select(*keep, F.explode(_list(F.col("_c"), "$.offers")).alias("_o")).select(*keep, _get(F.col("_o"), "$.content", "variant").alias("c"))
    c = c.withColumns({"_d": _list(F.col("c"), "$.deals"), "_n": _get(F.col("c"), "$.products[0].name", "string"), "brand": _get(F.col("c"), "$.products[0].brandName", "string")})
    c = c.withColumn("price_cents", _deal(F.col("_d"), "SALES_PRICE")).where("price_cents > 0")
    stated = _deal(F.col("_d"), "REGULAR_PRICE")
    advised = _deal(F.col("_d"), "RECOMMENDED_RETAIL_PRICE")
    badge = regular_from_badge(F.col("price_cents"), _get(F.col("c"), "$.discountLabel.type", "string"), _get(F.col("c"), "$.discountLabel.value", "string"))
    of = lambda kind: F.filter("_d", lambda d: _get(d, "$.type", "string") == kind)
    said = lambda d: F.filter(F.transform(_list(d, "$.conditions"), lambda x: _get(x, "$.other", "string")), lambda x: x.isNotNull())
    stated_unit = F.get(F.filter(F.transform(of("SALES_PRICE"), lambda d: F.trim(_get(d, "$.priceByBaseUnit", "string"))), lambda x: F.coalesce(x != "", F.lit(False))), F.lit(0))
    kilo = F.exists(F.flatten(F.transform(of("SALES_PRICE"), said)), lambda x: F.lower(F.regexp_replace(F.trim(x), r"\*+$", "")) == "kg-preis")
    lines = F.flatten(F.transform(of("OTHER"), lambda d: F.concat(F.split(F.coalesce(_get(d, "$.description", "string"), F.lit("")), r"\r?\n"), said(d))))
    note = F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, BONUS, 0)), lambda x: x != ""), F.lit(0))
    special = F.filter("_d", lambda d: (_get(d, "$.type", "string") == "SPECIAL_PRICE") & F.exists(_list(d, "$.conditions"), lambda x: F.lower(F.coalesce(_get(x, "$.other", "string"), F.lit(""))).contains("app")))
    return c.select(
        *keep, _get(F.col("c"), "$.id", "string").alias("id"), F.coalesce(F.nullif(F.trim(F.concat_ws(" ", "brand", "_n")), F.lit("")), F.lit("Angebot")).alias("name"), "brand", "price_cents",
        F.coalesce(F.when(stated > F.col("price_cents"), stated), F.when(advised > F.col("price_cents"), advised), badge).alias("regular_cents"),
        _get(F.col("c"), "$.products[0].description[0].paragraph", "string").alias("unit"),
        F.coalesce(stated_unit, F.when(kilo, F.concat(F.lit("1 kg = "), euros(F.col("price_cents"))))).alias("base_unit"), note.alias("note"),
        F.get(F.transform(special, lambda d: cents(_get(d, "$.max", "double"))), F.lit(0)).alias("app_cents"),
        F.filter(F.transform(_list(F.col("c"), "$.products[0].categoryPaths"), lambda x: _get(x, "$.name", "string")), lambda x: x.isNotNull()).alias("category_path"),
    )


def _text(v: Column, path: str) -> Column:
    """The trimmed text there; null if it is empty."""
    return F.nullif(F.trim(_get(v, path, "string")), F.lit(""))


def coupon_offers(pages: DataFrame, default_name: str = "Coupon", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, name, brand, price_cents, regular_cents, unit, per_unit, image_url, valid_from, valid_to) of coupon lists (column json).

    largePartNumeric is the price in euros, smallPartNumeric the one before; a coupon without the first is dropped. The unit is the first line of the packaging,
    else the price per unit. Without an id the title names the coupon, or its price.
    """
    o = pages.select(*keep, F.explode(_list(F.try_parse_json("json"), "$.offers")).alias("o"))
    at = lambda path: _text(F.col("o"), path)
    large, small = _get(F.col("o"), "$.priceBox.largePartNumeric", "double"), _get(F.col("o"), "$.priceBox.smallPartNumeric", "double")
    date = lambda k: F.try_to_date(F.substring(_get(F.col("o"), k, "string"), 1, 10))
    line = F.nullif(F.trim(F.get(F.split(_get(F.col("o"), "$.packaging", "string"), r"\r\n|\n|\r"), F.lit(0))), F.lit(""))
    rows = o.select(
        *keep, F.coalesce(at("$.id"), at("$.title"), large.cast("string")).alias("id"), F.coalesce(at("$.title"), F.lit(default_name)).alias("name"), at("$.brand").alias("brand"), cents(large).alias("price_cents"), cents(small).alias("regular_cents"),
        F.coalesce(line, at("$.pricePerUnit")).alias("unit"), at("$.pricePerUnit").alias("per_unit"), at("$.imageUrl").alias("image_url"), date("$.startValidityDate").alias("valid_from"), date("$.endValidityDate").alias("valid_to"),
    )
    return rows.where("price_cents is not null")


#: Fixed value: how a feed marks what no branch sells.
ONLINE_ONLY = "Nur Online Grafik"


def clearance_offers(pages: DataFrame, default_name: str = "Ausverkauf", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, name, brand, price_cents, regular_cents, base_unit, image_url, category_path) of clearance lists (column json).

    Only gross prices count. Dropped are rows marked as sold online only, without a readable price, or without an article number; a price before that isn't above the price is null.
    """
    p = pages.select(*keep, F.explode(_list(F.try_parse_json("json"), "$.products")).alias("p")).where(F.schema_of_variant(_get(F.col("p"), "$.tileData", "variant")).startswith("OBJECT"))
    at = lambda path: _get(F.col("p"), path, "string")
    online = F.exists(_list(F.col("p"), "$.tileData.eyecatchers"), lambda e: F.coalesce(_get(e, "$.alt", "string") == ONLINE_ONLY, F.lit(False)))
    now, before = money_cents(at("$.tileData.price.price.current.value")), money_cents(at("$.tileData.price.price.previous.value"))
    nodes = F.filter(_list(F.col("p"), "$.tileData.trackingData.categories"), lambda v: F.schema_of_variant(v) == "STRING")
    rows = p.where(~online).select(
        *keep, F.coalesce(at("$.dan"), at("$.tileData.dan")).alias("id"), F.coalesce(_text(F.col("p"), "$.title"), F.lit(default_name)).alias("name"), _text(F.col("p"), "$.brandName").alias("brand"), now.alias("price_cents"),
        F.when(before > now, before).alias("regular_cents"), base_unit_price(at("$.tileData.price.tileInfos[0]")).alias("base_unit"), at("$.tileData.images[0].tileSrc").alias("image_url"),
        F.filter(F.transform(nodes, lambda v: _get(v, "$", "string")), lambda x: F.trim(x) != "").alias("category_path"),
    )
    return rows.where("price_cents is not null and id is not null")


def batch(flyers: DataFrame, coupons: DataFrame, clearance: DataFrame) -> DataFrame:
    """The offers of all three feeds in one table: source, id, name, brand, price_cents, regular_cents, app_cents, unit, per_unit, note, image_url, category_path, valid_from, valid_to.

    What a feed doesn't have is null. Further columns that all three hold, such as the place they were asked for, are kept.
    """
    kinds = {"id": "string", "name": "string", "brand": "string", "price_cents": "long", "regular_cents": "long", "app_cents": "long", "unit": "string", "per_unit": "string", "note": "string", "image_url": "string", "category_path": "array<string>", "valid_from": "date", "valid_to": "date"}
    feeds = {"flyer": flyers.withColumnRenamed("base_unit", "per_unit"), "coupon": coupons, "clearance": clearance.withColumnRenamed("base_unit", "per_unit")}
    more = [c for c in flyers.columns if c not in (*kinds, "base_unit") and all(c in f.columns for f in feeds.values())]
    one = lambda name, df: df.select(F.lit(name).alias("source"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()], *more)
    rows = [one(*item) for item in feeds.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def history_records(rows: DataFrame) -> DataFrame:
    """(id, key, name, brand, cents, added) of saved records, a JSON array a row (column json): elements without key or name as text are dropped.

    A record's time is `addedAt`, in older ones `likedAt`; what is missing or of another type is null.
    """
    e = rows.select("id", F.explode(_list(F.try_parse_json("json"), "$")).alias("e"))
    typed = lambda path, kind: F.when(F.schema_of_variant(_get(F.col("e"), path, "variant")).isin(*kind), _get(F.col("e"), path, "string" if kind == ("STRING",) else "double"))
    number = ("BIGINT", "DOUBLE", "DECIMAL(1,0)", "DECIMAL(2,1)", "DECIMAL(3,1)")
    out = e.select("id", typed("$.key", ("STRING",)).alias("key"), typed("$.name", ("STRING",)).alias("name"), typed("$.brand", ("STRING",)).alias("brand"), typed("$.addedPriceCents", number).cast("long").alias("cents"), F.coalesce(typed("$.addedAt", number), typed("$.likedAt", number)).cast("long").alias("added"))
    return out.where("key is not null and name is not null")


def _walk(text: str | None, publisher: str | None) -> list[tuple]:
    """Every node below that has an id, a page count and an end of validity."""
    try:
        todo = [json.loads(text or "")]
    except ValueError:
        return []
    found: dict[str, tuple] = {}
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if {"id", "pageCount", "validUntil"} <= node.keys() and (publisher is None or node.get("publisher") == publisher) and isinstance(node["pageCount"], int):
                found.setdefault(str(node["id"]), (str(node["id"]), node["pageCount"], str(node["validUntil"])))
            todo += reversed(list(node.values()))
        elif isinstance(node, list):
            todo += reversed(node)
    return list(found.values())


def brochures(pages: DataFrame, publisher: str | None = None) -> DataFrame:
    """(page_id, id, pages, valid_until): brochures in the JSON blob of a page's html, at whatever depth; the first of an id counts."""
    kind = ArrayType(StructType([StructField("id", StringType()), StructField("pages", IntegerType()), StructField("valid_until", StringType())]))
    walk = F.udf(lambda text: _walk(text, publisher), kind, useArrow=True)  # recursion has no column form; one small blob a page
    blob = F.regexp_extract("html", r"(?s)<script[^>]*>\s*(?:window\.\w+\s*=\s*)?(\{.*?\})\s*;?\s*</script>", 1)
    return pages.where(blob != "").select("page_id", F.explode(walk(blob)).alias("_b")).select("page_id", "_b.id", "_b.pages", "_b.valid_until")


def current_brochures(df: DataFrame, today: Column, longest: int = 14, ahead: int = 8) -> DataFrame:
    """Of brochures (valid_from, valid_to): those active or starting by tomorrow; if there are none, the nearest within `ahead` days and a day after it."""
    rows = df.where((F.datediff("valid_to", "valid_from") <= longest) & (F.col("valid_to") >= today))
    rows = rows.withColumn("_soon", F.col("valid_from") <= F.date_add(today, 1))
    one = rows.agg(F.coalesce(F.bool_or("_soon"), F.lit(False)).alias("_any"), F.min("valid_from").alias("_first"))
    out = rows.crossJoin(F.broadcast(one))  # one row
    next_ = (F.col("_first") <= F.date_add(today, ahead)) & (F.col("valid_from") <= F.date_add("_first", 1))
    return out.where(F.when(F.col("_any"), F.col("_soon")).otherwise(next_)).drop("_soon", "_any", "_first")
