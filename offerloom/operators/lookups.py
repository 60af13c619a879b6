"""Lookups that rank their answers: price index by chain, catalogue items, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions.text import fold
from offerloom.operators.multimatch import matching_pairs
from offerloom.operators.ranking import first_of


def price_lookup(items: DataFrame, index: DataFrame) -> DataFrame:
    """items (key, chain) with cents and cross: the entry of their own chain, else of the first other chain by name; null if none."""
    wanted = items.select("key", "chain").distinct()
    found = wanted.join(index.select("key", F.col("chain").alias("_c"), "cents"), "key", "left")
    one = first_of(found, ["key", "chain"], [(F.col("_c") == F.col("chain")).desc_nulls_last(), F.col("_c").asc_nulls_last(), F.col("cents").asc_nulls_last()])
    return one.select("key", "chain", "cents", (F.col("_c") != F.col("chain")).alias("cross"))


def misses(items: DataFrame, index: DataFrame) -> DataFrame:
    return items.select("key").distinct().join(index.select("key").distinct(), "key", "left_anti")


def resolve_items(offers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(name, brand, category, group, label, item, step): what a list calls each distinct offer.

    An offer with a group is the first catalogue item whose label is the group's label, else the first with such a keyword, else an item of the group's own.
    Without a group it is the item of the longest keyword in name and brand, half a letter more for the offer's own category, of equal ones the first;
    items with an excluded word don't count. Without any it is an item of its own name. catalogue: pos, item, label, category, keywords, exclude. Labels and keywords
    meet the offers' groups in an equi-join, names are searched by one automaton of all keywords; offers are made distinct first.
    """
    key = ["name", "brand", "category", "group", "label"]
    rows = offers.select(*key).distinct().withColumns({"_id": F.struct(*key), "_text": fold(F.coalesce("label", "group")), "_hay": fold(F.concat_ws(" ", "name", "brand"))})
    none = F.expr("cast(array() as array<string>)")
    items = catalogue.select("pos", "item", fold("label").alias("_label"), F.col("category").alias("_category"), F.transform("keywords", fold).alias("_want"), F.transform(F.coalesce("exclude", none), fold).alias("_not"))
    words = items.select("pos", "item", F.explode(F.concat(F.array(F.struct(F.lit(0.0).alias("score"), F.col("_label").alias("_text"))), F.transform("_want", lambda k: F.struct(F.lit(1.0).alias("score"), k.alias("_text"))))).alias("_w")).select("pos", "item", "_w.*")
    grouped = rows.where("group is not null").join(words, "_text").select("_id", "item", F.struct("score", "pos").alias("_order"))
    alone = matching_pairs(rows.where("group is null").select("_id", "_hay"), "_hay", items.withColumn("_keys", F.col("_want")), ["pos", "item", "_category", "_keys"])
    length = F.array_max(F.transform(F.filter("_keys", lambda k: F.contains(F.col("_hay"), k)), F.length)) + F.when(F.col("_category") == F.col("_id.category"), 0.5).otherwise(0.0)
    found = grouped.unionByName(alone.select("_id", "item", F.struct((-length).alias("score"), "pos").alias("_order")))
    best = found.groupBy("_id").agg(F.min_by("item", "_order").alias("_item"))
    out = rows.select("_id").join(best, "_id", "left")
    own = F.when(F.col("_id.group").isNotNull(), F.concat(F.lit("grp:"), F.col("_id.group"))).otherwise(F.concat(F.lit("ofr:"), fold("_id.name")))
    step = F.when(F.col("_item").isNull(), "own").when(F.col("_id.group").isNotNull(), "group").otherwise("name")
    return out.select("_id.*", F.coalesce("_item", own).alias("item"), step.alias("step"))


def catalogue_suggestions(catalogue: DataFrame, basket: DataFrame, typed: str, popular: list[str], limit: int = 12) -> DataFrame:
    """(key, position): what to add to a list (basket.key): catalogue items whose English or German name, key or a keyword holds the typed text.

    catalogue: pos, key, en, de, keywords. Nothing typed: the popular keys in their order. The text is cut into pairs of letters; an index from pairs to items,
    built by Spark from the catalogue, gives the items that hold them all, and these are verified.
    """
    pool = catalogue.join(basket.select("key").distinct(), "key", "left_anti")
    text = typed.strip()
    if not text:
        place = F.array_position(F.array(*map(F.lit, popular)), F.col("key")) if popular else F.lit(0)
        pool = pool.withColumn("_place", place).where("_place > 0")
    else:
        needle = fold(F.lit(text))
        terms = F.concat(F.array(fold("en"), fold("de"), F.col("key")), F.transform("keywords", fold))
        holding = pool.select("key", F.explode(terms).alias("_term"))
        pairs = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2))))
        index = holding.select("key", "_term", F.explode(pairs(F.col("_term"))).alias("_pair"))
        asked = catalogue.sparkSession.range(1).select(pairs(needle).alias("_all"), needle.alias("_needle")).select("_needle", F.size("_all").alias("_n"), F.explode("_all").alias("_pair"))
        if len(text) > 1:
            held = index.join(F.broadcast(asked), "_pair").groupBy("key", "_term", "_needle", "_n").agg(F.count("*").alias("_met")).where("_met = _n and contains(_term, _needle)")  # the pairs of one text
        else:
            held = holding.where(F.contains("_term", needle))
        pool = pool.join(held.select("key").distinct(), "key", "left_semi").withColumn("_place", F.col("pos"))
    rows = pool.orderBy("_place", "key").limit(limit)
    return rows.select("key", F.row_number().over(Window.orderBy("_place", "key")).alias("position"))  # at most `limit` rows


def suggestions(groups: DataFrame, basket: DataFrame, shown: DataFrame, typed: str, limit: int = 12) -> DataFrame:
    """Groups on offer (key, label, and item_label and keywords of what a list calls them) that neither the basket nor the catalogue keys shown hold.

    Their label, their item's label or a keyword holds what was typed. In the order of groups_on_offer().
    """
    needle = fold(F.lit(typed.strip()))
    rows = groups.join(basket.select("key").distinct(), "key", "left_anti").join(shown.select("key").distinct(), "key", "left_anti")
    rows = rows.where(F.contains(fold("label"), needle) | F.contains(fold("item_label"), needle) | F.exists("keywords", lambda k: F.contains(fold(k), needle)))
    return rows.orderBy(F.collate("category_label", "de"), F.collate("label", "de"), "key").limit(limit)


def groups_on_offer(df: DataFrame, key: Column, label: Column, category_label: Column) -> DataFrame:
    """(key, label, category_label, position): distinct groups; the row of the smallest ext supplies the labels. By category label, then label, in German order."""
    rows = df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.min_by(F.struct(F.coalesce(label, key).alias("label"), category_label.alias("category_label")), "ext").alias("_l"))
    order = [F.collate("_l.category_label", "de"), F.collate("_l.label", "de"), F.col("key")]
    return rows.select("key", "_l.*", F.row_number().over(Window.orderBy(*order)).alias("position"))  # groups are few


def missing_chains(df: DataFrame, known: list[str]) -> DataFrame:
    """Known chains without a row: placeholders to append."""
    every = df.sparkSession.createDataFrame([(c,) for c in known], "chain string")
    return every.join(df.select("chain").distinct(), "chain", "left_anti")
