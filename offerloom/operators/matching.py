"""Joins between offers, names and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions.text import fold, norm_name
from offerloom.operators.multimatch import matching_pairs
from offerloom.operators.ranking import first_of, numbered


def cheapest_per_name(df: DataFrame, chain: str) -> DataFrame:
    """(key, ext, price_cents) of a chain's cheapest offer for each name; names without letters are left out."""
    own = df.where(F.col("chain") == chain).withColumn("key", norm_name("name")).where("key <> ''")
    best = own.groupBy("key").agg(F.min_by(F.struct("ext", "price_cents"), F.struct("price_cents", "ext")).alias("_b"))
    return best.select("key", "_b.ext", "_b.price_cents")


def two_chains(df: DataFrame, a: str, b: str) -> DataFrame:
    """(kind, key, a_cents, b_cents, gap, cheaper): names that both sell at different prices, and names only b sells."""
    one, two = cheapest_per_name(df, a), cheapest_per_name(df, b)
    one, two = one.select("key", F.col("price_cents").alias("a_cents")), two.select("key", F.col("price_cents").alias("b_cents"))
    both = two.join(one, "key", "left").where("a_cents is null or a_cents <> b_cents")
    return both.select(
        F.when(F.col("a_cents").isNull(), "only_b").otherwise("differs").alias("kind"), "key", "a_cents", "b_cents",
        F.abs(F.col("a_cents") - F.col("b_cents")).alias("gap"), F.when(F.col("a_cents") < F.col("b_cents"), a).when(F.col("a_cents") > F.col("b_cents"), b).alias("cheaper"),
    )


def keyword_matches(df: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("item",)) -> DataFrame:
    """Offers that hold any keyword of an item and none of its excluded words, in name and brand.

    items: item, keywords array<string>, exclude array<string>. Distinct (name, brand) pairs are matched, not offers, by one automaton of all words. keep: columns of items that go with
    each match, so that no join by item, of which there are few, has to bring them.
    """
    hay = fold(F.concat_ws(" ", "name", "brand"))
    pairs = df.select("name", "brand").distinct().withColumn("_hay", hay)
    wanted = items.select(*keep, F.transform("keywords", fold).alias("_want"), F.transform("exclude", fold).alias("_not"))
    found = matching_pairs(pairs, "_hay", wanted, list(keep)).select(*keep, F.col("name").alias("_n"), F.col("brand").alias("_b"))
    return df.join(found, df.name.eqNullSafe(found._n) & df.brand.eqNullSafe(found._b)).drop("_n", "_b")


def ranked_matches(df: DataFrame, items: DataFrame) -> DataFrame:
    """keyword_matches() with `rank`, the place among all matches of the item: the cheapest first, then by ext."""
    return numbered(keyword_matches(df, items), ["item"], [F.col("price_cents").asc(), F.col("ext").asc()])


def best_matches(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The cheapest match of each item (and of each further key)."""
    return first_of(matches, keys, [F.col("price_cents").asc(), F.col("ext").asc()])


def compare_chains(df: DataFrame, group: Column, chains: list[str], category: str | None = None) -> DataFrame:
    """(group, label, chain, ext, price_cents, spread, cheapest, position): each chain's cheapest offer of a group, for groups that two of the chains or more sell.

    chains: the ones compared, in their order; of equally cheap offers the first chain's is flagged. category: only its offers. Groups stand by spread, the largest
    first, then by label in German order; the label is that of the group's offer with the smallest ext.
    """
    own = df.where(group.isNotNull() & (group != "") & F.col("chain").isin(*chains))
    own = own if category is None else own.where(F.col("category") == category)
    label = F.coalesce(F.col("group_label"), group) if "group_label" in df.columns else group
    cell = own.groupBy(group.alias("group"), "chain").agg(F.min(F.struct("price_cents", "ext")).alias("_b"), F.min(F.struct(F.col("ext"), label.alias("label"))).alias("_l"))
    by, place = Window.partitionBy("group"), F.array_position(F.array(*map(F.lit, chains)), F.col("chain"))
    out = cell.withColumns({
        "_n": F.count("*").over(by), "price_cents": F.col("_b.price_cents"), "spread": F.max("_b.price_cents").over(by) - F.min("_b.price_cents").over(by), "label": F.min("_l").over(by)["label"],
        "_first": F.row_number().over(by.orderBy("_b.price_cents", place)),
    }).where("_n >= 2")
    rows = out.groupBy("group", "label", "spread").agg(F.collect_list(F.struct("chain", "_b.ext", "price_cents", (F.col("_first") == 1).alias("cheapest"))).alias("_c"))  # a row for each group, a cell for each chain
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy(F.desc("spread"), F.collate("label", "de"), "group")))
    return rows.select("group", "label", "spread", "position", F.inline("_c"))


def name_tokens(text: Column | str) -> Column:
    """The words of a name's key; none for null or for a name without letters."""
    return F.filter(F.split(F.coalesce(norm_name(text), F.lit("")), " "), lambda t: t != "")


def brand_matches(items: DataFrame, now: DataFrame) -> DataFrame:
    """items (key, brand, any others) with the offers of their brand: the items' columns but the brand, and the offers'.

    The offer's brand is the same, or holds all words of the item's; only an offer without a brand is searched by name. The item's words meet
    the offers' words in an equi-join: distinct (brand, name) pairs are split into words, and an item looks for its longest word.
    """
    want = name_tokens("brand")
    own_columns = [c for c in items.columns if c != "brand"]
    wanted = items.select(*own_columns, want.alias("_want")).where(F.size("_want") > 0)
    wanted = wanted.withColumn("_word", F.array_max(F.transform("_want", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"])
    own = name_tokens("brand")
    pairs = now.select("brand", "name").distinct().withColumn("_have", F.when(F.size(own) > 0, own).otherwise(name_tokens("name")))
    words = pairs.withColumn("_word", F.explode(F.array_distinct("_have")))
    found = words.join(wanted, "_word").where(F.size(F.array_except("_want", "_have")) == 0).select(*own_columns, F.col("brand").alias("_b"), F.col("name").alias("_n"))
    return now.join(found, now.brand.eqNullSafe(found._b) & now.name.eqNullSafe(found._n)).drop("_b", "_n")


def history_tiers(history: DataFrame, df: DataFrame, related: int = 8) -> DataFrame:
    """(key, tier, ext, rank): 1 for the same name, all of them, cheapest first; without any, the `related` best of tier 2 or 3.

    history: key, brand, group, tokens. Tier 2, the same brand, is for items that have a brand, tier 3, the same group, only for those without one.
    More shared name words come first, then the cheaper.
    """
    now = df.select("ext", "name", "brand", "price_cents", norm_name("name").alias("_name"), F.col("category").alias("_group"))
    items = history.select("key", F.col("brand").alias("_brand"), "group", "tokens")
    kept = ["key", "tokens", "ext", "name", "price_cents"]  # what a match is ranked by goes with it: no join by key, of which there are few, brings it
    exact = items.join(now, items.key == now._name).select(*kept)
    rest = items.join(exact.select("key").distinct(), "key", "left_anti")
    branded = F.coalesce(F.col("_brand"), F.lit("")) != ""
    brand = brand_matches(rest.where(branded).select("key", F.col("_brand").alias("brand"), "tokens"), now).select(*kept, F.lit(2).alias("tier"))
    alone = rest.where(~branded)
    group = alone.join(now, alone.group == now._group).select(*kept, F.lit(3).alias("tier"))
    shared = F.size(F.filter(name_tokens("name"), lambda t: F.array_contains("tokens", t)))
    best = first_of(brand.unionByName(group), ["key"], [shared.desc(), F.col("price_cents").asc(), F.col("ext").asc()], related, "rank")
    every = numbered(exact.select("key", "ext", "price_cents", F.lit(1).alias("tier")), ["key"], [F.col("price_cents").asc(), F.col("ext").asc()])
    names = ["key", "tier", "ext", "rank"]
    return every.select(*names).unionByName(best.select(*names))
