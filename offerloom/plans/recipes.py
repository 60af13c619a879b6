"""Recipes priced with what is on offer.

recipes: pos, recipe, tags array<string>, ingredients array<struct<label, keywords array<string>, exclude array<string>, staple boolean>>. An ingredient is
matched like an item of a shopping list; all ingredients of a cookbook are looked up by one automaton in distinct names and brands.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions.text import fold
from offerloom.operators.filters import chain_lens
from offerloom.operators.multimatch import matching_pairs

RECIPES = "pos int, recipe string, tags array<string>, ingredients array<struct<label:string,keywords:array<string>,exclude:array<string>,staple:boolean>>"


class Wishes(NamedTuple):
    """What a cook asks for."""

    stores: tuple[str, ...] = ()  # shop there only, if any of them has offers
    diet: str | None = None
    cuisine: str | None = None
    only_on_sale: bool = False  # nothing is left to buy
    cheapest_kg: bool = False  # by the sum of unit prices instead of the number on sale
    count: int = 20


def suits(tags: Column, diet: str | None) -> Column:
    """Whether a recipe's tags fit a diet: vegan is vegetarian too, `no-pork` is the absence of pork, any other diet a tag of its own."""
    if not diet:
        return F.lit(True)
    if diet == "vegetarian":
        return F.arrays_overlap(tags, F.array(F.lit("vegetarian"), F.lit("vegan")))
    return ~F.array_contains(tags, "pork") if diet == "no-pork" else F.array_contains(tags, diet)


def at_home(keywords: Column, pantry: list[str]) -> Column:
    """A pantry word and one of the keywords hold one another, either way round."""
    if not pantry:
        return F.lit(False)
    return F.exists(F.transform(keywords, fold), lambda w: F.exists(F.transform(F.array(*map(F.lit, pantry)), fold), lambda p: F.contains(w, p) | F.contains(p, w)))


def resolved(recipes: DataFrame, df: DataFrame, pantry: list[str]) -> DataFrame:
    """(recipe, pos, label, staple, role, ext, chain, price_cents, unit_cents) of every ingredient.

    role: on_sale with the cheapest matching offer, else have for staples and what is at home, else buy. df: offers with unit_cents.
    """
    parts = recipes.select("recipe", F.posexplode("ingredients").alias("pos", "_i")).select("recipe", "pos", "_i.*")
    need = F.struct("keywords", F.coalesce("exclude", F.expr("cast(array() as array<string>)")).alias("exclude"))
    parts = parts.withColumn("_need", need)
    names = df.groupBy("name", "brand").agg(F.min(F.struct("price_cents", "ext", "chain", "unit_cents")).alias("_b")).withColumn("_hay", fold(F.concat_ws(" ", "name", "brand")))
    wanted = parts.select("_need").distinct().withColumns({"_want": F.transform("_need.keywords", fold), "_not": F.transform("_need.exclude", fold)})
    best = matching_pairs(names, "_hay", wanted, ["_need"]).groupBy("_need").agg(F.min("_b").alias("_b"))
    have = F.coalesce("staple", F.lit(False)) | at_home(F.col("keywords"), pantry)
    role = F.when(F.col("_b").isNotNull(), "on_sale").when(have, "have").otherwise("buy")
    return parts.join(best, "_need", "left").select("recipe", "pos", "label", F.coalesce("staple", F.lit(False)).alias("staple"), role.alias("role"), "_b.*")


def ranked(recipes: DataFrame, df: DataFrame, wishes: Wishes = Wishes(), pantry: list[str] | None = None) -> DataFrame:
    """(recipe, on_sale, to_buy, cost, unit_sum, rank): the recipes that fit, best first, at most wishes.count.

    cost and unit_sum, the sums of prices and unit prices on sale, are null if there are none. Recipes with more on sale come first, or by unit_sum, null last; of equal ones
    the earlier in the book. Stores that have no offers don't count; if none has, all stores do.
    """
    fit = recipes.where(suits(F.col("tags"), wishes.diet))
    fit = fit if not wishes.cuisine else fit.where(F.array_contains("tags", wishes.cuisine))
    pool = chain_lens(df, list(wishes.stores)) if wishes.stores else df
    sale = F.col("role") == "on_sale"
    sums = resolved(fit, pool, pantry or []).groupBy("recipe").agg(F.count_if(sale).alias("on_sale"), F.count_if(F.col("role") == "buy").alias("to_buy"), F.sum("price_cents").alias("cost"), F.sum("unit_cents").alias("unit_sum"))
    none = F.lit(0).cast("long")
    out = fit.select("recipe", F.col("pos").alias("_pos")).join(sums, "recipe", "left").select("recipe", "_pos", F.coalesce("on_sale", none).alias("on_sale"), F.coalesce("to_buy", none).alias("to_buy"), "cost", "unit_sum")
    out = out.where("to_buy = 0") if wishes.only_on_sale else out
    order = [F.asc_nulls_last("unit_sum") if wishes.cheapest_kg else F.desc("on_sale"), F.asc("_pos"), F.asc("recipe")]
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= wishes.count).drop("_pos")  # a cookbook's length


def chains_of(recipes: DataFrame, df: DataFrame) -> DataFrame:
    """(recipe, chains): the chains of its cheapest offers, in the order of the ingredients; staples send nobody to a store."""
    rows = resolved(recipes, df, []).where("role = 'on_sale' and not staple").select("recipe", F.struct("pos", "chain").alias("_c"))
    lists = rows.groupBy("recipe").agg(F.array_distinct(F.array_sort(F.collect_list("_c"))["chain"]).alias("chains"))
    return recipes.select("recipe").join(lists, "recipe", "left").select("recipe", F.coalesce("chains", F.expr("cast(array() as array<string>)")).alias("chains"))
