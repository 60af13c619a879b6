"""Which store, or stores, for a list of categories or items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions.validity import valid_on
from offerloom.operators.filters import equal_to
from offerloom.operators.matching import keyword_matches


def cheapest_cells(df: DataFrame, categories: list[str], today: str, plz: str | None = None) -> DataFrame:
    """(store_id, chain, category, ext, price_cents): the cheapest valid offer of each store and category, of a postal code if one is given; no categories: all."""
    own = equal_to(df, plz=plz).where(valid_on(F.col("valid_to"), today))
    own = own.where(F.col("category").isin(*categories)) if categories else own
    best = own.groupBy("store_id", "category").agg(F.min(F.struct("price_cents", "ext", "chain")).alias("_b"))
    return best.select("store_id", "_b.chain", "category", "_b.ext", "_b.price_cents")


def _single(cells: DataFrame, key: str, found: str, total: str) -> DataFrame:
    """One row (key, found, total): the key with the most cells, then the least total, then the smallest key."""
    sums = cells.groupBy(key).agg(F.count("*").alias(found), F.sum("price_cents").alias(total))
    best = sums.agg(F.min_by(F.struct(key, found, total), F.struct(-F.col(found), F.col(total), F.col(key))).alias("_b"))
    return best.where("_b is not null").select("_b.*")


def _lacking(categories: list[str], found: Column) -> Column:
    """The categories asked for that are not among those found, in the order asked."""
    return F.array_except(F.array(*map(F.lit, categories)), found) if categories else F.expr("cast(array() as array<string>)")


def single_store(df: DataFrame, categories: list[str], today: str, plz: str | None = None) -> DataFrame:
    """The store that covers the most categories, then the cheapest, then the smallest id: its picks, its total, and the categories it lacks."""
    cells = cheapest_cells(df, categories, today, plz)
    own = cells.join(F.broadcast(_single(cells, "store_id", "covered", "total")), "store_id")  # one row
    every = Window.partitionBy()  # over the picks: at most a row for each category
    return own.select("store_id", "chain", "category", "ext", "price_cents", "covered", "total", _lacking(categories, F.collect_set("category").over(every)).alias("missing"))


def many_stores(df: DataFrame, categories: list[str], today: str, plz: str | None = None) -> DataFrame:
    """The cheapest offer of each category over all stores: each store's subtotal, the total, what is missing, and what it saves against single_store().

    All comes from the cells of store and category, which Spark computes once and reads again from their exchange.
    """
    cells = cheapest_cells(df, categories, today, plz)
    best = cells.groupBy("category").agg(F.min(F.struct("price_cents", "store_id", "ext", "chain")).alias("_b"))
    every = Window.partitionBy()  # over the picks: at most a row for each category
    picks = best.select("category", "_b.*").withColumns({
        "subtotal": F.sum("price_cents").over(Window.partitionBy("store_id")), "total": F.sum("price_cents").over(every), "n_stores": F.size(F.collect_set("store_id").over(every)).cast("long"),
        "missing": _lacking(categories, F.collect_set("category").over(every)),
    })
    out = picks.crossJoin(F.broadcast(_single(cells, "store_id", "_covered", "single_total").drop("store_id", "_covered")))  # one row
    return out.select("category", "store_id", "chain", "ext", "price_cents", "subtotal", "total", "n_stores", "single_total", F.greatest(F.col("single_total") - F.col("total"), F.lit(0)).alias("savings"), "missing")


def response(df: DataFrame, categories: list[str], store_count: int, today: str, plz: str | None = None) -> DataFrame:
    """One row, whatever there is: (store_count, baskets array<struct<store_id, chain, subtotal, items>>, total, single_total, savings, missing).

    With store_count 1 the best single store, which saves nothing; with more the cheapest picks of any number of stores. Without offers there are no baskets and all is missing.
    """
    if store_count <= 1:
        picks = single_store(df, categories, today, plz).withColumns({"subtotal": F.col("total"), "single_total": F.col("total"), "savings": F.lit(0).cast("long")})
    else:
        picks = many_stores(df, categories, today, plz)
    items = F.array_sort(F.collect_list(F.struct("category", "ext", "price_cents")))
    baskets = picks.groupBy("store_id", "chain", "subtotal", "total", "single_total", "savings", "missing").agg(items.alias("items"))
    whole = baskets.groupBy().agg(F.array_sort(F.collect_list(F.struct("store_id", "chain", "subtotal", "items"))).alias("baskets"), *[F.first(c).alias(c) for c in ("total", "single_total", "savings", "missing")])
    zero, every = F.lit(0).cast("long"), F.array(*map(F.lit, categories)) if categories else F.expr("cast(array() as array<string>)")
    return whole.select(F.size("baskets").alias("store_count"), "baskets", F.coalesce("total", zero).alias("total"), "single_total", F.coalesce("savings", zero).alias("savings"), F.coalesce("missing", every).alias("missing"))


def basket_plan(df: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each item, matched or not: its offer, the leg of the trip it belongs to, the plan's total, and the one chain that matches the most items at the least cost.

    items: item, keywords, exclude, and pick, the ext of an offer chosen by hand, which counts as long as it matches; else the cheapest match is taken. matches is the number of
    matching offers; leg orders the chains by subtotal, the dearest first. savings is null unless the single chain covers as many items as the plan.
    All comes from the cells of chain and item.
    """
    items = items.withColumn("_pick", F.col("pick") if "pick" in items.columns else F.lit(None).cast("string"))
    found = keyword_matches(df, items, ("item", "_pick"))
    offer = F.struct("price_cents", "ext", "chain")
    cells = found.groupBy("chain", "item").agg(F.min(offer).alias("_b"), F.min(F.when(F.col("ext") == F.col("_pick"), offer)).alias("_p"), F.count("*").alias("_n"))
    chosen = cells.groupBy("item").agg(F.coalesce(F.min("_p"), F.min("_b")).alias("_b"), F.sum("_n").alias("matches")).select("item", "_b.*", "matches")
    every = Window.partitionBy()  # at most a row for each item of the list
    legs = chosen.withColumns({"matched": F.count("*").over(every), "total": F.sum("price_cents").over(every), "subtotal": F.sum("price_cents").over(Window.partitionBy("chain"))})
    legs = legs.withColumn("leg", F.dense_rank().over(Window.orderBy(F.desc("subtotal"), "chain")))
    single = _single(cells.select("chain", "item", "_b.price_cents"), "chain", "single_items", "single_total").withColumnRenamed("chain", "single_chain")
    saved = F.when(F.col("single_items") == F.col("matched"), F.col("single_total") - F.col("total"))
    rows = legs.crossJoin(F.broadcast(single)).withColumn("savings", saved)  # one row
    return items.select("item").join(rows, "item", "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
