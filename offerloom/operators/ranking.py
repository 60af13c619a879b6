"""Duplicates, top-k and shelves. Every order ends in ext, which is unique, so results don't hang on the layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of(df: DataFrame, keys: list[Column | str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The n first rows of each group; Spark prunes each partition to n before the shuffle. rank: name of a column to keep."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def numbered(df: DataFrame, groups: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """df with each row's place in its group by `order`, however large a group is: rows are sorted into ranges by (group, order), written to the shared checkpoint folder so that every reader
    sees the same ranges, and numbered within their range, after the rows of the group that stand in earlier ranges."""
    from offerloom.sources.ingest import shared_folder

    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    ranges = df.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)
    counts = ranges.groupBy("_range", *groups).agg(F.count("*").alias("_n"))  # a row for each range and group in it
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = counts.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], before.alias("_before"))
    own = ranges.withColumn("_place", F.row_number().over(Window.partitionBy("_range", *groups).orderBy(*order)))
    same = own["_range"] == begun["_r"]
    for i, g in enumerate(groups):
        same = same & own[g].eqNullSafe(begun[f"_g{i}"])
    out = own.join(F.broadcast(begun), same)
    return out.select(*df.columns, (F.col("_before") + F.col("_place")).cast("int").alias(rank))


def serve_order() -> list[Column]:
    """Of duplicates, which one is served: with a price per unit, the larger discount, a flyer, with an image, the smallest ext."""
    return [F.col("per_unit").isNotNull().desc(), F.coalesce("discount_pct", F.lit(-1.0)).desc(), (F.col("source") == "flyer").desc(), F.col("image_url").isNotNull().desc(), F.col("ext").asc()]


def serve_dedup(df: DataFrame, key: Column) -> DataFrame:
    """One row for each store, name key and price."""
    return first_of(df.withColumn("_key", key), ["store_id", "_key", "price_cents"], serve_order()).drop("_key")


def scrape_order() -> list[Column]:
    """Of duplicates in a feed, which one is kept: with a price per unit, a strike price above the price, an image; of equals the largest ext."""
    return [F.col("per_unit").isNotNull().desc(), F.coalesce(F.col("regular_cents") > F.col("price_cents"), F.lit(False)).desc(), F.col("image_url").isNotNull().desc(), F.col("ext").desc()]


def scrape_dedup(df: DataFrame, key: Column) -> DataFrame:
    """One row for each name key and price over all stores."""
    return first_of(df.withColumn("_key", key), ["_key", "price_cents"], scrape_order()).drop("_key")


def last_wins(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return first_of(df, [key], order)


def by_discount() -> list[Column]:
    return [F.coalesce("discount_pct", F.lit(-1.0)).desc(), F.col("ext").asc()]


def by_price() -> list[Column]:
    return [F.col("price_cents").asc(), F.col("ext").asc()]


MODES = ("price", "discount", "unit")


def headline_discount() -> Column:
    """Per cent off as shown: of an app price below the price, against the regular price or else the price, rounded half up; else discount_pct. An app price is column app_cents."""
    app, before = F.col("app_cents"), F.coalesce("regular_cents", "price_cents")
    off = F.when(before > app, F.floor((before - app) * 100 / before + 0.5).cast("double"))
    return F.when(F.coalesce(app < F.col("price_cents"), F.lit(False)), off).otherwise(F.col("discount_pct"))


def sort_value(mode: Column, unit_cents: Column, discount: Column) -> Column:
    """What a row is ordered by, smallest first and null last, in its mode: price, unit price, or the discount, largest first. One order serves rows of different modes."""
    return F.when(mode == "unit", unit_cents.cast("double")).when(mode == "price", F.col("price_cents").cast("double")).otherwise(-discount)


def sort_key(mode: str | Column, unit_cents: Column) -> list[Column]:
    """Order of a listing: price, discount or unit price; rows without the value come last, equal ones by ext."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return [sort_value(mode, unit_cents, F.col("discount_pct")).asc_nulls_last(), F.col("ext").asc()]


#: Categories that start sorted by discount; all others start by unit price.
BY_DISCOUNT = ("household",)


def mode_of(category: Column, chosen: dict[str, str] | None = None, overall: str = "discount") -> Column:
    """The mode in force: the one chosen for the category, else the category's default; the overall one where no category is shown (null)."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair]), category) if chosen else F.lit(None).cast("string")
    return F.when(category.isNull(), overall).otherwise(F.coalesce(own, F.when(category.isin(*BY_DISCOUNT), "discount").otherwise("unit")))


def listing(df: DataFrame, order: list[Column], limit: int = 2000) -> DataFrame:
    """The first rows of an order, numbered. The limit comes after the order, which Spark runs as a top-k."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _labelled(df: DataFrame, wanted: list[str], labels: dict[str, str]) -> DataFrame:
    """Rows of the wanted categories with position, the place asked for, and label: the given one, else the row's own (column category_label), else the slug."""
    if not wanted:
        return df.limit(0).withColumns({"position": F.lit(1), "label": F.col("category")})
    given = F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col("category")) if labels else F.lit(None).cast("string")
    own = F.col("category_label") if "category_label" in df.columns else F.lit(None).cast("string")
    rows = df.where(F.col("category").isin(*wanted))
    return rows.withColumns({"position": F.array_position(F.array(*map(F.lit, wanted)), F.col("category")).cast("int"), "_own": F.coalesce(given, own, F.col("category"))})


def _shown(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first rows of each category, with its total, and the label of the first of them."""
    totals = rows.groupBy("category").agg(F.count("*").alias("total"))
    top = first_of(rows, ["category"], order, size, "rank").join(totals, "category")
    return top.withColumn("label", F.first("_own").over(Window.partitionBy("category").orderBy("rank"))).drop("_own")  # `size` rows of each


def shelves(df: DataFrame, wanted: list[str], labels: dict[str, str], chosen: dict[str, str] | None = None, size: int = 5) -> DataFrame:
    """(position, category, label, total, rank, ...): the first rows of each wanted category by its own mode, in the order asked for; categories without rows are left out. df: with unit_cents, app_cents."""
    rows = _labelled(df, wanted, labels)
    order = [sort_value(mode_of(F.col("category"), chosen), F.col("unit_cents"), headline_discount()).asc_nulls_last(), F.col("ext").asc()]
    return _shown(rows, order, size)


def cards(df: DataFrame, wanted: list[str], labels: dict[str, str], chosen: dict[str, str] | None = None, size: int = 3) -> DataFrame:
    """The same with the most discounted rows first, filled up with the category's best others by its own mode: one order says both, as a filler only comes once every discounted row is in."""
    rows = _labelled(df, wanted, labels).withColumn("_off", headline_discount())
    own = sort_value(mode_of(F.col("category"), chosen), F.col("unit_cents"), F.col("_off"))
    order = [F.col("_off").isNotNull().desc(), F.col("_off").desc_nulls_last(), F.when(F.col("_off").isNull(), own).asc_nulls_last(), F.col("ext").asc()]
    return _shown(rows, order, size).drop("_off")


def sections(df: DataFrame, mode: str) -> DataFrame:
    """(position, group, label, n, from_cents, muted, rank, ...): a category's rows under the heads of their groups.

    Groups stand by size, the largest first, then by label in German order; the label is that of the group's first row in the list's order (group_label, else the group). Rows without
    a group come last under `More`, or without a head if there are no groups. Rows stand by `mode`. df: with group, group_label, unit_cents, app_cents.
    """
    order = [sort_value(F.lit(mode), F.col("unit_cents"), headline_discount()).asc_nulls_last(), F.col("ext").asc()]
    rows = df.withColumn("group", F.nullif("group", F.lit("")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(*order)))
    first = F.struct("rank", F.coalesce("group_label", "group").alias("label"))
    heads = ranked.groupBy("group").agg(F.count("*").alias("n"), F.min("price_cents").alias("_least"), F.min(first)["label"].alias("_label"))
    rest = F.col("group").isNull()
    heads = heads.withColumns({"muted": rest, "_heads": F.count("*").over(Window.partitionBy())})  # a row for each group
    heads = heads.withColumns({"label": F.when(~rest, F.col("_label")).when(F.col("_heads") > 1, "More"), "from_cents": F.when(~rest, F.col("_least"))})
    place = F.row_number().over(Window.orderBy(rest.asc(), F.desc("n"), F.collate(F.coalesce("_label", F.lit("")), "de"), "group"))
    heads = heads.withColumn("position", place).select(F.col("group").alias("_g"), "position", "label", "n", "from_cents", "muted")
    return ranked.join(heads, ranked.group.eqNullSafe(heads._g)).drop("_g", "group_label")
