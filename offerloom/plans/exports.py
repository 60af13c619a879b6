"""Exports: nested candidate lists and numbered manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.operators.ranking import by_price, first_of


def candidates(df: DataFrame, categories: list[str], size: int = 12) -> DataFrame:
    """(chain, category, offers array): the cheapest of each chain and category, an empty list where there is none."""
    top = first_of(df.where(F.col("category").isin(*categories)), ["chain", "category"], by_price(), size, "_rank")
    lists = top.groupBy("chain", "category").agg(F.array_sort(F.collect_list(F.struct("_rank", "ext", "name", "price_cents"))).alias("offers"))  # at most `size`
    wanted = df.select("chain").distinct().withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    out = wanted.join(lists, ["chain", "category"], "left")
    return out.withColumn("offers", F.coalesce("offers", F.expr("cast(array() as array<struct<_rank:int,ext:string,name:string,price_cents:bigint>>)")))


def candidates_json(df: DataFrame, categories: list[str], size: int = 12) -> DataFrame:
    """One JSON document for each chain: category to list of offers."""
    rows = candidates(df, categories, size)
    return rows.groupBy("chain").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "offers"))))).alias("json"))


def manifest(df: DataFrame, per_sheet: int = 20, prefix: int = 4) -> DataFrame:
    """(sheet, cell, product, ext): distinct products by trimmed lower-case name, the first ext of each, in sheets.

    Products are numbered inside their first `prefix` characters, a task each, and after the products of smaller prefixes, which are counted.
    """
    product = F.lower(F.trim("name"))
    one = df.groupBy(product.alias("product")).agg(F.min("ext").alias("ext")).withColumn("_p", F.substring("product", 1, prefix))
    counts = one.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = one.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("product")) - 1).join(before, one["_p"].eqNullSafe(before["_p"]))
    n = F.col("_before") + F.col("_k")
    return ranked.select((F.floor(n / per_sheet) + 1).cast("int").alias("sheet"), (n % per_sheet + 1).cast("int").alias("cell"), "product", "ext")


def write_manifest(df: DataFrame, path: str) -> None:
    df.orderBy("sheet", "cell").write.mode("overwrite").csv(path, sep="\t", header=True)
