"""Which rows, chains and categories a view is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.operators.filters import in_vertical

#: The postal codes that the price history covers.
COVERED = (10115, 14199)


def covered_plz(plz: Column) -> Column:
    """Whether the text is a whole number among the covered postal codes."""
    number = F.trim(plz).try_cast("double")
    return F.coalesce((number == F.floor(number)) & number.between(*COVERED), F.lit(False))


def lands_on(df: DataFrame, chosen: list[str], by: str) -> DataFrame:
    """(by, lands): whether any of the chosen categories is served there."""
    return df.groupBy(by).agg(F.bool_or(F.col("category").isin(*chosen)).alias("lands"))


def companion_sections(df: DataFrame, *names: str) -> DataFrame:
    """The rows of several sections, which share none, one section after the other."""
    first, *rest = [df.where(in_vertical(n)).withColumn("section", F.lit(n)) for n in names]
    for other in rest:
        first = first.unionByName(other)
    return first


def comparison_scope(df: DataFrame, selected: list[str]) -> DataFrame:
    """(chain): the selected chains that are present, or all present ones if those are fewer than two."""
    present = df.select("chain").distinct().withColumn("_own", F.col("chain").isin(*selected) if selected else F.lit(False))
    enough = F.count_if("_own").over(Window.partitionBy()) >= 2  # a row for each chain
    return present.withColumn("_enough", enough).where(F.col("_own") | ~F.col("_enough")).select("chain")


def comparable_categories(df: DataFrame, scope: DataFrame, group: Column) -> DataFrame:
    """(category): those with a group that two chains of the scope or more sell."""
    cells = df.join(scope, "chain", "left_semi").where(group.isNotNull()).groupBy("category", group.alias("group")).agg(F.count_distinct("chain").alias("n"))
    return cells.where("n >= 2").select("category").distinct()


def active_category(categories: DataFrame, chosen: str | None) -> DataFrame:
    """(category): the chosen one if it is there, else the first."""
    order = [(F.col("category") == F.lit(chosen)).desc_nulls_last(), F.col("category").asc()]
    return categories.orderBy(*order).limit(1)


def division_of(texts: list[Column], divisions: list[tuple[str, list[str]]]) -> Column:
    """The first division of which a mark stands in any of the texts, in any case; null without one."""
    low = [F.lower(F.coalesce(t.cast("string"), F.lit(""))) for t in texts]
    out = F.lit(None).cast("string")
    for name, marks in reversed(divisions):
        hit = F.lit(False)
        for mark in marks:
            for t in low:
                hit = hit | F.contains(t, F.lit(mark))
        out = F.when(hit, name).otherwise(out)
    return out
