"""Upserts as functions of an old and a new table; writers replace whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.operators.filters import live_hides
from offerloom.operators.ranking import first_of


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of both, new ones replacing old ones of the same keys; of several new ones the first by `order` counts."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return first_of(both, keys, [F.col("_age").asc(), *order]).drop("_age")


def get_or_create(old: DataFrame, new: DataFrame, keys: list[str], refresh: list[str]) -> DataFrame:
    """Old rows, with the refreshed columns where the new value isn't null, and new rows whose keys are new."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in refresh])
    both = old.join(fresh, keys, "full")
    return both.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in refresh])


def toggled(chosen: DataFrame, value: str) -> DataFrame:
    """A set (column value) with one value added, or taken away if it was there."""
    one = chosen.sparkSession.range(1).select(F.lit(value).alias("value"))
    return chosen.join(one, "value", "left_anti").unionByName(one.join(chosen, "value", "left_anti"))


def toggled_hide(hides: DataFrame, key: str, since: Column, today: str) -> DataFrame:
    """Hides (key, since) with one added, or taken away if it was there; those that have run out go either way."""
    live = live_hides(hides, today).select("key", "since")
    one = hides.sparkSession.range(1).select(F.lit(key).alias("key"), since.cast("date").alias("since"))
    return live.join(one.select("key"), "key", "left_anti").unionByName(one.join(live.select("key"), "key", "left_anti"))


def toggled_store(hidden: DataFrame, chain: str, present: DataFrame) -> DataFrame:
    """Hidden chains (value) with one shown again, or hidden, unless it is the last of the chains present (chain) that can be seen."""
    one = hidden.sparkSession.range(1).select(F.lit(chain).alias("value"))
    chains = present.select("chain").distinct()
    seen = chains.where(F.col("chain") != chain).join(hidden.select(F.col("value").alias("chain")), "chain", "left_anti")
    there = chains.agg(F.coalesce(F.bool_or(F.col("chain") == chain), F.lit(False)).alias("_there")).crossJoin(seen.agg(F.count("*").alias("_others")))  # one row
    added = one.join(hidden, "value", "left_anti").crossJoin(F.broadcast(there)).where(~F.col("_there") | (F.col("_others") > 0)).select("value")
    return hidden.select("value").join(one, "value", "left_anti").unionByName(added)


def replace_table(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
