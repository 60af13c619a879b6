"""Data-quality gates: each returns the figures and whether they pass."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total_floor(df: DataFrame, floor: int, limit: int = 2000) -> DataFrame:
    """(n, enough, truncated): a count that equals the serving limit was probably cut there."""
    return df.agg(F.count("*").alias("n")).select("n", (F.col("n") >= floor).alias("enough"), (F.col("n") == limit).alias("truncated"))


def chain_floors(df: DataFrame, floor: int, strict: bool) -> DataFrame:
    """(chain, n, passes): the floor holds only after the weekly reset (strict); an absent chain can't be seen here."""
    return df.groupBy("chain").agg(F.count("*").alias("n")).withColumn("passes", (F.col("n") >= floor) | F.lit(not strict))


def coverage(df: DataFrame, value: Column, floor: float, by: str) -> DataFrame:
    """(by, pct, passes): the share of rows with a value."""
    return df.groupBy(by).agg(F.round(F.avg(value.isNotNull().cast("int")) * 100, 4).alias("pct")).withColumn("passes", F.col("pct") >= floor)


def self_disagreement(df: DataFrame, name: Column) -> DataFrame:
    """(names, disagreeing): names served twice or more, and those of them under more than one category."""
    by = df.groupBy(name.alias("_k")).agg(F.count("*").alias("_n"), F.count_distinct("category").alias("_c")).where("_n >= 2")
    return by.agg(F.count("*").alias("names"), F.count_if(F.col("_c") > 1).alias("disagreeing"))


def transition_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, n): rows added, removed, moved to another slug, or the same (columns id, slug)."""
    a, b = old.select("id", F.col("slug").alias("_a")), new.select("id", F.col("slug").alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "moved").otherwise("same")
    return a.join(b, "id", "full").groupBy(kind.alias("change")).agg(F.count("*").alias("n"))


def payload_audit(df: DataFrame, payload: Column, path: str, column: str) -> DataFrame:
    """(rows, defective): rows whose column differs from what the stored payload says."""
    said = F.try_variant_get(F.try_parse_json(payload), path, dict(df.dtypes)[column])
    return df.agg(F.count("*").alias("rows"), F.count_if(~said.eqNullSafe(F.col(column))).alias("defective"))


class Profile(NamedTuple):
    """What a section must serve; every field is given, so that none is forgotten."""

    offers: int  # after the weekly reset
    offers_stale: int  # in the course of the week, when offers have run out
    chains: int
    least_of_chain: int  # of each chain that is there; only after the reset, as a chain's week may end before
    unit_pct: float | None  # share of offers with a unit price; none: not judged


def judged(counts: DataFrame, profiles: dict[str, Profile], after_reset: bool, limit: int = 2000) -> DataFrame:
    """(section, gate, chain, value, floor, passes) of counts (section, chain, offers, with_unit).

    offers and chains of every section, chain_offers of each chain that is there, unit_pct where it is judged, and truncated: as many offers as are served at most were probably cut there.
    An absent chain fails `chains` only, a thin one `chain_offers` only.
    """
    spark = counts.sparkSession
    floors = spark.createDataFrame([(s, *p) for s, p in profiles.items()], "section string, offers_floor int, stale_floor int, chains_floor int, chain_floor int, pct_floor double")
    there = counts.where("offers > 0")
    sums = there.groupBy("section").agg(F.sum("offers").alias("_n"), F.count("*").alias("_chains"), F.sum("with_unit").alias("_units"))
    rows = floors.join(sums, "section", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("_n", "_chains", "_units")})
    one = lambda gate, value, floor, passes: F.struct(F.lit(gate).alias("gate"), F.lit(None).cast("string").alias("chain"), value.cast("double").alias("value"), floor.cast("double").alias("floor"), passes.alias("passes"))
    floor = F.col("offers_floor") if after_reset else F.col("stale_floor")
    pct = F.when(F.col("_n") > 0, F.round(F.col("_units") * 100.0 / F.col("_n"), 4)).otherwise(0.0)
    of_section = F.array(
        one("offers", F.col("_n"), floor, F.col("_n") >= floor), one("chains", F.col("_chains"), F.col("chains_floor"), F.col("_chains") >= F.col("chains_floor")), one("truncated", F.col("_n"), F.lit(limit), F.col("_n") != limit),
        F.when(F.col("pct_floor").isNotNull(), one("unit_pct", pct, F.col("pct_floor"), pct >= F.col("pct_floor"))),
    )
    whole = rows.select("section", F.explode(F.filter(of_section, lambda g: g.isNotNull())).alias("_g")).select("section", "_g.*")
    chains = there.join(floors, "section").select("section", F.lit("chain_offers").alias("gate"), "chain", F.col("offers").cast("double").alias("value"), F.col("chain_floor").cast("double").alias("floor"), ((F.col("offers") >= F.col("chain_floor")) | F.lit(not after_reset)).alias("passes"))
    return whole.unionByName(chains)
