"""Weekly price series: projection, statistics and the trail shown beside an offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points a trail shows; the ratio of maximum to minimum from which a series is noise.
MAX_POINTS, NOISE_RATIO = 8, 4


def iso_week(day: Column) -> Column:
    """YYYY-Www; sorts as text."""
    year = F.extract(F.lit("YEAROFWEEK"), day)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def weekly_series(df: DataFrame, key: Column) -> DataFrame:
    """(key, series array<struct<week, cents>>): the least price of each week, in order. One point for each week of a product."""
    weekly = df.groupBy(key.alias("key"), iso_week(F.col("valid_from")).alias("week")).agg(F.min("price_cents").alias("cents"))
    return weekly.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("week", "cents"))).alias("series"))


def newest(series: Column, points: int = MAX_POINTS) -> Column:
    return F.slice(series, F.greatest(F.size(series) - (points - 1), F.lit(1)), F.lit(points))


def project(index: DataFrame, wanted: DataFrame, points: int = MAX_POINTS) -> DataFrame:
    """The wanted keys of a price index, malformed points dropped, the newest ones kept."""
    rows = index.join(wanted.select("key").distinct(), "key", "left_semi")
    good = F.filter("series", lambda p: p["week"].rlike(r"^\d{4}-W\d{2}$") & (p["cents"] > 0))
    return rows.withColumn("series", newest(good, points))


def stats(df: DataFrame, key: Column) -> DataFrame:
    """(key, least, median, most, last, weeks_seen, appearances) over weekly least prices."""
    weekly = df.groupBy(key.alias("key"), iso_week(F.col("valid_from")).alias("week")).agg(F.min("price_cents").alias("cents"), F.count("*").alias("_n"))
    return weekly.groupBy("key").agg(
        F.min("cents").alias("least"), F.median("cents").alias("median"), F.max("cents").alias("most"),
        F.max_by("cents", "week").alias("last"), F.count("*").alias("weeks_seen"), F.sum("_n").alias("appearances"),
    )


def facts(df: DataFrame, key: Column, points: int = MAX_POINTS) -> DataFrame:
    """stats() with `series`, the newest weeks: what an index of prices holds of a product."""
    return stats(df, key).join(weekly_series(df, key).withColumn("series", newest(F.col("series"), points)), "key")


def short_week(week: Column) -> Column:
    """`W07` of `1998-W07`."""
    return F.regexp_replace(week, r"^\d{4}-", "")


def trail(known: DataFrame, today: DataFrame) -> DataFrame:
    """What may be said of today's price (key, cents; null cents: not on sale) beside its history, as tier and the fields of that tier.

    known: facts(). Tier 0: no history. 1, one week: its price and week. 2, two weeks: first, last and the change in per cent. 3: least, median, most; the
    week of the least if the series still shows it; flat; noisy, if the most is NOISE_RATIO times the least; unless noisy, the verdict and today's price in per cent of the median.
    """
    both = today.join(known, "key", "left")
    weeks = F.coalesce("weeks_seen", F.lit(0))
    tier = F.when(weeks == 0, 0).when((weeks <= 1) | (F.size("series") < 2), 1).when(weeks == 2, 2).otherwise(3)
    first, last = F.get("series", F.lit(0)), F.try_element_at("series", F.lit(-1))
    lowest = F.array_min(F.transform("series", lambda p: F.struct(p["cents"].alias("cents"), p["week"].alias("week"))))
    noisy = (F.col("least") > 0) & (F.col("most") >= NOISE_RATIO * F.col("least"))
    verdict = F.when(F.col("last") == F.col("least"), "true_low").when(F.col("last") > F.col("median"), "worse").otherwise("typical")
    half_up = lambda top, bottom: F.when(bottom > 0, F.floor(top * 100 / bottom + 0.5).cast("long"))
    rows = both.withColumn("tier", tier)
    at = lambda n, value: F.when(F.col("tier") == n, value)
    return rows.select(
        "key", F.col("tier").cast("int").alias("tier"), at(1, last["cents"]).alias("seen_cents"), at(1, short_week(last["week"])).alias("seen_week"),
        at(2, first["cents"]).alias("first_cents"), at(2, last["cents"]).alias("last_cents"), at(2, half_up(last["cents"] - first["cents"], first["cents"])).alias("delta_pct"),
        *[at(3, F.col(c)).alias(c) for c in ("least", "median", "most")], at(3, F.when(lowest["cents"] == F.col("least"), short_week(lowest["week"]))).alias("min_week"),
        at(3, F.col("most") == F.col("least")).alias("flat"), at(3, noisy).alias("noisy"), at(3, F.when(~noisy, verdict)).alias("verdict"), at(3, F.when(~noisy, half_up(F.col("cents"), F.col("median")))).alias("pct_of_usual"),
    )
