"""The ingest run: feed pages to versioned tables of stores and offers, batch after batch of a stream.

A version is written whole, then a commit names it; readers follow the highest commit, so they see both tables of one version or none. A batch that comes again after a failure finds
its commit and changes nothing, or writes the same version anew. While offers are written, Spark counts what the quality gates need, and the commit keeps the counts.

Pages: feed (flyer, coupon, clearance), chain, plz, store_name, market_code, lat, lng, json.
"""

from __future__ import annotations

import tempfile
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.pricing import discount_pct, served_per_unit
from offerloom.functions.text import name_key
from offerloom.functions.validity import valid_on
from offerloom.operators.filters import VERTICALS, in_vertical
from offerloom.operators.ranking import first_of, scrape_order
from offerloom.operators.rules import Book, classify
from offerloom.operators.upsert import upsert
from offerloom.sources import feeds

STORES = "chain string, plz string, store_name string, market_code string, lat double, lng double"
OFFERS = (
    "chain string, plz string, ext string, source string, name string, brand string, category string, category_path array<string>, price_cents long, regular_cents long, app_cents long, discount_pct double, unit string, per_unit string, "
    "note string, image_url string, valid_from date, valid_to date, unit_priced boolean, version long"
)
COMMIT = "version long, batch string, counts array<struct<section:string,chain:string,offers:long,with_unit:long>>"


class Plan(NamedTuple):
    """What a run knows beside its pages."""

    book: Book
    anchor: str  # the chain whose coupons say where a postal code is
    today: str  # validity of the counts
    routed: dict[str, str] = {}  # chain -> division: flyers of such a chain count only where its division is at home


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for what all executors share; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tables-")
    return named


class Versions:
    """Tables `stores` and `offers` in a folder, a version of both at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        if not self._exists():
            for name, schema in (("stores", STORES), ("offers", OFFERS)):
                self.write(spark.createDataFrame([], schema), name, 0)
            self.commit(0, "start", [])

    def _exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/0")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMIT).json(f"{self.path}/commits/*")

    def current(self) -> int:
        return self.commits().agg(F.max("version")).first()[0]

    def has(self, batch: str) -> bool:
        return bool(self.commits().where(F.col("batch") == batch).limit(1).count())

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/{self.current() if version is None else version}")

    def write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/{version}")

    def drop(self, name: str, version: int) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{version}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def commit(self, version: int, batch: str, counts: list[tuple]) -> None:
        """Last of all: the version becomes the current one."""
        self.spark.createDataFrame([(version, batch, counts)], COMMIT).coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/{version}")


def merged_stores(old: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each chain and postal code: stored ones keep name and code and take coordinates that aren't null, new ones are added."""
    last = lambda c: F.max(c).alias(f"_{c}")
    new = pages.groupBy("chain", "plz").agg(*[last(c) for c in ("store_name", "market_code", "lat", "lng")])
    both = old.withColumn("_old", F.lit(True)).join(new, ["chain", "plz"], "full")
    kept = {c: F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}")) for c in ("store_name", "market_code")}
    return both.select("chain", "plz", *[v.alias(c) for c, v in kept.items()], F.coalesce("_lat", "lat").alias("lat"), F.coalesce("_lng", "lng").alias("lng"))


def admitted(pages: DataFrame, stores: DataFrame, divisions: DataFrame, plan: Plan) -> DataFrame:
    """Pages that may be read: flyers only where the anchor chain's store has coordinates, and those of a routed chain only where its division (plz, division) is at home; other feeds always."""
    located = stores.where((F.col("chain") == plan.anchor) & F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("plz", F.lit(True).alias("_located"))
    home = divisions.select("plz", F.col("division").alias("_division"))
    wanted = F.lit(None).cast("string")
    for chain, division in plan.routed.items():
        wanted = F.when(F.col("chain") == chain, division).otherwise(wanted)
    rows = pages.join(located, "plz", "left").join(home, "plz", "left")
    return rows.where((F.col("feed") != "flyer") | (F.col("_located") & (wanted.isNull() | (wanted == F.col("_division"))))).drop("_located", "_division")


def read_offers(pages: DataFrame) -> DataFrame:
    """The offers of the pages, read by feed; of duplicates in a store's feed the fullest. Pages are dealt to as many tasks as a shuffle has, for a small file of them is long work."""
    pages = pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "json")
    of = lambda feed: pages.where(F.col("feed") == feed)
    keep = ("chain", "plz")
    rows = feeds.batch(feeds.flyer_offers(of("flyer"), keep), feeds.coupon_offers(of("coupon"), keep=keep), feeds.clearance_offers(of("clearance"), keep=keep))
    rows = rows.withColumns({"ext": F.concat_ws(":", "source", "id"), "_key": name_key("name")})
    return first_of(rows, ["chain", "plz", "source", "_key", "price_cents"], scrape_order()).drop("_key", "id")


def classified_offers(rows: DataFrame, plan: Plan, version: int) -> DataFrame:
    """OFFERS of read_offers(), classified, with discounts. The rows are read twice, for their distinct products and to be joined with what these are."""
    products = rows.select("name", "brand", F.col("category_path").alias("path"), F.col("unit").alias("caption"))
    known = classify(products, plan.book).select(F.col("name").alias("_n"), F.col("brand").alias("_b"), F.col("path").alias("_p"), F.col("caption").alias("_c"), F.col("slug").alias("category"))
    same = rows.name.eqNullSafe(known._n) & rows.brand.eqNullSafe(known._b) & rows.category_path.eqNullSafe(known._p) & rows.unit.eqNullSafe(known._c)
    rows = rows.join(known, same).withColumns({"discount_pct": discount_pct(F.col("price_cents"), F.col("regular_cents")), "unit_priced": served_per_unit("per_unit", "unit", "price_cents").isNotNull(), "version": F.lit(version).cast("long")})
    return rows.select(*[c.split()[0] for c in OFFERS.split(", ")])


def _counted(chains: list[str], today: str) -> dict[str, Column]:
    """What to count while offers are written, for each section and chain."""
    shown = valid_on(F.col("valid_to"), today)
    out = {}
    for section in VERTICALS:
        for chain in chains:
            own = shown & in_vertical(section) & (F.col("chain") == chain)
            out[f"{section}|{chain}|offers"], out[f"{section}|{chain}|with_unit"] = F.count_if(own), F.count_if(own & F.col("unit_priced"))
    return out


def ingest(tables: Versions, pages: DataFrame, divisions: DataFrame, plan: Plan, batch: str) -> int:
    """One batch of pages into the next version; the version that holds the batch, an earlier one if it was there already."""
    if tables.has(batch):
        return tables.commits().where(F.col("batch") == batch).agg(F.max("version")).first()[0]
    now = tables.current()
    version = now + 1
    tables.write(merged_stores(tables.read("stores", now), pages), "stores", version)
    stores = tables.read("stores", version)
    tables.write(read_offers(admitted(pages, stores, divisions, plan)), "read", version)  # a page is parsed once, not for each reader of its offers
    new = classified_offers(tables.read("read", version), plan, version)
    rows = upsert(tables.read("offers", now), new, ["chain", "plz", "ext"], [F.col("price_cents").asc(), F.col("name").asc()])
    chains = sorted({c for spec in VERTICALS.values() for c in spec["chains"]})
    seen, counted = Observation(), _counted(chains, plan.today)
    tables.write(rows.observe(seen, *[c.alias(name) for name, c in counted.items()]), "offers", version)
    counts = seen.get
    told = [(s, c, counts[f"{s}|{c}|offers"], counts[f"{s}|{c}|with_unit"]) for s in VERTICALS for c in chains if counts[f"{s}|{c}|offers"]]
    tables.commit(version, batch, told)
    tables.drop("read", version)
    return version


def ingest_stream(pages: DataFrame, path: str, divisions: DataFrame, plan: Plan, name: str, checkpoint: str):
    """The run as a stream's writer (not started): every trigger's pages become a version. A trigger that Spark repeats after a failure has the same number, and so the same batch."""

    def run(df: DataFrame, number: int) -> None:
        ingest(Versions(df.sparkSession, path), df, divisions, plan, f"{name}-{number}")

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)

