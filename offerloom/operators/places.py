"""Nearest stores and branch lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions.geo import EARTH_METRES, haversine
from offerloom.operators.ranking import first_of, numbered

#: Name beginnings of chains, in order: the first that fits names the chain.
PREFIXES = (("north plus", "north_plus"), ("north", "north"), ("south", "south"), ("east", "east"))


def with_distance(df: DataFrame, lat: float, lng: float) -> DataFrame:
    return df.withColumn("metres", haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")))


def chain_of(brand: Column, name: Column) -> Column:
    """The chain by prefix; for each chain the brand is tried before the name."""
    out = F.lit(None).cast("string")
    for prefix, chain in reversed(PREFIXES):
        hit = F.lower(F.coalesce(brand, F.lit(""))).startswith(prefix) | F.lower(F.coalesce(name, F.lit(""))).startswith(prefix)
        out = F.when(hit, chain).otherwise(out)
    return out


def from_mirrors(spark: SparkSession, mirrors: list[str]) -> DataFrame:
    """(area, mirror, json) of folders that hold a response for each area, in order of preference; the file's name is the area. A mirror that isn't there has no rows."""
    rows = spark.createDataFrame([], "area string, mirror int, json string")
    for n, folder in enumerate(mirrors):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            files = spark.read.text(folder, wholetext=True)
            name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
            rows = rows.unionByName(files.select(name.alias("area"), F.lit(n).alias("mirror"), F.col("value").alias("json")))
    return rows


def first_good(responses: DataFrame) -> DataFrame:
    """(area, mirror, json): of each area the response of the first mirror that didn't fail. A response that isn't an object with a list of elements has failed, and so has one with a remark, even if it holds elements."""
    parsed = responses.withColumn("_v", F.try_parse_json("json"))
    shape = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("_v", path, "variant")), F.lit(""))
    good = parsed.where(shape("$.elements").startswith("ARRAY") & shape("$.remark").isin("", "VOID"))
    return first_of(good, ["area"], [F.col("mirror").asc(), F.col("json").asc()]).select("area", "mirror", "json")


def elements(raw: DataFrame) -> DataFrame:
    """(id, chain, name, lat, lng, address) of a response's elements (column json); a response with a remark has failed and yields none."""
    schema = "remark string, elements array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
    parsed = raw.select(F.from_json("json", schema).alias("_j")).where(F.col("_j.remark").isNull())
    e = parsed.select(F.explode("_j.elements").alias("e"))
    tag = lambda k: F.try_element_at("e.tags", F.lit(k))
    street = F.nullif(F.concat_ws(" ", tag("addr:street"), tag("addr:housenumber")), F.lit(""))
    city = F.nullif(F.concat_ws(" ", tag("addr:postcode"), tag("addr:city")), F.lit(""))
    return e.select(
        "e.id", chain_of(tag("brand"), tag("name")).alias("chain"), F.coalesce(tag("name"), tag("brand")).alias("name"),
        F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lng"), F.nullif(F.concat_ws(", ", street, city), F.lit("")).alias("address"),
    ).where("chain is not null and lat is not null and lng is not null")


#: The finest cells in degrees of the order in which places are packed, places or blocks in a block of the index, and rows up to which a level of it is broadcast.
CELL, BLOCK, SMALL = 1e-5, 8, 50_000
#: Metres to the other side of the globe, and by how much a distance computed there may be off.
HALF, SLACK = EARTH_METRES * 3.141592653589793, 1.0


def kept(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, so that every reader sees the same rows."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        from offerloom.sources.ingest import shared_folder

        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def z_order(lat: Column, lng: Column, cell: float) -> Column:
    """The bits of a cell's row and column in turn: cells near each other mostly stand near each other in this order."""
    out = []
    for v in (lat, lng):
        n = (F.floor(v / cell).cast("long") + (1 << 25)).bitwiseAND(F.lit((1 << 31) - 1))
        for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            n = n.bitwiseOR(F.shiftleft(n, by)).bitwiseAND(F.lit(mask))
        out.append(n)
    return F.shiftleft(out[0], 1).bitwiseOR(out[1])


def balls(spots: DataFrame, key: list[str], size: int) -> DataFrame:
    """(by, _up, _block, _lat, _lng, _wide, _n): blocks of `size` spots that follow each other, the block of the next level each is in, and a middle from which no spot of it is farther than _wide metres."""
    block = lambda n: F.expr(f"(_rank - 1) div {n}")
    ends = spots.groupBy(*key, block(size).alias("_block"), block(size * BLOCK).alias("_up")).agg(F.min("_lat").alias("_s"), F.max("_lat").alias("_t"), F.min("_lng").alias("_w"), F.max("_lng").alias("_e"), F.count("*").alias("_n"))
    # a degree of longitude is longest at the block's end nearer to the equator
    stretch = F.when((F.col("_s") > 0) & (F.col("_t") <= 90), F.cos(F.radians("_s"))).when((F.col("_t") < 0) & (F.col("_s") >= -90), F.cos(F.radians("_t"))).otherwise(1.0)
    half = lambda a, b: F.sin(F.least(F.radians(F.col(b) - F.col(a)) / 4, F.lit(1.5707963267948966)))
    wide = 2 * EARTH_METRES * F.asin(F.least(F.sqrt(F.pow(half("_s", "_t"), F.lit(2)) + F.pow(stretch * half("_w", "_e"), F.lit(2))), F.lit(1.0)))
    return ends.select(*key, "_up", "_block", ((F.col("_s") + F.col("_t")) / 2).alias("_lat"), ((F.col("_w") + F.col("_e")) / 2).alias("_lng"), F.nanvl(wide, F.lit(HALF)).alias("_wide"), "_n")


def nearest_many(points: DataFrame, stores: DataFrame, k: int = 1, by: str | None = None, cell: float | None = None) -> DataFrame:
    """(lat, lng, by, store_id, metres, rank): the k nearest stores of every distinct point, of each value of `by` if one is named; ties by store_id. Rows without coordinates are left out.

    Of stores at the same spot only the k first can be among the nearest, so spots are searched. They are packed by z_order (cell: its finest width) into blocks of eight, those into blocks of eight, and so on. A point
    goes down from the eight largest blocks and leaves out each that is farther away than k spots surely are, so it meets few spots however many there are, and far from all of them too. A point stays with one task.
    """
    spark, key = points.sparkSession, [by] if by else []
    place = ["_lat", "_lng", *key]
    own = stores.where("lat is not null and lng is not null").select("store_id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), *key)
    first = first_of(own, place, [F.col("store_id").asc()], k, "_i")
    spots = first.groupBy(*place).agg(F.collect_list(F.struct("_i", "store_id")).alias("_own")).withColumn("_z", z_order(F.col("_lat"), F.col("_lng"), cell or CELL))
    spots = kept(numbered(spots, key, [F.col("_z").asc(), F.col("_lat").asc(), F.col("_lng").asc()], "_rank").drop("_z"))
    n, longest = spots.agg(F.count("*"), F.coalesce(F.max("_rank"), F.lit(1))).first()
    left = kept(points.where("lat is not null and lng is not null").select("lat", "lng").distinct().withColumn("_id", F.monotonically_increasing_id()))
    left = left.crossJoin(F.broadcast(spots.select(by).distinct())) if by else left  # a row for each chain
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = left.withColumn("_at", F.lit(0).cast("long")).repartition(tasks, "_id", *key)  # few bytes, but much work: not for one task
    mine = Window.partitionBy("_id", *key)
    sizes = [1]
    while sizes[-1] * BLOCK < longest:
        sizes.append(sizes[-1] * BLOCK)
    for size in reversed(sizes):
        level = balls(spots, key, size) if size > 1 else spots.select(*place, F.expr(f"(_rank - 1) div {BLOCK}").alias("_up"), F.lit(0.0).alias("_wide"), F.lit(1).alias("_n"), "_own")
        level = level.withColumnRenamed(by, "_by") if by else level
        same = F.col("_at") == F.col("_up")
        met = left.join(F.broadcast(level) if n * k <= SMALL * size else level, same & F.col(by).eqNullSafe(F.col("_by")) if by else same)
        metres = haversine(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
        met = met.withColumn("metres", metres).withColumn("_far", F.nanvl("metres", F.lit(HALF)) + F.col("_wide"))
        met = met.withColumn("_within", F.sum("_n").over(mine.orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)))
        met = met.withColumn("_sure", F.min(F.when(F.col("_within") >= k, F.col("_far"))).over(mine))
        left = met.where(F.col("_sure").isNull() | (F.col("_far") - 2 * F.col("_wide") <= F.col("_sure") + SLACK))
        left = left.select("_id", "lat", "lng", *key, F.col("_block").alias("_at")) if size > 1 else left.select("_id", "lat", "lng", *key, "metres", F.inline("_own"))
    return first_of(left, ["_id", *key], [F.col("metres").asc(), F.col("store_id").asc()], k, "rank").select("lat", "lng", *key, "store_id", "metres", "rank")


def nearest_per_chain(df: DataFrame, lat: float, lng: float) -> DataFrame:
    return first_of(with_distance(df, lat, lng), ["chain"], [F.col("metres").asc(), F.col("store_id").asc()])


def branches(df: DataFrame, lat: float, lng: float, chain: str | None = None, limit: int = 12, address: Column | None = None) -> DataFrame:
    """One row for each chain and address (without one: coordinates to four places), the nearest; then the nearest of the chain."""
    place = F.concat_ws("|", F.round("lat", 4).cast("string"), F.round("lng", 4).cast("string"))
    rows = with_distance(df, lat, lng).withColumn("_place", F.coalesce(address, place) if address is not None else place)
    rows = first_of(rows, ["chain", "_place"], [F.col("metres").asc(), F.col("store_id").asc()]).drop("_place")
    rows = rows if chain is None else rows.where(F.col("chain") == chain)
    return rows.orderBy("metres", "store_id").limit(limit)


def nearest_tagged(df: DataFrame, lat: float, lng: float, tag: Column) -> DataFrame:
    """(tag, store_id, metres): the tag of the nearest place that has one; places without a tag or coordinates are skipped."""
    rows = with_distance(df, lat, lng).withColumn("tag", tag).where("tag is not null and metres is not null")
    return rows.orderBy("metres", "store_id").limit(1).select("tag", "store_id", "metres")


def source_store(df: DataFrame, lat: float, lng: float) -> DataFrame:
    """The nearest place; places without coordinates come after all others."""
    return with_distance(df, lat, lng).orderBy(F.col("metres").asc_nulls_last(), F.col("store_id").asc()).limit(1)


def centroids(stores: DataFrame) -> DataFrame:
    """(plz, lat, lng): the middle of the places of each postal code."""
    return stores.groupBy("plz").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


def located(df: DataFrame, centres: DataFrame) -> DataFrame:
    """df (plz, lat, lng) with coordinates from the postal code's middle where a row lacks either; null without one."""
    both = df.join(centres.toDF("plz", "_lat", "_lng"), "plz", "left")
    own = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return both.withColumns({"lat": F.when(own, F.col("lat")).otherwise(F.col("_lat")), "lng": F.when(own, F.col("lng")).otherwise(F.col("_lng"))}).drop("_lat", "_lng")
