"""Many patterns in many texts: an Aho-Corasick automaton built once in each worker, and one pass over each text.

The patterns are authored: rule tokens, shopping lists, cookbooks. They reach the workers as a broadcast of at most
`MOST_BYTES`; a longer list is dealt to several automata of that size, each its own pass.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Bytes of the patterns of one automaton.
MOST_BYTES = 8 << 20
#: Patterns that the driver reads from a table; a longer table is joined by Spark instead.
MOST_PATTERNS = 200_000


class Automaton:
    """Which of the patterns, given as (number, pattern), stand in a text; an empty pattern stands in every text."""

    def __init__(self, patterns: Sequence[tuple[int, str]]):
        self.always = [i for i, p in patterns if not p]
        numbers: dict[str, list[int]] = {}
        for i, p in patterns:
            if p:
                numbers.setdefault(p, []).append(i)
        self.tree = ahocorasick.Automaton()
        for p, own in numbers.items():
            self.tree.add_word(p, own)
        if numbers:
            self.tree.make_automaton()
        self.empty = not numbers

    def found(self, text: str) -> list[int]:
        """Their numbers, ascending."""
        if self.empty:
            return list(self.always)
        hits = {id(own): own for _, own in self.tree.iter(text)}
        return sorted([*self.always, *(i for own in hits.values() for i in own)])


@functools.lru_cache(maxsize=16)
def automaton_of(patterns) -> Automaton:
    """A worker's automaton of a broadcast list, built once."""
    return Automaton(patterns.value)


class _Shared:
    """A broadcast that hashes by its name, so that a worker keeps what it built from it."""

    def __init__(self, broadcast):
        self.broadcast, self.name = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other) -> bool:
        return isinstance(other, _Shared) and self.name == other.name


def shared(spark: SparkSession, value) -> _Shared:
    return _Shared(spark.sparkContext.broadcast(value))


def parts_of(patterns: Sequence[str]) -> Iterator[list[tuple[int, str]]]:
    """The numbered patterns in lists of at most MOST_BYTES, a longer pattern alone."""
    own, size = [], 0
    for i, p in enumerate(patterns):
        n = len(p.encode())
        if own and size + n > MOST_BYTES:
            yield own
            own, size = [], 0
        own.append((i, p))
        size += n
    yield own


def found_in(spark: SparkSession, text: Column, patterns: Sequence[str]) -> Column:
    """array<int>: the positions in `patterns` of those that stand in the text, ascending; none for null."""

    def one(part: _Shared) -> Column:
        @F.arrow_udf(ArrayType(IntegerType()))
        def run(texts: pa.Array) -> pa.Array:
            tree = automaton_of(part)
            return pa.array([[] if t is None else tree.found(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

        return run(text)

    arrays = [one(shared(spark, part)) for part in parts_of(patterns)]
    return arrays[0] if len(arrays) == 1 else F.array_sort(F.concat(*arrays))


def matching_pairs(texts: DataFrame, hay: str, wanted: DataFrame, keep: list[str]) -> DataFrame:
    """Each row of texts with each row of wanted of which a pattern stands in column `hay`: columns of texts, those of `keep`.

    wanted: `keep`, and _want and _not, arrays of patterns; a pattern of _not that stands in the text rules the pair out. The patterns are read by the driver,
    at most MOST_PATTERNS; rows of texts meet the wanted rows by pattern, in an equi-join. A longer table is compared row by row.
    """
    spark = texts.sparkSession
    flat = wanted.select(*keep, F.explode(F.concat(F.transform("_want", lambda p: F.struct(p.alias("p"), F.lit(False).alias("no"))), F.transform(F.coalesce("_not", F.expr("cast(array() as array<string>)")), lambda p: F.struct(p.alias("p"), F.lit(True).alias("no"))))).alias("_t")).select(*keep, "_t.*").where("p is not null").distinct()
    read = [r["p"] for r in flat.select("p").distinct().limit(MOST_PATTERNS + 1).collect()]
    if len(read) > MOST_PATTERNS:
        has = lambda side: F.exists(side, lambda p: F.contains(F.col(hay), p))
        return texts.join(wanted, has("_want") & ~F.coalesce(has("_not"), F.lit(False))).drop("_want", "_not")
    patterns = sorted(read)
    if not patterns:
        return texts.join(wanted.limit(0).drop("_want", "_not"))
    numbered = spark.createDataFrame(list(enumerate(patterns)), "_hit int, p string").join(flat, "p").drop("p")
    hits = texts.withColumn("_id", F.struct(*texts.columns)).withColumn("_hit", F.explode(found_in(spark, F.col(hay), patterns)))
    pairs = hits.join(numbered, "_hit").groupBy("_id", *keep).agg(F.bool_or("no").alias("_no")).where("not _no")
    return pairs.select("_id.*", *keep)
