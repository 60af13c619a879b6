"""Shared pieces of the text operators: Arrow word arrays, lineage cuts, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
#: Lower-cases A-Z and leaves every other byte, so UTF-8 stays valid.
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)
#: Text that one numpy step holds at a time, in bytes. Bounds a Python worker's memory.
STEP_BYTES = 6 << 20
#: Rows of an Arrow batch.
ARROW_ROWS = 2000
#: Parts that the rows of a hub are dealt to.
SALTS = 4


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode, where nothing is shared."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, whatever executor is lost later."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches are held to ARROW_ROWS rows: whole texts are long rows, and a batch is in memory
    several times over, in the JVM and in the worker. A smaller setting of the session stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df


def steps(batches: Iterator[pa.RecordBatch], column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts come to about `size` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths) - lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def plain(texts: pa.Array, table: bytes | None = None) -> pa.Array:
    """Texts without nulls (null: empty), each ASCII byte mapped by `table`."""
    texts = pc.fill_null(texts, "")
    if table is None or not len(texts):
        return texts
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), texts.type)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    body = data.to_pybytes().translate(table) if data is not None else b""
    kind = pa.large_string() if wide else pa.string()
    return pa.Array.from_buffers(kind, len(texts), [None, offsets, pa.py_buffer(body)])


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(code of each word, where each text's words begin and end, the distinct words by code).

    Words are runs of characters other than [\\x20\\x09-\\x0D].
    """
    lists = pc.ascii_split_whitespace(texts)
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    ends = ends - ends[0]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary()).to_pylist()
    if b"" in distinct:  # space at either end of a text leaves an empty string there
        empty = distinct.index(b"")
        real = codes != empty
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        codes = codes[real]
        codes -= codes > empty
        del distinct[empty]
    return codes, ends, distinct


def hashes(distinct: list[bytes], seed: int = 0) -> np.ndarray:
    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(w, seed) for w in distinct), np.uint64, len(distinct))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Forest:
    """Union-find over row numbers of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    edges: columns a, b. Alternates the large-star and small-star steps, which take a
    logarithmic number of rounds; each round is two grouped minima and joins back, so a hub
    is never collected, and every round is written to the shared checkpoint folder.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    def beside(rows: DataFrame, low: DataFrame) -> DataFrame:
        """Each row with its node's minimum; a hub's rows are dealt by the other end too."""
        part = rows.withColumn("_s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        return part.join(low.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["a", "_s"])

    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = beside(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where("a > m").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = beside(large, low).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        then, seen = seen, mark(now)
        if then == seen:
            break
    rows = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return rows.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where the groups in them begin and end) from rows that come sorted by keys; each group comes whole, once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        edges = _edges(table, keys)
        if len(edges) > 2:  # the last group may go on
            yield table.slice(0, edges[-2]), edges[:-1]
            held = table.slice(edges[-2]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _edges(table, keys)


def _edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        x = table[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.concatenate([np.flatnonzero(new), [table.num_rows]])


def spread(linked, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of n nodes; linked(i, js) says which of the nodes js are linked with i."""
    rest, edges = np.arange(n), []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = linked(i, rest)
            found = rest[hit]
            rest = rest[~hit]
            edges += [(i, int(j)) for j in found]
            todo += found.tolist()
    return edges


def blocks(df: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """Deal the rows of each key to pairs of blocks of about `size` rows (columns block, lo, hi), so that any two rows meet in one pair.

    Keys of one row are left out. A key of n blocks sends each row to n pairs, a task each.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.expr(f"cast(ceil(_n / {size}) as int)").alias("_blocks"))
    dealt = df.join(counts, key).withColumn("block", F.expr(f"cast(pmod(xxhash64({member}), _blocks) as int)"))
    dealt = dealt.withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
    return dealt.withColumns({"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other")}).drop("_other", "_blocks")
