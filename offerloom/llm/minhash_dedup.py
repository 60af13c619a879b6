"""MinHash near-dedup with b-bit signatures; links are confirmed on full shingle sets.

1. Each text becomes its set of word shingles. Equal sets collapse to the document of the smallest id.
2. Each set gets minima of `HASHES` hash functions. Bands of the minima name candidates; the low `BITS`
   bits of every minimum, packed, stay as the signature.
3. In each band's bucket the signatures' equal fields, counted by bits and corrected for chance,
   estimate the similarity. Pairs far below the threshold go; of the rest only a spanning forest of
   each bucket is emitted, so a bucket of n sets yields fewer than n rows. Buckets over `BLOCK` sets are
   compared in pairs of blocks, each a task of its own.
4. The forests' components are clusters that hold every link whose sets met in a band. Inside each
   cluster every pair is compared on the full sets, again in blocks, and the true links' components
   are the result.

With rows of 4 minima and 24 bands, sets at the threshold miss each other in all bands with probability
2e-8 (similarity 0.85) or 3e-6 (0.8), and the estimate's cut lies five standard errors below the threshold.

Defined results: a text with fewer words than a shingle has is one shingle; null, empty or blank texts
have none and link with nothing; a null doc_id isn't compared, has no component and is kept; rows that share a
doc_id are judged each by its own text, and those that hold the component's id are kept; an empty table gives no rows;
other columns are ignored by minhash_dedup() and returned as they are by one_of_each(), whatever their names. Texts are
read whole; a very long one is one step, held a few times over in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.columns import unused
from offerloom.llm.common import ASCII_LOWER, blocks, components, cut, groups, hashes, mix, plain, small_batches, spread, steps, words

HASHES, BANDS, ROWS, BITS = 128, 24, 4, 4
BLOCK, SET_BLOCK = 1024, 256
_A = (mix(np.arange(HASHES, dtype=np.uint64), 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(HASHES, dtype=np.uint64), 2) >> np.uint64(32)).astype(np.uint32)
_LOW = np.uint64(0x1111111111111111)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its shingles of `width` words, A-Z lower-cased."""
    codes, ends, distinct = words(plain(texts, ASCII_LOWER))
    h = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = max(0, len(h) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled = mix(rolled + h[k : k + n], k)
    out = []
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(h[:0])
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(x), 2048):
            best = np.minimum(best, (x[k : k + 2048, None] * _A + _B).min(axis=0))
    return best


def bands(best: np.ndarray) -> np.ndarray:
    rows = best[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            key = mix(key + rows[:, k], k)
    return key


def packed(best: np.ndarray) -> bytes:
    """The low bits of every minimum, two to a byte."""
    low = (mix(best.astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
    return (low[::2] | (low[1::2] << 4)).tobytes()


def estimates(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (rows of 64-bit words): share of equal fields less what chance makes equal."""
    x = one ^ other
    x = (x | (x >> np.uint64(1)) | (x >> np.uint64(2)) | (x >> np.uint64(3))) & _LOW
    equal = 1 - np.bitwise_count(x).sum(axis=-1) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            best = [minima(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole[:, 0]), pa.array(whole[:, 1]),
                 pa.array([None if m is None else packed(m) for m in best], pa.binary()),
                 pa.array([None if m is None else bands(m).view(np.int64) for m in best], pa.list_(pa.int64()))],
                ["doc_id", "mark", "n", "set_a", "set_b", "signature", "bands"],
            )

    return run


def _candidates(least: float):
    """Spanning forests of the pairs whose estimate reaches `least`, a group at a time; groups of two all at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in groups(batches, ["band", "lo", "hi"]):
            ids = table["node"].to_numpy()
            bits = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint64).reshape(len(ids), -1)
            sizes = np.diff(edges)
            two = edges[:-1][sizes == 2]
            two = two[estimates(bits[two], bits[two + 1]) >= least]
            a, b = [ids[two]], [ids[two + 1]]
            for i, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = bits[i : i + n]
                found = np.array(spread(lambda x, ys, own=own: estimates(own[x], own[ys]) >= least, n), np.int64).reshape(-1, 2) + i
                a.append(ids[found[:, 0]])
                b.append(ids[found[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows are one set
        for batch in steps(batches, "text"):
            new = [n not in seen and not seen.add(n) for n in batch.column("node").to_pylist()]
            batch = batch.filter(pa.array(new))
            sets = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["cluster", "node", "shingles"])

    return run


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; shingles of one set only are left out, the rest go through in slices."""
    n = len(sets)
    member = np.repeat(np.arange(n), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    member, every = member[order], every[order]
    column = np.cumsum(np.concatenate([[False], every[1:] != every[:-1]]))
    often = np.bincount(column)[column] > 1
    member, column = member[often], column[often]
    column = np.unique(column, return_inverse=True)[1]
    total = np.zeros((n, n), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 4097, 4096))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        grid = np.zeros((n, 4096), np.float32)
        grid[member[a:b], column[a:b] - 4096 * k] = 1
        total += grid @ grid.T
    return total.astype(np.int64)


def _links(per_cent: int):
    """Spanning forests of the true links in each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in groups(batches, ["cluster", "lo", "hi"]):
            ids, a, b = table["node"].to_numpy(), [], []
            for i, j in zip(edges.tolist(), edges[1:].tolist()):
                sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].slice(i, j - i).to_pylist()]
                sizes = np.array([len(s) for s in sets])
                if len(sets) == 2:
                    both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
                    both[1, 0] = both[0, 1]
                else:
                    both = shared(sets)
                linked = 100 * both >= per_cent * (sizes[:, None] + sizes[None, :] - both)
                for x, y in spread(lambda x, ys, linked=linked: linked[x, ys], len(sets)):
                    a.append(ids[i + x])
                    b.append(ids[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _in_groups(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _mark(docs: DataFrame):
    """With doc_id, the name of a row: rows of one doc_id may hold different texts."""
    return F.xxhash64(docs["text"].cast("string"))


def classes(docs: DataFrame, width: int, per_cent: int) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id), one row per row."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _mark(docs).alias("mark"))
    signed = cut(docs.mapInArrow(_sign(width), "doc_id long, mark long, n long, set_a long, set_b long, signature binary, bands array<long>"))
    real = signed.where("n > 0 and doc_id is not null")
    # written: the numbers of the sets must not change, and the join with the members below is dealt anew, so that Spark can split a large group of copies
    one = real.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min_by("mark", "doc_id").alias("mark"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    owners = cut(one.withColumn("node", F.monotonically_increasing_id()))
    dealt = owners.select("node", "signature", F.explode("bands").alias("band"))
    similarity = per_cent / 100
    least = similarity - 5 * (similarity * (1 - similarity) / HASHES) ** 0.5
    pairs = _in_groups(blocks(dealt, "band", "node", BLOCK), ["band", "lo", "hi"], _candidates(least), "a long, b long")
    clusters = components(pairs).select("node", F.col("component").alias("cluster"))
    asked = owners.select("node", F.col("rep").alias("doc_id"), "mark").join(clusters, "node")
    inside = cut(docs.join(asked, ["doc_id", "mark"]).mapInArrow(_sets(width), "cluster long, node long, shingles binary"))
    links = components(_in_groups(blocks(inside, "cluster", "node", SET_BLOCK), ["cluster", "lo", "hi"], _links(per_cent), "a long, b long"))
    owned = owners.select("node", "set_a", "set_b", "rep").join(links, "node", "left")
    low = owned.where("component is not null").groupBy("component").agg(F.min("rep").alias("low"))
    owned = owned.join(low, "component", "left").select("set_a", "set_b", F.coalesce("low", "rep").alias("component_id"))
    found = signed.select("doc_id", "mark", F.col("n").alias("n_shingles"), "set_a", "set_b").join(owned, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "mark", "n_shingles", component.alias("component_id"))


def minhash_dedup(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row; links at similarity of `per_cent` hundredths or more."""
    out = classes(docs, width, per_cent).drop("mark")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those that minhash_dedup() does not keep."""
    own_id, own_mark = unused(docs.columns, "gone_id", "gone_mark")
    gone = classes(docs, width, per_cent).where("doc_id <> component_id").select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark))
    return docs.join(gone, (docs["doc_id"] == F.col(own_id)) & (_mark(docs) == F.col(own_mark)), "left_anti")
