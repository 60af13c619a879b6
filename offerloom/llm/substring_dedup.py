"""Substring dedup: Rabin-Karp hashes of every window of `window` words, counted over the corpus by Spark.

Documents are dealt to buckets of consecutive ids and about equal bytes, so that of two buckets the smaller number holds
the smaller ids: running sums of bytes along ranges of ids begin them. Then
1. each bucket hashes all its windows and sends each distinct hash once, in arrays for the parts of the hash space;
2. Spark explodes the arrays where they arrive and counts the buckets of each hash: all but the first are told of it;
3. each bucket removes the words of windows so named and of windows that repeat inside the bucket
   after their first start; overlapping windows merge into maximal intervals.
A window sequence costs one entry a bucket however often it occurs, so a hot passage doesn't gather in one task. Arrays
never outnumber windows. Windows are judged by 80 bits, of two polynomials of unlike bases: at 10^11 windows a chance match has
a probability of 0.004, at 10^12 of 0.4 for all of them together.

Defined results: null text has no words; rows that share a doc_id count as documents in a fixed order of their
texts; a null doc_id ranks after all others; an empty table gives no rows; other columns are ignored. A doc_id, or
null, with more text than a bucket is split by a hash of the texts; only equal rows are held together. Texts are
read whole; a very long one is one step, held a few times over in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.llm.common import cut, hashes, mix, plain, small_batches, steps, words

#: Text of a bucket.
BUCKET_BYTES = 12 << 20
#: Buckets for each that the driver knows: it holds 16 bytes for 768 MB of text, 2 MB for 100 TB.
COARSE = 64
#: Buckets that a range of ids holds at least: the last one of a range is seldom full.
RANGE = 16
#: Buckets, of 24 bytes each, that tasks are sent at most; more are joined by their coarse bucket.
BROADCAST_BUCKETS = 400_000
#: Tasks that count hashes for each shuffle partition, which bounds what one of them sorts, and parts of the hash space for each such task.
COUNTERS, PARTS = 2, 8
#: The bases of the two polynomials, odd so that they have inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(h: np.ndarray, window: int, base: int = BASES[0]) -> np.ndarray:
    """Polynomial hash of every `window` consecutive values, from prefix sums (modulo 2^64)."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(pow(base, -1, 1 << 64), len(h)), dtype=np.uint64)])
        return mix((sums[window:] - sums[:-window]) * _powers(base, n))


def _windows(texts: pa.Array, window: int) -> tuple:
    """(codes, ends, distinct words, first word of each window, its hash, 16 bits more)."""
    codes, ends, distinct = words(plain(texts))
    sizes = np.diff(ends)
    codes = codes.astype(np.int32)
    own = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    every = rolling(own, window)
    stop = np.repeat(ends[1:].astype(np.int32), sizes)[: len(every)]  # of the document of each word
    start = np.flatnonzero(np.arange(window, window + len(every), dtype=np.int32) <= stop).astype(np.int32)
    del stop
    every = every[start].view(np.int64)
    more = (rolling(mix(own, 7), window, BASES[1])[start] >> np.uint64(48)).astype(np.uint16).view(np.int16)
    return codes, ends, pa.array(distinct, pa.binary()), start, every, more


class Firsts:
    """Windows grouped by equal hashes."""

    def __init__(self, h: np.ndarray, more: np.ndarray):
        order = np.argsort(h).astype(np.int32)  # a bucket's windows are fewer than 2^31
        sorted_h = h[order]
        same = sorted_h[1:] == sorted_h[:-1]
        if (same & (more[order[1:]] != more[order[:-1]])).any():  # a chance match of 64 bits
            order = np.lexsort((more, h)).astype(np.int32)
            sorted_h = h[order]
            same = (sorted_h[1:] == sorted_h[:-1]) & (more[order[1:]] == more[order[:-1]])
        del sorted_h
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), ~same])).astype(np.int32)
        self.order, self.sizes = order, np.diff(starts, append=np.int32(len(h)))
        #: The first window of each group, and the hashes of the groups, rising.
        self.first = np.minimum.reduceat(order, starts) if len(h) else order
        self.h, self.more = h[self.first], more[self.first]

    def gone(self, h: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Of each window: its group is named in the hashes given, or it isn't the first of its group."""
        named = np.zeros(len(self.h), bool)
        at, stop = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        while (at < stop).any():  # groups that share the 64 bits are few
            at, stop, more = (x[at < stop] for x in (at, stop, more))
            named[at[self.more[at] == more]] = True
            at = at + 1
        out = np.zeros(len(self.order), bool)
        out[self.order] = True
        out[self.first] = named
        out[self.order[np.repeat(named, self.sizes)]] = True
        return out


def _ordered(table: pa.Table) -> pa.RecordBatch:
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


def _grouped(found: list[tuple[np.ndarray, np.ndarray]]) -> Firsts:
    """All windows found, which are given up: the list is emptied."""
    h, more = (np.concatenate(x) for x in zip(*found))
    found.clear()
    return Firsts(h, more)


def _send(window: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        own = _grouped([_windows(b.column("text"), window)[4:] for b in steps(iter([_ordered(table)]), "text")])
        turn = np.searchsorted(own.h, 0)  # groups rise as signed numbers, parts as unsigned ones
        h, more = (np.concatenate([x[turn:], x[:turn]]) for x in (own.h, own.more))
        del own
        part = (((h.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(part)), bool), part[1:] != part[:-1]]))
        cuts = pa.array(np.concatenate([starts, [len(part)]]), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (h, more)]
        return pa.table({"part": part[starts], "bucket": np.full(len(starts), table["bucket"][0].as_py(), np.int64), "h": lists[0], "more": lists[1]})

    return run


def _remove(window: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_pylist([], RESULT)
        batches = [(b, *_windows(b.column("text"), window)) for b in steps(iter([_ordered(docs)]), "text")]
        found, batches = [x[5:] for x in batches], [x[:5] for x in batches]
        gone = _grouped(found).gone(*(pc.list_flatten(told[c].combine_chunks()).to_numpy(zero_copy_only=False) for c in ("h", "more")))
        out, done = [], 0
        for b, codes, ends, distinct, start in batches:
            hit = start[gone[done : done + len(start)]]
            done += len(start)
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, hit, 1)
            np.add.at(change, hit + window, -1)
            covered = np.cumsum(change)[:-1] > 0
            stays = np.concatenate([[0], np.cumsum(~covered)])[ends]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
            begins, stops = edges[::2], edges[1::2]
            doc = np.searchsorted(ends, begins, side="right") - 1
            spans = [[] for _ in range(b.num_rows)]
            for d, i, j in zip(doc.tolist(), begins.tolist(), stops.tolist()):
                while j > ends[d + 1]:  # runs that meet at the border of two documents are two intervals
                    spans[d].append({"start": i - int(ends[d]), "end": int(ends[d + 1] - ends[d])})
                    i, d = int(ends[d + 1]), d + 1
                    while ends[d + 1] == i:
                        d += 1
                spans[d].append({"start": i - int(ends[d]), "end": j - int(ends[d])})
            kept = distinct.take(pa.array(codes[~covered]))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(stays, pa.int32()), kept), b" ").cast(pa.string())
            n = np.diff(ends)
            out.append(pa.table({"doc_id": b.column("doc_id"), "text": texts, "n_words": n, "n_removed": n - np.diff(stays), "intervals": pa.array(spans, RESULT.field("intervals").type)}).cast(RESULT))
        return pa.concat_tables(out)

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


class Dealer:
    """Numbers buckets along ids that come in order, by the bytes of their texts."""

    def __init__(self, bucket_bytes: int):
        self.bytes, self.next, self.room = bucket_bytes, 0, -1

    def begin(self, size: int) -> tuple[int, int] | None:
        """(bucket, number of buckets) if the id begins a bucket; one with more text than a bucket has several of its own."""
        n = max(1, -(-size // self.bytes))
        if n == 1 and size <= self.room:
            self.room -= size
            return None
        at, self.next = self.next, self.next + n
        self.room = self.bytes - size if n == 1 else -1
        return at, n


BOUNDS = pa.schema([("coarse", pa.int64()), ("bucket", pa.int64()), ("first", pa.int64()), ("number", pa.int64()), ("size", pa.int64())])


def joined(ranges: list[tuple[int, int, bool]], bucket_bytes: int) -> list[int]:
    """Of (bucket, bytes, whether it may be joined) of each range's first bucket, in order: the buckets that the one before takes in."""
    gone, room = [], -1
    for bucket, size, may in ranges:
        if may and size <= room:
            gone.append(bucket)
            room -= size
        else:
            room = bucket_bytes - size if may else -1
    return gone


def _table(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(BOUNDS), BOUNDS)], schema=BOUNDS)


def _bounds(bucket_bytes: int, apart: int):
    """The buckets of a range of ids, each with its first id, its bytes and the coarse bucket it belongs to; null is a coarse bucket of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, seen, coarse, held = Dealer(bucket_bytes), 0, 0, []
        for batch in batches:
            out = []
            for i, size, number in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "size", "range"))):
                if i is None:
                    dealer.room = -1
                begun = dealer.begin(size)
                if begun:
                    out += held
                    bucket = (number << 32) + begun[0]
                    coarse = bucket if seen % apart == 0 or i is None else coarse
                    held = [[coarse, bucket, i, begun[1], 0]]
                    seen += 1
                held[0][4] += size
            yield _table(out)
        yield _table(held)

    return run


def id_buckets(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, broadcast_most: int = BROADCAST_BUCKETS) -> DataFrame:
    """(doc_id, text, bucket): ranges of doc_id of about `bucket_bytes` of text each, null ids last.

    Ids with their bytes are dealt to ranges and summed along each; the buckets so begun are written. The driver
    holds those of BROADCAST_BUCKETS at most; of more the first of every COARSE, and a bucket among them is found by a join.
    """
    order = F.col("doc_id").asc_nulls_last()
    sizes = docs.groupBy("doc_id").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (RANGE * bucket_bytes) + 1)
    ranged = sizes.repartitionByRange(ranges, order).sortWithinPartitions(order).select("doc_id", "size", F.spark_partition_id().cast("long").alias("range"))
    bounds = cut(ranged.mapInArrow(_bounds(bucket_bytes, COARSE), "coarse long, bucket long, first long, number long, size long"))
    # one row a range: those of less than a bucket are joined with their neighbours
    whole = bounds.groupBy(F.shiftright("bucket", 32).alias("range")).agg(F.min("bucket").alias("bucket"), F.sum("size").alias("size"), ((F.count("first") == 1) & (F.count("*") == 1) & (F.max("number") == 1)).alias("may"))
    gone = joined([(r["bucket"], r["size"], r["may"]) for r in whole.orderBy("range").collect()], bucket_bytes)
    bounds = bounds.where(~F.col("bucket").isin(gone)) if gone else bounds
    few = bounds.count() <= broadcast_most
    # 24 bytes a bucket, or 24 bytes for COARSE buckets of text
    starts = (bounds if few else bounds.where("coarse = bucket")).orderBy("bucket").select("first", "bucket", "number").collect()
    absent = [(r["bucket"], r["number"]) for r in starts if r["first"] is None] or [(-1, 1)]
    firsts, names, numbers = (np.array([r[c] for r in starts if r["first"] is not None], np.int64) for c in ("first", "bucket", "number"))

    def found(ids: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        known = ids.notna().to_numpy()
        at = np.searchsorted(firsts, ids[known].to_numpy(np.int64), side="right") - 1
        name, number = np.full(len(ids), absent[0][0], np.int64), np.full(len(ids), absent[0][1], np.int64)
        name[known], number[known] = names[at], numbers[at]
        return name, number

    @F.pandas_udf("long")
    def coarse(ids: pd.Series) -> pd.Series:
        return pd.Series(found(ids)[0])

    @F.pandas_udf("long")
    def bucket(ids: pd.Series, marks: pd.Series) -> pd.Series:
        name, number = found(ids)
        return pd.Series(name + marks.to_numpy(np.int64) % number)

    if few:
        return docs.select("doc_id", "text", bucket("doc_id", F.xxhash64("text")).alias("bucket"))
    inside = bounds.groupBy("coarse").agg(F.sort_array(F.collect_list(F.struct("bucket", "first", "number"))).alias("buckets"))
    own = F.element_at(F.filter("buckets", lambda b: b["first"].isNull() | (b["first"] <= F.col("doc_id"))), -1)
    dealt = docs.select("doc_id", "text", coarse("doc_id").alias("coarse")).join(inside, "coarse").withColumn("own", own)
    return dealt.select("doc_id", "text", (F.col("own.bucket") + F.pmod(F.xxhash64("text"), F.col("own.number"))).alias("bucket"))


def substring_dedup(docs: DataFrame, window: int = 20, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text of the words that stay, n_words, n_removed, intervals removed, in words)."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = id_buckets(docs, bucket_bytes)
    tasks = COUNTERS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.groupBy("bucket").applyInArrow(_send(window, PARTS * tasks), "part int, bucket long, h array<long>, more array<short>")
    # dealt by part, which all that follows groups by: the hashes are exploded after the exchange, and counted without another
    each = sent.repartition(tasks, "part").select("part", "bucket", F.explode(F.arrays_zip("h", "more")).alias("w")).select("part", "bucket", "w.h", "w.more")
    nth = F.row_number().over(Window.partitionBy("part", "h", "more").orderBy("bucket"))
    told = each.withColumn("nth", nth).where("nth > 1").groupBy("part", "bucket").agg(F.collect_list("h").alias("h"), F.collect_list("more").alias("more"))
    return docs.groupBy("bucket").cogroup(told.select("bucket", "h", "more").groupBy("bucket")).applyInArrow(
        _remove(window), "doc_id long, text string, n_words long, n_removed long, intervals array<struct<start:int,end:int>>"
    )
