"""Line dedup: a sharded minimal perfect hash indexes the repeated lines; documents probe it.

1. Every document emits the 128-bit hashes of its distinct line keys; Spark counts the documents
   of each hash and keeps the smallest id (partial aggregation, so a hot line costs one row a task).
2. The hashes that more than one document holds are dealt to shards. One task a shard builds a
   minimal perfect hash and, by its positions, the arrays of fingerprints, document counts and owners.
3. The lines of each document travel as bare hashes to the shard's partition, where the arrays come
   first and the lines stream past them: no line meets a table of lines, and no group is held whole.
   There are enough shards for all lines of the corpus, and a shard that many repeated lines probe is
   copied to several partitions, by the counts found in step 1.
4. The dropped line numbers go back to their rows, named by doc_id and a hash of the text.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z lower-cased. Defined results:
null or empty text is one empty line; a null doc_id is neither compared nor changed; rows that share
a doc_id are one document and keep their lines unless a smaller id holds them; an empty table gives
no rows; other columns are ignored by line_dedup() and returned as they are by without_repeated_lines(), whatever
their names. Texts are read whole; a very long one is one step, held a few times over in its task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.columns import unused
from offerloom.llm.common import ASCII_LOWER, cut, mix, plain, small_batches, steps

BLANK = " \t\n\x0b\x0c\r"
#: Keys of a shard, and the most shards there are: their counters are all that reaches the driver.
SHARD_KEYS, MOST_SHARDS = 50_000, 65_536
#: Lines that one copy of a shard answers before another copy is made, and the most partitions they are dealt to for that.
PROBES, MOST_TASKS = 500_000, 65_536
GAMMA = 1.7


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bitmaps, the rank of a set bit is the place."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        level = 0
        while len(keys):
            size = _level_size(len(keys))
            at = mix(keys, level) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.levels.append(np.packbits(alone))
            keys = keys[~alone[at.astype(np.int64)]]
            level += 1

    def unpacked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For probing: each level's bits and the places they stand for."""
        out, before = [], 0
        for packed in self.levels:
            bits = np.unpackbits(packed).astype(bool)
            places = np.cumsum(bits) - 1 + before
            out.append((bits, places))
            before = int(places[-1]) + 1
        return out


def _level_size(n: int) -> int:
    return int(n * GAMMA) + 64


def _fingerprint(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first, 99) ^ second


class Shard:
    """The arrays of one shard, in the order of its perfect hash."""

    def __init__(self, first: np.ndarray, second: np.ndarray, count: np.ndarray, owner: np.ndarray):
        keys, index, times = np.unique(first, return_index=True, return_counts=True)
        self.odd = {}  # distinct lines whose first 64 bits agree: looked up by all 128
        for key in keys[times > 1]:
            for i in np.flatnonzero(first == key):
                self.odd[int(key), int(second[i])] = (int(count[i]), int(owner[i]))
        self.hash, self.n, self.levels = PerfectHash(keys), len(keys), None
        self.widths, left = [], len(keys)
        for packed in self.hash.levels:
            self.widths.append(_level_size(left))
            left -= int(np.unpackbits(packed).sum())
        place = self._place(keys)
        self.fingerprint, self.count, self.owner = np.zeros(self.n, np.uint64), np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.fingerprint[place], self.count[place], self.owner[place] = _fingerprint(keys, second[index]), count[index], owner[index]
        self.levels = None  # travels packed

    def _place(self, keys: np.ndarray) -> np.ndarray:
        if self.levels is None:
            self.levels = self.hash.unpacked()
        place, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, ((bits, places), width) in enumerate(zip(self.levels, self.widths)):
            at = (mix(keys[rest], level) % np.uint64(width)).astype(np.int64)
            hit = bits[at]
            place[rest[hit]] = places[at[hit]]
            rest = rest[~hit]
        return place

    def probe(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that hold the line, or 0 for a line that isn't indexed; the smallest of them)."""
        place = self._place(first)
        found = (place >= 0) & (self.n > 0)
        found[found] = self.fingerprint[place[found]] == _fingerprint(first[found], second[found])
        count, owner = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        count[found], owner[found] = self.count[place[found]], self.owner[place[found]]
        if self.odd:
            for i in np.flatnonzero(np.isin(first, np.array([k for k, _ in self.odd], np.uint64))):
                count[i], owner[i] = self.odd.get((int(first[i]), int(second[i])), (0, 0))
        return count, owner


def _lines(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, line number and both hashes of each line whose key has `least` code points."""
    lists = pc.split_pattern(plain(batch.column("text"), ASCII_LOWER), "\n")
    row = pc.list_parent_indices(lists).to_numpy()
    starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    keys = pc.utf8_trim(lists.flatten(), characters=BLANK)
    number = np.arange(len(row)) - starts[row]
    long = pc.greater_equal(pc.utf8_length(keys), least).to_numpy(zero_copy_only=False)
    keys = keys.filter(pa.array(long)).cast(pa.binary())
    whole = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join(whole(k) for k in keys.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
    return row[long], number[long], both[:, 0], both[:, 1]


def _held(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            row, _, a, b = _lines(batch, least)
            _, once = np.unique(np.stack([row.astype(np.uint64), a, b]), axis=1, return_index=True) if len(row) else (None, np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(a[once].view(np.int64)), pa.array(b[once].view(np.int64)), pa.array(ids[row[once]].astype(np.int64))], ["a", "b", "doc_id"])

    return run


def _shards_of(a: np.ndarray, shards: int) -> np.ndarray:
    return (mix(a, 77) % np.uint64(shards)).astype(np.int64)


def _number(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("a").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_shards_of(a, shards)), *batch.columns], ["shard", "a", "b", "n", "owner"])

    return run


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    shard = Shard(pdf["a"].to_numpy().view(np.uint64), pdf["b"].to_numpy().view(np.uint64), pdf["n"].to_numpy(), pdf["owner"].to_numpy())
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "arrays": [pickle.dumps(shard, protocol=5)]})


def _asked(least: int, firsts: np.ndarray, copies: np.ndarray):
    """Each line as a question to one copy of its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "mark"))
            row, number, a, b = _lines(batch, least)
            shard = _shards_of(a, len(firsts))
            with np.errstate(over="ignore"):
                copy = mix((ids ^ marks)[row].view(np.uint64) + number.astype(np.uint64), 5) % copies[shard].astype(np.uint64)
            n = len(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(firsts[shard] + copy.astype(np.int64)), pa.array(np.ones(n, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                 pa.array(ids[row]), pa.array(marks[row]), pa.array(number.astype(np.int32)), pa.nulls(n, pa.binary())],
                ["slot", "kind", "a", "b", "doc_id", "mark", "line", "arrays"],
            )

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by slot, the slot's arrays first: hold one shard, let the lines stream past it."""
    at, shard = None, None
    for batch in batches:
        slots, kinds = batch.column("slot").to_numpy(), batch.column("kind").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(slots) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(slots)]
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            if kinds[i] == 0:
                at, shard = slots[i], pickle.loads(batch.column("arrays")[i].as_py())
                continue
            if slots[i] != at:
                continue  # no line of this shard is repeated
            part = batch.slice(i, j - i)
            ids = part.column("doc_id").to_numpy()
            count, owner = shard.probe(part.column("a").to_numpy().view(np.uint64), part.column("b").to_numpy().view(np.uint64))
            lost = (count > 1) & (owner != ids)
            if lost.any():
                yield part.select(["doc_id", "mark", "line"]).filter(pa.array(lost))


def repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """(a, b, n, owner): the hash halves of every key in two documents or more, how many, and the smallest id."""
    held = small_batches(docs).where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_held(least), "a long, b long, doc_id long")
    found = held.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    return found.where("owner <> last").drop("last")


def _mark(docs: DataFrame):
    """With doc_id, the name of a row: rows of one doc_id may hold different texts."""
    return F.xxhash64(docs["text"].cast("string"))


def count_lines(docs: DataFrame) -> int:
    text = F.col("text").cast("string")
    return docs.agg(F.sum(F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"))), F.lit(0)) + 1)).first()[0] or 0


def slots(repeated: DataFrame, lines: int) -> tuple[DataFrame, np.ndarray]:
    """(repeated lines with their shards, copies of each shard), for a corpus of so many lines.

    A line that isn't indexed is alone with its hash, so such lines meet all shards alike.
    """
    shards = int(min(MOST_SHARDS, max(1, -(-repeated.count() // SHARD_KEYS), -(-lines // PROBES))))
    placed = repeated.mapInArrow(_number(shards), "shard long, a long, b long, n long, owner long")
    asked = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # at most MOST_SHARDS counters
    return placed, np.array([1 + (asked.get(i, 0) + lines // shards) // PROBES for i in range(shards)], np.int64)


def questions(docs: DataFrame, least: int, copies: np.ndarray) -> DataFrame:
    """Every line that is long enough, and the slot (a copy of a shard) that it is dealt to."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _mark(docs).alias("mark"))
    return texts.mapInArrow(_asked(least, np.cumsum(copies) - copies, copies), "slot long, kind int, a long, b long, doc_id long, mark long, line int, arrays binary")


def dropped_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, mark, lines array<int>): the line numbers that each row loses."""
    repeated = cut(repeated_lines(docs, least))
    placed, copies = slots(repeated, count_lines(docs))
    arrays = placed.groupBy("shard").applyInPandas(_build, "shard long, arrays binary")
    named = docs.sparkSession.createDataFrame(pd.DataFrame({"shard": np.arange(len(copies)), "first": np.cumsum(copies) - copies, "copies": copies}))
    index = arrays.join(named, "shard").select(
        F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("slot"), F.lit(0).alias("kind"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("a", "long"), ("b", "long"), ("doc_id", "long"), ("mark", "long"), ("line", "int"))], "arrays",
    )
    tasks = max(min(int(copies.sum()), MOST_TASKS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = index.unionByName(questions(docs, least, copies)).repartition(tasks, "slot").sortWithinPartitions("slot", "kind")
    lost = met.mapInArrow(_answer, "doc_id long, mark long, line int")
    return lost.groupBy("doc_id", "mark").agg(F.collect_set("line").alias("lines"))


def _kept(texts: pa.Array, lines: pa.Array) -> tuple[list[str], list[int], list[int]]:
    """Each text without the named lines, its lines before, and how many went."""
    kept, n, dropped = [], [], []
    for text, gone in zip(texts.to_pylist(), lines.to_pylist()):
        own = (text or "").split("\n")
        n.append(len(own))
        out = set(gone or ())
        left = [x for i, x in enumerate(own) if i not in out] if out else own
        dropped.append(len(own) - len(left))
        kept.append("\n".join(left))
    return kept, n, dropped


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        kept, n, dropped = _kept(batch.column("text"), batch.column("lines"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


def line_dedup(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, text without the lines that an earlier document holds, n_lines, n_dropped), one row per row."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _mark(docs).alias("mark"))
    return texts.join(dropped_lines(docs, least), ["doc_id", "mark"], "left").mapInArrow(_counted, "doc_id long, text string, n_lines long, n_dropped long")


def without_repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """docs, all columns, with the shortened texts (and n_chars, if there is one); a document that loses every word goes."""
    names, own_id, own_mark, gone = docs.columns, *unused(docs.columns, "lost_id", "lost_mark", "lost_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            kept, _, dropped = _kept(batch.column("text"), batch.column(gone))
            keep = [not d or not k.isspace() and k != "" for k, d in zip(kept, dropped)]
            columns = {c: batch.column(c) for c in names}
            shorter = pa.array([k if d else None for k, d in zip(kept, dropped)], batch.column("text").type)
            columns["text"] = pc.coalesce(shorter, batch.column("text"))
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(k) if d else c for k, d, c in zip(kept, dropped, columns["n_chars"].to_pylist())], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(keep, pa.bool_()))

    lost = dropped_lines(docs, least).toDF(own_id, own_mark, gone)
    met = docs.join(lost, (docs["doc_id"] == F.col(own_id)) & (_mark(docs) == F.col(own_mark)), "left")
    return met.drop(own_id, own_mark).mapInArrow(run, docs.schema)
