"""Best-fit packing by minimum bin slack.

1. Texts become token ids (each worker keeps a dictionary of words, so that a frequent word is tokenized once) and
   are cut into pieces of at most `size` ids. Spark counts the pieces of each length: at most `size` counters.
2. Bin after bin, the longest length left is placed and a bitset of reachable sums, grown over the
   available lengths with their counts, finds the fullest feasible rest. The combination found is
   removed as often as its lengths last, for the next bins would find the same one. A pattern is
   thus a combination and a number of bins; there are a few for each length, however many pieces.
3. Each piece is ranked among the pieces of its length: a rank inside its bucket of documents plus the
   pieces in the buckets before, so no length is gathered in one task. The rank names pattern, bin and
   place. Buckets hold about as many pieces as a task handles.

Defined results: null or empty text is one end-of-text id; rows that share a doc_id are packed each, with
the same piece numbers; a null doc_id is packed too; an empty table gives no rows; other columns are ignored. Texts are
tokenized whole; a very long one is one step, held a few times over in its task. Of a vocabulary that doesn't lower-case
or part letters from marks only the words are kept; one whose tokens cross white space is an error.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.llm.common import ASCII_LOWER, cut, plain, small_batches, steps, words

#: Words that a worker's dictionary holds before it forgets the rare ones.
MOST_WORDS = 400_000
#: Bytes of text that a task tokenizes at a time.
STEP = 4 << 20
#: A word of one token that stands between words in a call to the tokenizer.
MARK = "\x01"
#: Pieces of a bucket of the ranking.
BUCKET_PIECES = 50_000


_LETTER = np.array([0x61 <= b <= 0x7A for b in range(256)])
_MARK = np.array([0x21 <= b <= 0x7E and not chr(b).isalnum() for b in range(256)])


class WordIds:
    """Token ids of texts, word by word: white space always ends a token of this vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        if ids("ab cd\tab\ncd") != [*ids("ab"), *ids("cd"), *ids("ab"), *ids("cd")]:
            raise ValueError(f"{path}: tokens cross white space, which word-wise ids can't tell")
        #: Whether the vocabulary lower-cases, and parts letters from every ASCII mark.
        self.parts = all(ids(f"Ab{chr(m)}cdÉ{chr(m)}") == ids(f"ab {chr(m)}cdé {chr(m)}") for m in range(256) if _MARK[m])
        self.names: list[bytes] = []
        self.known: dict[bytes, int] = {}
        self.pool, self.sizes, self.hits = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the words that more than one step has met, if they are few enough, else none."""
        keep = self.hits > 1
        if keep.sum() > MOST_WORDS // 2:
            keep[:] = False
        self.pool = self.pool[np.repeat(keep, self.sizes)]
        self.sizes, self.hits = self.sizes[keep], np.zeros(int(keep.sum()), np.int32)
        self.names = [self.names[i] for i in np.flatnonzero(keep)]
        self.known = {w: i for i, w in enumerate(self.names)}

    def _learn(self, new: list[bytes]) -> None:
        """Ids of new words, many in a call with a mark between them; words that hold the mark go alone."""
        mark = MARK.encode()
        odd = [w for w in new if mark in w]
        even = [w for w in new if mark not in w] if odd else new
        between, pool, sizes = b" " + mark + b" ", [self.pool], [self.sizes]
        for i in range(0, len(even), 4096):
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(even[i : i + 4096]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            real = ids != self.mark
            pool.append(ids[real])
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(~real), [len(ids)]])) - 1)
        for w in odd:
            pool.append(np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, np.uint32))
            sizes.append([len(pool[-1])])
        self.pool, self.sizes = np.concatenate(pool), np.concatenate(sizes).astype(np.int32)
        at = len(self.names)
        self.names += [*even, *odd]
        self.known.update(zip([*even, *odd], range(at, at + len(new))))
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int32)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's ids begin and end)."""
        codes, ends, distinct = words(_parted(texts) if self.parts else plain(texts))
        if len(self.names) + len(distinct) > MOST_WORDS:
            self._forget()
        self._learn([w for w in distinct if w not in self.known])
        own = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.hits[own] += 1
        first = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[own][codes]
        each = self.sizes[own][codes]
        stops = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        first -= stops[:-1]
        at = np.repeat(first, each)
        at += np.arange(stops[-1])
        return self.pool[at], stops[ends]


def _parted(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and a space wherever a letter meets an ASCII mark: the vocabulary lower-cases and always
    parts there, and fewer words are distinct. Texts that may hold special tokens, which are matched as they stand, stay."""
    whole = plain(texts)
    lower = plain(whole, ASCII_LOWER)
    offsets = np.frombuffer(lower.buffers()[1], np.int32)[: len(lower) + 1].astype(np.int64) if pa.types.is_string(lower.type) and len(lower) else None
    if offsets is None or offsets[-1] == offsets[0]:
        return whole
    body = lower.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]]
    if b"<|" in body:
        return whole
    data = np.frombuffer(body, np.uint8)
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # the accented letters of Latin-1
    at = np.flatnonzero(letter[:-1] & _MARK[data[1:]]) + 1
    offsets = offsets - offsets[0]
    moved = (offsets + np.searchsorted(at, offsets)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(lower), [None, pa.py_buffer(moved.tobytes()), pa.py_buffer(np.insert(data, at, 0x20).tobytes())])


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each Python worker, whatever number of tasks it runs."""
    return WordIds(path)


def _pieces(path: str, size: int, end: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_ids(path)
        for batch in steps(batches, "text", STEP):
            ids, ends = tokens(batch.column("text"))
            row, number, start, length, crc, own = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                full = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                for k, s in enumerate(range(0, len(full), size)):
                    piece = full[s : s + size]
                    row.append(i)
                    number.append(k)
                    start.append(s)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    own.append(piece.astype(np.int32) if keep else None)
            out = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(own, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def fullest(counts: dict[int, int], size: int) -> list[tuple[int, int]]:
    """The longest length and the lengths (with their numbers) that leave the least slack beside it."""
    longest = max(counts)
    room, reach, seen = size - longest, 1, []
    limit = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        step = 1
        while left > 0 and not reach >> room & 1:
            step = min(step, left)
            seen.append((length, step, reach))
            reach |= (reach << length * step) & limit
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {longest: 1}
    for length, step, before in reversed(seen):
        if not before >> at & 1:
            at -= length * step
            used[length] = used.get(length, 0) + step
    return sorted(used.items(), reverse=True)


def patterns(counts: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(combination of lengths, bins that hold it) until no piece is left."""
    counts, out = dict(counts), []
    while counts:
        found = fullest(counts, size)
        bins = min(counts[length] // n for length, n in found)
        for length, n in found:
            counts[length] -= n * bins
            if not counts[length]:
                del counts[length]
        out.append((found, bins))
    return out


def _places(plan: list[tuple[list[tuple[int, int]], int]]) -> pd.DataFrame:
    """Of each length: from which rank on, it goes to which pattern's bins, how many to a bin, and where in the bin."""
    rows, ranks, first = [], {}, 0
    for found, bins in plan:
        offset = 0
        for length, n in found:
            rows.append((length, ranks.get(length, 0), first, n, offset))
            ranks[length] = ranks.get(length, 0) + n * bins
            offset += length * n
        first += bins
    return pd.DataFrame(rows, columns=["length", "from", "first", "each", "offset"]).sort_values(["length", "from"])


def _place(places: pd.DataFrame):
    by = {k: v[["from", "first", "each", "offset"]].to_numpy() for k, v in places.groupby("length")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(length[order])) + 1).tolist(), len(order)] if len(order) else [0]
            for a, b in zip(cuts, cuts[1:]):
                own, k = order[a:b], int(length[order[a]])
                line = by[k][np.searchsorted(by[k][:, 0], rank[own], side="right") - 1]
                nth = rank[own] - line[:, 0]
                sequence[own] = line[:, 1] + nth // line[:, 2]
                offset[own] = line[:, 3] + nth % line[:, 2] * k
            kept = [c for c in batch.schema.names if c not in ("rank",)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def token_pieces(docs: DataFrame, path: str, size: int = 4096, end: int = 1, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each text's ids and the end id, cut where they exceed `size`."""
    texts = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_pieces(path, size, end, keep_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>")


def pack(docs: DataFrame, path: str, size: int = 4096, end: int = 1, keep_ids: bool = False) -> DataFrame:
    """token_pieces() with the sequence and the place in it that each piece goes to; ids only if kept."""
    pieces = token_pieces(docs, path, size, end, keep_ids)
    pieces = cut(pieces if keep_ids else pieces.drop("ids"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    total = sum(counts.values())
    buckets = max(1, -(-total // BUCKET_PIECES))
    places = _places(patterns(counts, size))
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    pieces = pieces.withColumn("bucket", key)
    per = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("rank", rank.cast("long")).join(per, ["length", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids array<int>, " if keep_ids else "") + "sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(_place(places), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): what is fed to training, from pack(keep_ids=True)."""
    part = F.struct("offset", "ids", "doc_id")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # at most `size` pieces
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def vocabulary(spark: SparkSession, name: str = "word_bpe_49k.json") -> str:
    """Where that public vocabulary lies: in the folder that the session names by spark.offerloom.tokenizers, if any."""
    folder = spark.conf.get("spark.offerloom.tokenizers", None)
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
