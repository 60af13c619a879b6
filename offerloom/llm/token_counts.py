"""Token counts of whole texts from counts of distinct pre-tokens.

A pre-token is a stretch of a text that pieces of the vocabulary never cross: runs of the space mark begin one, and a
character that stands in no piece of several characters is one by itself. Merges only make pieces of the vocabulary, so
those on either side of such a border don't touch each other, and a text has as many tokens as its pre-tokens together.

1. Each task gathers the pre-tokens that two of its texts or more hold, with the number of texts, and forgets rare ones when
   they grow too many; Spark adds them up. The library counts the tokens of those held by most texts, at most `HOT` and none longer than
   `LONGEST` characters, and all tasks get them: a fixed size whatever the corpus. This only saves way: any set would do.
2. Each text's pre-token frequencies are made; those of hot pre-tokens are multiplied and summed where they are. The others
   of some texts make a packet, which is dealt by the pre-tokens' hash: a part for each shard. A shard's task meets all frequencies of
   its pre-tokens, counts each distinct one once, joins the counts to the frequencies by a hash table, and sends the sums back to the packet.
3. A packet's task adds the sums of its texts. How many occurrences came back is compared with how many were sent, so that a
   packet which came out differently when a lost task was run again is an error and never a wrong count. No token ids are kept anywhere.

Defined results: null text is empty and has no bytes and no tokens; texts are read whole, and a very long one is a packet
of its own; repeated rows come back as often as they were; a null doc_id is counted like others; an
empty table gives no rows; other columns are ignored. A model whose pieces cross the border before a space mark, that
rewrites texts, or for which a line end isn't a pre-token is an error.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import cut, groups, small_batches, steps

#: The vocabulary's mark of a space.
SPACE = "▁"
#: Pre-tokens whose counts every task gets, and the characters of the longest of them.
HOT, LONGEST = 1 << 16, 64
#: Pre-tokens that a task gathers before it forgets the rare ones.
GATHERED = 500_000
#: Bytes of text and number of texts of a packet.
PACKET_BYTES, PACKET_TEXTS = 16 << 20, 60_000
#: Pre-tokens that a shard's task remembers.
KNOWN = 1_000_000
#: Texts of more characters are matched piece by piece.
LONG_TEXT = 1 << 22
#: Texts that a model must leave as they are, but for the space mark.
PROBES = ("a  b ", " a\tb\n\nc", "ﬁ Ａ́ é ½", "<s></s><unk>", "　x y​z")


class Pieces:
    """A sentencepiece BPE model: its pre-tokens and their numbers of tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = {i for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        several = [p for i in range(model.get_piece_size()) if i not in odd and len(p := model.id_to_piece(i)) > 1]
        crossing = [p for p in several if re.search(f"[^{SPACE}]{SPACE}", p)]
        if crossing or any("\n" in p for p in several):
            raise ValueError(f"{path}: pieces cross the borders of pre-tokens: {crossing[:3]}")
        for text in PROBES:
            if model.normalize(text) != marked(text) or {i for i in model.encode(text) if not model.is_byte(i)} & odd:
                raise ValueError(f"{path}: the model rewrites texts or reads control strings in them")
        joined = "".join(map(re.escape, sorted(set("".join(several)) - {SPACE})))
        self.pattern = re.compile(f"{SPACE}+[{joined}]*|[{joined}]+|[^{SPACE}{joined}]")
        self.alone = len(model.encode("\n"))

    def split(self, text: str):
        text = marked(text)
        return self.pattern.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in self.pattern.finditer(text))

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token, which is encoded behind a line end, so that nothing is put before it."""
        return [len(ids) - self.alone for ids in self.model.encode(["\n" + p for p in pieces], num_threads=1)]


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def marked(text: str) -> str:
    """The text as the model sees it: a space mark before it and for every space."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _gathered(path: str):
    """Pre-tokens that several texts of a task hold, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = pieces_of(path), Counter()
        for batch in steps(batches, "text"):
            for text in batch.column("text").to_pylist():
                if text:
                    held.update(set(pieces.split(text)))
                    if len(held) > GATHERED:
                        least = sorted(held.values())[len(held) // 2]
                        held = Counter({p: n for p, n in held.items() if n > least})
        shown = [(p, n) for p, n in held.items() if n > 1 and len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in shown], pa.string()), pa.array([n for _, n in shown], pa.int64())], ["piece", "texts"])

    return run


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(pieces_of(path).counts(batch.column("piece").to_pylist()), pa.int64())], ["piece", "n"])

    return run


def hot_counts(texts: DataFrame, path: str) -> dict[str, int]:
    """The tokens of at most HOT pre-tokens held by most texts; of equally many, all or none."""
    own = cut(texts.mapInArrow(_gathered(path), "piece string, texts long").groupBy("piece").agg(F.sum("texts").alias("texts")))
    # Levels of a sixteenth of a doubling: a row for each level tells how far down HOT pieces reach.
    level = F.floor(F.log2("texts") * 16).cast("int")
    least, room = None, HOT
    for r in own.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 16 * 63 rows
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    if least is None:
        return {}
    return {r["piece"]: r["n"] for r in own.where(level >= least).mapInArrow(_counted(path), "piece string, n long").collect()}  # HOT rows at most


ROW = pa.schema([("to", pa.int32()), ("packet", pa.binary()), ("head", pa.bool_()), ("seen", pa.int64()), ("body", pa.binary())])
_KIND = "to int, packet binary, head boolean, seen long, body binary"


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed body, each behind its length."""
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zlib.compress(np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts), 1)


def _unpacked(body: bytes, *kinds) -> list:
    body, at, out = zlib.decompress(body), 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(body, np.int64, len(kinds)).tolist(), kinds):
        out.append(body[at : at + n] if kind is bytes else np.frombuffer(body[at : at + n], kind))
        at += n
    return out


class Packet:
    """Texts whose rare pre-tokens are counted elsewhere."""

    def __init__(self):
        self.ids, self.sizes, self.known = [], [], []
        self.pieces, self.texts, self.times = [], array("H"), array("q")
        self.name, self.bytes = xxhash.xxh3_128(), 0

    def add(self, doc_id: int | None, text: str, pieces: Pieces, hot: dict[str, int]) -> None:
        body, at, total = text.encode(), len(self.ids), 0
        self.name.update(f"{doc_id} {len(body)} ".encode())
        self.name.update(body)
        for piece, f in Counter(pieces.split(text)).items():
            n = hot.get(piece)
            if n is None:
                self.pieces.append(piece)
                self.texts.append(at)
                self.times.append(f)
            else:
                total += n * f
        self.ids.append(doc_id)
        self.sizes.append(len(body))
        self.known.append(total)
        self.bytes += len(body)

    def rows(self, shards: int) -> pa.RecordBatch:
        """The packet's own row, and a part for each shard: its distinct pre-tokens, how many texts hold each, these texts and the times."""
        name, times, texts = self.name.digest(), np.array(self.times, np.int64), np.array(self.texts, np.uint16)
        null = np.array([i is None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        head = _packed(null, ids, np.array(self.sizes, np.int64), np.array(self.known, np.int64))
        rows = [(xxhash.xxh3_64_intdigest(name) % shards, name, True, int(times.sum()), head)]
        coded = pa.array(self.pieces, pa.large_string()).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), [p.encode() for p in coded.dictionary.to_pylist()]
        shard = np.array([xxhash.xxh3_64_intdigest(p) % shards for p in distinct], np.int64)
        order = np.lexsort((codes, shard[codes])) if len(codes) else np.zeros(0, np.int64)
        codes, texts, times = codes[order], texts[order], times[order]
        edges = [*np.flatnonzero(np.diff(shard[codes], prepend=-1)).tolist(), len(codes)] if len(codes) else []
        for a, b in zip(edges, edges[1:]):
            first = np.flatnonzero(np.diff(codes[a:b], prepend=-1))
            own, held = codes[a:b][first], np.diff(np.append(first, b - a)).astype(np.uint16)
            rows.append((int(shard[own[0]]), name, False, int(times[a:b].sum()), _packed(b"\n".join(distinct[c] for c in own.tolist()), held, texts[a:b], times[a:b])))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), ROW.types)], schema=ROW)


def _sent(path: str, hot, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packet, pieces, counts = Packet(), pieces_of(path), hot.value
        for batch in steps(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                packet.add(doc_id, text or "", pieces, counts)
                if packet.bytes > PACKET_BYTES or len(packet.ids) >= PACKET_TEXTS:
                    yield packet.rows(shards)
                    packet = Packet()
        if packet.ids:
            yield packet.rows(shards)

    return run


def _answered(path: str):
    """Of each part, the sums of tokens of its texts; the packets' own rows go on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            bodies = []
            for head, body in zip(batch.column("head").to_pylist(), batch.column("body").to_pylist()):
                if not head:
                    joined, held, texts, times = _unpacked(body, bytes, np.uint16, np.uint16, np.int64)
                    own = joined.split(b"\n")
                    if len(known) > KNOWN:
                        known.clear()
                    new = [p for p in own if p not in known]
                    known.update(zip(new, pieces_of(path).counts([p.decode() for p in new])))
                    tokens = np.repeat(np.fromiter(map(known.__getitem__, own), np.int64, len(own)), held) * times
                    order = np.argsort(texts, kind="stable")
                    met, first = np.unique(texts[order], return_index=True)
                    body = _packed(met, np.add.reduceat(tokens[order], first))
                bodies.append(body)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("packet", "head", "seen")), pa.array(bodies, pa.binary())], ["packet", "head", "seen", "body"])

    return run


def _totals(limit: int):
    """Of each packet, its texts with their sums; packets of equal content have the same name, and share what came back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in groups(batches, ["packet"]):
            for i, j in zip(edges.tolist(), edges[1:].tolist()):
                own = table.slice(i, j - i).to_pylist()
                heads, parts = [r for r in own if r["head"]], [r for r in own if not r["head"]]
                if not heads or sum(r["seen"] for r in parts) != sum(r["seen"] for r in heads):
                    raise RuntimeError("a packet of texts came out differently when its task was run again; run the query again")
                null, ids, sizes, tokens = _unpacked(heads[0]["body"], bool, np.int64, np.int64, np.int64)
                back = np.zeros(len(ids), np.int64)
                for r in parts:
                    texts, sums = _unpacked(r["body"], np.uint16, np.int64)
                    back[texts] += sums
                tokens = tokens + back // len(heads)
                for _ in heads:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit: more tokens than `limit`), one row per row."""
    pieces = pieces_of(path)  # an unfit model is told before any work
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    end = dict(zip(["\n"], pieces.counts(["\n"])))  # the parts' separator is never sent
    hot, shards = spark.sparkContext.broadcast(hot_counts(texts, path) | end), int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.mapInArrow(_sent(path, hot, shards), _KIND).repartition(shards, "to")
    back = sent.mapInArrow(_answered(path), "packet binary, head boolean, seen long, body binary")
    rows = back.repartition(shards, "packet").sortWithinPartitions("packet")
    return rows.mapInArrow(_totals(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
