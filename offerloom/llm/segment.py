"""SentencePiece encoding and decoding: segmentations sampled without replacement by perturbed A-star search.

The lattice of a text holds every way to cut it into pieces of the vocabulary; characters without a piece become
UTF-8 byte pieces. A model file of merges has ranks, not probabilities, so a piece's weight is that of its rank
r by Zipf's law, 1 / (r + 10), and a byte's that of the last rank; a segmentation's probability is the product over
its pieces, normalised over the lattice by a backward sum.

Sampling: the largest Gumbel-perturbed value of a set of segmentations is itself a Gumbel number about the set's log
probability, so the search can value a set before it looks into it, and the segmentation that has that value is drawn
from the set by the probabilities alone. The best set is taken, its segmentation drawn piece by piece, and what is left of the set
is queued in parts, each valued below the whole: the other ways through a word, later the other pieces at a place. The first k
segmentations are a sample of k distinct ones. Only the best k + 1 sets can matter, so the queue stays that short. A segmentation's
inclusion score is 1 - exp(-exp(log p - t)), t being the (k + 1)th value; draws are seeded by the row's key.

Where even the most probable segmentation surely has a small share of the text's probability, as in nearly all texts, what is left is queued whole, as the one
set of all but those found: its value needs only its mass, and a draw from it is a draw from all ways that is repeated if it has been found. Values and
draws have the same joint distribution either way; which way a text goes depends on its lattice alone, not on draws. These texts are drawn together, in numpy:
the lattices of distinct words (cut further at characters that no piece crosses) lie in one table, where words with the same end share its part, and a step moves
every word of every sample by a piece.

Defined results: null or empty text has one segmentation, without pieces; a text with fewer than k segmentations
yields all, with score 1; repeated rows yield equal results; null keys are keys like others; an empty table gives no rows;
other columns are ignored. Texts go through whole; time and memory are linear in their length.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect, insort
from collections.abc import Callable, Iterator
from itertools import accumulate
from random import Random
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import small_batches, steps

SPACE = "▁"
#: Characters of the words whose lattices a worker keeps.
MOST_CHARS = 400_000
#: A set whose log probability is so far below the worst value that counts would need a draw finer than random() gives.
FAR_BELOW = 37.0
#: Characters that are not for text; one that a text lacks stands for a literal SPACE in it.
_SPARE = [chr(c) for c in range(0xFDD0, 0xFDF0)]
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Text whose words are looked up at a time, text that is drawn at a time (bytes), and edges that a worker's table holds.
STEP_BYTES, DRAWN_CHARS, MOST_EDGES = 1 << 19, 100_000, 3_000_000
#: Ids of an Arrow batch.
ROWS_IDS = 1 << 20
#: Times k + 1 that a bound of the probability of a text's best segmentation must fit into 1 for draws to be repeated.
ROOM = 2
#: Places of a table's index, at how many of them an end is looked for, and characters of the longest end in it.
INDEX_BITS, PROBES, INDEXED = 21, 4, 64
_GOLDEN, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PROBES = [_GOLDEN, *_MIX, np.uint64(0xD6E8FEB86659FD93)]


class Lattice(NamedTuple):
    """The ways to cut a word."""

    edges: list[list[tuple]]  # from each place: (where to, log weight, ids, share of the probability there, share of all others)
    sums: list[list[float]]  # running sums of the shares, without the last
    beta: list[float]  # log of the sum over all ways from each place to the end


class Search:
    """Segmentations in falling order of their perturbed values.

    A queued set is (minus its value, a number to part ties, words cut so far, log probability before each word, word,
    (a way through that word, how many pieces of it are fixed), places excluded after them). With None for the pieces it holds
    every way through the word but the one in `words`. Lists that are queued grow at their ends only, so sets share them, and a
    prefix is copied when its set is looked into: at most k times.
    """

    def __init__(self, words: list[Lattice], most: int, draw: Callable[[], float]):
        self.words, self.room, self.draw = words, most, draw
        self.queue: list[tuple] = []
        self.number, self.floor = 0, -math.inf

    def offer(self, mass: float, bound: float, *what) -> None:
        """Queue a set of log probability `mass` at a value drawn below `bound`, if it is among the best."""
        if mass < self.floor - FAR_BELOW:
            return
        fall = -math.log(1.0 - self.draw())
        value = min(bound, mass - math.log(max(math.exp(min(mass - bound, 700.0)) + fall, 1e-300)))
        if value <= self.floor:
            return
        self.number += 1
        insort(self.queue, (-value, self.number, *what))
        self.trim()

    def trim(self) -> None:
        del self.queue[self.room :]
        self.floor = -self.queue[-1][0] if len(self.queue) == self.room > 0 else -math.inf

    def next_value(self) -> float | None:
        return -self.queue[0][0] if self.queue else None

    def ways(self, k: int) -> Iterator[tuple[list[list[tuple]], float]]:
        """Up to k times (edges of each word, log probability)."""
        self.room -= 1
        way, before = [], [0.0]
        self.finish(way, before, -math.log(-math.log(1.0 - self.draw() or 0.5)))
        yield way, before[-1]
        for _ in range(k - 1):
            if not self.queue:
                return
            minus, _, old, logs, m, head, skip = self.queue.pop(0)
            self.room -= 1
            self.trim()
            way, before = old[:m], logs[: m + 1]
            self.through(way, before, -minus, m, old, head, skip)
            self.finish(way, before, -minus)
            yield way, before[-1]

    def through(self, way: list, before: list[float], value: float, m: int, old: list, head: tuple | None, skip: tuple) -> None:
        """Draw word m from a set of that value, and offer the parts of the set that are left."""
        edges, _, beta = self.words[m]
        logs = before
        if head is None:  # part the set by the first place that differs from the old way
            mass, parts = 1.0, []
            for edge in old[m]:
                parts.append(mass * edge[4])
                mass *= edge[3]
            at = self.pick(parts)
            for n, part in enumerate(parts):
                if n != at and part > 0:
                    self.offer(before[m] + math.log(part), value, old, logs, m, (old[m], n), (old[m][n][0],))
            head, skip = (old[m], at), (old[m][at][0],)
        word = head[0][: head[1]]
        place = word[-1][0] if word else 0
        logp = before[m] + sum(edge[1] for edge in word) + beta[place] - beta[0]
        open_ = [edge for edge in edges[place] if edge[0] not in skip]
        at = self.pick([edge[3] for edge in open_])
        left = sum(edge[3] for n, edge in enumerate(open_) if n != at)
        if left > 0:
            self.offer(logp + math.log(left), value, old, logs, m, head, (*skip, open_[at][0]))
        edge = open_[at]
        word.append(edge)
        while edge[0] < len(edges):
            logp += edge[1] + beta[edge[0]] - beta[place]
            place = edge[0]
            edge = edges[place][self.pick([e[3] for e in edges[place]])]
            if edge[4] > 0:
                self.offer(logp + math.log(edge[4]), value, old, logs, m, (word, len(word)), (edge[0],))
            word.append(edge)
        way.append(word)
        before.append(logp + edge[1] - beta[place])

    def finish(self, way: list, before: list[float], value: float) -> None:
        """Draw the words that follow, and offer the other ways through each."""
        draw = self.draw
        for m in range(len(way), len(self.words)):
            edges, sums, beta = self.words[m]
            i, n, share, others, weight, word, logp = 0, len(edges), 1.0, 0.0, -beta[0], [], before[-1]
            while i < n:
                edge = edges[i][bisect(sums[i], draw())] if sums[i] else edges[i][0]
                others += share * edge[4]
                share *= edge[3]
                weight += edge[1]
                word.append(edge)
                i = edge[0]
            way.append(word)
            before.append(logp + weight)
            if others > 0 and logp >= self.floor - FAR_BELOW:
                self.offer(logp + math.log(others), value, way, before, m, None, ())

    def pick(self, shares: list[float]) -> int:
        """A number drawn in proportion to the shares."""
        sums = list(accumulate(shares))
        return min(bisect(sums, self.draw() * sums[-1]), len(sums) - 1)


class Pieces:
    """The pieces of a model file, their log weights, and the lattices of words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text, self.byte, self.ids, self.weight = {}, {}, {}, {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.weight[i] = -math.log(n + 10)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.weight[i] = -math.log(10 - model.get_score(i))
            self.text[i] = piece
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.ids))
        #: (weight, its log, ids) of each piece, and () for what only begins a piece.
        self.entries: dict[str, tuple] = {p[:n]: () for p in self.ids for n in range(1, len(p))}
        self.entries |= {p: (math.exp(self.weight[i]), self.weight[i], (i,)) for p, i in self.ids.items()}
        #: Pieces never cross the start of a word, so lattices of words are enough.
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.known: dict[str, Lattice] = {}
        self.held = 0
        self._make_trie()
        #: Kinds of a text's bytes: 1 a space, 2 a character that stands in no piece but its own, so that no piece crosses it.
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        self.kind = np.array([2 * (i < 128 and chr(i) not in inside) for i in range(256)], np.uint8)
        self.kind[ord(" ")] = 1
        self.spare_apart = _SPARE[0] not in inside
        self.table = Table(self)

    def _make_trie(self) -> None:
        """Beginnings of pieces as numbered nodes: slots by (node, character) with the node it leads to, and the piece that ends at a node or -1."""
        number = {"": 0} | {p: i for i, p in enumerate(self.entries, 1)}
        keys = np.array([(number[p[:-1]] << 21) | ord(p[-1]) for p in self.entries], np.int64)
        slots = self._slot(keys)
        first = np.full(1 << 18, -1)
        first[slots[::-1]] = np.arange(len(keys))[::-1]
        rest = np.flatnonzero(first[slots] != np.arange(len(keys)))  # the slot holds another
        rest = rest[np.argsort(keys[rest])]
        self.held_key, self.held_node = np.where(first < 0, -1, keys[first]), (first + 1).astype(np.int32)
        self.shared = np.zeros(1 << 18, bool)
        self.shared[slots[rest]] = True
        self.rest_key, self.rest_node = np.append(keys[rest], 1 << 62), np.append(rest + 1, 0).astype(np.int32)
        self.ends = np.full(len(number), -1, np.int32)
        for p, i in self.ids.items():
            self.ends[number[p]] = i
        self.byte_ids = np.array([self.byte[b] for b in range(256)])
        n = len(self.text)
        self.log_weight, self.byte_weight = np.array([self.weight.get(i, 0.0) for i in range(n)]), -math.log(n + 10)
        said = [bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].replace(SPACE, " ").encode() for i in range(n)]
        #: What pieces say, then what they say without the space put before each text.
        self.said = pa.array([*said, *(x[1:] for x in said)], pa.large_binary())

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _GOLDEN) >> np.uint64(46)).astype(np.int64)

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """The node that (node, character) leads to, 0 for none."""
        slots = self._slot(keys)
        same = self.held_key[slots] == keys
        out = np.where(same, self.held_node[slots], np.int32(0))
        look = np.flatnonzero(~same & self.shared[slots])
        at = np.searchsorted(self.rest_key, keys[look])
        out[look] = np.where(self.rest_key[at] == keys[look], self.rest_node[at], 0)
        return out

    def lattice(self, word: str, spare: str) -> Lattice:
        if word in self.known:
            return self.known[word]
        n, entries = len(word), self.entries
        edges: list[list[tuple]] = [[] for _ in range(n)]
        sums: list[list[float]] = [[] for _ in range(n)]
        beta = [0.0] * (n + 1)
        ratio = [1.0]  # sums over all ways from the places after i, as multiples of the first of them: no underflow, however long the word
        for i in range(n - 1, -1, -1):
            own, total = [], 0.0
            for j in range(i + 1, min(n, i + self.longest) + 1):
                entry = entries.get(word[i:j])
                if entry is None:  # no piece begins so
                    break
                if entry:
                    x = entry[0] * ratio[j - i - 1]
                    total += x
                    own.append((j, entry[1], entry[2], x))
            if not entries.get(word[i]):
                data = (SPACE if word[i] == spare else word[i]).encode("utf-8", "surrogatepass")
                ids = tuple(self.byte[b] for b in data)
                weight = sum(self.weight[b] for b in ids)
                total += math.exp(weight)
                own.append((i + 1, weight, ids, math.exp(weight)))
            if len(own) == 1:
                edges[i] = [(*own[0][:3], 1.0, 0.0)]
            else:
                edges[i] = [(j, w, ids, x / total, (total - x) / total) for j, w, ids, x in own]
                sums[i] = [x / total for x in accumulate(e[3] for e in own)]
                del sums[i][-1]
            beta[i] = beta[i + 1] + math.log(total)
            ratio = [1.0, *(r / total for r in ratio[: self.longest - 1])]
        out = Lattice(edges, sums, beta)
        if spare not in word and n <= MOST_CHARS:
            if self.held + n > MOST_CHARS:
                self.known.clear()
                self.held = 0
            self.known[word] = out
            self.held += n
        return out

    def words(self, text: str) -> list[Lattice]:
        if not text:
            return []
        spare = next((c for c in _SPARE if c not in text), _SPARE[0])
        whole = SPACE + text.replace(SPACE, spare).replace(" ", SPACE)
        return [self.lattice(w, spare) for w in (_WORD.findall(whole) if self.apart else [whole])]

    def best(self, text: str) -> list[int]:
        """The most probable segmentation (Viterbi)."""
        out: list[int] = []
        for edges, _, _ in self.words(text):
            n = len(edges)
            value, step = [0.0] * (n + 1), [None] * n
            for i in range(n - 1, -1, -1):
                value[i], step[i] = max(((w + value[j], (j, ids)) for j, w, ids, *_ in edges[i]), key=lambda x: (x[0], x[1][0]))
            i = 0
            while i < n:
                i, ids = step[i]
                out += ids
        return out

    def sample(self, text: str, k: int, seed: int) -> list[tuple[list[int], float, float]]:
        """k distinct segmentations: (ids, log probability, inclusion score), in the order they are found."""
        rows, ids, at, logp, inclusion = self.sample_all([text], k, [seed])
        return [(ids[a:b].tolist(), p, q) for a, b, p, q in zip(at, at[1:], logp.tolist(), inclusion.tolist())]

    def searched(self, text: str, k: int, seed: int) -> list[tuple[list[int], float, float]]:
        """sample() by a queue of parts."""
        search = Search(self.words(text), k + 1, Random(seed).random)
        found = [(way, logp) for way, logp in search.ways(k)]
        bound = search.next_value()
        out = []
        for way, logp in found:
            score = 1.0 if bound is None else -math.expm1(-math.exp(min(logp - bound, 700.0)))
            out.append(([p for word in way for edge in word for p in edge[2]], logp, score))
        return out

    def cuts(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Words, cut further where no piece crosses, of several texts, their SPACEs written as spaces and literal ones as _SPARE[0]; how many each text has."""
        parts = [f" {t.replace(SPACE, _SPARE[0])}".encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = b"".join(parts)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(size)
        begin = np.zeros(len(data), bool)
        if self.apart:
            kind = self.kind[np.frombuffer(data, np.uint8)]
            space, alone = kind == 1, kind == 2
            begin[1:] = alone[1:] | alone[:-1] | (space[1:] & ~space[:-1])
            if self.spare_apart and any(SPACE in t or _SPARE[0] in t for t in texts):
                for found in re.finditer(re.escape(_SPARE[0].encode()), data):
                    begin[found.start()] = True
                    begin[found.end() : found.end() + 1] = True
        begin[(ends - size)[size > 0]] = True
        places = np.append(np.flatnonzero(begin), len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)])
        return words.dictionary_encode(), np.diff(np.searchsorted(places[:-1], ends), prepend=0)

    def sample_all(self, texts: list[str], k: int, seeds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """sample() of several texts: (row of each segmentation, all ids, where each one's begin, log probabilities, inclusion scores).

        A text's segmentations stand together; texts that are drawn together come first.
        """
        table = self.table
        words, many = self.cuts(texts)
        nodes = table.enter(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
        begins = np.cumsum(many) - many
        best, some = np.zeros(len(texts)), np.flatnonzero(many)
        if len(some):
            best[some] = np.add.reduceat(table.best[nodes] - table.total[nodes], begins[some])
        wide = [b < -math.log(ROOM * (k + 1)) and _SPARE[0] not in t for b, t in zip(best.tolist(), texts)]
        found, which, group, size = [], [], [], 0
        together = [i for i, w in enumerate(wide) if w]
        for i in together:
            group.append(i)
            size += len(texts[i])
            if size > DRAWN_CHARS or i == together[-1]:
                own = np.array(group)
                among = _ragged_places(begins[own], many[own]) if group[-1] - group[0] >= len(group) else slice(begins[group[0]], begins[i] + many[i])
                found.append(table.draw(nodes[among], many[own], k, np.array([seeds[j] for j in group], np.uint64)))
                which.append(np.repeat(own, k))
                group, size = [], 0
        for i in (i for i, w in enumerate(wide) if not w):
            own = self.searched(texts[i], k, seeds[i])
            flat = np.array([p for ids, _, _ in own for p in ids], np.int32)
            found.append((flat, np.array([len(ids) for ids, _, _ in own]), np.array([p for _, p, _ in own]), np.array([q for _, _, q in own])))
            which.append(np.full(len(own), i))
        if table.full():
            self.table = Table(self)
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0), np.zeros(0)
        flat, lengths, logp, inclusion = (np.concatenate(x) for x in zip(*found))
        return np.concatenate(which), flat.astype(np.int32, copy=False), np.concatenate(([0], np.cumsum(lengths))).astype(np.int64), logp, inclusion

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """decode() of several lists."""
        own = ids.copy()
        own[at[:-1][at[1:] > at[:-1]]] += len(self.text)
        said = self.said.take(pa.array(own))
        _, ends, data = said.buffers()
        offsets = np.frombuffer(ends, np.int64, len(own) + 1, 8 * said.offset)[at]
        return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(offsets), data])

    def decode(self, ids: list[int]) -> str:
        """The text that any segmentation stands for."""
        if not ids:
            return ""
        data = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].replace(SPACE, " ").encode() for i in ids)
        return data.decode("utf-8", "surrogatepass")[1:]  # without the space put before the text


def _ragged_places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of several ranges, one after another."""
    ends = np.cumsum(size)
    out = np.repeat(first - ends + size, size)
    out += np.arange(len(out))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64."""
    out = x >> np.uint64(30)
    out ^= x
    out *= _MIX[0]
    half = out >> np.uint64(27)
    out ^= half
    out *= _MIX[1]
    np.right_shift(out, np.uint64(31), out=half)
    out ^= half
    return out


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) of counters."""
    return (_mixed(x) >> np.uint64(11)) * 2.0**-53


def _room(x: np.ndarray, size: int) -> np.ndarray:
    """x, or a copy with more room."""
    if size <= len(x):
        return x
    out = np.empty(max(size, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


class Table:
    """The lattices of many words. The ways from a place in a word depend on what follows alone, so words with the same end share its places:
    a node is an end of words, found by the node of the end that is one character shorter and that character. Node 0 is the empty end.

    A node's edges lie together, the longest piece first. Ends of more than INDEXED characters, and those beyond PROBES places of the index, are nodes of
    their own each time.
    """

    def __init__(self, model: Pieces):
        self.model, self.nodes, self.edges = model, 1, 0
        self.key, self.node = np.full(1 << INDEX_BITS, -1), np.empty(1 << INDEX_BITS, np.int32)  # the index
        self.first = np.zeros(1 << 16, np.int32)  # of each node: its first edge
        self.total = np.zeros(1 << 16)  # log sum over the ways to the word's end
        self.best = np.zeros(1 << 16)  # log weight of the best of them
        self.most = np.zeros(1 << 18, np.uint64)  # of each edge: the largest 64-bit draw that doesn't go on to the next
        self.step = np.zeros(1 << 18, np.int64)  # its piece, or -1 - the character written as several bytes; the first edge of the node it leads to, -1 at the end

    def full(self) -> bool:
        return self.edges > MOST_EDGES

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of keys, and a place among them of each node that is new, in their order."""
        out, new = np.empty(len(keys), np.int32), []
        left, own = np.arange(len(keys)), keys
        for probe in range(PROBES):
            slots = ((own.astype(np.uint64) * _PROBES[probe]) >> np.uint64(64 - INDEX_BITS)).astype(np.int64)
            held = self.key[slots]
            free = np.flatnonzero(held < 0)
            if len(free):
                at = slots[free]
                self.key[at] = own[free]
                won = np.flatnonzero(self.key[at] == own[free])
                at, free = at[won], free[won]
                self.node[at] = free
                one = free[self.node[at] == free]
                self.node[slots[one]] = np.arange(self.nodes, self.nodes + len(one), dtype=np.int32)
                self.nodes += len(one)
                new.append(left[one])
                held = self.key[slots]
            same = held == own
            if same.all():
                out[left] = self.node[slots]
                left = left[:0]
                break
            hit, miss = np.flatnonzero(same), np.flatnonzero(~same)
            out[left[hit]] = self.node[slots[hit]]
            left, own = left[miss], own[miss]
        if len(left):
            out[left] = np.arange(self.nodes, self.nodes + len(left), dtype=np.int32)
            self.nodes += len(left)
            new.append(left)
        return out, np.concatenate(new) if new else left

    def enter(self, words: pa.LargeBinaryArray) -> np.ndarray:
        """The node of each word, entered if it is new."""
        model, count = self.model, len(words)
        _, ends, data = words.buffers()
        ends = np.frombuffer(ends, np.int64, count + 1, 8 * words.offset)
        body = np.frombuffer(data, np.uint8)[: ends[-1]] if count else np.zeros(0, np.uint8)
        chars = np.frombuffer(body.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chars[chars == ord(" ")] = ord(SPACE)
        if len(chars) != len(body):
            ends = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))[ends]
        size = np.diff(ends)
        order = np.argsort(-size, kind="stable")
        last, size = ends[1:][order], size[order]
        deep = np.searchsorted(-size, -np.arange(1, size[0] + 1 if count else 1), side="right").tolist()  # words of so many characters or more
        node_at, node = np.zeros(len(chars) + 1, np.int32), np.zeros(count, np.int32)
        old, at, back, levels = self.nodes, [], [], [self.nodes]
        for length, many in enumerate(deep[:INDEXED], 1):  # all words, from their ends
            place = last[:many] - length
            node[:many], new = self.find((node[:many].astype(np.int64) << 21) | chars[place])
            node_at[place] = node[:many]
            if len(new):
                at.append(place[new])
                back.append(np.full(len(new), length))
                levels.append(self.nodes)
        if len(deep) > INDEXED:
            many = deep[INDEXED]
            place = _ragged_places(last[:many] - size[:many], size[:many] - INDEXED)
            length = np.repeat(last[:many], size[:many] - INDEXED) - place
            by_length = np.argsort(length, kind="stable")
            at.append(place[by_length])
            back.append(length[by_length])
            node_at[at[-1]] = np.arange(self.nodes, self.nodes + len(place))
            node[:many] = node_at[last[:many] - size[:many]]
            levels += (self.nodes + np.cumsum(np.bincount(length)[INDEXED + 1 :])).tolist()
            self.nodes = levels[-1]
        if self.nodes > old:
            self.first, self.total, self.best = (_room(x, self.nodes) for x in (self.first, self.total, self.best))
            self.connect(chars, node_at, np.concatenate(at), np.concatenate(back), levels)
        out = np.empty(count, np.int32)
        out[order] = node
        return out

    def connect(self, chars: np.ndarray, node_at: np.ndarray, place: np.ndarray, back: np.ndarray, levels: list[int]) -> None:
        """The edges of new nodes, each standing at a place in the words, so many characters before the word's end."""
        model, n, old = self.model, len(place), levels[0]
        which, at, node, length = np.arange(n), place, np.zeros(n, np.int64), 0
        froms, tos, logs, own = [], [], [], []
        single, count = np.zeros(n, bool), np.zeros(n, np.int64)
        while len(at):  # along the beginnings of pieces, from all places at once
            node = model.follow((node << 21) | chars[at])
            good = np.flatnonzero(node)
            which, at, node, length = which[good], at[good] + 1, node[good].astype(np.int64), length + 1
            left, piece = back[which] - length, model.ends[node]
            whole = np.flatnonzero(piece >= 0)
            source, piece = which[whole], piece[whole]
            froms.append(source)
            tos.append(np.where(left[whole] > 0, node_at[at[whole]], 0))
            own.append(piece)
            logs.append(model.log_weight[piece])
            count[source] += 1
            if length == 1:
                single[source] = True
            more = np.flatnonzero(left > 0)
            which, at, node = which[more], at[more], node[more]
        bare = np.flatnonzero(~single)
        code = chars[place[bare]]
        code = np.where(code == ord(_SPARE[0]), ord(SPACE), code)
        froms.append(bare)
        tos.append(np.where(back[bare] > 1, node_at[place[bare] + 1], 0))
        own.append(np.where(code < 0x80, model.byte_ids[np.minimum(code, 0x7F)], -1 - code).astype(np.int32))
        logs.append(_said_in(code) * model.byte_weight)
        count[bare] += 1
        heads = np.concatenate(([0], np.cumsum(count)))
        free, edges = heads[1:].copy(), int(heads[-1])
        target, log, piece = np.empty(edges, np.int32), np.empty(edges), np.empty(edges, np.int32)
        for source, to, weight, ids in zip(froms, tos, logs, own):  # the longest in front
            free[source] -= 1
            spot = free[source]
            target[spot], log[spot], piece[spot] = to, weight, ids
        del froms, tos, logs, own, free
        total, best = self.total, self.best
        for a, b in zip(levels, levels[1:]):  # from the words' ends
            x, y = heads[a - old], heads[b - old]
            here, to = heads[a - old : b - old] - x, target[x:y]
            weight, v = log[x:y], total[to]
            best[a:b] = np.maximum.reduceat(weight + best[to], here)
            v += weight
            top = np.maximum.reduceat(v, here)
            log[x:y] = v
            v -= np.repeat(top, count[a - old : b - old])
            top += np.log(np.add.reduceat(np.exp(v), here))
            total[a:b] = top
        share = np.exp(log - np.repeat(total[old : self.nodes], count))
        cut = share  # running sums of a node's shares
        some, j = np.flatnonzero(count > 1), 1
        while len(some):
            spot = heads[some] + j
            cut[spot] += cut[spot - 1]
            j += 1
            some = some[count[some] > j]
        most = (np.minimum(cut, 1 - 2.0**-53) * 2.0**64).astype(np.uint64)
        most[heads[1:] - 1] = np.uint64((1 << 64) - 1)
        before, self.edges = self.edges, self.edges + edges
        self.most, self.step = _room(self.most, self.edges), _room(self.step, self.edges)
        self.most[before : self.edges] = most
        self.first[old : self.nodes] = heads[:-1] + before
        step = self.step[before : self.edges].view(np.int32)
        step[::2], step[1::2] = piece, np.where(target == 0, np.int32(-1), self.first[target])

    def walk(self, nodes: np.ndarray, many: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A way drawn for each seed, seeds[n, j], through the nth of texts with so many words: (all pieces, where each way's begin, log probabilities), ways in the order of the seeds."""
        k, among = seeds.shape[1], np.arange(len(nodes))
        begins = np.cumsum(many) - many
        kind = np.int32 if k * len(nodes) < 1 << 31 else np.int64
        who = (among + np.repeat((k - 1) * begins, many)).astype(kind)[:, None] + np.repeat(many, many).astype(kind)[:, None] * np.arange(k, dtype=kind)
        who = who.ravel()  # the word's place among those of all ways
        among -= np.repeat(begins, many)
        key = _mixed((np.repeat(seeds, many, axis=0) + (among.astype(np.uint64) * _GOLDEN)[:, None]).ravel())
        edge = np.repeat(self.first[nodes], k)  # the draws of a word stand together, as they look at the same edges
        taken, pieces = [], np.empty(len(who), np.int32)
        while len(who):
            key += _GOLDEN
            u = _mixed(key)
            beyond = np.flatnonzero(u > self.most[edge])
            if len(beyond):
                own, at = u[beyond], edge[beyond]
                rest = np.arange(len(beyond))
                while len(rest):
                    at[rest] += 1
                    rest = rest[own[rest] > self.most[at[rest]]]
                edge[beyond] = at
            step = self.step[edge].view(np.int32)
            to = step[1::2]
            taken.append((who, step[::2]))
            on = to >= 0
            pieces[who[~on]] = len(taken)
            on = np.flatnonzero(on)
            who, edge, key = who[on], to[on], key[on]
        ends = np.cumsum(pieces, dtype=np.int64)
        begin, out = ends - pieces, np.empty(ends[-1], np.int32)
        for n, (who, piece) in enumerate(taken):
            out[begin[who] + n] = piece
        at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(np.repeat(many, k))))]
        weight = self.model.log_weight[out]
        wide = np.flatnonzero(out < 0)
        weight[wide] = _said_in(-1 - out[wide]) * self.model.byte_weight
        logp = np.add.reduceat(weight, at[:-1]) - np.repeat(np.add.reduceat(self.total[nodes], begins), k)
        return out, at, np.minimum(logp, 0.0)

    def draw(self, nodes: np.ndarray, many: np.ndarray, k: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """k distinct ways through each of texts with so many words: (ids, how many of each way, log probabilities, inclusion scores)."""
        n = len(many)
        seeded = lambda own, number: _mixed(own + np.uint64(number * int(_GOLDEN) % (1 << 64)))
        ids, at, logp = self.walk(nodes, many, np.stack([seeded(seeds, j + 1) for j in range(k)], 1))
        logp, again = logp.reshape(n, k).T, {}
        for j in range(1, k):
            for i in np.flatnonzero((logp[j] == logp[:j]).any(0)).tolist():
                own = again.setdefault(i, [ids[at[i * k + h] : at[i * k + h + 1]] for h in range(k)])
                begin, tries = many[:i].sum(), 0
                while any(np.array_equal(own[j], own[h]) for h in range(j)):
                    tries += 1
                    own[j], _, p = self.walk(nodes[begin : begin + many[i]], many[i : i + 1], seeded(seeds[i : i + 1], (tries << 32) + j + 1)[:, None])
                    logp[j, i] = p[0]
        fall = lambda j: -np.log1p(-_uniform(seeded(seeds, (1 << 62) + j)))
        with np.errstate(over="ignore"):
            value = -np.log(np.maximum(fall(0), 1e-300))
            for j in range(1, k + 1):  # the value of the set of all ways but the j found
                mass = np.log1p(-np.exp(logp[:j]).sum(0))
                value = np.minimum(value, mass - np.log(np.maximum(np.exp(np.minimum(mass - value, 700.0)) + fall(j), 1e-300)))
            inclusion = -np.expm1(-np.exp(np.minimum(logp - value, 700.0)))
        lengths = np.diff(at)
        if again:
            parts, done = [], 0
            for i, own in sorted(again.items()):
                parts += [ids[at[done] : at[i * k]], *own]
                lengths[i * k : i * k + k] = [len(x) for x in own]
                done = i * k + k
            ids = np.concatenate([*parts, ids[at[done] :]])
        if (ids < 0).any():
            ids, lengths = self.as_bytes(ids, lengths)
        return ids, lengths, logp.T.ravel(), inclusion.T.ravel()

    def as_bytes(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with the bytes of characters that have no piece."""
        codes, which = np.unique(ids[ids < 0], return_inverse=True)
        said = [[self.model.byte[b] for b in chr(-1 - c).encode("utf-8", "surrogatepass")] for c in codes.tolist()]
        size = np.ones(len(ids), np.int64)
        size[ids < 0] = np.array([len(x) for x in said])[which]
        ends = np.cumsum(size)
        out = np.repeat(ids, size)
        held = np.cumsum([0, *map(len, said)])
        out[out < 0] = np.array([b for x in said for b in x], np.int32)[_ragged_places(held[which], held[which + 1] - held[which])]
        ways = np.cumsum(lengths)
        return out, np.diff(np.concatenate(([0], np.concatenate(([0], ends))[ways])))


def _said_in(codes: np.ndarray) -> np.ndarray:
    """Bytes of characters."""
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


def _runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lists that hold about ROWS_IDS ids together."""
    part = at[:-1] // ROWS_IDS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


@functools.lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(path)


def sample_segmentations(df: DataFrame, keys: list[str], path: str, k: int = 3, seed: int = 0, text: str = "text") -> DataFrame:
    """keys, sample (from 0), ids, log_probability, inclusion, decoded: k rows for each row of df, fewer if its text has fewer segmentations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for part in steps(batches, "_text", STEP_BYTES):
            texts = [t or "" for t in part.column("_text").to_pylist()]
            row, ids, at, logp, inclusion = model.sample_all(texts, k, [xxhash.xxh3_64_intdigest(key, seed) for key in part.column("_key").to_pylist()])
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            number = np.arange(len(row)) - np.repeat(begin, np.diff(begin, append=len(row)))
            for a, b in _runs(at):
                own, places = ids[at[a] : at[b]], at[a : b + 1] - at[a]
                named = [part.column(f"_k{n}").take(pa.array(row[a:b])) for n in range(len(keys))]
                lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [*named, pa.array(number[a:b], pa.int32()), lists, pa.array(logp[a:b]), pa.array(inclusion[a:b]), model.decode_all(own, places).cast(pa.string())],
                    [*keys, "sample", "ids", "log_probability", "inclusion", "decoded"],
                )

    kinds = dict(df.dtypes)
    named = [F.col(c).alias(f"_k{n}") for n, c in enumerate(keys)]
    key = F.to_json(F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(keys)]))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "sample int", "ids array<int>", "log_probability double", "inclusion double", "decoded string"])
    return small_batches(df).select(*named, key.alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
