"""Source divergence audit: how far the sources of a language differ in the terms they use.

1. In-mapper stripes: a task folds whole documents into term -> (document frequency, count by source) stripes, by
   language, and hands them on at its end, or whenever they fill its memory.
2. Spark deals the stripes by (language, term) and merges them: sums by source, then one stripe for each term. Terms in
   fewer than `least` documents of their language go; what stays is small beside the corpus and is written to the shared folder.
3. Every merged stripe meets its language's sources and their totals, and emits divergences: for each two sources
   the difference of their shares, summed inside the task first, and each source's share above the language's.

A group's share of a term is 1 + floor(10**9 * (count + 5) / (N + 5 * V)), in integers of any length; N is the group's count of
kept terms and V the number of terms the language keeps. The work on pairs grows with the square of a language's
sources, as the result does; a task holds the sums of the pairs that its stripes touch, in blocks of sources, and hands them on
whenever they grow too many. The totals are broadcast if there are at most `GROUPS` groups, else joined by language.

Defined results: null text, lang and source are ''; a source without terms, or a language that keeps none, still has its
pairs (of a language that keeps none they differ by 0); a source alone in its language has no pairs; repeated rows count as often as they stand; equal values are
ranked by item, in the order of UTF-8; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.llm.common import ASCII_LOWER, cut, plain, small_batches, steps, words

#: Lower-cases A-Z; every other ASCII character but a-z becomes a space.
TERMS = bytes(b if b > 0x7F or chr(b).isalpha() else 0x20 for b in ASCII_LOWER)
#: Cells (term, source) and bytes of terms that a task folds before it hands its stripes on.
CELLS, TERM_BYTES = 1_000_000, 32 << 20
#: Shares are whole numbers of billionths; counts get this much more.
SCALE, MORE = 10**9, 5
#: Pairs of sources whose sums a task holds; sources of a block.
PAIRS, BLOCK = 1 << 20, 256
#: Groups whose totals may be broadcast.
GROUPS = 100_000
#: Counts up to here keep SCALE * (count + MORE) within 64 bits.
NARROW = 9_000_000_000
STRIPE = "lang string, term string, texts long, cells array<struct<source: string, count: long>>"


class Stripes:
    """Stripes of some documents: cells of (language, term) and (language, source) numbers."""

    def __init__(self):
        self.terms: dict[tuple[int, bytes], int] = {}
        self.langs: dict[str, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.keys, self.parts, self.size, self.cells = np.zeros(0, np.int64), np.zeros((2, 0), np.int64), 0, 0
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def fold(self, texts: pa.Array, langs: list[str], sources: list[str]) -> None:
        codes, ends, distinct = words(plain(texts, TERMS))
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)], np.int64)
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(ends))
        in_doc, count = np.unique(doc * max(1, len(distinct)) + codes, return_counts=True)
        doc, codes = np.divmod(in_doc, max(1, len(distinct)))
        own, at = np.unique(lang[doc] * max(1, len(distinct)) + codes, return_inverse=True)
        numbers = []
        for x, i in zip(*(v.tolist() for v in np.divmod(own, max(1, len(distinct))))):
            known = self.terms.get((x, distinct[i]))
            if known is None:
                known = self.terms[x, distinct[i]] = len(self.terms)
                self.size += len(distinct[i])
            numbers.append(known)
        self.new.append((np.array(numbers, np.int64)[at] << 24 | group[doc], np.stack([np.ones_like(count), count])))
        self.cells += len(count)
        if self.cells > 4 * CELLS:
            self._merge()

    def _merge(self) -> None:
        keys, parts = np.concatenate([self.keys, *(k for k, _ in self.new)]), np.concatenate([self.parts, *(p for _, p in self.new)], axis=1)
        order = np.argsort(keys, kind="stable")
        keys, parts = keys[order], parts[:, order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.parts = keys[first], np.add.reduceat(parts, first, axis=1) if len(first) else parts
        self.new, self.cells = [], len(self.keys)

    def full(self) -> bool:
        return self.size > TERM_BYTES or len(self.keys) > CELLS or len(self.groups) >= 1 << 23

    def rows(self) -> pa.RecordBatch:
        """The stripes, and for each group met, with or without terms, a stripe of its own whose term is a space and the source."""
        self._merge()
        langs, groups = list(self.langs), list(self.groups)
        term, group = self.keys >> 24, self.keys & ((1 << 24) - 1)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        names = list(self.terms)
        own = [names[i] for i in term[first].tolist()]
        texts = np.add.reduceat(self.parts[0], first) if len(first) else first
        sources = pa.array([s for _, s in groups], pa.string())
        lang = pa.array([langs[x] for x, _ in own] + [x for x, _ in groups], pa.string())
        term = pa.array([w for _, w in own], pa.binary()).cast(pa.string())
        term = pa.concat_arrays([term, pa.array([" " + s for _, s in groups], pa.string())])
        cells = pa.StructArray.from_arrays([pa.concat_arrays([sources.take(pa.array(group)), sources]), pa.array(np.concatenate([self.parts[1], np.zeros(len(groups), np.int64)]))], ["source", "count"])
        offsets = np.concatenate([first, len(group) + np.arange(len(groups) + 1)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([lang, term, pa.array(np.concatenate([texts, np.zeros(len(groups), np.int64)]).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), cells)], ["lang", "term", "texts", "cells"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Stripes()
    for batch in steps(batches, "text"):
        held.fold(batch.column("text"), *(pc.fill_null(batch.column(c), "").to_pylist() for c in ("lang", "source")))
        if held.full():
            yield held.rows()
            held = Stripes()
    if held.groups:
        yield held.rows()


def merged_stripes(docs: DataFrame) -> DataFrame:
    """(lang, term, texts, cells: counts by source): one stripe for each term of a language, and one for each of its sources (see Stripes.rows)."""
    texts = small_batches(docs).select("text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    folded = texts.mapInArrow(_folded, STRIPE)
    # The term's documents ride on its first cell, so that one pass of sums by source keeps them.
    cells = folded.select("lang", "term", "texts", F.posexplode("cells").alias("at", "cell"))
    cells = cells.select("lang", "term", F.when(F.col("at") == 0, F.col("texts")).otherwise(0).alias("texts"), "cell.source", "cell.count")
    dealt = cells.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("texts").alias("texts"), F.sum("count").alias("count"))
    return by_source.groupBy("lang", "term").agg(F.sum("texts").alias("texts"), F.collect_list(F.struct("source", "count")).alias("cells"))


def _shares(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    if len(counts) and counts.max() > NARROW:
        return (1 + SCALE * (counts.astype(object) + MORE) // below.astype(object)).astype(np.int64)
    return 1 + SCALE * (counts + MORE) // below


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of |p - q| of pairs of a language's sources over the stripes of the task."""
    sums: dict[tuple[str, int, int, int], np.ndarray] = {}
    held = 0

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, a, b, _), own in sums.items():
            x, y = np.nonzero(np.triu(own, 1) if a == b else own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array((x + a).astype(np.int32)), pa.array((y + b).astype(np.int32)), pa.array(own[x, y])], ["lang", "x", "y", "value"])

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            own = batch.filter(pc.equal(langs.indices, code))
            below = np.array(own.column("below")[0].as_py(), np.int64)
            n, lists = len(below), own.column("at")
            row = np.repeat(np.arange(own.num_rows), pc.list_value_length(lists).to_numpy())
            at, count = lists.flatten().to_numpy(), own.column("count").flatten().to_numpy()
            for rows in range(0, own.num_rows, step := max(1, (1 << 21) // max(n, 1))):
                here = (row >= rows) & (row < rows + step)
                whole = np.zeros((min(step, own.num_rows - rows), n), np.int64)
                whole[row[here] - rows, at[here]] = count[here]
                shares = _shares(whole, below[None, :])
                for a in range(0, n, BLOCK):
                    for b in range(a, n, BLOCK):
                        key = (lang, a, b, n)
                        if key not in sums:
                            sums[key] = np.zeros((min(BLOCK, n - a), min(BLOCK, n - b)), np.int64)
                            held += sums[key].size
                        for x in range(min(BLOCK, n - a)):
                            sums[key][x] += np.abs(shares[:, b : b + BLOCK] - shares[:, a + x, None]).sum(axis=0)
                        if held > PAIRS:
                            yield from handed()
                            sums.clear()
                            held = 0
    yield from handed()


def source_divergence(docs: DataFrame, least: int = 30, ranks: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for every other source, `term` rows for the `ranks` terms most above the language's share."""
    names = F.startswith("term", F.lit(" "))
    stripes = cut(merged_stripes(docs).where((F.col("texts") >= least) | names))
    cells = stripes.select("lang", "term", F.explode("cells").alias("cell")).select("lang", "term", "cell.*")
    groups = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    kept = stripes.where(~names)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    listed = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"), F.sum("n").alias("all")).join(sizes, "lang", "left")
    more = F.lit(MORE) * F.coalesce("v", F.lit(0))
    below = F.transform("groups", lambda g: g["n"] + more)
    facts = cut(listed.select("lang", F.transform("groups", lambda g: g["source"]).alias("sources"), below.alias("below"), (F.col("all") + more).alias("all_below")))  # a row for each language
    few = groups.count() <= GROUPS
    met = kept.join(F.broadcast(facts) if few else facts, "lang")
    indexed = met.select("lang", "below", F.transform("cells", lambda c: (F.array_position("sources", c["source"]) - 1).cast("int")).alias("at"), F.transform("cells", lambda c: c["count"]).alias("count"))
    apart = indexed.mapInArrow(_differences, "lang string, x int, y int, value long").groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))

    named = facts.select("lang", F.posexplode("sources").alias("x", "source"))
    every = named.join(named.toDF("lang", "y", "item"), "lang").where("x <> y")  # the pairs that are the result
    both = every.withColumns({"_x": F.least("x", "y"), "_y": F.greatest("x", "y")}).join(apart.toDF("lang", "_x", "_y", "value"), ["lang", "_x", "_y"], "left")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    def share(count, below):
        exact = lambda c: c.cast("decimal(38,0)")
        top = F.lit(SCALE).cast("decimal(10,0)") * (count + MORE).cast("decimal(20,0)")
        return F.lit(1) + F.call_function("div", top, exact(below))

    total = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["count"])
    rows = met.select("lang", "term", share(total, F.col("all_below")).alias("q"), "sources", "below", F.explode("cells").alias("cell")).where("cell.count > 0")
    own = F.element_at("below", F.array_position("sources", F.col("cell.source")).cast("int"))
    above = rows.select("lang", F.col("cell.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (share(F.col("cell.count"), own) - F.col("q")).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks))
