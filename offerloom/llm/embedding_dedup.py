"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours.

1. Equal vectors of a label collapse to the smallest vec_id, with their number.
2. First lists: vectors are sorted by sign codes of random hyperplanes, in `TABLES` orders, and each is compared with
   those near it in the order.
3. Rounds: each vector's neighbours and reverse neighbours meet and are compared with each other; a list keeps
   the `LIST` best. Lists that end up saturated (full, and all at the threshold or above) are enlarged fourfold
   and go through another round.
4. Edges near the threshold or above it make clusters. A vector with `BEST` links or more may have its lists filled by its own
   group, so such vectors are also covered by leaders: each is within the angle `REACH` of one. All leaders of a label are compared in
   blocks; where the leaders' radii allow a link between two clusters, their members are compared too, and a link joins the clusters.
   Inside a cluster all pairs are compared in double precision, in blocks, which counts the links of lists of any length and keeps
   a spanning forest of the edges at the threshold or above.
5. Audit: the links of `AUDIT` vectors of each kind (any, with near neighbours, with `BEST` links or more; taken by hash, the labels
   in turn) are counted against all vectors by brute force, of more vectors until `SEEN` true links are seen. If fewer than `RECALL`
   of a kind's were found, everything is repeated with twice the tables and one round more. After `ATTEMPTS`, or if `MOST_ASKED`
   vectors of a kind show too few links to judge, all pairs of each label are compared in blocks, which needs no audit.

Defined results: null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing
and stay; vectors of unequal length don't link; rows that share a vec_id are vectors of their own, but one node of a component;
a null vec_id has no component and is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.llm.common import Forest, blocks, components, cut, groups, small_batches, spread

TABLES, BITS, NEAR, BEST = 12, 24, 8, 4
LIST, ROUNDS, NEW = 12, 2, 3
#: How far below the threshold an edge still draws two vectors into one cluster.
MARGIN, BLOCK = 0.06, 512
#: Cosine to its leader that a vector has at least.
REACH = 0.98
AUDIT, RECALL, ATTEMPTS = 64, 0.98, 3
SEEN, MOST_ASKED = 200, 1024


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, digests, sizes = [], [], []
        labelled = pc.is_valid(batch.column("label")).to_pylist()
        for v, known in zip(batch.column("embedding"), labelled):
            unit = None
            if known and v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                size = np.abs(x).max()
                if np.isfinite(size) and size > 0:
                    x = x / size  # no overflow in the norm
                    unit = x / np.sqrt(x @ x)
                    digests.append(xxhash.xxh3_128_digest(v.values.to_numpy(zero_copy_only=False).tobytes()))
            if unit is None:
                digests.append(None)
            vectors.append(None if unit is None else unit.tobytes())
            sizes.append(0 if unit is None else len(unit))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "label", "size", "digest", "vector"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1)


def _coded(tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == size))
                if size not in planes:
                    planes[size] = np.random.default_rng(seed * 1000 + size).standard_normal((size, tables * BITS))
                bits = (_matrix(own.column("vector")) @ planes[size] > 0).reshape(own.num_rows, tables, BITS)
                codes = bits @ (1 << np.arange(BITS - 1, -1, -1))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, t, np.int32)), own.column("label"), own.column("size"), pa.array(codes[:, t].astype(np.int64)), own.column("rep"), own.column("vector")], ["table", "label", "size", "code", "rep", "vector"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's best among the NEAR before and after it in the order; a task's borders are seen by other tables."""
    tail = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
        tail = table.slice(max(0, table.num_rows - NEAR)).combine_chunks().to_batches()[0] if table.num_rows else None
        keys = [table[c].to_numpy() for c in ("table", "label", "size")]
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        group = np.cumsum(new)
        edges = [0, *(np.flatnonzero(np.diff(keys[2])) + 1).tolist(), table.num_rows]
        for i, j in zip(edges, edges[1:]):
            if j - i < 2:
                continue
            ids, x, own = table["rep"].to_numpy()[i:j], _matrix(table["vector"].slice(i, j - i)), group[i:j]
            n = j - i
            sims, other = np.full((n, 2 * NEAR), -2.0), np.zeros((n, 2 * NEAR), np.int64)
            for s in range(1, min(NEAR, n - 1) + 1):
                both = np.where(own[s:] == own[:-s], np.einsum("ij,ij->i", x[s:], x[:-s]), -2.0)
                sims[:-s, s - 1], other[:-s, s - 1] = both, ids[s:]
                sims[s:, NEAR + s - 1], other[s:, NEAR + s - 1] = both, ids[:-s]
            best = np.argsort(-sims, axis=1, kind="stable")[:, :BEST]
            row = np.repeat(np.arange(n), BEST)
            found = sims[row, best.ravel()] > -2
            yield pa.RecordBatch.from_arrays([pa.array(ids[row][found]), pa.array(other[row, best.ravel()][found]), pa.array(sims[row, best.ravel()][found])], ["u", "v", "sim"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the vectors that meet at p, each one's NEW best that beat the last of its list."""
    for table, edges in groups(batches, ["p"]):
        ids, least = table["m"].to_numpy(), table["least"].to_numpy()
        vectors = table["vector"]
        u, v, sim = [], [], []
        for i, j in zip(edges.tolist(), edges[1:].tolist()):
            own, x = ids[i:j], _matrix(vectors.slice(i, j - i))
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :NEW]
            row = np.repeat(np.arange(j - i), best.shape[1])
            s = sims[row, best.ravel()]
            good = s > least[i:j][row]
            u.append(own[row[good]])
            v.append(own[best.ravel()[good]])
            sim.append(s[good])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v)), pa.array(np.concatenate(sim))], ["u", "v", "sim"])


def _count_links(least: float):
    """Of each pair of blocks: the copies that each vector links with across it, and a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in groups(batches, ["cluster", "lo", "hi"]):
            ids, copies, block = table["rep"].to_numpy(), table["copies"].to_numpy(), table["block"].to_numpy()
            a, b, n = [], [], []
            for i, j in zip(edges.tolist(), edges[1:].tolist()):
                x = _matrix(table["vector"].slice(i, j - i))
                linked = x @ x.T >= least
                np.fill_diagonal(linked, False)
                if table["lo"][i].as_py() != table["hi"][i].as_py():
                    linked &= block[i:j, None] != block[None, i:j]
                a.append(ids[i:j])
                b.append(ids[i:j])
                n.append(linked @ copies[i:j])
                forest = np.array(spread(lambda y, zs, linked=linked: linked[y, zs], j - i), np.int64).reshape(-1, 2) + i
                a.append(ids[forest[:, 0]])
                b.append(ids[forest[:, 1]])
                n.append(np.zeros(len(forest), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(n).astype(np.int64))], ["a", "b", "n"])

    return run


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector with its leader and the largest angle between that leader and its vectors."""
    for table, edges in groups(batches, ["cluster", "part"]):
        ids, lead, radius = table["rep"].to_numpy(), np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows)
        for i, j in zip(edges.tolist(), edges[1:].tolist()):
            x, rest = _matrix(table["vector"].slice(i, j - i)), np.arange(j - i)
            while len(rest):
                sims = x[rest] @ x[rest[0]]
                near = sims >= REACH
                near[0] = True
                lead[i + rest[near]] = ids[i + rest[0]]
                radius[i + rest[near]] = np.arccos(np.clip(sims[near], -1, 1)).max()
                rest = rest[~near]
        columns = [table[c].combine_chunks() for c in ("g", "cluster", "rep", "vector")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(lead), pa.array(radius)], ["g", "cluster", "rep", "vector", "lead", "radius"])


def _near_leaders(least: float):
    """Of each pair of blocks of leaders: a spanning forest of their links (sure), and pairs of other clusters whose members may link."""
    turn = np.arccos(least) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in groups(batches, ["g", "lo", "hi"]):
            ids, cluster, radius = (table[c].to_numpy() for c in ("lead", "cluster", "radius"))
            a, b, sure = [], [], []
            for i, j in zip(edges.tolist(), edges[1:].tolist()):
                x = _matrix(table["vector"].slice(i, j - i))
                sims, own = x @ x.T, cluster[i:j]
                forest = np.array(spread(lambda y, zs: sims[y, zs] >= least, j - i), np.int64).reshape(-1, 2)  # noqa: B023
                joined = Forest(j - i)
                for y, z in forest.tolist():
                    joined.join(y, z)
                root = np.array([joined.root(y) for y in range(j - i)])
                forest = forest[own[forest[:, 0]] != own[forest[:, 1]]]
                maybe = np.arccos(np.clip(sims, -1, 1)) <= turn + radius[i:j, None] + radius[None, i:j]
                maybe &= (own[:, None] != own[None, :]) & (root[:, None] != root[None, :])
                pairs = np.concatenate([forest, np.argwhere(np.triu(maybe, 1))]) + i
                a.append(ids[pairs[:, 0]])
                b.append(ids[pairs[:, 1]])
                sure.append(np.arange(len(pairs)) < len(forest))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(sure))], ["a", "b", "sure"])

    return run


def _any_link(least: float):
    """The pairs of leaders of which a member links with a member of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in groups(batches, ["a", "b"]):
            first, a, b = table["first"].to_numpy(), table["a"].to_numpy(), table["b"].to_numpy()
            found = []
            for i, j in zip(edges.tolist(), edges[1:].tolist()):
                x, own = _matrix(table["vector"].slice(i, j - i)), first[i:j]
                if (x[own] @ x[~own].T >= least).any():
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], ["a", "b"])

    return run


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _best(edges: DataFrame, size) -> DataFrame:
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return one.withColumn("_n", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("_n") <= size).drop("_n")


def _round(lists: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """One round of NN-descent on lists of `size`; reverse lists are as long."""
    back = lists.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).where(F.col("_n") <= size)
    met = lists.select(F.col("u").alias("p"), F.col("v").alias("m")).union(back.select("v", "u")).union(reps.select("rep", "rep")).distinct()
    last = lists.groupBy("u").agg(F.when(F.count("*") >= size, F.min("sim")).otherwise(-2.0).alias("least"))
    known = reps.select(F.col("rep").alias("m"), "vector").join(last.withColumnRenamed("u", "m"), "m", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    rows = met.join(known, "m").select("p", "m", "least", "vector").repartition(_partitions(reps), "p").sortWithinPartitions("p")
    return cut(_best(lists.union(rows.mapInArrow(_meet, "u long, v long, sim double")), size))


def neighbour_lists(reps: DataFrame, least: float, tables: int, rounds: int) -> DataFrame:
    """(u, v, sim): the neighbour lists after `rounds` rounds, saturated ones enlarged."""
    coded = reps.mapInArrow(_coded(tables, 1), f"table int, label {dict(reps.dtypes)['label']}, size int, code long, rep long, vector binary")
    order = ["table", "size", "label", "code"]
    near = coded.repartitionByRange(_partitions(reps), *order).sortWithinPartitions(*order, "rep").mapInArrow(_neighbours, "u long, v long, sim double")
    lists = cut(_best(near, LIST))
    for _ in range(rounds):
        lists = _round(lists, reps, LIST)
    full = lists.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("low")).where((F.col("n") >= LIST) & (F.col("low") >= least))
    dense = full.select(F.col("u").alias("rep"))
    around = lists.join(dense.withColumnRenamed("rep", "u"), "u")
    enlarged = _round(around, reps.join(dense, "rep", "left_semi"), 4 * LIST)
    return lists.union(enlarged)


def _between(lists: DataFrame, clusters: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """(a, b): clusters that links between vectors with BEST links or more join, whatever their lists are filled with."""
    n = _partitions(reps)
    dense = lists.where(F.col("sim") >= least).groupBy("u").agg(F.countDistinct("v").alias("n")).where(F.col("n") >= BEST).select(F.col("u").alias("rep"))
    kinds = reps.groupBy("label", "size").agg(F.min("rep").alias("g"))
    rows = reps.join(dense, "rep", "left_semi").join(clusters, "rep").join(kinds, ["label", "size"])
    parts = rows.groupBy("cluster").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("_parts"))
    dealt = rows.join(parts, "cluster").select("g", "cluster", F.expr("cast(pmod(xxhash64(rep), _parts) as int)").alias("part"), "rep", "vector")
    led = cut(dealt.repartition(n, "cluster", "part").sortWithinPartitions("cluster", "part", "rep").mapInArrow(_led, "g long, cluster long, rep long, vector binary, lead long, radius double"))
    leaders = blocks(led.where("rep = lead"), "g", "lead", BLOCK)
    keys = ["g", "lo", "hi"]
    pairs = cut(leaders.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_near_leaders(least), "a long, b long, sure boolean").distinct())
    members, maybe = led.select("lead", "vector"), pairs.where("not sure").select("a", "b")
    sides = [maybe.join(members.withColumnRenamed("lead", side), side).select("a", "b", F.lit(side == "a").alias("first"), "vector") for side in ("a", "b")]
    shown = sides[0].union(sides[1]).repartition(n, "a", "b").sortWithinPartitions("a", "b").mapInArrow(_any_link(least), "a long, b long")
    of = led.where("rep = lead").select("lead", "cluster")
    both = pairs.where("sure").select("a", "b").union(shown).join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b")
    return both.select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def _links(reps: DataFrame, least: float, tables: int, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rep, links: linked copies of other vectors), (edges a, b that span the links), the neighbour lists."""
    lists = neighbour_lists(reps, least, tables, rounds)
    clusters = components(lists.where(F.col("sim") >= least - MARGIN).select(F.col("u").alias("a"), F.col("v").alias("b")))
    clusters = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    merged = components(_between(lists, clusters, reps, least)).select(F.col("node").alias("cluster"), "component")
    clusters = clusters.join(merged, "cluster", "left").select("rep", F.coalesce("component", "cluster").alias("cluster"))
    return *_compared(reps.join(clusters, "rep").select("cluster", "rep", "copies", "vector"), reps, least), lists


def _compared(inside: DataFrame, reps: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """_links' first two, by a comparison of all pairs of each cluster."""
    dealt = blocks(inside, "cluster", "rep", BLOCK)
    keys = ["cluster", "lo", "hi"]
    counted = cut(dealt.repartition(_partitions(reps), *keys).sortWithinPartitions(*keys).mapInArrow(_count_links(least), "a long, b long, n long"))
    return counted.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links")), counted.where("a <> b").select("a", "b")


def exact_links(reps: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """_links' first two, by a comparison of all pairs of a label and size."""
    kinds = reps.groupBy("label", "size").agg(F.min("rep").alias("cluster"))
    return _compared(reps.join(kinds, ["label", "size"]).select("cluster", "rep", "copies", "vector"), reps, least)


def _asked(reps: DataFrame, n: int) -> list:
    """n vectors by hash, the labels in turn."""
    order = Window.partitionBy("label", "size").orderBy(F.xxhash64("rep"), "rep")
    turns = reps.select("rep", "label", "size", "vector").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return turns.orderBy("_n", F.xxhash64("rep"), "rep").limit(n).collect()  # bounded by n


def audited(reps: DataFrame, lists: DataFrame, links: DataFrame, least: float) -> float | None:
    """The smallest share of true links found, of all kinds of vectors; None if too few true links were seen to judge."""
    near = lists.where(F.col("sim") >= least - MARGIN).groupBy("u").agg(F.countDistinct(F.when(F.col("sim") >= least, F.col("v"))).alias("n"))
    kinds = [reps, *(reps.join(k.select(F.col("u").alias("rep")), "rep", "left_semi") for k in (near, near.where(F.col("n") >= BEST)))]
    n = AUDIT
    while True:
        asked = [_asked(k, n) for k in kinds]
        found = [audit(reps, links, least, a) for a in asked]
        if sum(true for true, _ in found) >= SEEN or len(asked[0]) < n:  # fewer than n: all were asked
            return min((hit / true for true, hit in found if true), default=1.0)
        if n >= MOST_ASKED:
            return None
        n = min(4 * n, MOST_ASKED)


def audit(reps: DataFrame, links: DataFrame, least: float, asked: list) -> tuple[int, int]:
    """(links of the vectors asked about by brute force against all vectors, those of them that were found)."""
    queries: dict[tuple, list] = {}
    for r in asked:
        queries.setdefault((r["label"], r["size"]), []).append((r["rep"], np.frombuffer(r["vector"], np.float64)))
    stacked = {key: (np.array([r for r, _ in own]), np.stack([v for _, v in own])) for key, own in queries.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, size = batch.column("label").to_pylist(), batch.column("size").to_numpy()
            ids, copies = batch.column("rep").to_numpy(), batch.column("copies").to_numpy()
            at: dict[tuple, list] = {}
            for i, key in enumerate(zip(label, size.tolist())):
                at.setdefault(key, []).append(i)
            out, n = [], []
            for key, (asked_here, v) in stacked.items():
                if key in at:
                    own = np.array(at[key])
                    x = _matrix(batch.column("vector").take(pa.array(own)))
                    linked = (v @ x.T >= least) & (asked_here[:, None] != ids[own][None, :])
                    out += asked_here.tolist()
                    n += (linked @ copies[own]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(n, pa.int64())], ["rep", "n"])

    true = reps.mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    row = true.join(links, "rep", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("links", F.lit(0))))).first()
    return row[0] or 0, row[1] or 0


def embedding_dedup(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row."""
    rows = cut(small_batches(vectors).select(F.col("vec_id").cast("long"), "label", "embedding").mapInArrow(_prepare, f"vec_id long, label {dict(vectors.dtypes)['label']}, size int, digest binary, vector binary"))
    real = rows.where("vector is not null and vec_id is not null")
    key = ["label", "size", "digest"]
    reps = cut(real.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    tables, rounds = TABLES, ROUNDS
    for _ in range(ATTEMPTS):
        links, edges, lists = _links(reps, least, tables, rounds)
        recall = audited(reps, lists, links, least)
        if recall is None or recall >= RECALL:
            break
        tables, rounds = 2 * tables, rounds + 1
    if recall is None or recall < RECALL:
        links, edges = exact_links(reps, least)
    found = reps.select(*key, "rep", "copies").join(links, "rep", "left").join(components(edges).withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", *key).join(found, key, "left")
    out = out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
