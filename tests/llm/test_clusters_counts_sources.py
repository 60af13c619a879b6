"""Centroid clustering, token counts and source divergence against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from offerloom.llm import divergence, token_counts
from offerloom.llm.centroids import VantageTree, cluster_centroids
from offerloom.llm.divergence import source_divergence
from offerloom.llm.token_counts import Pieces

MODEL = path("piece_bpe_32k.model")
lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
VECTORS = "vec_id long, embedding array<double>, label int, cluster string, distance int, at long"


def brute_clusters(rows, k, rounds, size, scale):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centres = [v for i, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centres = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inside = Counter()
    for _, c, d in found:
        inside[c] += d
    digest = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    return Counter((i, c, d, inside[c], sum(inside.values()), digest(c)) for i, c, d in found)


def clusters(spark, rows, **how):
    df = spark.createDataFrame([(i, v, None, "x", 1, 2) for i, v in rows], VECTORS).repartition(3)
    return Counter(tuple(r) for r in cluster_centroids(df, **how).drop("centroid").collect())


def test_clusters_equal_brute_force(spark):
    dice = random.Random(3)
    rows = [(i, [dice.choice([-1.5, -0.25, 0.0, 0.0, 0.4, 1.0]) for _ in range(4)]) for i in range(400)]  # many equal vectors and distances
    rows += [(7, [0.1] * 4), (7, [0.1] * 4), (None, [0.3] * 4), (900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [math.nan, 1.0, 1.0, 1.0]), (905, [math.inf, 1.0, 1.0, 1.0])]
    for k in (1, 5, 40):
        assert clusters(spark, rows, k=k, rounds=3, size=4, scale=8) == brute_clusters(rows, k, 3, 4, 8)
    assert clusters(spark, rows[:3], k=16, rounds=2, size=4, scale=8) == brute_clusters(rows[:3], 16, 2, 4, 8)


def test_clusters_of_large_components_are_exact(spark):
    rows = [(i, [3e6 + i / 64, -(2.0**24), 0.5 * i]) for i in range(60)] + [(100, [4e7, 0.0, 1.0])]
    assert clusters(spark, rows, k=6, rounds=2, size=3, scale=64) == brute_clusters(rows, 6, 2, 3, 64)
    far = clusters(spark, [(1, [1e15, 0.0, 0.0]), (2, [-1e15, 0.0, 0.0]), (3, [1e300, 0.0, 0.0])], k=1, rounds=1, size=3, scale=64)
    assert sorted(r[0] for r in far) == [1, 2] and {r[2:5] for r in far} == {(None, None, None)}  # no long holds them; the third isn't a long itself


def test_no_vectors_no_clusters(spark):
    assert not clusters(spark, [], k=3, rounds=2, size=3, scale=64) and not clusters(spark, [(1, None)], k=3, rounds=2, size=3, scale=64)
    with pytest.raises(ValueError):
        cluster_centroids(spark.createDataFrame([], VECTORS), k=1 << 20)


def test_tree_finds_the_nearest_and_opens_few_nodes():
    dice = np.random.default_rng(5)
    for size, spread in ((2, 3), (3, 1000), (64, 40)):
        centres = dice.integers(-spread, spread, (60, size))
        centres[30:35] = centres[3]  # equal centroids
        x = np.concatenate([dice.integers(-spread, spread, (500, size)), centres])
        number, square = VantageTree(centres.tolist()).nearest(x)
        away = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (square == away.min(axis=1)).all() and (number == away.argmin(axis=1)).all()


class Counting(VantageTree):
    met = 0

    def _squares(self, x, centre):
        self.met += len(x)
        return super()._squares(x, centre)


def test_tree_prunes():
    dice = np.random.default_rng(6)
    centres = dice.integers(-100_000, 100_000, (512, 2))
    tree = Counting(centres.tolist())
    tree.met = 0
    tree.nearest(centres + 3)
    assert tree.met < 512 * 60  # of 512 distances each


def odd_texts():
    dice = random.Random(11)
    letters = ["a", "b", "the", "ing", " ", "  ", "   ", "\n", "\t", "▁", "é", "́", "日", "本", "\x00", "<s>", "</s>", "<unk>", "<0x0A>", "​", "1", "23", ".", "…", "ﬁ", "\U0001f600", "и", "ни", "\r\n", "\xa0", "　", "Ａ"]
    return ["".join(dice.choices(letters, k=dice.randrange(1, 40))) for _ in range(1500)] + ["", " ", "▁", "  ", "\n", "a ", " a", "▁▁ ▁"]


def test_counts_of_pre_tokens_add_up():
    pieces = Pieces(MODEL)
    for text in odd_texts():
        assert sum(pieces.counts(list(pieces.split(text)))) == len(pieces.model.encode(text)), repr(text)
    assert not pieces.counts([])


def test_token_counts_of_odd_tables(spark, odd, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()] + [(1000 + i, t) for i, t in enumerate(odd_texts())]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("piece", "name", "texts", "n", "known", "rows", "to", "packet", "head", "seen", "body")})
    encode = Pieces(MODEL).model.encode
    true = Counter((i, len((t or "").encode()), len(encode(t or "")), len(encode(t or "")) > 100) for i, t in rows)
    counted = lambda: Counter(tuple(r) for r in token_counts.token_counts(more, MODEL, limit=100).collect())
    assert counted() == true
    for name, small in (("HOT", 5), ("PACKET_TEXTS", 3), ("KNOWN", 1), ("GATHERED", 50)):  # nearly all counts come by the join; many packets, some of them equal; little memory
        monkeypatch.setattr(token_counts, name, small)
    twice = more.unionAll(more)
    assert counted() == true
    assert Counter(tuple(r) for r in token_counts.token_counts(twice, MODEL, limit=100).collect()) == Counter({k: 2 * n for k, n in true.items()})
    assert token_counts.token_counts(more.limit(0), MODEL).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert not token_counts.token_counts(more.limit(0), MODEL).collect()


def brute_divergence(rows, least, ranks):
    rows = [((g or ""), (s or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t))) for t, g, s in rows]
    out = []
    for lang in {g for g, _, _ in rows}:
        own = [(s, w) for g, s, w in rows if g == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = {t for t, n in df.items() if n >= least}
        count = {s: Counter() for s, _ in own}
        for s, w in own:
            count[s].update(t for t in w if t in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q, p = share(sum(count.values(), Counter())), {s: share(c) for s, c in count.items()}
        for s in p:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s], "term": [(t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i) for i, (t, v) in enumerate(ranked, 1) if part == "pair" or i <= ranks]
    return Counter(out)


def test_divergence_equals_brute_force(spark, monkeypatch):
    dice = random.Random(2)
    words = ["Alpha", "alpha", "beta", "gamma", "Été", "été", "日本", "it's", "x1y", "_z", "ÄB", "zz\x00zz", "\U0001f600"]
    rows = [(" ".join(dice.choices(words, k=dice.randrange(30))), dice.choice(["en", "en", "de", None]), dice.choice(["a", "b", "ç", "", None, "\U0001f600"])) for _ in range(300)]
    rows += [(None, "fr", "only"), ("", "it", "one"), ("123 !?", "it", "two"), ("alpha " * 5000, "en", "long"), (None, "en", "mute"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], "text string, lang string, source string, term int, cells string, texts long").repartition(4)
    true = brute_divergence(rows, 20, 3)
    found = lambda d=df: Counter(tuple(r) for r in source_divergence(d, least=20, ranks=3).collect())
    assert found() == true
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "PAIRS", 3)
    monkeypatch.setattr(divergence, "GROUPS", 1)
    assert found() == true
    assert not found(df.limit(0))


def test_stripes_are_spilled_and_merged(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TERM_BYTES", 0)
    import pyarrow as pa

    rows = [("a b b", "en", "s"), ("a c", "en", "t"), ("", "en", "u")]
    batch = pa.RecordBatch.from_pydict({"text": [t for t, _, _ in rows], "lang": [g for _, g, _ in rows], "source": [s for _, _, s in rows]})
    parts = [b for one in range(3) for b in divergence._folded(iter([batch.slice(one, 1)] * 2))]
    assert len(parts) > 3
    cells = Counter()
    for part in parts:
        for r in part.to_pylist():
            cells[r["term"], "texts"] += r["texts"]
            for c in r["cells"]:
                cells[r["term"], c["source"]] += c["count"]
    assert cells["a", "texts"] == 4 and cells["a", "s"] == 2 and cells["b", "s"] == 4 and cells["c", "t"] == 2 and (" u", "u") in cells


def test_shares_of_large_counts_are_exact():
    count, below = np.array([[10**15, 3]]), np.array([[10**16 + 7, 11]])
    assert divergence._shares(count, below).tolist() == [[1 + 10**9 * (10**15 + 5) // (10**16 + 7), 1 + 10**9 * 8 // 11]]
