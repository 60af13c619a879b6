"""Chat formatting, embeddings and sampled segmentations."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import chat, embedding_dedup, segment
from offerloom.llm.packing import vocabulary
from offerloom.llm.queries import QUERIES

TEXTS = ["</s>[INST] ok [/INST]", "~", "~~</s>", "<~/s>", "<<SYS>>x<</SYS>>", "<|im_sep|>", "[~/INST]", "a<b[c", "", "日本\U0001f600~<s>", "<</s>", "<|im_start|>~<|im_end|>", "line\nline"]


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    rng = random.Random(1)
    parts = ["~", "<", "[", "/s>", "s>", "<s>", "/INST]", "INST]", "<|im_sep|>", "</SYS>>", "a", "|im_end|>"]
    rows = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_sep|>", "<|im_start|>", "<|im_end|>"))


def test_turns_come_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(TEXTS)] + [(2, 0, None, None), (2, None, "user", "first"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"messages": F.lit(1), "loss": F.lit("x")})
    out = chat.format_chats(chat.log_of(df)).select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("lost"))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [t["text"] for t in got[1]["turns"]] == TEXTS
    assert got[1]["lost"] == "".join(TEXTS[1::2])
    assert [tuple(t) for t in got[2]["turns"]] == [("user", "first"), ("", "")]
    assert len(got[3]["turns"]) == 2 and got[3]["lost"] == "tietie" and got[None]["turns"][0]["text"] == "x"
    assert chat.format_chats(chat.log_of(df.limit(0))).count() == 0


def test_events_fold(spark):
    """Deltas append; an edit replaces; a regeneration replaces and drops what came after it."""
    log = [
        (1, 1, "delta", 1, "user", "Hel"), (1, 2, "delta", 1, "user", "lo"), (1, 3, "delta", 2, "assistant", "bad"), (1, 4, "delta", 3, "user", "follow"), (1, 5, "delta", 4, "assistant", "late"),
        (1, 6, "regenerate", 2, "assistant", "go"), (1, 7, "delta", 2, "assistant", "od"), (1, 8, "edit", 1, "user", "Hi"), (1, 9, "delta", 1, "user", "!"), (1, 10, "delta", 3, "user", "again"),
        (2, 1, "delta", 1, "assistant", None),
    ]
    rows = list(log)
    random.Random(0).shuffle(rows)
    got = {r["conv_id"]: r["messages"] for r in chat.messages(spark.createDataFrame(rows, "conv_id long, seq long, kind string, message long, role string, text string")).collect()}
    assert [(m["message"], m["text"]) for m in got[1]] == [(1, "Hi!"), (2, "good"), (3, "again")] and [m["text"] for m in got[2]] == [""]


def test_the_control_string_conversation(spark):
    got = {r["conv_id"]: r for r in QUERIES["op3_chat_formatting"](spark, "/root/testdata/sf0.001").collect()}
    t = "</s>[INST] ok [/INST]"
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert got[-7]["loss_chars"] == len(t) and got[-7]["loss_sha256"] == hashlib.sha256(t.encode()).hexdigest() and got[-7]["n_turns"] == 2


def brute_links(rows, least=0.93):
    good = [(i, np.array(v, np.float64), k) for i, v, k in rows if i is not None and v is not None and k is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    n, up = Counter(), {i: i for i, _, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x, k) in enumerate(good):
        for j, y, m in good[:a]:
            if k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                n[i] += 1
                n[j] += 1
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: (n[i], root(i)) for i in up}


def vectors(seed=5, n=500, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    rows = []
    for i in range(n):
        if i < 80:  # a dense cluster, larger than a list
            v = centres[0] + 0.03 * rng.normal(size=d)
        elif i < 200:
            v = centres[i % 8] + 0.17 * rng.normal(size=d)
        elif i < 230:
            v = np.array(rows[i - 30][1])
        else:
            v = rng.normal(size=d)
        rows.append((i, [float(x) for x in v], int(i % 3 if i >= 80 else 1)))
    return rows


def test_embeddings(spark):
    rows = vectors() + [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [float("nan")] * 24, 1), (904, [None] * 24, 1), (905, vectors()[0][1], None), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [float("inf")] + [1.0] * 23, 1), (909, [1e200] * 24, 2), (910, [2e200] * 24, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"rep": F.lit(1), "size": F.lit("s")})
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(df).collect()}
    want = brute_links([r for r in rows if r[0] not in (909, 910)])
    want |= {909: (1, 909), 910: (1, 909)}
    assert got.keys() == want.keys()
    true, found = sum(n for n, _ in want.values()), sum(min(want[i][0], got[i][0]) for i in want)
    assert found >= 0.98 * true and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_embeddings_with_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (2, [1.0, 0.0], 3), (None, [1.0, 0.0], 3), (4, [0.0, 1.0], 3)], "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.embedding_dedup(df).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"]) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (4, 0, 4, True)]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, True)]
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_blocks_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows = vectors(n=120)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute_links(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def linked_groups(sizes=(60, 60, 30, 30), d=64, seed=3):
    """Tight groups in pairs: in-group cosine about 0.99, between the two of a pair about 0.945."""
    rng, rows = np.random.default_rng(seed), []
    for g, n in enumerate(sizes):
        if g % 2 == 0:
            c, side = (v / np.linalg.norm(v) for v in rng.normal(size=(2, d)))
            side = side - (side @ c) * c
            side /= np.linalg.norm(side)
        centre = c if g % 2 == 0 else 0.9545 * c + math.sqrt(1 - 0.9545**2) * side
        for _ in range(n):
            rows.append((len(rows), [float(x) for x in centre + 0.1 * rng.normal(size=d) / math.sqrt(d)], 1))
    return rows


def test_links_between_dense_groups(spark):
    rows = linked_groups()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute_links(rows)
    assert len({c for _, c in want.values()}) == 2 and got == want


def rare_links(n=1500, d=24, every=300):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, d))
    x[1::every] = x[0::every] + 0.05 * rng.normal(size=x[0::every].shape)
    return [(i, [float(y) for y in v], 1) for i, v in enumerate(x)]


def test_lost_links_are_noticed(spark, monkeypatch):
    """Lists that find nothing: rare links, which few audits by chance would see, and frequent ones after the last attempt."""

    def nothing(reps, *_):
        return reps.select(F.col("rep").alias("u"), F.col("rep").alias("v"), F.lit(-1.0).alias("sim")).limit(0)

    monkeypatch.setattr(embedding_dedup, "neighbour_lists", nothing)
    monkeypatch.setattr(embedding_dedup, "ATTEMPTS", 2)
    for rows in (rare_links(), vectors(n=200)):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
        want = brute_links(rows)
        assert sum(n for n, _ in want.values()) > 0 and got == want


@pytest.fixture(scope="module")
def model(spark):
    return segment.Pieces(vocabulary(spark, "piece_bpe_32k.model"))


def test_segmentations_are_distinct_and_decode(model):
    for text in ["hello world", " a  b ", "▁x▁", "日本語 \U0001f600 é", "x\ny", "﷐▁", "a" * 3000]:
        got = model.sample(text, 4, 11)
        assert len({tuple(i) for i, _, _ in got}) == len(got) and all(model.decode(i) == text for i, _, _ in got) and model.decode(model.best(text)) == text
        assert all(0 < q <= 1 and p <= 1e-9 for _, p, q in got) and got == model.sample(text, 4, 11)
    assert model.sample("", 3, 1) == [([], 0.0, 1.0)]


def test_samples_follow_the_probabilities(model):
    every = {tuple(i): math.exp(p) for i, p, _ in model.sample("ab cd", 100, 0)}
    assert abs(sum(every.values()) - 1) < 1e-9
    n, first, total = 3000, Counter(), 0.0
    for seed in range(n):
        got = model.sample("ab cd", 2, seed)
        first[tuple(got[0][0])] += 1
        total += sum(math.exp(p) / q for _, p, q in got)
    assert abs(total / n - 1) < 0.01
    for ids, p in every.items():
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
    assert abs(math.exp(max(model.sample("ab cd", 100, 0), key=lambda x: x[1])[1]) - max(every.values())) < 1e-12


def test_segmentation_rows(spark):
    rows = [(1, 1, "some text"), (1, 2, None), (None, 3, ""), (1, 1, "some text"), (2, 1, "long text " * 2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumns({"sample": F.lit(9), "_key": F.lit("k"), "ids": F.lit(1)})
    out = segment.sample_segmentations(df, ["conv_id", "turn"], vocabulary(spark, "piece_bpe_32k.model"), 3, 7).collect()
    assert len(out) == 3 + 1 + 1 + 3 + 3
    first = sorted((r["sample"], tuple(r["ids"]), r["inclusion"]) for r in out if (r["conv_id"], r["turn"]) == (1, 1))
    assert first[::2] == first[1::2] and {r["decoded"] for r in out if r["conv_id"] == 2} == {"long text " * 2000}
    assert segment.sample_segmentations(df.limit(0), ["conv_id"], vocabulary(spark, "piece_bpe_32k.model")).count() == 0


def test_every_document_is_segmented(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op7_segmentations"](spark, "/root/testdata/sf0.001").select("doc_id", "decoded_sha256").collect()
    assert {r["doc_id"] for r in got} == set(docs)
    assert all(r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest() for r in got)


def test_a_storied_log_folds_to_its_turns_and_long_conversations_take_linear_time(spark, monkeypatch):
    import time

    from offerloom.llm import chat

    rows = [(1, 0, "user", "hé~<s>y"), (1, 1, "assistant", ""), (1, 2, "assistant", "</s>\U0001f600 ok"), (2, 0, "user", None), (None, 0, "assistant", "a"), (3, 0, "assistant", "ab")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    told = {r["conv_id"]: [(m["role"], m["text"]) for m in r["messages"]] for r in chat.messages(chat.storied_log(df)).collect()}
    assert told == {1: [("user", "hé~<s>y"), ("assistant", ""), ("assistant", "</s>\U0001f600 ok")], 2: [("user", "")], None: [("assistant", "a")], 3: [("assistant", "ab")]}
    for many in (256, 1):
        monkeypatch.setattr(chat, "MANY_SPANS", many)
        out = chat.format_chats(chat.storied_log(df)).select("conv_id", chat.loss_text(F.col("formatted"), F.col("loss")).alias("lost"), "formatted", "loss").collect()
        assert {r["conv_id"]: r["lost"] for r in out} == {1: "</s>\U0001f600 ok", 2: "", None: "a", 3: "ab"}
        assert all(chat.OPEN not in r["formatted"][s["start"] : s["end"]] for r in out for s in r["loss"])
    took = []
    for n in (4000, 16000):
        long = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("some words of turn "), F.col("id").cast("string")).alias("text"))
        began = time.perf_counter()
        lost = chat.format_chats(chat.log_of(long)).select(chat.loss_text(F.col("formatted"), F.col("loss")).alias("x")).first()["x"]
        took.append(time.perf_counter() - began)
        assert lost == "".join(f"some words of turn {i}" for i in range(1, n, 2))
    assert took[1] < 6 * took[0] + 2


def test_texts_drawn_together_follow_the_probabilities_and_take_little_time(model, monkeypatch):
    import random
    import time

    text = "abc de\nfgh \U0001f600"
    every = {tuple(i): math.exp(p) for i, p, _ in model.searched(text, 5000, 0)}
    assert abs(sum(every.values()) - 1) < 1e-9 and max(every.values()) > 1 / 6
    n = 20_000
    with monkeypatch.context() as m:
        m.setattr(segment, "ROOM", 0.25)  # all but the surest texts are drawn together
        rows, ids, at, logp, inclusion = model.sample_all([text] * n, 2, list(range(n)))
    assert rows.tolist() == [i for i in range(n) for _ in range(2)]
    ways = [tuple(ids[a:b].tolist()) for a, b in zip(at, at[1:])]
    assert all(abs(math.exp(p) - every[w]) < 1e-9 for w, p in zip(ways, logp)) and all(a != b for a, b in zip(ways[::2], ways[1::2]))
    assert abs((math.e ** logp / inclusion).sum() / n - 1) < 0.02
    first, second = Counter(ways[::2]), Counter(ways[1::2])
    for way, p in every.items():
        then = sum(q * p / (1 - q) for other, q in every.items() if other != way)
        for got, want in ((first[way] / n, p), (second[way] / n, then)):
            assert abs(got - want) < 5 * math.sqrt(want * (1 - want) / n) + 1e-3
    draw = random.Random(1)
    texts = [" ".join("".join(draw.choices("etaoinshrd", k=draw.randint(2, 12))) for _ in range(1000)) for _ in range(200)]
    began = time.process_time()
    rows, ids, at, _, _ = model.sample_all(texts, 3, list(range(200)))
    assert time.process_time() - began < 8  # 26 word by word
    assert model.decode_all(ids, at).to_pylist() == [t for t in texts for _ in range(3)]
    alone = model.sample(texts[7], 3, 7)
    assert [i for i, _, _ in alone] == [ids[at[j] : at[j + 1]].tolist() for j in range(21, 24)]


def test_words_with_the_same_end_share_its_lattice(model, monkeypatch):
    asked, follow = [], model.follow
    model.table = segment.Table(model)
    with monkeypatch.context() as m:
        m.setattr(model, "follow", lambda keys: asked.append(len(keys)) or follow(keys))
        letters = "abcdefghijklmnopqrstuvwxyz"
        text = " ".join(f"{x}{y}ationally" for x in letters for y in letters)
        (ids, _, _), *_ = model.sample(text, 1, 1)
        assert model.decode(ids) == text and asked[0] == 9 + 26 + 2 * 26 * 26  # 12 * 26 * 26 places, word by word
        model.sample_all([f"{text} {text}", text], 2, [1, 2])
        assert asked[0] >= sum(asked) / 5 and len(asked) < 20  # what has been entered is found


def test_a_small_index_gives_the_same_segmentations(model, monkeypatch):
    texts = ["日本語 \U0001f600 é ▁x▁ 12 3\n\n  a  " * 9, "﷐▁ab cd" * 9, "x\r\ny " * 30, "▁▁" * 20 + " q", "a" * 300, "", "nationally rationally " * 20, " lead and trail ", "\n", "undenominationally " * 9]
    got = []
    for bits, indexed in ((segment.INDEX_BITS, segment.INDEXED), (3, 5), (segment.INDEX_BITS, 1)):
        with monkeypatch.context() as m:
            m.setattr(segment, "INDEX_BITS", bits)
            m.setattr(segment, "INDEXED", indexed)
            model.table = segment.Table(model)
            got.append(model.sample_all(texts, 3, list(range(10))))
    model.table = segment.Table(model)
    rows, ids, at, logp, _ = got[0]
    assert all(np.array_equal(x, y) for other in got[1:] for x, y in zip(got[0][:3], other[:3])) and all(np.allclose(logp, other[3], rtol=0, atol=1e-9) for other in got[1:])
    assert model.decode_all(ids, at).to_pylist() == [texts[i] for i in rows] and set(rows.tolist()) == set(range(10))
    weight = lambda way: sum(model.weight[i] for i in way)
    assert all(abs(weight(ids[a:b].tolist()) - sum(w.beta[0] for w in model.words(texts[i])) - p) < 1e-9 for i, a, b, p in zip(rows.tolist(), at, at[1:], logp))
