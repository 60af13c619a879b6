"""Each stage of the pipeline, on its own input, against brute force."""

import corpus_pipeline as cp
from conftest import OWN, brute_components, brute_lines, words
from pyspark.sql import functions as F
from test_text_operators import base_counts, brute_secrets, check_packing

from offerloom.llm.packing import vocabulary
from offerloom.llm.quality import quality_rules, train

DATA = "/root/testdata/sf0.001"


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, packed = docs.columns, None
    for n, (name, stage) in enumerate(cp.STAGES):
        out, before = stage(spark, docs, DATA), pairs(docs)
        if n == 4:
            packed = out.collect()
            check_packing(packed, before, vocabulary(spark))
            break
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = pairs(docs)
        if n == 0:
            field = train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
            judged = {r["doc_id"] for r in quality_rules(spark.read.parquet(f"{DATA}/documents.parquet"), field).where("kept").collect()}
            assert {i for i, _ in after} == judged and all(base_counts(t)[0] >= 50 for _, t in after)
        if n == 1:
            want = brute_lines(before)
            assert after == sorted((i, want[i][0]) for i, t in before if not want[i][2] or words(want[i][0]))
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        if n == 2:
            want = brute_components(before, 5, 80)
            assert after == [(i, t) for i, t in before if want[i][1] == i]
        if n == 3:
            assert [i for i, _ in after] == [i for i, _ in before]
            for (_, a), (_, b) in zip(before, after):
                spans, text = brute_secrets(a)[1], ""
                at = 0
                for start, _, end in spans:
                    if start >= at:
                        text += a[at:start] + "[secret]"
                    at = max(at, end)
                assert b == text + a[at:]
    whole = cp.run(spark, DATA).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_odd_documents_pass_through(spark, odd, tmp_path):
    for empty in (False, True):
        docs = odd.limit(0) if empty else odd
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == odd.columns
            out.write.parquet(str(tmp_path / f"{name}-{empty}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{empty}"))
            assert all(tuple(r[c] for c in OWN) == tuple(range(len(OWN))) and (r["line"], r["n"], r["lines"], r["bucket"]) == ("x", 1, [1], "k") for r in docs.collect())
        n = cp.STAGES[-1][1](spark, docs, DATA).count()
        assert (n == 0) == empty
