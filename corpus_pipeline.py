"""A training corpus from raw documents: five stages, each the whole-corpus form of one text operator.

1. quality rules: documents that the base rules or the line field reject go;
2. line dedup: lines that an earlier document holds go; a document that loses every word goes with them;
3. MinHash near-dedup on sets of 5-word shingles at a similarity of 0.8: one document of each group stays, the
   one with the smallest doc_id;
4. secret scans: every span found is replaced by `[secret]`;
5. best-fit packing into sequences of 4096 tokens.

Stages 1 to 4 return the columns of documents, any others too, unchanged but for text and n_chars (if there is one).
Null, empty and blank texts fail the quality rules; a null doc_id is judged by them like others, and is neither
compared nor dropped by stages 2 and 3. Rows that share a doc_id are one document to line dedup, are judged each by its
own text in stage 3, and are packed each. Texts are read whole, and a very long one is one step of its task. An empty
table passes through all stages. What the stages write stays in the shared folder, for the returned rows are read from it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from offerloom.llm.common import checkpoint_dir
from offerloom.llm.line_dedup import without_repeated_lines
from offerloom.llm.minhash_dedup import one_of_each
from offerloom.llm.packing import pack, vocabulary
from offerloom.llm.quality import good_documents, train
from offerloom.llm.secrets import without_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, width=5, per_cent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary(spark), size=4096, end=1)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near_copies), ("secret_scan", secrets), ("packing", packing)]

#: The line field, the token ids and the packing are beyond SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
