"""The queries of the text operators: whole tables in, digest columns out, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.centroids import cluster_centroids
from offerloom.llm.chat import format_chats, loss_text, parse, storied_log
from offerloom.llm.divergence import source_divergence
from offerloom.llm.embedding_dedup import embedding_dedup
from offerloom.llm.licences import licence_scan
from offerloom.llm.line_dedup import line_dedup
from offerloom.llm.minhash_dedup import minhash_dedup
from offerloom.llm.packing import pack, vocabulary
from offerloom.llm.quality import quality_rules, train
from offerloom.llm.secrets import KINDS, find_secrets, listed
from offerloom.llm.segment import sample_segmentations
from offerloom.llm.substring_dedup import substring_dedup
from offerloom.llm.token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines but those that a smaller doc_id holds too."""
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the line field's verdict for every document."""
    docs = _table(spark, sf_dir, "documents")
    out = quality_rules(docs, train(docs, _table(spark, sf_dir, "labels")))
    return out.drop("lines")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, told as a log of drafts, regenerations, edits and deltas, folded and formatted; digests are of what is read back."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    made = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    out = format_chats(storied_log(rows.unionByName(made)))
    read = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("lost"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: pattern spans and high-entropy spans."""
    out = find_secrets(_table(spark, sf_dir, "documents"))
    kinds = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *kinds, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and the sequences of 4096 tokens that hold them."""
    out = pack(_table(spark, sf_dir, "documents"), vocabulary(spark), size=4096, end=1)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 3-word shingles overlap by 85 per cent or more."""
    return minhash_dedup(_table(spark, sf_dir, "documents"), width=3, per_cent=85)


def op7_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every document, read back for a check."""
    rows = _table(spark, sf_dir, "documents")
    out = sample_segmentations(rows, ["doc_id"], vocabulary(spark, "piece_bpe_32k.model"), k=3, seed=7)
    return out.select("doc_id", "sample", "ids", "log_probability", "inclusion", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of vectors of a label whose cosine is 0.93 or more, and every vector's number of links."""
    return embedding_dedup(_table(spark, sf_dir, "embeddings"), least=0.93)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that start earlier in the corpus too."""
    out = substring_dedup(_table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases, labels and score."""
    return licence_scan(_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of the integer vectors after three rounds."""
    return cluster_centroids(_table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens."""
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary(spark, "piece_bpe_32k.model"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and the terms that mark each source."""
    return source_divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_secret_scan": op4_secret_scan,
    "op5_packing": op5_packing,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_segmentations": op7_segmentations,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_token_counts": op12_token_counts,
    "op13_source_divergence": op13_source_divergence,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _clustered(k: int, rounds: int) -> str:
    """The clustering, round by round."""
    out = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS c, e AS m FROM v ORDER BY 1 LIMIT {k})"""
    for i in range(rounds + 1):
        out += f""",
p{i} AS (SELECT r, vec_id, e, c, list_sum(list_transform(range(1, 65), lambda i: (e[i] - m[i]) * (e[i] - m[i]))) AS d FROM v, c{i}),
a{i} AS MATERIALIZED (SELECT r, vec_id, e, c, CAST(d AS BIGINT) AS d FROM p{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        if i < rounds:
            out += f""",
s{i} AS (SELECT c, i, CAST(sum(e[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, e, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} USING (c))"""
    return out + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""


SQL: dict[str, str] = {
    "op11_centroid_clustering": _clustered(16, 3),
    "op13_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
cell AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cell USING (lang, source) GROUP BY ALL),
size AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
share AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5) // (total + 5 * v) AS BIGINT) AS p
  FROM grp g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN cell USING (lang, source, term)),
whole AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 5) // (any_value(total) + 5 * any_value(v)) AS BIGINT) AS q
  FROM cell JOIN (SELECT lang, sum(total) AS total FROM grp GROUP BY lang) USING (lang) JOIN size USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
joint AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM share JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM joint
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50""",
    "op1_line_dedup": f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM parts),
keyed AS (SELECT *, translate(trim(line, {_BLANK}), {_AZ}) AS k FROM numbered),
shared AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, coalesce(owner <> doc_id, false) AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op3_chat_formatting": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (SELECT *, length(regexp_replace(replace(text, '~', '~~'),
    '([<\[])(/?s>|\|im_(?:sep|start|end)\|>|</?SYS>>|/?INST\])', '\1~\2', 'g')) AS body FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(3 + length(role) + 10 + body + 4) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id""",
    "op6_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
spot AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
sh AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM spot
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) IN (1, 2)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS x, a AS y FROM edge UNION SELECT x, b FROM reach JOIN edge ON a = y),
smallest AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN size ON size.doc_id = w.doc_id LEFT JOIN smallest ON x = w.doc_id""",
    "op8_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS x, a AS y FROM edge UNION SELECT x, b FROM reach JOIN edge ON a = y),
smallest AS (SELECT x, min(y) AS c FROM reach GROUP BY x), n AS (SELECT a, count(*) AS n FROM edge GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON a = vec_id LEFT JOIN smallest ON x = vec_id""",
    "op9_substring_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
win AS (SELECT doc_id, i, string_agg(word, ' ') OVER o AS s, count(*) OVER o AS n FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
again AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS later FROM win WHERE n = 20),
cov AS (SELECT p.doc_id, p.i, word, coalesce(bool_or(later) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM p LEFT JOIN again ON again.doc_id = p.doc_id AND again.i = p.i)
SELECT w.doc_id, count(word) AS n_words, count(word) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id GROUP BY w.doc_id""",
}
