"""Secret scans with DataFrame functions only: fixed patterns, and sliding-window entropy of candidate strings.

Patterns are matched leftmost and non-overlapping; what lies between the matches gives their offsets. Candidates
are runs of `[A-Za-z0-9+/_=-]` of 20 or more characters with a digit. Each has a class: hex; one_case, letters of one
case and digits; mixed, with letters of both cases; or marked, all others (at most one case, with any of `+/_=-`). A window of 20 characters slides over it; the counts of its
characters are kept up to date as one enters and one leaves, and so is the sum of n*log2(n) over them (in
integers, so that results don't hang on rounding). Windows whose Shannon entropy reaches the class's bound make a
span, from the first such window to the last, less what the patterns' spans cover: each piece that is left is a span.
A candidate with a text of the allow-list, or a UUID, is no finding.

Defined results: null text is empty and has no spans; offsets are in code points, ends exclusive; null or repeated
doc_ids are rows like others; an empty table gives no rows; other columns are ignored by find_secrets() and returned as
they are by without_secrets(), whatever their names. Each row is judged by itself, its text whole. The offsets of a text with m matches take m*m/2 array copies: fit for thousands in a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.columns import unused

# The kinds, in order, and their patterns.
KINDS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f]{16,}+",
}
ASSIGN_LEAST = 12
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
#: Bits that a window's entropy must reach, by class.
BOUNDS = {"hex": 3.0, "one_case": 3.65, "mixed": 3.9, "marked": 3.75}
ALLOW = ("example", "changeme", "placeholder", "dummy", "sample", "redacted", "0123456789", "abcdefghij", "xxxx")
_UNIT = 1 << 20
_N_LOG_N = [round(n * math.log2(n) * _UNIT) if n else 0 for n in range(WINDOW + 1)]
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def _spans(text: Column, pattern: str, kind: int, keep: Column | None) -> Column:
    """Spans of the pattern's matches; keep: a column of booleans, one for each match."""
    match, gap = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kept = keep if keep is not None else F.transform(match, lambda m: F.lit(True))
    parts = F.zip_with(F.zip_with(match, gap, lambda m, g: F.struct(F.length(m).alias("size"), F.length(g).alias("gap"))), kept, lambda p, k: F.struct(p["size"].alias("size"), p["gap"].alias("gap"), k.alias("kept")))
    parts = F.filter(parts, lambda p: p["size"].isNotNull())

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        own = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + p["size"]).alias("end")))
        return F.struct((start + p["size"]).alias("at"), F.when(p["kept"], F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), _none().alias("out")), step, lambda a: a["out"])


def base_spans(text: Column) -> Column:
    """Of every pattern's matches; a text without one is passed over after one search a pattern."""
    long = F.transform(F.regexp_extract_all(text, F.lit(KINDS["assign"]), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST)
    out = [F.when(text.rlike(p), _spans(text, p, i, long if k == "assign" else None)).otherwise(_none()) for i, (k, p) in enumerate(KINDS.items())]
    return F.concat(*out)


def entropy_range(candidate: Column, bound: Column) -> Column:
    """struct<first, last>: the first and the last window's start whose scaled sum of n*log2(n) is at most `bound`; null if none."""
    table = F.array(*[F.lit(x).cast("long") for x in _N_LOG_N])
    codes = F.transform(F.filter(F.split(candidate, "", -1), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    begin = F.struct(F.transform(F.sequence(F.lit(0), F.lit(len(ALPHABET))), lambda _: F.lit(0)).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def f(n: Column) -> Column:
        return F.get(table, n)

    def run(all_codes: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            go = F.when(p["i"] >= WINDOW, F.get(all_codes, p["i"] - WINDOW)).otherwise(F.lit(0))
            less = F.when((go > 0) & (go != p["come"]), f(F.get(acc["n"], go) - 1) - f(F.get(acc["n"], go))).otherwise(F.lit(0))
            more = F.when(go != p["come"], f(F.get(acc["n"], p["come"]) + 1) - f(F.get(acc["n"], p["come"]))).otherwise(F.lit(0))
            n = F.when(go == p["come"], acc["n"]).otherwise(F.transform(acc["n"], lambda v, k: v + F.when(k == p["come"], 1).when((k == go) & (go > 0), -1).otherwise(0)))
            total = acc["sum"] + less + more
            start = p["i"] - WINDOW + 1
            hit = (start >= 0) & (total <= bound)
            return F.struct(n.alias("n"), total.alias("sum"), F.when(hit & acc["first"].isNull(), start).otherwise(acc["first"]).alias("first"), F.when(hit, start).otherwise(acc["last"]).alias("last"))

        return F.aggregate(F.transform(all_codes, lambda c, i: F.struct(c.alias("come"), i.alias("i"))), begin, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return F.element_at(F.transform(F.array(codes), run), 1)


def _less(span: Column, found: Column) -> Column:
    """The pieces of the span that none of the sorted spans `found` covers."""

    def piece(start: Column, end: Column) -> Column:
        own = F.array(F.struct(start.alias("start"), F.lit(len(KINDS)).alias("kind"), end.alias("end")))
        return F.when(start < end, own).otherwise(_none())

    def step(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], b["start"])).alias("out"))

    met = F.filter(found, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    begin = F.struct(span["start"].alias("at"), _none().alias("out"))
    return F.aggregate(met, begin, step, lambda a: F.concat(a["out"], piece(a["at"], span["end"])))


def entropy_spans(text: Column, found: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of the candidates' high-entropy stretches, less the spans `found`, which come sorted."""
    bounds = {k: round((math.log2(WINDOW) - b) * WINDOW * _UNIT) for k, b in BOUNDS.items()}
    bound = lambda c: (
        F.when(c.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$"), F.lit(bounds["hex"]))
        .when(c.rlike("^(?:[0-9a-z]++|[0-9A-Z]++)$"), F.lit(bounds["one_case"]))
        .when(c.rlike("[a-z]") & c.rlike("[A-Z]"), F.lit(bounds["mixed"]))
        .otherwise(F.lit(bounds["marked"]))
    )
    listed = "(?i)" + "|".join(allow) + "|^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    match, gap = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    parts = F.filter(F.zip_with(match, gap, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"))), lambda p: p["m"].isNotNull())

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        seen = F.when(p["m"].rlike(listed), F.lit(None)).otherwise(entropy_range(p["m"], bound(p["m"])))
        own = F.transform(F.filter(F.array(seen), lambda s: s["first"].isNotNull()), lambda s: F.struct((start + s["first"]).alias("start"), F.lit(len(KINDS)).alias("kind"), (start + s["last"] + WINDOW).alias("end")))
        return F.struct((start + F.length(p["m"])).alias("at"), F.concat(acc["out"], own).alias("out"))

    new = F.aggregate(parts, F.struct(F.lit(0).alias("at"), _none().alias("out")), step, lambda a: a["out"])
    apart = F.flatten(F.transform(new, lambda s: _less(s, found)))
    return F.when(text.rlike(CANDIDATE), apart).otherwise(_none())


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs' columns doc_id and text with base and spans: array<struct<start, kind, end>>, sorted; kind counts KINDS, then entropy."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", F.array_sort(base_spans(F.col("text"))))
    return rows.withColumn("spans", F.array_sort(F.concat("base", entropy_spans(F.col("text"), F.col("base"), allow))))


def without_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW, mark: str = "[secret]") -> DataFrame:
    """docs, all columns, with every span of the texts replaced by the mark (and n_chars, if there is one)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base, spans = unused(docs.columns, "base_spans", "all_spans")
    rows = docs.withColumn(base, F.array_sort(base_spans(text)))
    rows = rows.withColumn(spans, F.array_sort(F.concat(base, entropy_spans(text, F.col(base), allow))))
    rows = rows.withColumn("text", redacted(F.col("text"), F.col(spans), mark))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        rows = rows.withColumn("n_chars", F.when(F.size(spans) > 0, changed).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "entropy")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch of overlapping spans replaced by the mark."""

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        own = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, own).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
