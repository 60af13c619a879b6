"""Quality rules: a linear-chain conditional random field labels each line as content or boilerplate.

The field has two labels, weights over the features of a line, and weights for the change of labels. It is
fitted here, on at most `most` labelled documents (a documented bound; the smallest hashes of doc_id are
taken), from document labels: lines of good documents are content; lines of bad ones are boilerplate, unless
a first fit takes them for content. Viterbi decoding then finds the best label sequence of each
document, and the share of words in content lines decides whether it stays. Base rules go first.

Fitting reads the texts of at most 2 * `most` rows, for rows may share a labelled doc_id, one partition of them at a time on the driver; what it
keeps is 12 numbers a line.

Defined results: a null or empty text has no words and fails the base rules; a document's lines are taken
whole, however many; if labels are missing, or only of one kind, every line is content; a null doc_id
is judged like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import LOWER, UPPER, plain, small_batches, steps, words

MOST_LABELLED, CONTENT_SHARE = 1500, 0.5
SYMBOLS, BLANK, DIGITS = b"#*$%&|<>", b" \t\n\x0b\x0c\r", b"0123456789"
#: Lines of a chain in training; longer documents are several chains there (not in decoding).
CHAIN = 64
N_FEATURES = 12


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(a row of features for each line, its number of words, lines with a word that repeat an earlier one)."""
    out, counts, seen, repeated = np.zeros((len(lines), N_FEATURES)), np.zeros(len(lines), np.int64), set(), 0
    for i, line in enumerate(lines):
        parts = line.split()
        n = counts[i] = len(parts)
        row = out[i]
        row[0] = 1
        if not n:
            row[1] = 1
            continue
        again = line in seen
        repeated += again
        seen.add(line)
        size, lower, upper = len(line), len(line) - len(line.translate(None, LOWER)), len(line) - len(line.translate(None, UPPER))
        row[2:] = (
            again,
            (size - len(line.translate(None, SYMBOLS))) / n,
            upper / (upper + lower + 1),
            line.count(b"!") / n,
            line.count(b"|") / n,
            (size - len(line.translate(None, DIGITS))) / size,
            1 - len(set(parts)) / n,
            min(size / n, 30) / 10,
            parts[-1][-1:] in (b".", b"!", b"?"),
            np.log1p(n) / 5,
        )
    np.minimum(out, 3, out=out)
    return out, counts, repeated


@dataclass
class LineField:
    """Scores of a chain: features of a line for content (boilerplate scores 0), and the changes of label (0: boilerplate)."""

    weights: np.ndarray
    changes: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: true where the best label sequence says content; ties go to content."""
        scores, ((bb, bc), (cb, cc)) = (features @ self.weights).tolist(), self.changes.tolist()
        b, c, came = 0.0, scores[0], []
        for s in scores[1:]:
            from_c_to_b, from_c_to_c = c + cb >= b + bb, c + cc >= b + bc
            came.append((from_c_to_b, from_c_to_c))
            b, c = (c + cb if from_c_to_b else b + bb), (c + cc if from_c_to_c else b + bc) + s
        label, out = c >= b, [c >= b]
        for pair in reversed(came):
            label = pair[label]
            out.append(label)
        return np.array(out[::-1], bool)


def _gradient(x: np.ndarray, y: np.ndarray, real: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of label chains y (chains x lines) by the forward-backward sums."""
    n, length = y.shape
    emit = np.stack([np.zeros((n, length)), x @ w], axis=2)
    ahead, back = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    ahead[:, 0] = emit[:, 0]
    for k in range(1, length):
        step = np.logaddexp(ahead[:, k - 1, :1] + t[0], ahead[:, k - 1, 1:] + t[1]) + emit[:, k]
        ahead[:, k] = np.where(real[:, k, None], step, ahead[:, k - 1])
    for k in range(length - 2, -1, -1):
        after = emit[:, k + 1] + back[:, k + 1]
        step = np.logaddexp(after[:, :1] + t[:, 0], after[:, 1:] + t[:, 1])
        back[:, k] = np.where(real[:, k + 1, None], step, 0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    content = np.exp(ahead[:, :, 1] + back[:, :, 1] - total[:, None]) * real
    both = real[:, 1:, None, None] * np.exp(ahead[:, :-1, :, None] + t + (emit + back)[:, 1:, None, :] - total[:, None, None, None])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
    return np.einsum("nl,nlf->f", (y - content) * real, x), seen - both.sum((0, 1))


def fit(chains: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, ridge: float = 1.0) -> LineField:
    """Adam on the penalised log-likelihood; chains of unequal length are padded and masked."""
    length = max(map(len, chains))
    x, y, real = np.zeros((len(chains), length, N_FEATURES)), np.zeros((len(chains), length), int), np.zeros((len(chains), length), bool)
    for i, (c, own) in enumerate(zip(chains, labels)):
        x[i, : len(c)], y[i, : len(c)], real[i, : len(c)] = c, own, True
    p, m, v = np.zeros(N_FEATURES + 4), 0.0, 0.0
    for k in range(1, rounds + 1):
        gw, gt = _gradient(x, y, real, p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2))
        g = np.concatenate([gw, gt.ravel()]) - ridge * p
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return LineField(p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2))


def everything() -> LineField:
    """The field that takes every line for content."""
    return LineField(np.zeros(N_FEATURES), np.zeros((2, 2)))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> LineField:
    """A field from `most` labelled documents at most; labels: doc_id, quality (1 good, 0 bad; others are left out)."""
    named = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("_quality"))
    named = named.orderBy(F.xxhash64("doc_id"), "_quality").limit(most)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(named), "doc_id")
    chains, kinds = [], []
    for row in rows.select("text", "_quality").orderBy(F.xxhash64("doc_id"), "text").limit(2 * most).toLocalIterator():
        lines = (row["text"] or "").encode().split(b"\n")
        f = line_features(lines)[0]
        chains += [f[k : k + CHAIN] for k in range(0, len(f), CHAIN)]
        kinds += [row["_quality"]] * len(range(0, len(f), CHAIN))
    if len(set(kinds)) < 2:
        return everything()
    known = [np.full(len(c), k) for c, k in zip(chains, kinds)]
    first = fit(chains, known)
    again = [own if k else first.decode(c).astype(int) for c, own, k in zip(chains, known, kinds)]
    return fit(chains, again)


def repeat_words(codes: np.ndarray, ends: np.ndarray, kinds: int) -> np.ndarray:
    """Of each text, the words that stand in 3-word windows found twice or more in it."""
    n = len(codes) - 2
    if n <= 0:
        return np.zeros(len(ends) - 1, np.int64)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    pair = codes[:-1] * kinds + codes[1:]
    if kinds > 2_000_000:  # else three codes make one 64-bit number as they are
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * kinds + codes[2:]
    at = np.flatnonzero(doc[:-2] == doc[2:])
    order = at[np.lexsort((window[at], doc[at]))]
    same = (window[order[1:]] == window[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    often = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, often, 1)
    np.add.at(change, often + 3, -1)
    return np.diff(np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])[ends])


def judge(batch: pa.RecordBatch, field: LineField, least: float) -> dict[str, list]:
    """The columns of quality_rules() but doc_id, of one batch."""
    codes, ends, distinct = words(plain(batch.column("text")))
    repeats = repeat_words(codes, ends, len(distinct)).tolist()
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "lines")}
    for text, n, again in zip(batch.column("text").to_pylist(), np.diff(ends).tolist(), repeats):
        data = (text or "").encode()
        features, counts, repeated = line_features(data.split(b"\n"))
        content = field.decode(features)
        share = float(counts[content].sum() / n) if n else 0.0
        failed = n < 50 or 100 * again > 50 * n
        row = (n, len(text or "") - len(data) + len(data.translate(None, BLANK)), len(data) - len(data.translate(None, SYMBOLS)), repeated, again, failed, not failed and share >= least, share, content.tolist())
        for k, v in zip(out, row):
            out[k].append(v)
    return out


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, lines array<boolean>"


def quality_rules(docs: DataFrame, field: LineField, least: float = CONTENT_SHARE) -> DataFrame:
    """Counts, base rules and verdict of each row; lines: true for content, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **judge(batch, field, least)})

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def good_documents(docs: DataFrame, field: LineField, least: float = CONTENT_SHARE) -> DataFrame:
    """The rows of docs, with all their columns, whose text is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            yield batch.filter(pa.array(judge(batch, field, least)["kept"], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
