"""Quality rules: line sequence labelling with a linear-chain conditional random field.

Each line with a word gets a few 0/1 features. A two-label chain (content, boilerplate) trained here scores whole
line sequences; Viterbi decoding labels every line, and the share of characters in content lines decides whether a
document stays. A handful of plain word rules stands before it.

The labels are of documents; weak labels of their lines, which change inside documents, are made from them first
(``line_labels``), and the chain's transitions are learned from those changes.

Defined cases: a null or empty text has no words and fails the base rule; lines without a word are not labelled; a
text without labelled lines has share 0; repeated rows are judged each for itself; rows with a null id are judged like
any other; other columns, whatever their names, pass through ``keep_good`` untouched. Without labels the chain falls
back to ``DEFAULT_MODEL``, so that an empty label table still gives a verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_column, table, texts_of

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
CONTENT, BOILERPLATE = 0, 1
#: Names of the features of a line, in the order of the weights.
FEATURES = (
    "always", "under_4_words", "under_10_words", "ends_a_sentence", "some_symbols", "many_symbols", "upper_case",
    "cells", "exclaims", "few_distinct_words", "seen_before", "digits", "address",
)
#: (emission weights by feature and label, transition weights): used where no labelled line exists.
DEFAULT_MODEL = (
    [[1.0, 0.0], [-0.3, 0.3], [0.0, 0.0], [0.7, -0.7], [-0.3, 0.3], [-1.5, 1.5], [-1.5, 1.5],
     [-1.5, 1.5], [-1.0, 1.0], [-1.5, 1.5], [-0.5, 0.5], [-0.5, 0.5], [-0.5, 0.5]],
    [[0.5, -0.5], [-0.5, 0.5]],
)
#: Documents that the chain is fitted on, at most (half of each label).
TRAINING_DOCUMENTS = 2_000
MIN_CONTENT_SHARE = 0.4


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[int, ...]:
    n, chars = len(words), sum(map(len, words))
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    upper = len(line) - len(line.translate(None, UPPER))
    lower = len(line) - len(line.translate(None, LOWER))
    digits = len(line) - len(line.translate(None, DIGITS))
    return (
        1, n < 4, n < 10, words[-1][-1:] in (b".", b"?", b":", b'"'), symbols > 0, 12 * symbols > chars,
        upper > lower, line.count(b"|") >= 2, 8 * line.count(b"!") > n, n >= 4 and 2 * len(set(words)) < n, seen,
        5 * digits > chars, b"http" in line or b"www." in line,
    )


def lines_of(text: bytes) -> tuple[list[tuple[int, ...]], list[int], int]:
    """Features and length of every line that has a word, and how many of them equal an earlier line."""
    rows, sizes, seen, repeated = [], [], set(), 0
    for line in text.split(b"\n"):
        if words := line.split():
            again = line in seen
            repeated += again
            seen.add(line)
            rows.append(line_features(line, words, again))
            sizes.append(len(line))
    return rows, sizes, repeated


def viterbi(emit: np.ndarray, move: list[list[float]]) -> list[int]:
    """Best label sequence of a two-label chain; the content label wins ties."""
    (cc, cb), (bc, bb) = move
    e = emit.tolist()
    c, b = e[0]
    back = []
    for x, y in e[1:]:
        to_c, to_b = b + bc > c + cc, b + bb > c + cb
        back.append((to_c, to_b))
        c, b = x + (b + bc if to_c else c + cc), y + (b + bb if to_b else c + cb)
    label = int(b > c)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]


def line_labels(sequences: list[np.ndarray], bad: np.ndarray, rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> list[np.ndarray]:
    """Weak labels of single lines, so that the chain sees labels change inside documents.

    A logistic model of single lines is fitted with each document's label on all of its lines, both labels and all
    documents counting alike. Then a line keeps its document's label unless that model contradicts: lines of bad
    documents that look like content are content, and lines of good ones that clearly don't are boilerplate.
    """
    sizes = np.array([len(s) for s in sequences])
    x, y = np.concatenate(sequences).astype(float), np.repeat(bad, sizes).astype(float)
    share = np.where(bad, bad.mean(), 1 - bad.mean())
    weight = np.repeat(0.5 / share / sizes, sizes) / len(sizes)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += rate * (x.T @ ((y - p) * weight) * 4 - decay * w)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    label = np.where(np.repeat(bad, sizes), p >= 0.5, p >= 0.8)
    return np.split(np.where(label, BOILERPLATE, CONTENT), np.cumsum(sizes)[:-1])


def fit_chain(sequences: list[np.ndarray], labels: list[np.ndarray], bad: np.ndarray, rounds: int = 60, rate: float = 0.5, decay: float = 1e-3):
    """Weights of the chain by gradient ascent on the conditional log-likelihood of labelled lines.

    Expected feature and transition counts come from the forward-backward recursion, run over all sequences at once,
    one line index at a time. Good and ``bad`` documents count alike, and so do long and short ones.
    """
    f = len(FEATURES)
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    sequences, bad = [sequences[i] for i in order], np.asarray(bad)[order]
    sizes = np.array([len(s) for s in sequences])
    steps = int(sizes[0])
    active = [int((sizes > t).sum()) for t in range(steps)]
    at = [np.stack([s[t] for s in sequences[: active[t]]]).astype(float) for t in range(steps)]
    true = [np.array([labels[i][t] for i in order[: active[t]]]) for t in range(steps)]
    weight = 0.5 / np.where(bad, bad.mean(), 1 - bad.mean()) / sizes
    w, m = np.zeros((f, 2)), np.zeros((2, 2))
    for _ in range(rounds):
        scores = [x @ w for x in at]
        alpha = [scores[0]]
        for t in range(1, steps):
            prior = alpha[-1][: active[t], :, None] + m
            alpha.append(np.logaddexp(prior[:, 0], prior[:, 1]) + scores[t])
        gw, gm = -decay * w, -decay * m
        beta = np.zeros((active[-1], 2))
        for t in range(steps - 1, -1, -1):
            if t < steps - 1:
                ahead = scores[t + 1] + beta
                pair = alpha[t][: active[t + 1], :, None] + m + ahead[:, None, :]
                z = np.logaddexp.reduce(pair.reshape(len(pair), -1), axis=1)
                p = np.exp(pair - z[:, None, None])
                same = np.zeros_like(p)
                same[np.arange(len(p)), true[t][: len(p)], true[t + 1]] = 1
                gm = gm + ((same - p) * weight[: len(p), None, None]).sum(0) / len(sizes)
                part = m[None] + ahead[:, None, :]
                beta = np.zeros((active[t], 2))
                beta[: len(part)] = np.logaddexp(part[:, :, 0], part[:, :, 1])
            p = alpha[t] + beta
            p = np.exp(p - np.logaddexp(p[:, :1], p[:, 1:]))
            y = np.zeros_like(p)
            y[np.arange(len(p)), true[t]] = 1
            gw = gw + at[t].T @ ((y - p) * weight[: len(p), None]) / len(sizes)
        w, m = w + rate * gw, m + rate * gm
    return w.tolist(), m.tolist()


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, documents: int = TRAINING_DOCUMENTS):
    """Fit the chain on the lines of at most ``documents`` labelled texts (bounded sample, both labels alike).

    Takes rows whose id's crc32 modulo 5 is not 0, in the order of a hash of the id, and one row of each id; only 0/1
    line features, no texts, reach the driver.
    """
    pool = labels.where(F.col("quality").isNotNull() & (fold_column(F.col("doc_id"), 5) != 0)).select("doc_id", "quality")
    key = F.xxhash64("doc_id")
    good = pool.where("quality = 1").orderBy(key, "doc_id").limit(documents // 2)
    bad = pool.where("quality <> 1").orderBy(key, "doc_id").limit(documents // 2)
    chosen = good.unionByName(bad).groupBy("doc_id").agg(F.max("quality").alias("quality"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [bytes(v for r in lines_of(t or b"")[0] for v in r) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "quality", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `documents` ids
        .select("doc_id", "quality", "text").mapInArrow(features, f"doc_id {kind}, quality int, f binary").where(F.octet_length("f") > 0)
        .groupBy("doc_id").agg(F.min(F.struct("quality", "f")).alias("r")).select("r.*").collect()
    )
    found = sorted((r["quality"], bytes(r["f"])) for r in found)
    bad = np.array([q != 1 for q, _ in found])
    if not len(bad) or bad.all() or not bad.any():
        return DEFAULT_MODEL
    sequences = [np.frombuffer(f, np.uint8).reshape(-1, len(FEATURES)) for _, f in found]
    return fit_chain(sequences, line_labels(sequences, bad), bad)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice, first occurrences included."""
    n = len(words)
    if n < 3:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    k = len(ids)
    if k == n:
        return 0
    pair = x[:-1] * k + x[1:]
    _, pair = np.unique(pair, return_inverse=True)
    _, back, count = np.unique(pair[:-1] * k + x[2:], return_inverse=True, return_counts=True)
    twice = count[back] > 1
    hit = np.zeros(n, bool)
    for j in range(3):
        hit[j : j + len(twice)] |= twice
    return int(hit.sum())


def judge(text: bytes, model, min_share: float = MIN_CONTENT_SHARE) -> tuple[int, int, int, int, int, bool, float, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content share, kept."""
    words = text.split()
    joined = b"".join(words)
    points = len(joined) - _continuations(joined)
    rows, sizes, repeated = lines_of(text)
    again = repeated_words(words)
    failed = len(words) < 50 or 100 * again > 50 * len(words)
    share = 0.0
    if rows:
        path = viterbi(np.array(rows, np.float64) @ np.array(model[0]), model[1])
        share = sum(s for s, y in zip(sizes, path, strict=True) if y == CONTENT) / sum(sizes)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), points, symbols, repeated, again, failed, share, not failed and share >= min_share


_CONTINUATION = bytes(range(0x80, 0xC0))


def _continuations(data: bytes) -> int:
    return 0 if data.isascii() else len(data) - len(data.translate(None, _CONTINUATION))


VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "content_share double, kept boolean"
)
_KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]


def verdicts(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """One row per document: its id and the verdict columns. One pass, no shuffle."""
    names = [x.split()[0] for x in VERDICT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t or b"", model, min_share) for t in texts_of(batch.column(1))]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {VERDICT}")


def keep_good(docs: DataFrame, model, text_col: str = "text", min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The documents that pass, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge(t or b"", model, min_share)[-1] for t in texts_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verdicts(docs, train(spark, docs, table(spark, sf_dir, "labels"))).drop("content_share")


QUERIES = {"op7_quality_rules": op7_quality_rules}
