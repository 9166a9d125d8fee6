"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``WIDTH - 1``, so that every byte
window of the whole text is seen once. ``FILTERS`` learned filters of ``WIDTH`` bytes run over each chunk; a ReLU and a
maximum over the chunk give its features; the mean and the maximum over all chunks, joined, go through a learned
logistic layer to one probability. Only bytes enter; ids, labels, languages and sources do not.

Training takes at most ``TRAINING_DOCUMENTS`` labelled documents (a documented bound; both labels alike, in the order
of a hash of the id, with a crc32 modulo 5 that is not 0). The gradient of a maximum goes to the winning window only.

Defined cases: null and empty texts have one chunk of padding and get the score of an empty document; texts shorter
than a filter are padded; repeated rows score alike; rows with a null id are scored; without both labels every score
is the share of label 1 (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_column, table, texts_of

WIDTH, FILTERS, CHUNK = 6, 16, 512
TRAINING_DOCUMENTS, EPOCHS, BATCH, RATE = 3_000, 6, 64, 0.02
CUT = 0.3


class Network:
    """Filters ``w[place, byte, filter]`` with ``bias``, and the logistic layer ``v`` over mean and maximum, ``v0``."""

    def __init__(self, w: np.ndarray, bias: np.ndarray, v: np.ndarray, v0: float):
        self.w, self.bias, self.v, self.v0 = w, bias, v, v0

    @classmethod
    def start(cls, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        w = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        return cls(w, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)

    def pairs(self) -> list[np.ndarray]:
        """Filters for pairs of bytes: the same sums in half the look-ups."""
        return [(self.w[j][:, None] + self.w[j + 1][None]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]


def chunks(text: bytes) -> np.ndarray:
    """Chunks of a text as rows of CHUNK + WIDTH - 1 bytes; the last is filled with zeros."""
    step, size = CHUNK, CHUNK + WIDTH - 1
    n = max(1, -(-(len(text) - WIDTH + 1) // step))
    padded = np.zeros((n - 1) * step + size, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::step]


def responses(pairs: list[np.ndarray], bias: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of each filter over each chunk, and where it is."""
    two = rows[:, :-1].astype(np.int32) << 8 | rows[:, 1:]
    out = pairs[0][two[:, :CHUNK]]
    for j, p in enumerate(pairs[1:], 1):
        out += p[two[:, 2 * j : 2 * j + CHUNK]]
    at = out.argmax(axis=1)
    return np.maximum(np.take_along_axis(out, at[:, None], axis=1)[:, 0] + bias, 0), at


def features(net: Network, pairs: list[np.ndarray], texts: list[bytes], block: int = 512) -> np.ndarray:
    """Mean and maximum over the chunks of each text, a bounded number of chunks at a time."""
    total, most, count = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS)), np.zeros(len(texts))
    owner, held, n = [], [], 0

    def fold() -> None:
        top, _ = responses(pairs, net.bias, np.concatenate(held))
        who = np.concatenate(owner)
        np.add.at(total, who, top)
        np.maximum.at(most, who, top)

    for i, text in enumerate(texts):
        rows = chunks(text)
        count[i] = len(rows)
        for s in range(0, len(rows), block):
            part = rows[s : s + block]
            held.append(part)
            owner.append(np.full(len(part), i))
            n += len(part)
            if n >= block:
                fold()
                owner, held, n = [], [], 0
    if held:
        fold()
    return np.concatenate([total / count[:, None], most], axis=1)


def predict(net: Network, pairs: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(net, pairs, texts) @ net.v + net.v0, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Adam on the cross-entropy, both labels weighted alike."""
    net, rng = Network.start(seed), np.random.default_rng(seed)
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    shapes = [net.w, net.bias, net.v]
    first, second, step = [np.zeros_like(s) for s in shapes], [np.zeros_like(s) for s in shapes], 0
    cut = [chunks(t) for t in texts]
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            batch = order[s : s + BATCH]
            rows = np.concatenate([cut[i] for i in batch])
            sizes = np.array([len(cut[i]) for i in batch])
            starts = np.cumsum(sizes) - sizes
            parts = [responses(net.pairs(), net.bias, rows[k : k + 1024]) for k in range(0, len(rows), 1024)]
            top, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            mean, most = np.add.reduceat(top, starts) / sizes[:, None], np.maximum.reduceat(top, starts)
            x = np.concatenate([mean, most], axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ net.v + net.v0, -30, 30)))
            d = (p - labels[batch]) * weight[batch] / len(batch)
            gv, g0 = x.T @ d + 1e-4 * net.v, d.sum()
            dx = d[:, None] * net.v
            owner = np.repeat(np.arange(len(batch)), sizes)
            dtop = dx[owner, :FILTERS] / sizes[owner, None] + dx[owner, FILTERS:] * (top == most[owner])
            dtop = (dtop * (top > 0)).astype(np.float32)
            gw = np.zeros_like(net.w)
            r, f = np.nonzero(dtop)
            for j in range(WIDTH):
                np.add.at(gw, (j, rows[r, at[r, f] + j], f), dtop[r, f])
            step += 1
            for value, g, m, q in zip(shapes, (gw, dtop.sum(0), gv.astype(np.float32)), first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                q *= 0.99
                q += 0.01 * g * g
                value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-6)
            net.v0 -= RATE * 20 * g0
    # Scores as shares of the labels seen, not of evenly weighted ones.
    net.v0 += float(np.log(share / (1 - share)))
    return net


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAINING_DOCUMENTS) -> Network:
    """Fit on at most ``documents`` labelled documents; the bounded sample is fitted on the driver."""
    pool = labels.where(F.col("quality").isNotNull() & (fold_column(F.col("doc_id"), 5) != 0)).select("doc_id", "quality")
    key = F.xxhash64("doc_id")
    parts = [pool.where(c).orderBy(key, "doc_id").limit(documents // 2) for c in ("quality = 1", "quality <> 1")]
    chosen = parts[0].unionByName(parts[1]).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `documents` ids
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "text")).alias("r")).select("doc_id", "r.*").collect()  # one row each
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    y = np.array([float(r["quality"] == 1) for r in rows])
    if len(set(y)) < 2:
        net = Network.start()
        net.v[:], net.v0 = 0, 30.0 * (2 * y.mean() - 1) if len(y) else 0.0
        return net
    return fit([(r["text"] or "").encode("utf-8", "surrogatepass") for r in rows], y)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` per row. One pass, no shuffle; the network (about 100 kB) goes to every executor."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value.pairs()
        for batch in batches:
            texts = [t or b"" for t in texts_of(batch.column(1))]
            p = predict(shared.value, pairs, texts) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = fold_column(F.col("doc_id"), 5) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
