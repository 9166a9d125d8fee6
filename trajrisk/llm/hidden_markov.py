"""Language-model scores from a hidden Markov model over words.

Training texts are read once and stored as chunks of about ``CHUNK_BYTES``: the distinct words of a chunk and its texts
as numbers of these. Every Baum-Welch round runs forward-backward over all training texts of all chunks; expected counts
are summed within tasks and then across partitions.

* The first ``ROUNDS`` rounds, from seeded random emissions, tell the states apart. In them a state emits hash classes
  of words (``CLASSES`` and one for the end of a text), so that the model that is sent out has a fixed size.
* The last round gathers expected counts by word and state. Chunks send their distinct words, with counts in all and by
  state, in packed pieces to buckets of the vocabulary, which sum them and send them back to the chunks that asked. A
  token's state shares are the same in any group of texts and are counted in whole steps of 1/255, so that sums don't
  depend on how texts are put into chunks.
  A word crosses the shuffle once a chunk, however often it occurs; the number of buckets follows the input.

The scaled forward recursion over the word emissions then gives the exact likelihood of each text. State s emits word w
with (E(w, s) + L(s) * B(k, s) / (V(k) + 1)) / (E(s) + L(s)): E are the expected counts of the last round, E(w, s) in
proportion to the word's summed steps, B(k, s) is the emission of the word's class k, V(k) the distinct training words
of the class, the one more is for words never seen, and L(s) spreads V + 1 counts over the states by their use.

Defined cases: null and empty texts are the end token alone; repeated rows count and are scored each; a row with a
null id is dealt by the crc32 of the empty text; without training texts the model is that of the start and N is 0; words
are never cut; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fold_column, materialize, pack as _pack, table, unpack as _unpack

STATES, CLASSES = 8, 8192
ROUNDS = 5
#: Text bytes of a chunk, beyond which the next one begins, and of the input for each bucket of the vocabulary.
CHUNK_BYTES, BUCKET_BYTES = 16 << 20, 32 << 20
#: Tokens in a group of texts that go through the recursion side by side.
GROUP_TOKENS = 800_000
#: Tokens in a block of times that are worked on at once where no recursion is needed, so that they stay in the cache.
BLOCK_TOKENS = 16_384
#: Rows of a product of states, a multiple of the blocks of the common libraries (2, 4, 8, 12 and 16).
ROWS = 48
#: Steps in which the state shares of a token are counted.
SHARES = 255


@dataclass
class Model:
    start: np.ndarray  # by state
    move: np.ndarray  # from state, to state
    emit: np.ndarray  # class, state

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """From expected counts; every state keeps a little of the overall distribution."""
        overall = emit.sum(1, keepdims=True) + 0.01
        emit = emit + overall / overall.sum() * 20
        return cls((start + 0.1) / (start + 0.1).sum(), _rows(move + 0.1), emit / emit.sum(0))

    @classmethod
    def first(cls, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        flat = np.exp(rng.normal(0, 1, (CLASSES + 1, STATES)))
        flat[CLASSES] = flat[:CLASSES].mean()
        return cls(np.full(STATES, 1 / STATES), _rows(np.eye(STATES) * 4 * STATES + 1), flat / flat.sum(0))


def _rows(x: np.ndarray) -> np.ndarray:
    return x / x.sum(1, keepdims=True)


class _Numbers(dict):
    """Numbers words in the order of their first look-up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def _class(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(CLASSES)).astype(np.int32)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Words of each text, all words as numbers in the order of their first place, and the distinct words, with blanks between."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    if not len(coded):
        return sizes, np.zeros(0, np.int32), b""
    codes, words = np.concatenate([c.indices.to_numpy() for c in coded.chunks]), coded.chunk(0).dictionary  # all have the same
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:  # before the first blank of a text, or behind the last
        real = codes != empty
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~real], minlength=len(sizes))
        codes = codes[real]
        codes -= codes > empty
        words = pa.concat_arrays([words[:empty], words[empty + 1 :]])
    words = words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary())  # any bytes
    return sizes, codes, pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(b" ", words.type))[0].as_py()


def _chunks(rows: DataFrame, id_type: str, chunk_bytes: int) -> DataFrame:
    """Texts in chunks: ids, fold and size of each text, its tokens as numbers of the chunk's words, these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            ids, held, texts = zip(*(b.columns for b in parts), strict=True)
            ids, held = pa.concat_arrays(ids), pa.chunked_array(held).fill_null(False).to_numpy()
            sizes, codes, words = _words(pa.chunked_array(texts))
            blobs = (held, sizes, codes, words, _class(hashes(words.split())).astype(np.uint16))
            column = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            made = [pa.array([task << 32 | count], pa.int64()), column, *(pa.array([_pack(b)], pa.binary()) for b in blobs)]
            return pa.RecordBatch.from_arrays(made, ["chunk", "ids", "held", "sizes", "codes", "words", "classes"])

        for batch in batches:
            ends, at = np.cumsum(pc.binary_length(batch.column(2)).fill_null(0).to_numpy(), dtype=np.int64), 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                end = int(np.searchsorted(ends, before + chunk_bytes - size)) + 1  # behind the text that fills the chunk
                parts.append(batch.slice(at, end - at))
                if end > batch.num_rows:
                    size += int(ends[-1]) - before
                    break
                yield row()
                count, parts, size, at = count + 1, [], 0, end
        if parts:
            yield row()

    blobs = ", ".join(f"{n} binary" for n in ("held", "sizes", "codes", "words", "classes"))
    return rows.select("doc_id", "held_out", "text").mapInArrow(run, f"chunk long, ids array<{id_type}>, {blobs}")


def _by_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch one at a time, as each holds a whole chunk."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _sequences(codes: np.ndarray, sizes: np.ndarray, end: int, which: np.ndarray | None = None) -> list[np.ndarray]:
    """The texts' tokens, each with ``end`` behind."""
    stops = np.cumsum(sizes + 1)
    flat = np.empty(len(codes) + len(sizes), np.int32)
    real = np.ones(len(flat), bool)
    real[stops - 1] = False
    flat[real], flat[stops - 1] = codes, end
    numbers = slice(None) if which is None else which
    return [flat[a:b] for a, b in zip((stops - sizes - 1)[numbers].tolist(), stops[numbers].tolist(), strict=True)]


def groups(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Sequences of similar length side by side: their numbers, tokens by time, sequences that reach each time."""
    lengths = np.array([len(x) for x in sequences], np.int64)
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        most = GROUP_TOKENS + (ends[at - 1] if at else 0)
        end = max(at + 1, int(np.searchsorted(ends, most, "right")))
        mine = order[at:end]
        sizes = lengths[mine]
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")
        first = np.cumsum(active) - active  # place of the first sequence's token, by time
        tokens = np.empty(sizes.sum(), np.int32)
        for j, i in enumerate(mine.tolist()):
            tokens[first[: lengths[i]] + j] = sequences[i]
        yield mine, tokens, active.tolist()
        at = end


def _blocks(active: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of time with some ``BLOCK_TOKENS`` tokens: first time, time behind, first token, token behind."""
    first = lo = hi = 0
    for t, n in enumerate(active):
        if hi > lo and hi + n - lo > BLOCK_TOKENS:
            yield first, t, lo, hi
            first, lo = t, hi
        hi += n
    yield first, len(active), lo, hi


class _Product:
    """Buffers for the states of up to ``n`` sequences, ``held``, and their product with ``square``, ``out``.

    Products are of ``ROWS`` rows: a row's sums are then rounded alike whatever rows are beside it, as libraries take
    what is left of their own blocks, and single rows, in another order."""

    def __init__(self, n: int, square: np.ndarray):
        self.square = square
        self.held = np.zeros((-(-n // ROWS) * ROWS, len(square)), square.dtype)
        self.out = np.ones_like(self.held)

    def step(self, n: int) -> Callable[[], np.ndarray]:
        """A function that fills the first ``n`` rows of ``out``."""
        if n <= ROWS:  # np.dot has the same product with less around it, which counts in the long tails of long texts
            return partial(np.dot, self.held[:ROWS], self.square, self.out[:ROWS])
        shape = (-(-n // ROWS), ROWS, len(self.square))
        size = shape[0] * ROWS
        return partial(np.matmul, self.held[:size].reshape(shape), self.square, self.out[:size].reshape(shape))


def forward(model: Model, tokens: np.ndarray, active: list[int], keep: bool) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray | None]:
    """Natural log-likelihoods of the sequences of a group; with ``keep`` scaled alphas and scales by token instead."""
    kind = np.float32 if keep else np.float64
    emit, k = model.emit.astype(kind, copy=False), len(model.start)
    product = _Product(active[0], model.move.astype(kind))
    product.out[:] = model.start
    total = None if keep else np.zeros(active[0])
    alphas, scales = (np.empty((len(tokens), n), kind) if keep else None for n in (k, 1))
    for first, stop, lo, hi in _blocks(active):
        e, at = emit.take(tokens[lo:hi], 0), 0
        scale = scales[lo:hi] if keep else np.empty((hi - lo, 1))
        for n, times in itertools.groupby(active[first:stop]):
            stretch = slice(at, at := at + n * sum(1 for _ in times))
            step, a, ahead = product.step(n), product.held[:n], product.out[:n]
            for mine, c in zip(e[stretch].reshape(-1, n, k), scale[stretch].reshape(-1, n, 1), strict=True):
                np.multiply(mine, ahead, mine)
                np.add.reduce(mine, 1, None, c, True)
                np.divide(mine, c, a)
                step()
        if keep:
            np.divide(e, scale, alphas[lo:hi])
        else:  # one after the other in the order of time, whatever is in a block
            sizes = np.array(active[first:stop])
            np.add.at(total, np.arange(hi - lo) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.log(scale[:, 0]))
    return total, alphas, scales


def expect(model: Model, sequences: list[np.ndarray], steps: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of all sequences (Baum-Welch counts); with ``steps`` the state shares of each
    token in whole steps, so that emissions are integers, and their sums the same in any order; moves are not counted then.

    A token's shares are the same in any group; sums over tokens are in double precision."""
    k, rows = len(model.start), len(model.emit)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, rows))
    e32, back = model.emit.astype(np.float32, copy=False), np.ascontiguousarray(model.move.T.astype(np.float32))
    for _, tokens, active in groups(sequences):
        _, alphas, scales = forward(model, tokens, active, True)
        product, after = _Product(active[0], back), 0
        pairs = np.zeros((k, k))
        for first, stop, lo, hi in reversed(list(_blocks(active))):
            e = e32.take(tokens[lo:hi], 0)
            e /= scales[lo:hi]
            betas, at = np.empty_like(e), hi - lo
            for n, times in itertools.groupby(reversed(active[first:stop])):
                stretch = slice(at - n * sum(1 for _ in times), at)
                at = stretch.start
                step, a, beta = product.step(n), product.held[:n], product.out[:n]
                beta[after:] = 1  # sequences that end here
                after = n
                for mine, b in zip(e[stretch].reshape(-1, n, k)[::-1], betas[stretch].reshape(-1, n, k)[::-1], strict=True):
                    b[:] = beta
                    np.multiply(mine, beta, a)
                    step()
            if not steps and stop > 1:
                e *= betas
                since = max(first, 1)
                at = 0 if first else active[0]
                before = np.arange(lo + at, hi) - np.repeat(active[since - 1 : stop - 1], active[since:stop])
                pairs += alphas.take(before, 0).T.astype(float) @ e[at:].astype(float)
            alphas[lo:hi] *= betas  # of this time on, alphas are the state shares
        start += alphas[: active[0]].sum(0, dtype=float)
        move += pairs * model.move
        if steps:
            alphas *= np.float32(steps)
            np.rint(alphas, out=alphas)
        del scales, product
        many = max(rows, BLOCK_TOKENS)  # as the sums take as long for each time they are added
        for at in range(0, len(tokens), many):
            mine, shares = tokens[at : at + many].astype(np.intp), np.ascontiguousarray(alphas[at : at + many].T, float)
            for s in range(k):
                emit[s] += np.bincount(mine, shares[s], rows)
        del alphas, shares  # before the next group
    return start, move, np.ascontiguousarray(emit.T)


def _expected(chunks: DataFrame, model: Model) -> Model:
    """One Baum-Welch round over all training texts: counts by class from every task, summed by Spark."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    names = ["row", *(f"s{i}" for i in range(STATES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, k = None, STATES
        for batch in batches:
            for row in _by_row(batch):
                sizes, learn = _unpack(row["sizes"], np.int64), ~_unpack(row["held"], bool)
                classes = _unpack(row["classes"], np.uint16).astype(np.int32)
                codes = classes[_unpack(row["codes"], np.int32)]
                part = np.concatenate(expect(shared.value, _sequences(codes, sizes, CLASSES, learn)), axis=None)
                total = part if total is None else total + part
        if total is not None:
            rows = np.concatenate([total[: k + k * k].reshape(-1, k), total[k + k * k :].reshape(-1, k)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), *(pa.array(c) for c in rows.T)], names)

    kinds = ", ".join(["row long", *(f"{n} double" for n in names[1:])])
    columns = chunks.select("held", "sizes", "codes", "classes")
    sums = columns.mapInArrow(run, kinds).groupBy("row").agg(*(F.sum(n).alias(n) for n in names[1:])).collect()
    counts = np.zeros((1 + STATES + CLASSES + 1, STATES))
    for r in sums:  # CLASSES + STATES + 2 rows
        counts[r["row"]] = r[1:]
    return Model.of_counts(counts[0], counts[1 : 1 + STATES], counts[1 + STATES :]) if counts.any() else model


def train(chunks: DataFrame, rounds: int = ROUNDS) -> Model:
    """Baum-Welch by class over all training texts of the chunks."""
    model = Model.first()
    for _ in range(rounds):
        model = _expected(chunks, model)
    return model


def _asked(chunks: DataFrame, model: Model, buckets: int) -> DataFrame:
    """``bucket, chunk, words, n, shares``: the words of a chunk by bucket, their training counts in all and by state."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row in _by_row(batch):
                sizes, learn = _unpack(row["sizes"], np.int64), ~_unpack(row["held"], bool)
                codes, classes = _unpack(row["codes"], np.int32), _unpack(row["classes"], np.uint16)
                n = np.bincount(codes[np.repeat(learn, sizes)], minlength=len(classes)).astype(np.int32)
                local = Model(model.start, model.move, model.emit.astype(np.float32)[np.append(classes, np.uint16(CLASSES))])
                shares = expect(local, _sequences(codes, sizes, len(classes), learn), SHARES)[2]
                del local, codes
                # The end of a text is a word of its own, empty, which every chunk asks for.
                words, n = [*_unpack(row["words"]).split(), b""], np.append(n, np.int32(learn.sum()))
                bucket = _bucket(hashes(words), buckets)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(np.concatenate([[-1], bucket[order], [buckets]])))
                out = []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    i = order[a:b]
                    blobs = (b"\n".join([words[j] for j in i.tolist()]), n[i], shares[i].astype(np.int64))
                    out.append((int(bucket[i[0]]), row["chunk"], *map(_pack, blobs)))
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "words", "n", "shares"])

    columns = chunks.select("chunk", "held", "sizes", "codes", "words", "classes")
    return columns.mapInArrow(run, "bucket int, chunk long, words binary, n binary, shares binary")


ANSWER = "chunk long, bucket int, c binary, shares binary"


def _answered(asked: DataFrame) -> DataFrame:
    """Per bucket and chunk the corpus counts, in all and by state, of the words asked for, in their order.

    A row without a chunk has what a bucket adds to the totals: tokens, words, expected counts by state, words by class.
    """

    def run(group: pa.Table) -> pa.Table:
        numbers = _Numbers()
        pieces, total, mass = [], np.zeros(1024, np.int64), np.zeros((1024, STATES), np.int64)
        for words, n, shares in zip(*(group.column(x).to_pylist() for x in ("words", "n", "shares")), strict=True):
            at = np.fromiter(map(numbers.__getitem__, _unpack(words).split(b"\n")), np.int64)
            while len(numbers) > len(total):
                total, mass = np.concatenate([total, np.zeros_like(total)]), np.concatenate([mass, np.zeros_like(mass)])
            total[at] += _unpack(n, np.int32)  # a chunk's words are distinct
            mass[at] += _unpack(shares, np.int64).reshape(-1, STATES)
            pieces.append(at)
        words = list(numbers)
        total, shares = total[: len(words)], mass[: len(words)]
        known = total > 0
        whole = np.maximum(shares.sum(1, keepdims=True), 1)
        states = (total[:, None] * (shares / whole)).sum(0)
        real = known & np.array([w != b"" for w in words], bool)
        kinds = np.bincount(_class(hashes(words))[real], minlength=CLASSES)
        end = words.index(b"") if b"" in numbers else -1
        sums = np.concatenate([[total.sum(), known.sum(), real.sum()], states, kinds, [total[end] if end >= 0 else 0]]).astype(float)
        answers = [(c, b, _pack(total[at]), _pack(shares[at])) for c, b, at in zip(group.column("chunk").to_pylist(), group.column("bucket").to_pylist(), pieces, strict=True)]
        answers.append((None, answers[0][1], _pack(sums), b""))
        columns = [pa.array(c, t) for c, t in zip(zip(*answers, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
        return pa.Table.from_arrays(columns, ["chunk", "bucket", "c", "shares"])

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


@dataclass
class Totals:
    tokens: int
    words: int
    states: np.ndarray  # expected counts by state, ends of texts included
    kinds: np.ndarray  # distinct training words by class

    @property
    def spread(self) -> np.ndarray:
        """Counts of words never seen, by state."""
        return (self.words + 1) * (self.states / self.tokens if self.tokens else np.full(STATES, 1 / STATES))


def word_emissions(model: Model, totals: Totals, c: np.ndarray, shares: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Emissions of words by state; ``classes`` is ``CLASSES`` for the end of a text."""
    whole = np.maximum(shares.sum(1, dtype=np.int64), 1)
    room = np.append(totals.kinds + 1, 1)[classes]  # the end has its class for itself
    out = np.empty(shares.shape)
    for s, (spread, states) in enumerate(zip(totals.spread, totals.states, strict=True)):
        out[:, s] = (c * (shares[:, s] / whole) + spread * model.emit[classes, s] / room) / (states + spread)
    return out


def score(
    docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Scores of all rows; ``training`` is the condition that picks the rows to learn from.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (~training).alias("held_out"))
    id_type = docs.schema[id_col].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    buckets = -(-size // bucket_bytes) or 1
    chunks = materialize(_chunks(rows, id_type, chunk_bytes), "chunks")
    model = train(chunks)
    answers = materialize(_answered(_asked(chunks, model, buckets)), "answers", free=True)
    sums = [_unpack(bytes(r["c"]), float) for r in answers.where("chunk is null").select("c").toLocalIterator()]  # one a bucket
    sums = np.sum(sums, axis=0) if sums else np.zeros(3 + STATES + CLASSES + 1)
    totals = Totals(int(sums[0]), int(sums[1]), sums[3 : 3 + STATES], sums[3 + STATES : -1])
    shared = docs.sparkSession.sparkContext.broadcast((model, totals))
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        model, totals = shared.value
        kind = texts.schema.field("ids").type.value_type
        return pa.concat_tables([_scored(model, totals, row, kind, found) for b in texts.to_batches() for row in _by_row(b)])  # one row

    def _scored(model: Model, totals: Totals, row: dict, kind: pa.DataType, found: pa.Table) -> pa.Table:
        order = np.argsort(_bucket(hashes([*_unpack(row["words"]).split(), b""]), buckets), kind="stable")
        by = np.argsort(found.column("bucket").to_numpy(), kind="stable").tolist()
        c, shares = np.zeros(len(order), np.int64), np.zeros((len(order), STATES), np.int64)
        at = 0
        for i in by:  # answers are in the order of the words of their bucket
            part = _unpack(found.column("c")[i].as_py(), np.int64)
            mine = order[at : at + len(part)]
            c[mine], shares[mine] = part, _unpack(found.column("shares")[i].as_py(), np.int64).reshape(-1, STATES)
            at += len(part)
        classes = np.append(_unpack(row["classes"], np.uint16), np.uint16(CLASSES))
        sizes, codes, held = _unpack(row["sizes"], np.int64), _unpack(row["codes"], np.int32), _unpack(row["held"], bool)
        local = Model(model.start, model.move, word_emissions(model, totals, c, shares, classes))
        del shares
        sequences = _sequences(codes, sizes, len(order) - 1)
        n, real, plain = sizes + 1, c > 0, np.log10(c + 1.0)
        known = np.array([np.count_nonzero(real[s]) for s in sequences], np.int64)
        base = np.array([plain[s].sum() for s in sequences]) - n * np.log10(totals.tokens + totals.words + 1)
        hidden = np.zeros(len(n))
        for mine, tokens, active in groups(sequences):
            hidden[mine] = forward(local, tokens, active, False)[0]
        return pa.table({
            "doc_id": pa.array(row["ids"], kind), "held_out": held, "n_tokens": n, "n_known": known,
            "train_tokens": np.full(len(n), totals.tokens), "base_score": base, "score": hidden / np.log(10),
        })

    scored = chunks.groupBy("chunk").cogroup(answers.where("chunk is not null").groupBy("chunk")).applyInArrow(run, schema)
    scored = materialize(scored, "scores", free=True)
    discard(chunks)
    discard(answers)
    return scored


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold_column(F.col("doc_id"), 7) != 2)


QUERIES = {"op6_hidden_markov": op6_hidden_markov}
