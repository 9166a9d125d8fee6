"""Packing of documents into sequences of equal length by multiway differencing (Karmarkar and Karp).

Every task tokenises its documents in batches. Whole sequences are cut from the front of long documents; what is left
of each document is cut into a few items. Each item begins as a partition of its own into as many windows as the batch needs, all
but one empty. The two partitions of the largest imbalance are merged again and again, the fullest windows of one onto
the emptiest of the other, until one partition is left, whose windows are nearly equal. Where a window exceeds the
capacity the number of windows rises and differencing begins anew: first by short windows of a power of two of ids, the
sizes that need no padding, cut from the longest items, the larger the more exceeds; then by full windows.

Nothing is shuffled: a batch's windows hold its own documents, and the padding of a batch does not depend on the number
of batches.

Defined cases: a null or empty text is the closing id alone; every row is a document, repeated and null ids included;
texts of any length are cut into several sequences; ids are of any type; an empty table gives no piece; other columns
are ignored. Strings of special tokens in a text are read as the library's defaults do.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .stretches import Encoder, JoinedTokens, gather, split_texts

#: The tokenizer is a parameter; this place of the public vocabulary is only the default.
MODEL = "/opt/tokenizers/byte_bpe_50k.json"
LENGTH = 2048
#: The id that closes a document.
CLOSING = 1
#: Ids that are packed together: beyond, the next batch begins.
BATCH_IDS = 1 << 19
#: Bytes of the texts that are encoded together.
PIECE_BYTES = 4 << 20
#: Parts of a sequence's length: what is left of a document beside whole sequences is cut into items of one such part
#: at most, as few items of a window leave large differences (2 % of padding for whole rests, 0.5 % for quarters).
PARTS = 4
#: Bits of a node's number.
BITS = 32
#: The shortest window that is opened for what exceeds the capacity.
SHORTEST = 64


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each item, and the sums of the ``k`` windows, by largest-difference merging."""
    n = len(sizes)
    if not n or k == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()] * k, np.int64)[:k]
    # A node is an item or two nodes that share a window. Partitions list their non-empty windows, the fullest first, as
    # numbers of the sum and, in the lower bits, the node.
    node = (1 << BITS) - 1
    children: list[tuple[int, int]] = []
    parts = {i: [int(x) << BITS | i] for i, x in enumerate(sizes)}
    heap = [(-int(x), i) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    name = n
    while len(heap) > 1:
        (_, x), (_, y) = heapq.heappop(heap), heapq.heappop(heap)
        a, b = parts.pop(x), parts.pop(y)
        over = len(a) + len(b) - k
        if over > 0:  # the emptiest windows of one take the fullest of as many of the other
            both, first = [], n + len(children)
            for i, (p, q) in enumerate(zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)):
                children.append((p & node, q & node))
                both.append((p >> BITS) + (q >> BITS) << BITS | first + i)
            a = a[: len(a) - over] + b[: len(b) - over] + both
        else:
            a = a + b
        a.sort(reverse=True)
        parts[name] = a
        heapq.heappush(heap, ((a[-1] >> BITS if len(a) == k else 0) - (a[0] >> BITS), name))
        name += 1
    last = parts[heap[0][1]]
    window = np.full(n + len(children), -1, np.int64)
    window[[x & node for x in last]] = np.arange(len(last))
    for i in range(len(children) - 1, -1, -1):
        window[list(children[i])] = window[n + i]
    return window[:n], np.array([x >> BITS for x in last] + [0] * (k - len(last)), np.int64)


def windows(items: list[list[int]], length: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for items ``[document, start, length]`` of less than ``length`` ids.

    Cuts made for short windows shorten the items in place.
    """
    short: list[list[tuple[int, int, int]]] = []
    total = sum(x[2] for x in items)
    longest = [(-x[2], i) for i, x in enumerate(items)]
    heapq.heapify(longest)

    def open_short(size: int) -> None:
        """One more window, of a power of two of ids from the fronts of the longest items."""
        nonlocal total
        window = []
        left = size
        while left:
            n, i = heapq.heappop(longest)
            if -n != items[i][2]:
                continue
            doc, start, have = items[i]
            take = min(left, have)
            window.append((doc, start, take))
            items[i] = [doc, start + take, have - take]
            if have > take:
                heapq.heappush(longest, (take - have, i))
            left -= take
        total -= size
        short.append(window)

    # What full windows cannot take, in steps of the shortest window, goes into short ones.
    rest = -(-(total % length) // SHORTEST) * SHORTEST
    if rest < length and total >= 2 * length:
        for bit in range(length.bit_length() - 1):
            if rest >> bit & 1:
                open_short(1 << bit)
    size, more = SHORTEST, 0
    while True:
        at = [i for i, x in enumerate(items) if x[2]]
        if not at:
            return short
        window, sums = differencing(np.array([items[i][2] for i in at], np.int64), max(1, -(-total // length)) + more)
        over = int(np.maximum(sums - length, 0).sum())
        if not over:
            break
        size = max(size, 1 << (over // 8).bit_length())
        if size < length and total >= 2 * size:
            open_short(size)
            size *= 2
        else:
            more += 1 + over // (4 * length)
    full: list[list[tuple[int, int, int]]] = [[] for _ in sums]
    for i, w in zip(at, window.tolist(), strict=True):
        full[w].append(tuple(items[i]))
    return [w for w in full if w] + short


def pack_batch(sizes: np.ndarray, length: int, parts: int = PARTS) -> list[list[tuple[int, int, int]]]:
    """All sequences of a batch of documents: lists of (document, start, length)."""
    out, items, longest = [], [], -(-length // parts)
    for d, n in enumerate(sizes.tolist()):
        whole = n // length
        out += [[(d, j * length, length)] for j in range(whole)]
        for start in range(whole * length, n, longest):
            items.append([d, start, min(longest, n - start)])
    return out + windows(items, length)


@functools.lru_cache(1)
def encoder_of(model: str) -> Encoder:
    """One encoder for all tasks of a worker, as loading takes time."""
    return Encoder(JoinedTokens(model, specials=True))


def pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that are encoded together: texts of about ``PIECE_BYTES``, at least one row."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def encoded(encoder: Encoder, texts: pa.Array, closing: int) -> list[np.ndarray]:
    """Ids of each text and the closing one."""
    encoder.begin()
    heads, parts, ends = split_texts(texts)
    rest = encoder.numbers(parts)
    tokens, starts, sizes = encoder.finish()
    first = encoder.encode.alone(heads)  # no blank is before a text
    flat, total = gather(tokens, starts[rest], sizes[rest]), np.concatenate([[0], np.cumsum(sizes[rest])])
    last, stops = np.array([closing], np.int32), total[ends].tolist()
    return [np.concatenate([head, flat[a:b], last]) for head, a, b in zip(first, [0, *stops[:-1]], stops, strict=True)]


def pack_documents(
    docs: DataFrame, model: str = MODEL, length: int = LENGTH, closing: int = CLOSING, batch_ids: int = BATCH_IDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, doc_tokens, start, ids, sequence_id, offset`` per piece of a document; pieces fill a sequence from 0 on."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "doc_tokens", "start", "ids", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, sequence = encoder_of(model), TaskContext.get().partitionId(), 0
        owners, found, size, arrow = [], [], 0, pa.null()

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for s in pack_batch(np.array([len(x) for x in found]), length):
                offset = 0
                for d, start, n in s:
                    rows.append((d, start, n, task << 32 | sequence, offset))
                    offset += n
                sequence += 1
            for a in range(0, len(rows), 4096):
                d, start, n, number, offset = map(list, zip(*rows[a : a + 4096], strict=True))
                flat = np.concatenate([found[x][s : s + m] for x, s, m in zip(d, start, n, strict=True)])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat, pa.int32()))
                lengths = pa.array([len(found[x]) for x in d], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([owners[x] for x in d], arrow), lengths, pa.array(start, pa.int64()), ids, pa.array(number, pa.int64()), pa.array(offset, pa.int64())],
                    names,
                )

        for batch in batches:
            arrow = batch.column(0).type
            for piece in pieces_of(batch):
                for i, ids in zip(piece.column(0).to_pylist(), encoded(encoder, piece.column(1), closing), strict=True):
                    owners.append(i)
                    found.append(ids)
                    size += len(ids)
                    if size >= batch_ids:
                        yield from packed()
                        owners, found, size = [], [], 0
        if found:
            yield from packed()

    schema = f"doc_id {kind}, doc_tokens long, start long, ids array<int>, sequence_id long, offset long"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def with_digest(pieces: DataFrame) -> DataFrame:
    """``ids_crc32`` instead of the ids of a piece, over them as little-endian unsigned 32-bit numbers."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64())
            long = pa.array(np.diff(offsets).astype(np.int64))
            owner, tokens, start, _, sequence, offset = batch.columns
            yield pa.RecordBatch.from_arrays(
                [owner, start, long, crc, tokens, sequence, offset], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

    return pieces.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(pack_documents(table(spark, sf_dir, "documents")))


QUERIES = {"op12_packing": op12_packing}
