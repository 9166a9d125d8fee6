"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``LENGTH`` bytes around it also starts earlier: in a document with a smaller id, or earlier
in the same one. Suffixes are only sorted where that is possible, in four steps:

1. Every window of ``LENGTH`` bytes is given to the least of its hashed 16-byte grams, its anchor; equal windows have
   equal anchors at equal places. Anchors that occur once in the whole corpus cannot start a repeat and end here: their
   hashes are counted in packs, and only those that occur more often come back to their documents.
2. The remaining windows are cut out with their anchor, and each cutting is told by a 128-bit code of its bytes and of
   its anchor's place. Equal cuttings are folded into the earliest one, first within a task, so that a passage that a
   third of all documents share reaches its bucket once per task, then after a shuffle of the codes by anchor.
   An anchor that occurs more than ``HOT`` times is no bucket: each window of its cuttings is told by a 128-bit code of
   its own bytes and folded in the same two steps, so that contexts that differ do not gather in one task.
3. The bytes of a cutting are fetched only where an anchor has different cuttings: these are shuffled by anchor, and one
   anchor is one suffix bucket. Buckets are sorted block by block. A block first ranks the sampled suffixes at the
   places of a difference cover modulo ``PERIOD``, counted from the anchor; all other suffixes are then ordered by their
   first 32 bytes and, where these tie, by the rank of the next sampled suffix. Memory is bounded by the block and the
   largest bucket, ``HOT`` cuttings, not by the corpus. The earliest suffix of each group equal to ``LENGTH`` bytes stays.
4. Removed windows of a document are merged to runs.

A document that equals an earlier one as a whole is found by its digest and needs no sorting.

Defined cases: a null text counts as empty; texts under ``LENGTH`` bytes lose nothing; rows that repeat id and text
are one document and report the same; of different texts with one id that with the smaller digest comes first; a null
id comes before all others; other columns pass through ``remove_repeats``, which decodes what stays and leaves out
bytes of characters that were cut.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, id_numbers, materialize, materialize_by, pack as _pack, salted_left_join, table, texts_of, unpack as _unpack

LENGTH, GRAM = 100, 16
#: A difference cover: every residue modulo PERIOD is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes of texts that are hashed at a time, and of cuttings that are sorted at a time.
SEGMENT, BLOCK = 1 << 20, 4 << 20
#: Bytes of texts whose anchors are packed together, and bytes of the input for each bucket of anchor hashes.
FLUSH, BUCKET_BYTES = 16 << 20, 32 << 20
#: Occurrences of an anchor whose cuttings are sorted together, and windows of other anchors that are folded together.
HOT, FOLDED = 2_000, 200_000
NULL_ID = -(1 << 63)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_NEXT = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])


def ranges(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of concatenated texts by anchor: first start, last start, anchor place, anchor hash."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = _BYTE[data]
    for j, step in enumerate((1, 2, 4, 8)):
        h = h[:-step] * _ODD[j] + h[step:]
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(30)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, LENGTH - GRAM + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    at = (np.minimum(low[: len(low) - (width - span)], low[width - span :]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n, bool)  # windows that do not cross the end of a text
    begin = 0
    for end in ends:
        inside[begin : max(begin, end - LENGTH + 1)] = True
        begin = end
    first = inside & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1]])
    last = inside & np.concatenate([first[1:] | ~inside[1:], [True]])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return lo, hi, at[lo], h[at[lo]]


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in pieces of about ``SEGMENT`` bytes: data, ends, and for each piece its text and place in it.

    A longer text is cut into pieces that overlap by ``LENGTH - 1`` bytes, so that every window is in one of them.
    """
    parts, owners, places, size = [], [], [], 0

    def piece():
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(owners), np.array(places)

    for i, text in enumerate(texts):
        for place in range(0, max(1, len(text) - LENGTH + 1), SEGMENT):
            part = text[place : place + SEGMENT + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            parts.append(part)
            owners.append(i)
            places.append(place)
            size += len(part)
            if size >= SEGMENT:
                yield piece()
                parts, owners, places, size = [], [], [], 0
    if parts:
        yield piece()


def _packed_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, hs, ns, kids``: anchor hashes of about ``FLUSH`` bytes of texts, packed by ranges of the spread hash.

    Of each hash its number of occurrences, and its text if it occurs once here. Hashes that occur more often here are
    settled: they are also sent with all their texts, without ``ns``, to a bucket by turns, so that a hash that is in
    very many texts reaches the bucket of its own once a pack.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        hs: list[np.ndarray] = []
        kids: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            h, kid = np.concatenate(hs), np.concatenate(kids)
            order = np.argsort(h * _ODD[0], kind="stable")  # anchors are small hashes: spread them
            h, kid = h[order], kid[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
            n = np.diff(np.append(at, len(h))).astype(np.int32)
            many = np.repeat(n > 1, n)
            out = [((task * 31 + count) % buckets, _pack(h[many]), None, _pack(kid[many]))] if many.any() else []
            h, kid = h[at], kid[at]
            bucket = ((h * _ODD[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(h)]), len(h)).tolist()
            out += [(int(bucket[a]), _pack(h[a:b]), _pack(n[a:b]), _pack(kid[a:b])) for a, b in itertools.pairwise(edges)]
            return _batch(out, _arrow(PACK))

        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for data, ends, owners, _ in segments([t or b"" for t in texts_of(batch.column(1))]):
                lo, _, _, h = ranges(data, ends)
                hs.append(h)
                kids.append(ids[owners[np.searchsorted(ends, lo, side="right")]])
                size += len(data)
                if size >= FLUSH:
                    yield rows()
                    hs, kids, size, count = [], [], 0, count + 1
        if hs:
            yield rows()

    return docs.select("kid", "text").mapInArrow(run, PACK)


def _repeated_anchors(packs: DataFrame, hot: int) -> DataFrame:
    """``kid, h`` for anchors that occur twice or more; rows without ``kid`` name those that occur more than ``hot`` times."""

    def run(group: pa.Table) -> pa.Table:
        out_kid, out_h, often, parts = [], [], np.zeros(0, np.int64), []
        for h, n, kid in zip(*(group.column(x).to_pylist() for x in ("hs", "ns", "kids")), strict=True):
            h, kid = _unpack(h, np.int64), _unpack(kid, np.int64)
            if n is None:
                out_h.append(h)
                out_kid.append(kid)
            else:
                parts.append((h, _unpack(n, np.int32), kid))
        if parts:
            h, n, kid = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h, n, kid = h[order], n[order], kid[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            total = np.add.reduceat(n.astype(np.int64), at)
            often = h[at[total > hot]]
            keep = np.repeat(total > 1, np.diff(np.append(at, len(h)))) & (n == 1)
            out_h.append(h[keep])
            out_kid.append(kid[keep])
        h, kid = np.concatenate([*out_h, often]), np.concatenate([*out_kid, often])
        named = np.arange(len(h)) >= len(h) - len(often)
        return pa.table({"kid": pa.array(kid, pa.int64(), mask=named), "h": pa.array(h, pa.int64())})

    return packs.groupBy("bucket").applyInArrow(run, "kid long, h long")


PACK = "bucket int, hs binary, ns binary, kids binary"
CODE = "h long, kid long, dig long, start long, rel int, n int, c0 long, c1 long"
CUTTING = "h long, kid long, dig long, start long, rel int, n int, cut binary"


def _signed(x: int) -> int:
    """The lowest 64 bits as a signed number."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def codes(rows: Iterator[tuple[int, int, bytes, np.ndarray]], hot: frozenset[int] = frozenset()) -> Iterator[tuple]:
    """Cuttings of texts at the anchors in question, each as a 128-bit code instead of its bytes.

    Takes id, digest, text and the hashes that repeat somewhere. Of equal cuttings only the earliest has a code. All
    windows of the others are repeats; neighbours among these are one row, under a spread-out hash of its own. At the
    anchors in ``hot`` the cuttings that are left are taken apart into windows, each under the code of its bytes.
    """
    windows: dict[int, tuple[int, int, int]] = {}
    cuts: dict[tuple[int, int], bytes] = {}
    earliest: dict[tuple[int, int], tuple[tuple[int, int, int], int, int]] = {}
    run: list[int] = []  # id, digest, start and number of windows

    def repeat() -> tuple:
        kid, dig, start, n = run
        return _signed((kid * 0x9E3779B1 + start) * 0x9E3779B97F4A7C15), kid, dig, start, 0, n, None, None

    def repeated(me: tuple[int, int, int], n: int) -> Iterator[tuple]:
        nonlocal run
        if run and run[:2] == [*me[:2]] and run[2] + run[3] == me[2]:
            run[3] += n
        else:
            if run:
                yield repeat()
            run = [*me, n]

    def alone() -> Iterator[tuple]:
        for code, me in windows.items():
            yield _signed(code >> 64), *me, 0, 1, _signed(code >> 64), _signed(code)
        windows.clear()

    for kid, dig, text, wanted in rows:
        wanted = np.unique(wanted.astype(np.int64).view(np.uint64))
        for data, ends, _, places in segments([text]):
            lo, hi, at, h = ranges(data, ends)
            i = np.searchsorted(wanted, h)
            i[i == len(wanted)] = 0
            keep = wanted[i] == h if len(wanted) else np.zeros(len(h), bool)
            raw = data.tobytes()
            piece = np.searchsorted(ends, lo, side="right")
            shift = (places - np.concatenate([[0], ends[:-1]]))[piece]  # from the place in data to the place in the text
            found = (x[keep].tolist() for x in (lo, hi, at, h.view(np.int64), shift))
            for a, b, c, k, base in zip(*found, strict=True):
                key = k, xxhash.xxh3_128_intdigest(raw[a : b + LENGTH], seed=c - a)
                me, n = (kid, dig, a + base), b - a + 1
                other = earliest.get(key)
                if other is None or me < other[0]:
                    earliest[key] = me, c - a, n
                    if k in hot:
                        cuts[key] = raw[a : b + LENGTH]
                    me, n = (other[0], other[2]) if other else (None, 0)
                if me is not None and me != earliest[key][0]:
                    yield from repeated(me, n)
    for key, cut in cuts.items():
        (kid, dig, start), _, n = earliest.pop(key)
        for j in range(n):
            code, me = xxhash.xxh3_128_intdigest(cut[j : j + LENGTH]), (kid, dig, start + j)
            other = windows.get(code)
            if other is None or me < other:
                windows[code] = me
                me = other
            if me is not None and me != windows[code]:
                yield from repeated(me, 1)
        if len(windows) >= FOLDED:
            yield from alone()
    if run:
        yield repeat()
    yield from alone()
    for (k, code), (me, rel, n) in earliest.items():
        yield k, *me, rel, n, _signed(code >> 64), _signed(code)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, FOLDED)):
        yield _batch(part, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(","))])


def _codes(affected: DataFrame, hot: list[int]) -> DataFrame:
    shared = affected.sparkSession.sparkContext.broadcast(frozenset(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hashes = texts_of(batch.column(2)), batch.column(3)
            step = 2_000  # texts whose cuttings are folded together
            for s in range(0, batch.num_rows, step):
                part = range(s, min(s + step, batch.num_rows))
                rows = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), texts[i] or b"", hashes[i].values.to_numpy()) for i in part)
                yield from _batches(codes(rows, shared.value), _arrow(CODE))

    return affected.select("kid", "dig", "text", "hs").mapInArrow(run, CODE)


def _judged(coded: DataFrame) -> DataFrame:
    """Of all cuttings those that are ``later`` than an equal one, and the first of each kind where an anchor has several."""
    place, code = F.struct("kid", "dig", "start"), F.struct("c0", "c1")
    same, anchor = Window.partitionBy("h", "c0", "c1"), Window.partitionBy("h")
    rows = coded.repartition("h").withColumns({"first": F.min(place).over(same)})
    rows = rows.withColumn("many", F.min(code).over(anchor) != F.max(code).over(anchor))
    later = F.col("c0").isNull() | (F.col("first") != place)
    return rows.withColumn("later", later).where("later or many").select("h", "kid", "dig", "start", "rel", "n", "later")


def _cuttings(places: DataFrame, affected: DataFrame) -> DataFrame:
    """The bytes of the cuttings at ``places``."""
    wanted = places.groupBy("kid").agg(F.collect_set(F.struct("h", "start", "rel", "n", "dig")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, size, out = _arrow(CUTTING), 0, []
        for batch in batches:
            kids, digs, cuts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for i, text in enumerate(texts_of(batch.column(2))):
                mine = cuts[i].values
                for h, start, rel, n, dig in zip(*(mine.field(j).to_pylist() for j in range(5)), strict=True):
                    if dig != digs[i]:
                        continue
                    cut = text[start : start + n - 1 + LENGTH]
                    size += len(cut)
                    out.append((h, kids[i], digs[i], start, rel, n, cut))
                if size >= BLOCK:
                    yield _batch(out, schema)
                    size, out = 0, []
        yield _batch(out, schema)

    return affected.select("kid", "dig", "text").join(wanted, "kid").select("kid", "dig", "text", "cuts").mapInArrow(run, CUTTING)


def _words(data: np.ndarray, at: np.ndarray, count: int) -> list[np.ndarray]:
    """``count`` big-endian 8-byte words from each place on."""
    w = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for j in range(8):
        w |= padded[j : j + len(data)] << np.uint64(56 - 8 * j)
    limit = len(data) - 1
    return [w[np.minimum(at + 8 * j, limit)] for j in range(count)]


def sort_block(bucket: np.ndarray, rel: np.ndarray, n: np.ndarray, cut: list[bytes], order: np.ndarray) -> list[np.ndarray]:
    """For each cutting the windows that repeat an earlier one, as a 0/1 array.

    ``bucket``: number of the anchor; ``rel``: the anchor's place in the cutting; ``order``: rank of the cutting's
    first window among all (equal for the same place of the same document).
    """
    data = np.frombuffer(b"".join(cut), np.uint8)
    sizes = np.array([len(c) for c in cut])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(cut)), n)
    k = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    start = base[owner] + k
    place = k - rel[owner]  # counted from the anchor
    gap = _NEXT[place % PERIOD]
    # Ranks of the sampled suffixes.
    sample = np.unique(start + gap)
    words = _words(data, sample, (LENGTH + 7) // 8)
    by = np.lexsort(words[::-1])
    lcp = np.zeros(len(by), np.int64)
    open_ = np.ones(max(0, len(by) - 1), bool)
    for w in words:
        diff = (w[by[1:]] ^ w[by[:-1]]).astype(np.uint64)
        same = diff == 0
        part = np.full(len(diff), 8)
        some = open_ & ~same
        part[some] = _leading_bytes(diff[some])
        lcp[1:] += np.where(open_, part, 0)
        open_ &= same
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    spot = back[np.searchsorted(sample, start + gap)]
    rank = np.empty(len(start), np.int64)
    for g in np.unique(gap):
        level = np.cumsum(lcp < LENGTH - g)
        mine = gap == g
        rank[mine] = level[spot[mine]]
    # All suffixes: bucket and place, first 32 bytes, then the rank of the next sampled suffix.
    head = _words(data, start, 4)
    key = (bucket[owner].astype(np.int64) << 16) | (place + LENGTH)
    by = np.lexsort((order[owner], rank, *head[::-1], key))
    new = np.zeros(len(by), bool)
    new[:1] = True
    for column in (key, *head, rank):
        c = column[by]
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    later = np.empty(len(by), bool)
    later[by] = order[owner][by] > order[owner][by[at]][group]
    return np.split(later, np.cumsum(n)[:-1])


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two words, from their difference (not 0)."""
    out = np.zeros(len(x), np.int64)
    for j in range(1, 8):
        out += x < np.uint64(1 << (64 - 8 * j))
    return out


RUN = "kid long, dig long, first long, last long"


def _repeats(cuts: DataFrame) -> DataFrame:
    """``kid, dig, first, last``: ranges of window starts that repeat an earlier window."""

    def block(rows: list[tuple]) -> list[tuple]:
        out = []
        bucket = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        places = sorted({(r[1], r[2], r[3]) for r in rows})
        rank = {p: i for i, p in enumerate(places)}
        order = np.array([rank[r[1], r[2], r[3]] for r in rows])
        found = sort_block(bucket, np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), [r[6] for r in rows], order)
        for r, later in zip(rows, found, strict=True):
            if later.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], later.astype(np.int8), [0]])))
                out += [(r[1], r[2], r[3] + a, r[3] + b - 1) for a, b in edge.reshape(-1, 2).tolist()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK and row[0] != held[-1][0]:  # a bucket is not split
                    yield _batch(block(held), _arrow(RUN))
                    held, size = [], 0
                held.append(row)
                size += len(row[6]) + 16
        if held:
            yield _batch(block(held), _arrow(RUN))

    return cuts.repartition("h").sortWithinPartitions("h").mapInArrow(run, RUN)


def covered(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Maximal removed byte ranges, as (start, end) rows, from ranges of window starts."""
    if not len(first):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order] + LENGTH)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return np.stack([start[at], end[np.concatenate([at[1:] - 1, [len(end) - 1]])]], axis=1)


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> tuple[DataFrame, list[DataFrame]]:
    """One row per row of ``docs``: ``doc_id, n_bytes, sha, text, runs``; and the stored tables that they come from.

    Documents that lose nothing have only ``sha``, the digest of their bytes; the others have their text and ``runs``
    of removed window starts; for copies of earlier documents ``runs`` is null as well as ``sha``.
    """
    numbers = id_numbers(docs, id_col)
    if numbers is not None:  # ids that are no whole numbers count by their order
        docs = docs.select(id_col, text_col).join(numbers.withColumnRenamed("__id", id_col), id_col, "left")
    kid = F.coalesce(F.col(id_col if numbers is None else "__number").cast("long"), F.lit(NULL_ID))
    whole = docs.select(kid.alias("kid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = whole.withColumn("md5", F.md5(F.col("text").cast("binary")))
    whole = whole.withColumn("dig", F.conv(F.substring("md5", 1, 15), 16, 10).cast("long"))
    size = whole.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    anchors = materialize(_repeated_anchors(_packed_anchors(whole, -(-size // BUCKET_BYTES) or 1), hot), "anchors", free=True)
    often = [r[0] for r in anchors.where("kid is null").select("h").collect()]  # at most one for every ``hot`` windows
    hashes = anchors.where("kid is not null").groupBy("kid").agg(F.collect_list("h").alias("hs"))
    slim = whole.select("kid", "md5")
    owner = slim.groupBy("md5").agg(F.min("kid").alias("owner"), F.count("*").alias("m")).where("m > 1").drop("m")
    copies = salted_left_join(slim, owner, "md5", "kid").where("kid > owner").groupBy("kid").agg(F.collect_set("md5").alias("copies"))
    marked = whole.join(hashes.hint("merge"), "kid", "left").join(copies.hint("merge"), "kid", "left")
    marked = marked.withColumn("copy", F.coalesce(F.array_contains("copies", F.col("md5")), F.lit(False)) & (F.octet_length("text") >= LENGTH))
    open_ = F.col("hs").isNotNull() & ~F.col("copy")
    marked = materialize_by(
        marked.select(
            "kid", "doc_id", "dig", F.octet_length("text").cast("long").alias("n_bytes"), "copy",
            F.when(~open_ & ~F.col("copy"), F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
            F.when(open_, F.col("text")).alias("text"), F.when(open_, F.col("hs")).alias("hs"),
        ), "marked", "kid", free=True,
    )
    discard(anchors)
    affected = marked.where("hs is not null")
    judged = materialize(_judged(_codes(affected, often)), "judged", free=True)
    later = judged.where("later").selectExpr("kid", "dig", "start as first", "start + n - 1 as last")
    found = later.unionByName(_repeats(_cuttings(judged.where("not later"), affected)))
    runs = materialize(found.groupBy("kid").agg(F.collect_list(F.struct("dig", "first", "last")).alias("found")), "runs", free=True)
    discard(judged)
    none_type = "array<struct<first:bigint,last:bigint>>"
    none = F.array().cast(none_type)
    done = marked.where("hs is null").select("doc_id", "n_bytes", "sha", "text", F.lit(None).cast(none_type).alias("runs"))
    mine = F.transform(F.filter("found", lambda r: r["dig"] == F.col("dig")), lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last")))
    open_rows = affected.join(runs, "kid", "left").withColumn("runs", F.coalesce(mine, none))
    return done.unionByName(open_rows.select("doc_id", "n_bytes", "sha", "text", "runs")), [marked, runs]


def stripped(rows: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept``, the remaining bytes where some were removed.

    Takes the rows of ``repeated_ranges``.
    """
    empty = hashlib.sha256(b"").hexdigest()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            sizes, shas = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, text in enumerate(texts_of(batch.column(3))):
                runs = batch.column(4)[i]
                if shas[i] is not None:
                    out.append((0, 0, shas[i], None))
                elif not runs.is_valid:
                    out.append((sizes[i], 1, empty, b""))
                else:
                    first, last = (runs.values.field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
                    spans = covered(first, last)
                    kept, at = [], 0
                    for a, b in spans.tolist():
                        kept.append(text[at:a])
                        at = b
                    kept = b"".join([*kept, text[at:]])
                    out.append((len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if len(spans) else None))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "n_bytes", "sha", "text", "runs")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents with their repeats taken out of the text; ``size_col``, if there, follows the new text.

    ``id_col`` is to be unique here, as it is after near-duplicate removal; rows with a null id keep their text.
    """
    rows, stored = repeated_ranges(docs, id_col, text_col)
    changed = stripped(rows).where("n_removed > 0 and doc_id is not null").select(F.col("doc_id").alias(id_col), F.col("kept").alias("__new"))
    changed = materialize(changed, "changed")
    for t in stored:
        discard(t)
    changed = changed.dropDuplicates([id_col])
    at = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = batch.column(len(at)).to_pylist()
            where = at.index(text_col)
            old = batch.column(where)
            texts = [o if k is None else k.decode("utf-8", "ignore") for k, o in zip(new, old.to_pylist(), strict=True)]
            columns = list(batch.columns[: len(at)])
            columns[where] = pa.array(texts, old.type)
            if size_col in at:
                spot = at.index(size_col)
                columns[spot] = pa.array(
                    [o if k is None else len(t) for k, o, t in zip(new, columns[spot].to_pylist(), texts, strict=True)], columns[spot].type
                )
            yield pa.RecordBatch.from_arrays(columns, at)

    return docs.join(changed, id_col, "left").select(*(docs[c] for c in at), "__new").mapInArrow(run, docs.schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, made = repeated_ranges(table(spark, sf_dir, "documents"))
    out = materialize(stripped(rows).drop("kept"), "stripped")
    for t in made:
        discard(t)
    return out


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
