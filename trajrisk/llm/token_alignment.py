"""Alignment of the tokens of two tokenizers over the same bytes, as relations.

``align`` takes two token tables ``(key, at, id)``. Lengths come from a table of the vocabulary; a windowed sum gives
each token its end. A full equi-join of both sides on key and end leaves one row for every byte offset where a token of
either side ends: the stretch of bytes before it lies in one token of each side, and every overlapping pair of tokens
shares exactly one such stretch. So the rows are the links; both ids come from the nearest end at or behind a row, a
range join that the same window does which counts the cuts, the offsets where both sides end, and so numbers the
groups. No pair is made that is not a link, however long a group is.

``alignments`` applies this to documents. No token of either vocabulary reaches across the blanks at which ``stretches``
cuts, so a corpus is aligned by its distinct stretches: each is encoded and aligned once, in packs that take the place
of ``key``. Blocks of documents list their stretches, which are joined with what the alignment found for them; each
document's groups and links are then put together from those of its stretches. Pairs are counted by document in each
block, summed over all blocks in Spark, and handed back to the blocks that hold them.

Defined cases: null and empty texts, and texts whose tokens do not give back a blank and the text (such as a U+2581,
which a piece takes for a blank), have no tokens: zeros and an empty digest, and no share in counts; every row is a
document, repeated and null ids included; strings of special tokens are plain text; texts without a blank are one
stretch however long; ids are of any type; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, materialize_by, pack, table, unpack
from .stretches import JoinedTokens, Numbers, byte_tokens, gather, stretches

#: The vocabularies are parameters; these places of the public ones are only the defaults.
BYTE_MODEL, PIECE_MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes of a block of documents, beyond which the next one begins. A single longer text makes a longer block.
BLOCK_BYTES = 12 << 20
#: Characters of the stretches of a pack; a single longer stretch makes a longer pack.
PACK_CHARS = 1 << 20
#: Bits of an id in a pair's number.
BITS = 24


def link_type(ids: int) -> np.dtype:
    """A link as it is stored with its stretch: both ids, and whether either token ends where the bytes they share do (1
    for that of the first vocabulary, 2 for that of the second)."""
    kind = "<u2" if ids <= 1 << 16 else "<u4"
    return np.dtype([("a", kind), ("b", kind), ("ends", "u1")])




def piece_tokens(model: str) -> list[bytes]:
    """Bytes of the ids of a vocabulary of pieces; control pieces and the unknown one have none."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    out = []
    for i in range(m.vocab_size()):
        text = m.id_to_piece(i)
        byte = bytes([int(text[3:5], 16)]) if m.is_byte(i) else text.replace("▁", " ").encode()
        out.append(b"" if m.is_control(i) or m.is_unknown(i) else byte)
    return out


@functools.lru_cache(1)
def vocabularies_of(byte_model: str, piece_model: str):
    """Encoders and token bytes of both vocabularies, once for all tasks of a worker."""
    return (JoinedTokens(byte_model, specials=False), piece_encoder(piece_model)), (byte_tokens(byte_model), piece_tokens(piece_model))


def piece_encoder(model: str):
    """Function from stretches to their tokens, one after the other, and their numbers."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a in range(0, len(parts), 10_000):
            found = m.encode(parts[a : a + 10_000], num_threads=1)
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter(itertools.chain.from_iterable(found), np.int32, int(counts[-1].sum())))
        return np.concatenate(flat), np.concatenate(counts)

    return encode


def align(a: DataFrame, b: DataFrame, a_bytes: DataFrame, b_bytes: DataFrame, key: str) -> DataFrame:
    """``key, end, a, b, a_ends, b_ends, cut_group``: one row for each pair of tokens with bytes in common.

    ``a`` and ``b`` have ``key, at, id``, the vocabularies ``id, n_bytes`` (few rows: these are broadcast). Groups are
    numbered from the end of a key on; rows whose ends are those of both tokens are the last of their group.

    The full join on key and end is a union folded by both: a full outer join forgets how its sides are dealt out, and
    Spark would shuffle all tokens again for the window, where the union leaves them where they are.
    """

    def ends(tokens: DataFrame, lengths: DataFrame, name: str, other: str) -> DataFrame:
        so_far = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sized = tokens.join(F.broadcast(lengths), "id").where("n_bytes > 0")
        return sized.select(key, F.sum("n_bytes").over(so_far).cast("int").alias("end"), F.col("id").alias(name), F.lit(None).cast("int").alias(other))

    both = ends(a, a_bytes, "a", "b").unionByName(ends(b, b_bytes, "b", "a")).groupBy(key, "end").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    back = Window.partitionBy(key).orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a_ends, b_ends = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.select(
        key, "end", F.last("a", True).over(back).alias("a"), F.last("b", True).over(back).alias("b"), a_ends.alias("a_ends"), b_ends.alias("b_ends"),
        F.sum((a_ends & b_ends).cast("int")).over(back).cast("int").alias("cut_group"),
    )


def _lengths(spark: SparkSession, tokens: list[bytes]) -> DataFrame:
    return spark.createDataFrame([(i, len(t)) for i, t in enumerate(tokens)], "id int, n_bytes int").coalesce(1)


def blocks_of(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """One row a block of documents: its number, their ids, the number of stretches of each document, these as numbers of
    the block's distinct stretches ``parts``. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["block", "ids", "counts", "stretches", "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, arrow = TaskContext.get().partitionId(), 0, pa.null()
        ids, rows, size, number = [], [], 0, Numbers()

        def row() -> pa.RecordBatch:
            one = lambda x, k: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k))
            blobs = [np.array([len(r) for r in rows], np.int32), np.concatenate(rows)]
            made = [one(ids, arrow), *(pa.array([pack(x)], pa.binary()) for x in blobs), one(list(number), pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | count]), *made], names)

        for batch in batches:
            arrow = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                parts = stretches(t) if t else []
                rows.append(np.fromiter(map(number.__getitem__, parts), np.int32, len(parts)))
                size += len(t or "")
                if size >= block_bytes:
                    yield row()
                    ids, rows, size, count, number = [], [], 0, count + 1, Numbers()
        if ids:
            yield row()

    return docs.select(id_col, text_col).mapInArrow(run, f"block long, ids array<{kind}>, counts binary, stretches binary, parts array<string>")


def packs_of(parts: DataFrame, byte_model: str, piece_model: str, pack_chars: int = PACK_CHARS) -> DataFrame:
    """One row a pack of distinct stretches ``part``: its number, the stretches, whether the tokens of both vocabularies
    give each back, the byte lengths of these, and the tokens of both over them. No shuffle."""
    names = ["pack", "parts", "fine", "lengths", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, tables = vocabularies_of(byte_model, piece_model)
        task, count = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def row() -> pa.RecordBatch:
            raw = [f" {p}".encode("utf-8", "surrogatepass") for p in held]
            lengths = np.fromiter(map(len, raw), np.int32, len(raw))
            fine, tokens = np.ones(len(raw), bool), []
            for encode, known in zip(encoders, tables, strict=True):
                flat, sizes = encode(held)
                given = list(map(known.__getitem__, flat.tolist()))
                at = np.concatenate([[0], np.cumsum(sizes)])
                long = np.concatenate([[0], np.cumsum(np.fromiter(map(len, given), np.int64, len(given)))])
                if b"".join(given) != b"".join(raw) or (long[at[1:]] - long[at[:-1]] != lengths).any():
                    fine &= np.array([b"".join(given[x:y]) == r for x, y, r in zip(at[:-1], at[1:], raw, strict=True)], bool)
                tokens.append((flat, sizes))
            one = lambda x, k: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k))
            lists = [one(flat[np.repeat(fine, sizes)], pa.int32()) for flat, sizes in tokens]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | count]), one(held, pa.string()), one(fine, pa.bool_()), one(lengths[fine], pa.int32()), *lists], names)

        for batch in batches:
            for p in batch.column(0).to_pylist():
                held.append(p)
                size += len(p)
                if size >= pack_chars:
                    yield row()
                    held, size, count = [], 0, count + 1
        if held:
            yield row()

    return parts.select("part").mapInArrow(run, "pack long, parts array<string>, fine array<boolean>, lengths array<int>, a array<int>, b array<int>")


def _links_of_pack(row: pa.Table, links: pa.Table, kind: np.dtype) -> pa.Table:
    """``part, links`` for the stretches of a pack: their links in order, packed; null where tokens don't give a stretch back."""
    end = links["end"].to_numpy()
    order = np.argsort(end)
    record = np.zeros(len(end), kind)
    for n in "ab":
        record[n] = links[n].to_numpy()[order]
        record["ends"] += links[f"{n}_ends"].to_numpy(zero_copy_only=False)[order] * np.uint8("ab".index(n) + 1)
    fine = row["fine"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    lengths = row["lengths"].combine_chunks().flatten().to_numpy()
    stop = np.zeros(len(fine), np.int64)
    stop[fine] = np.searchsorted(end[order], np.cumsum(lengths, dtype=np.int64), "right") * kind.itemsize
    offsets = np.concatenate([[0], np.maximum.accumulate(stop)]).astype(np.int32)
    parts = row["parts"].combine_chunks().flatten()
    blobs = pa.Array.from_buffers(pa.binary(), len(fine), [pa.array(fine).buffers()[1], pa.py_buffer(offsets), pa.py_buffer(record.tobytes())])
    return pa.table([parts, blobs], ["part", "links"])


def _digest_block(row: dict, at: np.ndarray, blobs: pa.Array, kind: np.dtype, labels: list[bytes]) -> dict:
    """What a block's documents are made of, from the links of its stretches ``at``."""
    order = np.argsort(at)
    blobs = blobs.take(pa.array(order))
    fine = blobs.is_valid().to_numpy(zero_copy_only=False)
    n_links = blobs.fill_null(b"").cast(pa.large_binary())
    record = np.frombuffer(b"".join(n_links.to_pylist()), kind)
    n = len(at)
    per = {"n_links": np.diff(np.frombuffer(n_links.buffers()[1], np.int64)[n_links.offset : n_links.offset + n + 1]) // kind.itemsize}
    del blobs, n_links
    a, b, a_ends, b_ends = record["a"], record["b"], record["ends"] & 1 > 0, record["ends"] & 2 > 0
    stretch = np.repeat(np.arange(n, dtype=np.int32), per["n_links"])
    cut = a_ends & b_ends
    per |= {"n_a": np.bincount(stretch[a_ends], minlength=n), "n_b": np.bincount(stretch[b_ends], minlength=n), "n_groups": np.bincount(stretch[cut], minlength=n)}
    # Texts of groups: the ids of either side, in order.
    number = np.cumsum(cut, dtype=np.int32) - cut
    sides = []
    for ids, ends in ((a, a_ends), (b, b_ends)):
        names = list(map(labels.__getitem__, ids[ends].tolist()))
        size = np.bincount(number[ends], minlength=int(cut.sum()))
        start = (np.cumsum(size) - size).tolist()
        sides.append([names[s] if k == 1 else b",".join(names[s : s + k]) for s, k in zip(start, size.tolist(), strict=True)])
    groups = [x + b"|" + y for x, y in zip(*sides, strict=True)]
    start = (np.cumsum(per["n_groups"]) - per["n_groups"]).tolist()
    text = [groups[s] if k == 1 else b";".join(groups[s : s + k]) for s, k in zip(start, per["n_groups"].tolist(), strict=True)]
    del sides, groups, names, stretch, number
    pairs, pair = np.unique(a.astype(np.int64) << BITS | b, return_inverse=True)
    pair = pair.astype(np.int32)
    link_starts = np.cumsum(per["n_links"]) - per["n_links"]
    counts, flat = unpack(row["counts"], np.int32), unpack(row["stretches"], np.int32)
    if not fine.all():  # documents with such a stretch have no tokens
        ends = np.cumsum(counts)
        bad = np.add.reduceat(np.append(~fine[flat], False).astype(np.int64), np.minimum(ends - counts, len(flat))) * (counts > 0) > 0
        flat, counts = flat[np.repeat(~bad, counts)], np.where(bad, 0, counts).astype(np.int32)
    out = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    held, stamp = np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int64)
    begin = 0
    for size in counts.tolist():
        mine = flat[begin : begin + size]
        begin += size
        for k in ("n_a", "n_b", "n_groups", "n_links"):
            out[k].append(int(per[k][mine].sum()))
        out["groups_sha256"].append(hashlib.sha256(b";".join([text[s] for s in mine.tolist()])).hexdigest() if size else "")
        once = np.unique(mine)
        found = gather(pair, link_starts[once], per["n_links"][once])
        stamp[found] = np.arange(len(found))
        held[found[stamp[found] == np.arange(len(found))]] += 1
    return out | {"pairs": pairs, "held": held, "links": pack(pair), "link_counts": pack(per["n_links"].astype(np.int32))}


def alignments(
    docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
    pack_chars: int = PACK_CHARS,
) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    vocabularies = byte_tokens(byte_model), piece_tokens(piece_model)
    labels, link = spark.sparkContext.broadcast([b"%d" % i for i in range(max(map(len, vocabularies)))]), link_type(max(map(len, vocabularies)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = materialize(blocks_of(docs, id_col, text_col, block_bytes), "blocks")
    places = materialize_by(made.select(F.col("block").alias("own"), F.posexplode("parts").alias("place", "part")), "places", "part", free=True)
    blocks = materialize_by(made.drop("parts"), "blocks", "block")  # by block, so that it is not shuffled to meet its stretches
    discard(made)
    packs = materialize(packs_of(places.select("part").distinct(), byte_model, piece_model, pack_chars), "packs")

    def tokens(name: str) -> DataFrame:
        return packs.select("pack", name).repartition(tasks, "pack").select("pack", F.posexplode(name).alias("at", "id"))

    links = align(tokens("a"), tokens("b"), *(_lengths(spark, v) for v in vocabularies), key="pack")
    whole = packs.select(F.col("pack").alias("own_pack"), "parts", "fine", "lengths").groupBy("own_pack")
    each = whole.cogroup(links.groupBy("pack")).applyInArrow(lambda left, right: _links_of_pack(left, right, link), "part string, links binary")
    known = materialize_by(each, "links", "part", free=True)  # as the places are, so that neither is shuffled to join them
    discard(packs)

    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    names = ["block", "ids", *numbers, "groups_sha256", "pairs", "held", "links", "link_counts"]

    def one(value: list, k: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), pa.array(value, k))

    def digest(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {n: left[n][0].as_py() for n in ("block", "counts", "stretches")}
        made = _digest_block(row, right["place"].to_numpy(), right["links"].combine_chunks(), link, labels.value)
        arrays = [
            pa.array([row["block"]]), left["ids"].combine_chunks(), *(one(made[n], pa.int64()) for n in numbers), one(made["groups_sha256"], pa.string()),
            one(made["pairs"], pa.int64()), one(made["held"], pa.int32()),
            *(pa.array([made[n]], pa.binary()) for n in ("links", "link_counts")),
        ]
        return pa.table(arrays, names)

    schema = (
        f"block long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
        "pairs array<long>, held array<int>, links binary, link_counts binary"
    )
    found = places.join(known, "part").select("own", "place", "links").groupBy("own")
    packed = blocks.select("block", "ids", "counts", "stretches").groupBy("block")
    made = materialize(packed.cogroup(found).applyInArrow(digest, schema), "aligned", free=True)
    for t in (places, known):
        discard(t)

    each = made.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    count = each.where("held > 0").groupBy("pair").agg(F.sum("held").alias("count"))
    most = count.groupBy(F.shiftright("pair", BITS).alias("a")).agg(F.max("count").alias("most"))
    count = count.withColumn("a", F.shiftright("pair", BITS)).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    known = each.join(count, "pair").select("block", "at", "count", "best")  # one row for each pair of a block

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {n: unpack(left[n][0].as_py(), np.int32) for n in ("counts", "stretches", "links", "link_counts")}
        size = int(row["links"].max()) + 1 if len(row["links"]) else 0
        counted = left["n_a"].combine_chunks().flatten().to_numpy() > 0
        total, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = right["at"].to_numpy()
        total[at], best[at] = right["count"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        n = len(row["link_counts"])
        owner = np.repeat(np.arange(n), row["link_counts"])
        sums = [np.bincount(owner, weights=values[row["links"]], minlength=n).astype(np.int64) for values in (total, best)]
        ends = np.concatenate([[0], np.cumsum(row["counts"])])
        per = [np.concatenate([[0], np.cumsum(s[row["stretches"]])]) for s in sums]
        count_sum, n_best = ((p[ends[1:]] - p[ends[:-1]]) * counted for p in per)
        lists = [left[x].combine_chunks().flatten() for x in ("ids", *numbers)]
        return pa.table([*lists, pa.array(n_best), pa.array(count_sum), left["groups_sha256"].combine_chunks().flatten()], ["doc_id", *numbers, "n_best", "count_sum", "groups_sha256"])

    left = made.select(F.col("block").alias("own"), "ids", *numbers, "groups_sha256", "links", "link_counts")
    left = left.join(blocks.select(F.col("block").alias("own"), "counts", "stretches"), "own").groupBy("own")
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = materialize(left.cogroup(known.groupBy("block")).applyInArrow(finish, schema), "alignments", free=True)
    for t in (made, blocks):
        discard(t)
    return out


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
