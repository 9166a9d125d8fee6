"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of all training tokens: documents are packed into shards of a few MB, and every
shard is one row with its terms, their posting counts and the postings (token positions in the shard's token
stream). Documents never cross shards, so a phrase lives in one shard, lists are intersected where they lie, and
nothing is shuffled; executors share the test windows, which are broadcast in blocks of a checked size.

``phrase_matches`` intersects offset-adjusted lists from the rarest term of each window on, so that most windows end
after one look at a count. ``proximity_matches`` finds where all terms of a group stand within a span of words.

Defined cases: null and empty texts have no words and are never hit; items without a word have no window; every row is
reported for itself, whether its id is repeated or null, as a document is known by its shard and its place there; ids
are of any type; items of the same id and text count once; rows of ``benchmark`` with a null id mark words as hit but
are not listed; an empty benchmark hits nothing; other columns are ignored, and kept by ``drop_hit``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, discard, leave_out, materialize, table, texts_of

WINDOW = 10
#: Text bytes in a shard, beyond which the next one begins. A single longer text makes a longer shard.
SHARD_BYTES = 4 << 20
#: Words of test items broadcast at a time; larger benchmarks are searched in several passes.
BLOCK_WORDS = 2_000_000
#: Places that are compared at a time.
PLACES = 2_000_000
INDEX = "sizes binary, terms binary, counts binary, postings binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class _Codes(dict):
    """Numbers terms in the order of their first look-up."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def pack(texts: list[bytes | None]) -> dict[str, bytes]:
    """One shard of the index: a row of packed arrays."""
    codes = _Codes()
    sizes, parts = np.zeros(len(texts), np.int32), []
    for i, text in enumerate(texts):
        words = words_of(text or b"")
        sizes[i] = len(words)
        parts.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
    stream = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    counts = np.bincount(stream, minlength=len(codes)).astype(np.int32)
    lists = np.sort(stream << 32 | np.arange(len(stream)))  # by term, then position
    return {
        "sizes": sizes.tobytes(), "terms": b" ".join(codes),
        "counts": counts.tobytes(), "postings": lists.astype(np.int32).tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index as a stored table, one row a shard: its number, the documents' ids, packed arrays. One pass, no shuffle."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            shard = pack(texts)
            owners = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, kind))
            made = [pa.array([task << 32 | count], pa.int64()), owners, *(pa.array([shard[n]], pa.binary()) for n in names)]
            return pa.RecordBatch.from_arrays(made, ["shard", "ids", *names])

        task, count = TaskContext.get().partitionId(), 0
        ids, texts, size, kind = [], [], 0, pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or b"")
                if size >= shard_bytes:
                    yield row()
                    ids, texts, size, count = [], [], 0, count + 1
        if ids:
            yield row()

    id_type = docs.schema[id_col].dataType.simpleString()
    return materialize(docs.select(id_col, text_col).mapInArrow(run, f"shard long, ids array<{id_type}>, {INDEX}"), "postings")


class Shard:
    """A row of the index, opened for lookups."""

    def __init__(self, row: dict):
        self.shard, self.ids, self.sizes = row["shard"], row["ids"], np.frombuffer(row["sizes"], np.int32)
        self.counts, self.postings = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["postings"], np.int32)
        self.term_of = {t: i for i, t in enumerate(row["terms"].split(b" "))} if row["terms"] else {}
        self.starts = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        self.ends = np.cumsum(self.sizes, dtype=np.int64)  # of documents, in the token stream
        self.stream = np.empty(len(self.postings), np.int32)
        self.stream[self.postings] = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)

    def codes(self, terms: list[bytes]) -> np.ndarray:
        return np.fromiter((self.term_of.get(t, -1) for t in terms), np.int64, len(terms))

    def positions(self, code: int) -> np.ndarray:
        return self.postings[self.starts[code] : self.starts[code + 1]]

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, side="right")

    def phrases(self, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For phrases of equal length (rows of term codes): numbers of phrases and where they start, piece by piece.

        Lists adjusted by the term's offset are intersected, from the rarest term of each phrase on; documents are not
        crossed. Whether a place is in a term's list is looked up in ``stream``, which the postings fill.
        """
        n, size = matrix.shape[1], self.counts[matrix]
        order = np.argsort(size, axis=1, kind="stable")
        rare = np.take_along_axis(size, order[:, :1], 1)[:, 0].astype(np.int64)
        begin = 0
        while begin < len(matrix):
            end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(rare[begin:]), PLACES, side="right")))
            which = np.repeat(np.arange(begin, end), rare[begin:end])
            first = order[begin:end, 0]
            start = self.starts[matrix[np.arange(begin, end), first]]
            step = np.arange(len(which)) - np.repeat(np.cumsum(rare[begin:end]) - rare[begin:end], rare[begin:end])
            at = self.postings[np.repeat(start, rare[begin:end]) + step].astype(np.int64) - first[which - begin]
            good = (at >= 0) & (at + n <= len(self.stream))
            which, at = which[good], at[good]
            for k in range(1, n):
                if not len(at):
                    break
                offset = order[which, k]
                good = self.stream[at + offset] == matrix[which, offset]
                which, at = which[good], at[good]
            good = self.documents(at) == self.documents(at + n - 1)
            yield which[good], at[good]
            begin = end


def windows_of(items: list[tuple[object, bytes]], size: int) -> tuple[list[bytes], dict[int, tuple[np.ndarray, list[list[str]]]]]:
    """Terms, and by window length the distinct windows (as term numbers) with the ids of their items."""
    terms: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item, text in items:
        codes = [terms.setdefault(w, len(terms)) for w in words_of(text)]
        n = min(size, len(codes))
        for i in range(len(codes) - n + 1 if codes else 0):
            owners = found.setdefault(n, {}).setdefault(tuple(codes[i : i + n]), set())
            if item is not None:
                owners.add(str(item))
    return list(terms), {n: (np.array(list(w), np.int64), [sorted(x) for x in w.values()]) for n, w in found.items()}


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[object, bytes]]]:
    """Test items, streamed to the driver and handed on in blocks of at most about ``block_words`` words."""
    block, size = [], 0
    for row in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).distinct().toLocalIterator():
        block.append((row[0], row[1].encode("utf-8", "surrogatepass")))
        size += len(words_of(block[-1][1]))
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def phrase_matches(index: DataFrame, items: list[tuple[object, bytes]], size: int = WINDOW) -> DataFrame:
    """Per indexed document, by ``shard`` and ``place``: its id and number of words, the starts and ends of hit word
    runs, the ids of matching items."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(windows_of(items, size))
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"shard long, place int, doc_id {kind}, n_words long, hit binary, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, windows = shared.value
        for batch in batches:
            arrow = batch.schema.field("ids").type.value_type
            for row in batch.to_pylist():
                shard = Shard(row)
                codes = shard.codes(terms)
                n = len(shard.sizes)
                edges, owners = np.zeros(len(shard.stream) + 1, np.int32), [set() for _ in range(n)]
                for length, (matrix, ids) in windows.items():
                    for begin in range(0, len(matrix), PLACES // 10):
                        local = codes[matrix[begin : begin + PLACES // 10]]
                        there = np.flatnonzero((local >= 0).all(axis=1))
                        for which, at in shard.phrases(local[there]):
                            np.add.at(edges, at, 1)
                            np.add.at(edges, at + length, -1)
                            found = np.unique(np.stack([there[which] + begin, shard.documents(at)], axis=1), axis=0)
                            for w, d in found.tolist():
                                owners[d].update(ids[w])
                hit = np.cumsum(edges)[:-1] > 0
                first = np.concatenate([[0], shard.ends[:-1]]) if n else []
                runs = [_runs(hit[a:b]) for a, b in zip(first, shard.ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard.shard)), pa.array(np.arange(n, dtype=np.int32)), pa.array(shard.ids, arrow),
                     pa.array(shard.sizes.astype(np.int64)), pa.array(runs, pa.binary()), pa.array([sorted(x) for x in owners], pa.list_(pa.string()))],
                    ["shard", "place", "doc_id", "n_words", "hit", "items"],
                )

    return index.mapInArrow(run, schema)


def _runs(hit: np.ndarray) -> bytes:
    """Starts and ends of runs of true values, as packed int32 pairs."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return change.astype(np.int32).tobytes()


def proximity_matches(index: DataFrame, groups: list[tuple[str, list[str]]], span: int) -> DataFrame:
    """``(doc_id, group, start, end)``: minimal word ranges of at most ``span`` words that hold all terms of a group.

    From the rarest term of the group on, each of its positions takes the nearest positions of the other terms.
    """
    wanted = [(name, [w for t in terms for w in words_of(t.encode())]) for name, terms in groups]
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                shard = Shard(row)
                for name, terms in wanted:
                    codes = shard.codes(sorted(set(terms)))
                    if not len(codes) or (codes < 0).any():
                        continue
                    lists = sorted((shard.positions(c).astype(np.int64) for c in codes), key=len)
                    for p in lists[0]:
                        d = int(shard.documents(p))
                        lo, hi = max(int(shard.ends[d - 1]) if d else 0, p - span + 1), min(int(shard.ends[d]), p + span) - 1
                        near = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi, side="right")] for x in lists[1:]]
                        if not all(map(len, near)):
                            continue
                        best = None
                        for start in sorted({int(p), *(int(v) for x in near for v in x if v <= p)}):
                            ends = [x[np.searchsorted(x, start) :] for x in near]
                            if all(map(len, ends)):
                                end = max([int(p), *(int(e[0]) for e in ends)])
                                if end - start < span and (best is None or end - start < best[1] - best[0]):
                                    best = (start, end)
                        if best:
                            base = int(shard.ends[d - 1]) if d else 0
                            out.append((shard.ids[d], name, best[0] - base, best[1] - base + 1))
            columns = list(zip(*sorted(set(out), key=str), strict=True)) or [[]] * 4
            arrow = batch.schema.field("ids").type.value_type
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (arrow, pa.string(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "group", "start", "end"],
            )

    return index.mapInArrow(run, f"doc_id {kind}, `group` string, start long, end long")


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``shard, place, doc_id, n_words, hit`` (runs of hit words), ``items`` (sorted ids of items found)."""
    index = build_index(docs, id_col, text_col)
    parts = [phrase_matches(index, b, size) for b in item_blocks(benchmark, "item_id", "text", block_words)]
    out = functools.reduce(DataFrame.unionByName, parts) if parts else phrase_matches(index, [], size)
    if len(parts) > 1:  # each block of a large benchmark has a row for every document
        merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
        out = out.groupBy("shard", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("hit").alias("hits"), merged.alias("items")
        ).select("shard", "place", "doc_id", "n_words", _merge_runs("hits").alias("hit"), "items")
    out = materialize(out, "hits")
    discard(index)
    return out


def drop_hit(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a window of the benchmark, with all their columns; each row is judged by its own text."""
    text = F.coalesce(text_col, F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")), F.lit("\0"), text).cast("binary"))
    found = contamination(docs.select(key.alias("key"), text.alias("text")), benchmark, size, id_col="key")
    gone = found.where(F.octet_length("hit") > 0).select(F.col("doc_id").alias("__key")).distinct()
    return leave_out(docs, gone, key, "__key")


def _merge_runs(column: str):
    """Column with the union of several lists of packed runs."""

    def one(runs) -> bytes:
        pairs = np.concatenate([np.frombuffer(r, np.int32) for r in runs]).reshape(-1, 2)
        edges = np.zeros(int(pairs.max(initial=0)) + 1, np.int32)
        np.add.at(edges, pairs[:, 0], 1)
        np.add.at(edges, pairs[:, 1], -1)
        return _runs(np.cumsum(edges) > 0)

    def merged(runs: pd.Series) -> pd.Series:
        return runs.map(one)

    return F.pandas_udf(merged, "binary")(column)


def run_words(column: str):
    """Column with the number of words in packed runs."""

    def total(runs: pd.Series) -> pd.Series:
        return runs.map(lambda r: int(np.frombuffer(r, np.int32).reshape(-1, 2).dot([-1, 1]).sum())).astype("int64")

    return F.pandas_udf(total, "long")(column)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = run_words("hit")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = rf"""
WITH d AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM (
       SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_SQL}') AS w FROM documents)),
  i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_SQL}') AS w FROM benchmark),
  iw AS (SELECT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (
       SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
  lens AS (SELECT DISTINCT n FROM iw),
  dw AS (SELECT doc_id, p, n, win FROM (
       SELECT doc_id, p, n, string_agg(w, ' ') OVER (PARTITION BY doc_id, n ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS win,
              count(*) OVER (PARTITION BY doc_id, n ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS c
       FROM d, lens WHERE n = 10) WHERE c = 10
     UNION ALL
     SELECT d.doc_id, d.p, s.n, s.win FROM (SELECT DISTINCT n, win, split_part(win, ' ', 1) AS w1 FROM iw WHERE n < 10) s
       JOIN d ON d.w = s.w1
       WHERE s.win = (SELECT string_agg(e.w, ' ' ORDER BY e.p) FROM d e WHERE e.doc_id = d.doc_id AND e.p BETWEEN d.p AND d.p + s.n - 1)),
  m AS (SELECT DISTINCT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
  h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
  t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
        FROM m GROUP BY doc_id),
  n AS (SELECT doc_id, coalesce(len(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_SQL}')), 0) AS n_words FROM documents)
SELECT n.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM n LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES = {"op5_decontamination": ORACLE}
