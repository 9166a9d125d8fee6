"""Ranked lexical search with impact-ordered postings, a score at a time.

``build_index`` packs documents into shards of a few MB. With the corpus' document and word counts, every posting gets
its exact integer impact, and a shard's postings of a term are grouped by impact, the highest first. ``search`` takes
queries in blocks of a bounded number of terms to all shards: for each query the groups of all its terms are added up
in descending order of what they contribute. It stops only when the remaining bounds prove that no document outside a
small set of candidates can reach the k best, and then completes the candidates' scores from the shard's postings by
document. The k-th score of earlier shards of a task is a bound for later ones; per task and query k rows are left,
which Spark ranks.

Defined cases: null and empty texts have no terms, count for neither statistic and are never found; items without a
term, or with terms that no document holds, find nothing; every row of ``docs`` is a document for itself, repeated and
null ids included, and null ids come last among equal scores; rows of the queries that equal in id and text count once,
and rows of one id with different texts are queries of their own; ids are of any type; an empty table finds nothing;
other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, discard, materialize, pack, table, texts_of, unpack

#: Text bytes and documents of a shard, beyond which the next one begins. A single longer text makes a longer shard.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 60_000
#: Distinct terms of queries, summed over queries, that are sent to the shards at a time.
BLOCK_TERMS = 200_000
#: Candidates, as a multiple of k, whose scores are completed; more of them are told apart by further groups first.
CANDIDATES = 8
COLUMNS = ["terms", "counts", "docs", "groups", "impacts", "sizes"]


class _Codes(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def shard_postings(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, documents per term, documents and frequencies by term and document, terms per document."""
    codes = _Codes()
    sizes, parts = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        words = (text or b"").translate(ALNUM).split()
        sizes[i] = len(words)
        parts.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
    both = np.concatenate(parts) << 32 | np.repeat(np.arange(len(texts)), sizes)
    both.sort()
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    often = np.diff(np.concatenate([first, [len(both)]]))
    both = both[first]
    counts = np.bincount(both >> 32, minlength=len(codes))
    return list(codes), counts.astype(np.int32), (both & 0xFFFFFFFF).astype(np.int32), often.astype(np.int32), sizes


def by_impact(counts: np.ndarray, docs: np.ndarray, often: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> list[np.ndarray]:
    """Postings of a shard grouped by exact impact: documents, groups per term, impact and size of each group."""
    m = 25 + 75 * sizes * n_docs // max(n_terms, 1)
    f = often.astype(np.int64)
    impact = 1_000_000_000 * f // (1000 * f + 8 * m[docs])
    term = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((docs, -impact, term))
    impact, docs = impact[order], docs[order]
    new = np.concatenate([[True], (impact[1:] != impact[:-1]) | (term[1:] != term[:-1])]) if len(docs) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    groups = np.bincount(term[first], minlength=len(counts))
    return [docs, groups.astype(np.int32), impact[first].astype(np.int32), np.diff(np.concatenate([first, [len(docs)]])).astype(np.int32)]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, int]:
    """The stored index, one row a shard, with the number of documents that have terms and of all their terms."""
    kind = docs.schema[id_col].dataType.simpleString()
    head = ["shard", "ids", "n_docs", "n_terms"]
    raw = ["terms", "counts", "docs", "often", "lengths"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            terms, counts, where, often, sizes = shard_postings(texts)
            owners = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, arrow))
            blobs = [pack(b" ".join(terms)), *map(pack, (counts, where, often, sizes))]
            numbers = [pa.array([x], pa.int64()) for x in (int((sizes > 0).sum()), int(sizes.sum()))]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | count]), owners, *numbers, *(pa.array([b], pa.binary()) for b in blobs)], head + raw)

        task, count, arrow = TaskContext.get().partitionId(), 0, pa.null()
        ids, texts, size = [], [], 0
        for batch in batches:
            arrow = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or b"")
                if size >= shard_bytes or len(ids) >= SHARD_DOCS:
                    yield row()
                    ids, texts, size, count = [], [], 0, count + 1
        if ids:
            yield row()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                counts, where, often = (unpack(row[n][0].as_py(), np.int32) for n in raw[1:4])
                made = by_impact(counts, where, often, unpack(row["lengths"][0].as_py(), np.int64), n_docs, n_terms)
                blobs = [row["terms"], row["counts"], *(pa.array([pack(x)], pa.binary()) for x in made)]
                yield pa.RecordBatch.from_arrays([row["shard"], row["ids"], *blobs], ["shard", "ids", *COLUMNS])

    schema = f"shard long, ids array<{kind}>, n_docs long, n_terms long, " + ", ".join(f"{n} binary" for n in raw)
    postings = materialize(docs.select(id_col, text_col).mapInArrow(first, schema), "postings")
    all_of = postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n_docs, n_terms = int(all_of[0]), int(all_of[1])
    schema = f"shard long, ids array<{kind}>, " + ", ".join(f"{n} binary" for n in COLUMNS)
    index = materialize(postings.select("shard", "ids", *raw).mapInArrow(second, schema), "impacts")
    discard(postings)
    return index, n_docs, n_terms


class Shard:
    """An opened row of the index: postings by impact, and by document for completing scores."""

    def __init__(self, ids: list, terms: bytes, arrays: list[np.ndarray], wanted: dict[bytes, int]):
        counts, self.docs, groups, impacts, sizes = arrays
        self.ids = ids
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.starts = self.ends - counts
        self.impact = np.repeat(impacts, sizes).astype(np.int64)
        self.code = {t: i for i, t in enumerate(terms.split(b" ")) if t in wanted} if terms else {}
        n = max(len(counts), 1)
        keys = self.docs.astype(np.int64) * n + np.repeat(np.arange(len(counts)), counts)
        self.order = np.argsort(keys)
        self.keys, self.n = keys[self.order], n

    def best(self, query: list[tuple[bytes, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores of all that may be among the ``k`` best, scores below ``floor`` left out."""
        found = [(self.code[t], w) for t, w in query if w > 0 and t in self.code]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, weights = (np.array(x, np.int64) for x in zip(*found, strict=True))
        at, end = self.starts[codes].copy(), self.ends[codes]
        score = np.zeros(len(self.ids), np.int64)
        most = weights * self.impact[at]
        if int(most.sum()) < floor:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        level = int(most.max())
        while True:
            level //= 2
            for i in np.flatnonzero(most > level):
                # The groups whose impact is above the level; these stand first.
                a, b = int(at[i]), int(end[i])
                to = a + int(np.searchsorted(-self.impact[a:b], -(level // int(weights[i])), "left"))
                score[self.docs[a:to]] += weights[i] * self.impact[a:to]
                at[i] = to
                most[i] = weights[i] * self.impact[to] if to < b else 0
            rest = int(most.sum())
            bound = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0, 1)
            if rest == 0:
                who = np.flatnonzero(score >= bound)
                return who, score[who]
            if rest < bound:
                who = np.flatnonzero(score >= bound - rest)
                if len(who) <= CANDIDATES * k:
                    return self.complete(who, codes, weights, bound)

    def complete(self, who: np.ndarray, codes: np.ndarray, weights: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(who):
            return who, np.zeros(0, np.int64)
        wanted = who[:, None] * self.n + codes[None, :]
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[place] == wanted
        score = (np.where(hit, self.impact[self.order[place]], 0) * weights[None, :]).sum(axis=1)
        return who[score >= bound], score[score >= bound]


def _first(found: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    """The ``k`` best of (score, id): highest first, then by id, null ids last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]


def document_counts(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of a block's terms is. The driver gets a row for each of these terms at most."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t, n in zip(unpack(terms).split(b" "), unpack(counts, np.int32).tolist(), strict=False):
                    if t in shared.value:
                        total[t] = total.get(t, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["term", "n"])

    rows = index.select("terms", "counts").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["term"]): r["n"] for r in rows}


def search_block(index: DataFrame, queries: list[tuple[int, list[tuple[bytes, int]]]], k: int) -> DataFrame:
    """``query, doc_id, score``: per task the ``k`` best documents of each query (number, weighted terms)."""
    shared = index.sparkSession.sparkContext.broadcast((queries, {t: 1 for _, q in queries for t, _ in q}))
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted = shared.value
        best: dict[int, list[tuple[int, object]]] = {q: [] for q, _ in queries}
        arrow = pa.null()
        for batch in batches:
            arrow = batch.schema.field("ids").type.value_type
            for r in range(batch.num_rows):
                row = {n: batch[n][r].as_py() for n in batch.schema.names}
                shard = Shard(row["ids"], unpack(row["terms"]), [unpack(row[n], np.int32) for n in COLUMNS[1:]], wanted)
                for number, terms in queries:
                    kept = best[number]
                    who, scores = shard.best(terms, k, kept[-1][0] if len(kept) == k else 1)
                    if len(who):
                        best[number] = _first(kept + [(s, shard.ids[d]) for d, s in zip(who.tolist(), scores.tolist(), strict=True)], k)
        rows = [(q, s, i) for q, kept in best.items() for s, i in kept]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[2], arrow), pa.array(columns[1], pa.int64())], ["query", "doc_id", "score"]
        )

    return index.mapInArrow(run, f"query long, doc_id {kind}, score long")


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query, item_id, terms``: the distinct queries with their terms and how often each has them."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = queries.select(F.col(id_col).alias("item_id"), text_col).distinct().withColumn("query", F.monotonically_increasing_id())
    items = materialize(items, "queries")
    each = items.select("query", F.explode(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))).alias("term"))
    each = each.groupBy("query", "term").agg(F.count("*").alias("n"))
    lists = each.groupBy("query").agg(F.collect_list(F.struct("term", "n")).alias("terms"))
    return materialize(items.select("query", "item_id").join(lists, "query"), "query_terms")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score for each query."""
    index, n_docs, n_terms = build_index(docs, id_col, text_col, shard_bytes)
    asked = query_terms(queries, query_id, query_text)
    parts, block, size = [], [], 0

    def flush() -> None:
        nonlocal block, size
        held = document_counts(index, {t for _, q in block for t, _ in q})
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in held.items()}
        weighted = [(q, sorted((t, n * weight[t]) for t, n in terms if t in weight)) for q, terms in block]
        parts.append(search_block(index, weighted, k))
        block, size = [], 0

    for row in asked.select("query", "terms").toLocalIterator():
        block.append((row["query"], [(t["term"].encode(), t["n"]) for t in row["terms"]]))
        size += len(block[-1][1])
        if size >= block_terms:
            flush()
    if block or not parts:
        flush()
    found = materialize(functools.reduce(DataFrame.unionByName, parts), "ranked")
    discard(index)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Terms of a text whose letters A to Z are in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')) AS t FROM documents),
  f AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
  l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
  c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM l),
  w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY t, n_docs),
  i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')) AS t FROM benchmark),
  q AS (SELECT item_id, t, count(*)::BIGINT AS qf FROM i GROUP BY ALL),
  m AS (SELECT doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM l, c),
  s AS (SELECT item_id, doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM q JOIN w USING (t) JOIN f USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES = {"op13_ranked_search": ORACLE}
