"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function maps every five-word shingle of a text to 64 bits; the ``SKETCH`` smallest values are the document's
bottom-k sketch. Inverted lists of retained values bring together documents whose sketches overlap, an estimate over
the sketch of the union drops pairs that are too far apart, and the Jaccard similarity of the full shingle sets decides.

How hot lists are kept small without losing links:

* Documents with equal shingle sets form a class first; only its smallest id goes on.
* A document is listed under its rarest retained values only (prefix filter): documents with a similarity of at least
  0.75 share at least ``need`` retained values, so they meet among the first ``size - need + 1`` values of each in
  any common order, here by document frequency. Sets of up to 48 shingles have whole sketches and an exact ``need``.
  Beyond that ``need`` is 28 of 64, which a pair at exactly 0.75 misses with a chance below one in a million.
* Lists aren't expanded to pairs. Every member is compared with one member of its list first (a star), links are joined
  to components, and only lists that still span several components go on. Their documents are listed once more under
  their whole sets, whose exact prefixes of a quarter leave shared passages and looser copies out. What these lists
  hold between different components is compared: pairs of short lists one by one, clusters of long lists in pairs of
  blocks, each a group of bounded size that counts all its intersections at once. No list is cut short.

Defined cases: null and blank texts have an empty set, link with nothing and are their own component; texts with one to
four words are one shingle; repeated rows link to each other and report the same component; of rows with one id and
different texts the one with the smallest digest speaks for the id; rows with a null id link with nothing, get a null
component and are kept; other columns pass through ``keep_first`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, id_numbers, leave_out, materialize, salted_left_join, small_batches, table, texts_of

SHINGLE, SKETCH, THRESHOLD = 5, 64, 75
WHOLE, NEED = 48, 28
#: Lists of more entries are compared in blocks of this many documents instead of pair by pair.
LONG_LIST, BLOCK = 48, 512
#: Words whose hashes a task keeps at hand.
CACHED_WORDS = 250_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes | None, cache: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (ASCII letters lower-cased)."""
    words = (text or b"").lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    if len(cache) > CACHED_WORDS:
        cache.clear()
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    x = h[: n - 4] * _MIX[0]
    for j in range(1, SHINGLE):
        x = x + h[j : n - 4 + j] * _MIX[j]
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.unique(x)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, digest`` (of the set) and ``sketch`` (its smallest hashes, packed). One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            sets = [shingles(t, cache) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                 pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "digest", "sketch"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, sketch binary")


def _values(classes: DataFrame) -> DataFrame:
    """``value, rep, n``: one row for each retained hash of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(s, np.int64) for s in batch.column(2).to_pylist()]
            sizes = [len(p) for p in parts]
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            each = [np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(each[0]), pa.array(each[1])], ["value", "rep", "n"])

    return classes.select("rep", "n", "sketch").mapInArrow(run, "value long, rep long, n long")


def _all_values(texts: DataFrame) -> DataFrame:
    """``value, rep, n``: one row for each shingle hash of a text, none left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            for rep, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                found = shingles(text, cache).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), rep)), pa.array(np.full(len(found), len(found)))], ["value", "rep", "n"]
                )

    return texts.select("rep", "text").mapInArrow(run, "value long, rep long, n long")


def _lists(values: DataFrame, size, need) -> DataFrame:
    """``value, rep, n, single``: the prefixes, without the ``single`` values that only that class has."""
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("rep")
    ranked = values.join(shared, "value").withColumns({
        "single": size - F.count("*").over(own), "rank": F.row_number().over(own.orderBy("df", "value")),
    })
    prefixes = materialize(ranked.where(F.col("single") + F.col("rank") <= size - need + 1).select("value", "rep", "n", "single"), "prefixes")
    wide = prefixes.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value")
    lists = materialize(prefixes.join(wide, "value"), "lists", free=True)
    discard(prefixes)
    return lists


def estimate(a: bytes, b: bytes) -> bool:
    """Whether the sketch of the union leaves a similarity at the threshold possible."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    top = min(s[-1] for s in (x, y) if len(s) == SKETCH) if max(len(x), len(y)) == SKETCH else None
    if top is not None:
        x, y = x[: np.searchsorted(x, top, "right")], y[: np.searchsorted(y, top, "right")]
    both = np.concatenate([x, y])
    both.sort()
    twice = both[1:] == both[:-1]
    total = len(both) - int(twice.sum())
    if total > SKETCH:  # the smallest SKETCH values of the union only
        keep = np.concatenate([[True], ~twice]).cumsum() <= SKETCH
        twice, total = twice[keep[1:]], SKETCH
    return 64 * int(twice.sum()) >= NEED * total


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose union sketch leaves a similarity at the threshold possible."""
    one = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [estimate(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose full shingle sets reach the threshold."""
    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last = _Hashes(), (None, None)
        for batch in batches:
            good = []
            b = batch.column(1).to_pylist()
            for i, (ta, tb) in enumerate(zip(texts_of(batch.column(2)), texts_of(batch.column(3)), strict=True)):
                if last[0] != b[i]:
                    last = (b[i], shingles(tb, cache))
                x, y = shingles(ta, cache), last[1]
                inter = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * inter >= THRESHOLD * (len(x) + len(y) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    found = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return found.sortWithinPartitions("b").mapInArrow(run, "a long, b long")


def _open_entries(lists: DataFrame, components: DataFrame | None) -> DataFrame:
    """Entries of the lists that span several components ``c``; with the list's size ``m`` and its ``star``."""
    if components is None:
        entries = lists.withColumn("c", F.col("rep"))
    else:
        entries = lists.join(components.withColumnRenamed("node", "rep"), "rep", "left")
        entries = entries.select("value", "rep", "n", "single", F.coalesce("component", "rep").alias("c"))
    # An original has no value of its own, its edited copies do: the star is best at the fewest.
    star = F.struct("single", F.xxhash64("rep").alias("h"), F.col("rep").alias("b"), F.col("n").alias("nb"))
    spans = entries.groupBy("value").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.min(star).alias("star")
    ).where("lo < hi")
    return materialize(entries.join(spans.select("value", "m", "star"), "value"), "entries")


def block_links(first: list[tuple[int, int, np.ndarray]], second: list[tuple[int, int, np.ndarray]] | None) -> list[tuple[int, int]]:
    """Links between (or, without ``second``, within) blocks of documents ``(rep, component, set)``.

    All similarities are exact; of the links that join the same components one is enough.
    """
    values = np.concatenate([s for *_, s in first])
    owner = np.repeat(np.arange(len(first)), [len(s) for *_, s in first])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    sizes = np.array([len(s) for *_, s in first])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for j, (rep, c, mine) in enumerate(second or first):
        lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
        n = hi - lo
        hits = owner[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        inter = np.bincount(hits, minlength=len(first))
        good = 100 * inter >= THRESHOLD * (sizes + len(mine) - inter)
        for i in np.flatnonzero(good if second else good[:j]):
            x, y = find(first[i][1]), find(c)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(rep, first[i][0]), max(rep, first[i][0])))
    return out


def _hot_links(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of documents that meet in long lists: clusters of such lists, compared block by block.

    Documents of a cluster are dealt to size classes, each a quarter larger than the one before, so that links are only
    possible inside a class and between neighbours; and these to blocks of about ``BLOCK`` rows. Every pair of blocks
    that may have links is a group of its own.
    """
    cluster = connected_components(entries.select(F.col("rep").alias("a"), F.col("star.b").alias("b")))
    cluster = cluster.withColumnRenamed("node", "rep")
    step = float(np.log(100 / THRESHOLD))
    rows = entries.select("rep", "n", "c").distinct().join(cluster, "rep").withColumn("s", F.floor(F.log("n") / step).cast("int"))
    count = rows.groupBy("component", "s").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    near = lambda d: count.select("component", (F.col("s") - d).alias("s"), F.col("blocks").alias(f"b{d + 1}"))
    for d in (-1, 0, 1):  # blocks of the class before, of the own one and of the next
        rows = rows.join(near(d), ["component", "s"], "left")
    mine = F.pmod(F.xxhash64("rep"), F.col("b1")).cast("int")
    numbers = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    group = lambda s, t, lo, hi: F.struct(s.alias("s"), t.alias("t"), lo.alias("lo"), hi.alias("hi"))
    rows = rows.withColumn("mine", mine)
    own, s_ = F.col("mine"), F.col("s")
    groups = F.concat(
        F.transform(numbers(F.col("b1")), lambda o: group(s_, s_, F.least(own, o), F.greatest(own, o))),
        F.transform(numbers(F.col("b2")), lambda o: group(s_, s_ + 1, own, o)), F.transform(numbers(F.col("b0")), lambda o: group(s_ - 1, s_, o, own)),
    )
    rows = rows.select("component", "rep", "c", "s", "mine", F.explode(groups).alias("g")).join(texts, "rep")
    rows = rows.select("component", F.col("g.s").alias("s0"), F.col("g.t").alias("s1"), "g.lo", "g.hi", F.struct("s", "mine").alias("mine"), "rep", "c", "text")

    def compare(group: pa.Table) -> pa.Table:
        cache = _Hashes()
        blocks: dict[tuple[int, int], list] = {}
        for mine, rep, c, text in zip(*(group.column(x).to_pylist() for x in ("mine", "rep", "c")), texts_of(group.column("text")), strict=True):
            blocks.setdefault((mine["s"], mine["mine"]), []).append((rep, c, shingles(text, cache)))
        parts = list(blocks.values())
        s0, s1, lo, hi = (group.column(x)[0].as_py() for x in ("s0", "s1", "lo", "hi"))
        found = block_links(parts[0], None) if (s0, lo) == (s1, hi) else block_links(*parts) if len(parts) == 2 else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.groupBy("component", "s0", "s1", "lo", "hi").applyInArrow(compare, "a long, b long")


def _links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """``node, component`` of all classes that are linked with another one."""
    size = F.least("n", F.lit(SKETCH))
    exact = F.ceil(F.col("n") * (THRESHOLD / 100))
    fits = f"least(n, nb) * 100 >= {THRESHOLD} * greatest(n, nb)"
    pair = (F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b"))
    lists = _lists(_values(classes), size, F.when(F.col("n") <= WHOLE, exact).otherwise(NEED))
    spoken = classes.join(lists.select("rep").distinct(), "rep").select("rep", "digest")
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(spoken, "rep").dropDuplicates(["rep", "digest"])
    texts = materialize(texts.select("rep", "text"), "texts", free=True)

    # First every document against the star of each of its lists.
    entries = _open_entries(lists, None)
    pairs = entries.select("rep", "n", "star.*").where("rep <> b").where(fits).select(*pair).distinct()
    stars = materialize(_verified(_near(pairs, classes), texts), "stars")
    components = None if stars.isEmpty() else connected_components(stars)
    discard(entries)

    # Then what is still open, listed anew under whole sets.
    entries = _open_entries(lists, components)
    discard(lists)
    lists = _lists(_all_values(texts.join(entries.select("rep").distinct(), "rep")), F.col("n"), exact)
    discard(entries)
    entries = _open_entries(lists, components)
    short, long = entries.where(F.col("m") <= LONG_LIST), entries.where(F.col("m") > LONG_LIST)
    other = short.select("value", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    pairs = short.join(other, "value").where("c <> cb and rep < b").where(fits).select(*pair).distinct()
    rest = _verified(_near(pairs, classes), texts)
    if not long.isEmpty():
        rest = rest.unionByName(_hot_links(long, texts))
    rest = materialize(rest, "rest")
    if not rest.isEmpty():
        if components is not None:
            discard(components)
        components = connected_components(stars.unionByName(rest))
    for t in (lists, texts, entries, stars, rest):
        discard(t)
    return components


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``; ids that are no whole numbers are numbered in
    their order and given back."""
    numbers = id_numbers(docs, id_col)
    if numbers is not None:
        rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(numbers, "__id", "left")
        found = near_duplicates(rows.select(F.col("__number").alias("doc_id"), "text"))
        name = lambda c: numbers.select(F.col("__number").alias(c), F.col("__id").alias(f"{c}_name"))
        out = found.join(name("doc_id"), "doc_id", "left").join(name("component_id"), "component_id", "left")
        out = materialize(out.select(F.col("doc_id_name").alias("doc_id"), "n_shingles", F.col("component_id_name").alias("component_id"), "kept"), "groups")
        for t in (found, numbers):
            discard(t)
        return out
    with small_batches(docs.sparkSession):
        return _groups(docs, id_col, text_col)


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = materialize(sketch(docs, id_col, text_col), "sketches")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    voice = full.groupBy("doc_id").agg(F.min("digest").alias("digest"))
    owner = voice.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1").drop("m")
    members = salted_left_join(voice, owner, "digest", "doc_id")
    members = materialize(members.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "digest"), "members")
    classes = materialize(
        full.join(members.where("doc_id = rep"), ["doc_id", "digest"]).dropDuplicates(["doc_id"])
        .select("rep", F.col("n_shingles").alias("n"), "digest", "sketch"), "classes", free=True,
    )
    components = _links(docs, classes, id_col, text_col)
    whole = members.select("doc_id", "rep")
    if components is not None:
        whole = whole.join(components.withColumnRenamed("node", "rep"), "rep", "left")
        whole = whole.select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    else:
        whole = whole.withColumnRenamed("rep", "component_id")
    out = rows.select("doc_id", "n_shingles").join(whole, "doc_id", "left")
    own = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == own, F.lit(True))
    out = materialize(out.select("doc_id", "n_shingles", own.alias("component_id"), kept.alias("kept")), "groups")
    for t in (rows, members, classes, *([components] if components is not None else [])):
        discard(t)
    return out


def _set_digest(text):
    """Column with the digest of a text's shingle set, null for an empty one."""

    def digests(texts: pd.Series) -> pd.Series:
        cache = _Hashes()
        sets = (shingles(None if t is None else t.encode("utf-8", "surrogatepass"), cache) for t in texts)
        return pd.Series([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets])

    return F.pandas_udf(digests, "binary")(text)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each group, with all their columns; rows with a null id stay.

    Of rows with one id that stays, the one that speaks for it is kept; of equal ones any.
    """
    groups = near_duplicates(docs, id_col, text_col)
    gone = groups.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    stay = leave_out(docs, gone, F.col(id_col), "__gone")
    again = groups.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.count("*").alias("n")).where("n > 1").select(id_col)
    if again.isEmpty():
        return stay
    again = materialize(again, "again")
    several = stay.join(again, id_col, "left_semi").withColumn("__d", _set_digest(F.col(text_col)))
    order = Window.partitionBy(id_col).orderBy(F.col("__d").asc_nulls_last(), F.col(text_col).asc_nulls_last())
    one = several.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*docs.columns)
    return stay.join(again, id_col, "left_anti").select(*docs.columns).unionByName(one)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_dedup": op9_near_dedup}
