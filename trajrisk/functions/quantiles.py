"""Exact quantiles of large groups by adaptive selection: a wanted rank lies in an open range of values, which is narrowed
until it has few rows; only these are sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import delete, stored

#: Rows of a range that one task sorts, at most, unless they are of few values.
SMALL = 100_000
#: Edges that a round takes from a range's quantile sketch, and the sketch's accuracy.
EDGES, ACCURACY = 128, 10_000
#: Ranges that are sent to every task; more are joined by shuffle.
BROADCAST_RANGES = 100_000


def _in_range(rows: DataFrame, ranges: DataFrame, by: list[str], few: bool) -> DataFrame:
    """Rows with every range of their group that holds them; an end that is null is open."""
    inside = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
    return rows.join(F.broadcast(ranges) if few else ranges, by).where(inside)


def ranked_ranges(rows: DataFrame, qs: Sequence[float], by: list[str], small: int = SMALL) -> DataFrame:
    """``*by, n, _at, _rank, _share, _lo, _hi, _base, _size, _value`` for the ranks of each quantile.

    The value of a rank is known, or lies between ``_lo`` and ``_hi``, both excluded, where ``_size`` rows are and which
    ``_base`` rows precede. Each round sketches every range of more than ``small`` rows, counts the rows on either side
    of the two edges around the rank, and keeps the part that has it. Whatever the values, the range loses both edges'
    values in every round; with edges near the ranks it shrinks by some ``EDGES`` / 3.
    """
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    wanted = n.select(*by, "n", F.posexplode(F.array(*(F.lit(float(q)) for q in qs))).alias("_at", "_p"))
    rank = (F.col("n") - 1) * F.col("_p")
    low, share = F.floor(rank), rank - F.floor(rank)
    ranks = F.array(F.struct(low.alias("_rank"), (1 - share).alias("_share")), F.struct((low + 1).alias("_rank"), share.alias("_share")))
    wanted = wanted.select(*by, "n", "_at", F.explode(ranks).alias("_r")).select(*by, "n", "_at", "_r.*").where("_share > 0")
    none = F.lit(None).cast("double")
    ranges = stored(wanted.select("*", none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_base"), F.col("n").alias("_size"), none.alias("_value")), "ranges")
    grid = F.array(*(F.lit(i / EDGES) for i in range(EDGES + 1)))
    while not (wide := ranges.where(F.col("_value").isNull() & (F.col("_size") > small))).isEmpty():
        few = ranges.count() <= BROADCAST_RANGES
        zone = Window.partitionBy(*by, "_lo", "_hi")
        wide = wide.withColumn("_zone", F.min(F.struct("_at", "_rank")).over(zone))
        zones = wide.select(*by, "_lo", "_hi", "_zone").distinct()
        sketch = _in_range(rows, zones, by, few).groupBy(*by, "_zone").agg(F.percentile_approx("_v", grid, ACCURACY).alias("_edges"))
        place = (F.col("_rank") - F.col("_base")) / F.col("_size") * EDGES
        edge = lambda c: F.element_at("_edges", F.greatest(F.lit(1), F.least(F.lit(EDGES + 1), c)).cast("int"))
        tried = wide.join(sketch, [*by, "_zone"]).withColumns({"_a": edge(F.floor(place)), "_b": edge(F.ceil(place) + 2)}).drop("_edges", "_zone")
        tried = stored(tried, "tried")
        below = lambda c: F.count_if(F.col("_v") < F.col(c))
        upto = lambda c: F.count_if(F.col("_v") <= F.col(c))
        cuts = tried.select(*by, "_lo", "_hi", "_a", "_b", "_at", "_rank")
        counted = _in_range(rows, cuts, by, few).groupBy(*by, "_at", "_rank").agg(below("_a").alias("_a0"), upto("_a").alias("_a1"), below("_b").alias("_b0"), upto("_b").alias("_b1"))
        seen = F.col("_rank") - F.col("_base")
        part = (
            F.when(seen < F.col("_a0"), _range("_lo", "_a", F.lit(0), F.col("_a0")))
            .when(seen < F.col("_a1"), F.struct(none.alias("_lo"), none.alias("_hi"), F.col("_base").alias("_base"), F.col("_size").alias("_size"), F.col("_a").alias("_value")))
            .when(seen < F.col("_b0"), _range("_a", "_b", F.col("_a1"), F.col("_b0") - F.col("_a1")))
            .when(seen < F.col("_b1"), F.struct(none.alias("_lo"), none.alias("_hi"), F.col("_base").alias("_base"), F.col("_size").alias("_size"), F.col("_b").alias("_value")))
            .otherwise(_range("_b", "_hi", F.col("_b1"), F.col("_size") - F.col("_b1")))
        )
        narrowed = tried.join(counted, [*by, "_at", "_rank"]).select(*by, "n", "_at", "_rank", "_share", part.alias("_part")).select(*by, "n", "_at", "_rank", "_share", "_part.*")
        done = ranges.where(F.col("_value").isNotNull() | (F.col("_size") <= small))
        after = stored(done.unionByName(narrowed), "ranges")
        delete(ranges)
        delete(tried)
        ranges = after
    return ranges


def _range(lo: str, hi: str, more, size):
    return F.struct(
        F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), (F.col("_base") + more).alias("_base"), size.cast("long").alias("_size"), F.lit(None).cast("double").alias("_value")
    )


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), small: int = SMALL) -> DataFrame:
    """``*by, n, q``: quantiles by linear interpolation between ranks, as an array in the order of ``qs``.

    Nulls are left out; without ``by`` and without values there is one row with ``n`` 0. Equal values are folded before
    anything is sorted. ``df`` is read once for the counts, once for the few rows at the ranks, and twice for each round
    that narrows ranges; so it is best a stored table.
    """
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ranges = ranked_ranges(rows, qs, keys, small)
    few = ranges.count() <= BROADCAST_RANGES
    open_ = ranges.where("_value IS NULL").select(*keys, "_lo", "_hi", "_at", "_rank", "_base")
    folded = _in_range(rows, open_, keys, few).groupBy(*keys, "_at", "_rank", "_base", "_v").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys, "_at", "_rank").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    folded = folded.withColumn("_end", F.col("_base") + F.sum("_c").over(order))
    found = folded.where("_rank < _end AND _rank >= _end - _c").select(*keys, "_at", "_rank", F.col("_v").alias("_found"))
    both = ranges.join(found, [*keys, "_at", "_rank"], "left").withColumn("_x", F.coalesce("_value", "_found") * F.col("_share"))
    sums = both.groupBy(*keys, "n", "_at").agg(F.sum("_x").alias("_x"))
    array = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"])
    out = sums.groupBy(*keys, "n").agg(array.alias("q"))
    if by:
        return out
    one = df.sparkSession.range(1).select(F.lit(0).alias("_all"))
    return one.join(out, "_all", "left").select(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "q")
