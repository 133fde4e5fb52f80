"""Sharding: contiguous shards of ordered atomic groups with the smallest largest shard.

Native: DataFrame functions only. Groups of equal texts stay whole and are ordered by their least key. The smallest
capacity for which a greedy pass fills at most ``shards`` shards is found by binary search, and the cuts are made there.

A pass over all groups for each capacity would be slow, so the search works on ranges. All groups are summed up in at
most ``ATOMS`` ranges of the order, which fit in one row. A pass over ranges that may not be cut gives a capacity that
suffices, and one over ranges that may be cut anywhere one that is needed; between the two, the cuts can fall into
only a few windows of the order. The groups of these windows are the next round's ranges, until every range in a
window is one group, and then the smallest capacity is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Ranges of the order in a round; they are folded as one array.
ATOMS = 40_000
#: Bytes that a row adds to those of its text.
ROW_BYTES = 16


def _greedy(atoms: Column, capacity: Column) -> Column:
    """Where a greedy pass over the atoms (ends of ranges, ascending) cuts: the ends of its shards."""
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<bigint>")

    def step(s: Column, end: Column) -> Column:
        over = end - s["start"] > capacity
        return F.struct(F.when(over, s["last"]).otherwise(s["start"]).alias("start"), end.alias("last"), F.when(over, F.concat(s["cuts"], F.array(s["last"]))).otherwise(s["cuts"]).alias("cuts"))

    return F.aggregate(atoms, F.struct(zero.alias("start"), zero.alias("last"), empty.alias("cuts")), step, lambda s: F.concat(s["cuts"], F.array(s["last"])))


def _count(atoms: Column, capacity: Column) -> Column:
    """Shards that a greedy pass fills."""
    zero = F.lit(0).cast("long")

    def step(s: Column, end: Column) -> Column:
        over = end - s["start"] > capacity
        return F.struct((s["n"] + F.when(over, F.lit(1)).otherwise(F.lit(0))).alias("n"), F.when(over, s["last"]).otherwise(s["start"]).alias("start"), end.alias("last"))

    return F.aggregate(atoms, F.struct(F.lit(1).alias("n"), zero.alias("start"), zero.alias("last")), step, lambda s: s["n"])


def smallest_capacity(row: DataFrame, low: int, high: int, shards: int) -> int:
    """The least capacity in [low, high] for which a greedy pass over ``ends`` of the one row fills at most ``shards``
    shards; ``high`` must be enough. Each query tries 31 capacities, so few are needed."""
    while low < high:
        width = max(1, (high - low) // 31)
        tried = [c for c in range(low, low + 32 * width, width) if c < high]
        each = row.select("ends", F.explode(F.array(*[F.lit(c).cast("long") for c in tried])).alias("capacity"))
        best = each.where(_count(F.col("ends"), F.col("capacity")) <= shards).agg(F.min("capacity")).first()[0]
        at = tried.index(best) if best is not None else len(tried)
        low, high = (tried[at - 1] + 1 if at else low), (best if best is not None else high)
    return low


def minimax_cuts(groups: DataFrame, shards: int, atoms: int = ATOMS) -> tuple[int, list[int]]:
    """The least capacity and the ends of its shards, for ``groups (start long, size long)`` with running starts."""
    total, largest, count = groups.agg(F.max(F.col("start") + F.col("size")), F.max("size"), F.count(F.lit(1))).first()
    if not count:
        return 0, []
    low = max(-(-total // shards), largest)
    high = low + largest
    atoms = max(atoms, 4 * shards)  # ranges of small groups stay below half of any capacity in question
    near, bytes_near = groups.select("start", "size", (F.col("start") + F.col("size")).alias("end")), total
    while True:
        exact = count <= atoms
        if exact:
            ends = near.select("end")
        else:
            # Small groups whose ends lie close make a range of less than twice the span; a larger one is a range.
            span = max(1, bytes_near // atoms)
            ends = near.groupBy(F.floor(F.col("end") / span)).agg(F.max("end").alias("end")).select("end").union(near.where(F.col("size") > span).select(F.explode(F.array("start", "end"))).where("col > 0"))
        last = near.sparkSession.range(1).select(F.lit(total).cast("long").alias("end"))
        row = common.written(ends.union(last).distinct().agg(F.sort_array(F.collect_list("end")).alias("ends")))
        high = smallest_capacity(row, low, high, shards)
        if exact or high == low:
            return high, _even_cuts(row, high, total, shards)
        # A greedy pass over ranges with the lower bound lags behind any in question, and one with the upper bound and
        # a range more is ahead of it: between the two lies each cut.
        lag, lead = row.select(_greedy(F.col("ends"), F.lit(low).cast("long")), _greedy(F.col("ends"), F.lit(high + 2 * span).cast("long"))).first()
        # Windows that meet are one, so an end lies in a window if more windows begin up to it than end before it.
        windows: list[list[int]] = []
        for lo, hi in sorted((lag[j], lead[j] if j < len(lead) else total) for j in range(min(shards, len(lag)))):
            if windows and lo <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], hi)
            else:
                windows.append([lo, hi])
        begun = F.filter(_longs([lo for lo, _ in windows]), lambda lo: lo <= F.col("end"))
        over = F.filter(_longs([hi for _, hi in windows]), lambda hi: hi < F.col("end"))
        inside = F.size(begun) > F.size(over)
        fewer = common.written(near.where(inside))
        now, bytes_near = fewer.agg(F.count(F.lit(1)), F.sum("size")).first()
        if now == count:  # nothing falls out any more: finer ranges decide
            atoms *= 2
        near, count = fewer, now


def _longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _even_cuts(row: DataFrame, capacity: int, total: int, shards: int) -> list[int]:
    """Ends of shards, none over the capacity, in one query. From the end, greedy shards give the least place for each
    cut; from the start, each cut is the end nearest to an even share of the rest, not before that place nor beyond the
    capacity."""
    whole = F.lit(total).cast("long")
    mirrored = F.transform(F.reverse(F.concat(_longs([0]), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))), lambda e: whole - e)
    # back[i]: from total - back[i] on, i + 1 shards are enough.
    row = row.select("ends", _greedy(mirrored, F.lit(capacity).cast("long")).alias("back"))

    def pick(b: Column) -> Column:
        share = b["share"]
        below = F.array_max(F.filter("ends", lambda e: (e >= b["low"]) & (e <= b["high"]) & (e <= share)))
        above = F.array_min(F.filter("ends", lambda e: (e >= b["low"]) & (e <= b["high"]) & (e > share)))
        pair = F.transform(F.array(F.struct(below.alias("below"), above.alias("above"))), lambda p: F.when(p["above"].isNull() | (share - p["below"] <= p["above"] - share), p["below"]).otherwise(p["above"]))
        return F.coalesce(F.get(pair, F.lit(0)), b["start"])

    def step(s: Column, left: Column) -> Column:
        start = s["start"]
        least = F.when(left <= F.size("back"), whole - F.get("back", left - 1)).otherwise(F.lit(0))
        rest, n = whole - start, left.cast("long") + 1
        bounds = F.struct(start.alias("start"), F.greatest(start, least).alias("low"), (start + capacity).alias("high"), (start + ((rest - rest % n) / n).cast("long")).alias("share"))
        cut = F.transform(F.array(bounds), pick)
        return F.struct(F.get(cut, F.lit(0)).alias("start"), F.concat(s["cuts"], cut).alias("cuts"))

    if shards < 2:
        return [total]
    begin = F.struct(F.lit(0).cast("long").alias("start"), _longs([]).alias("cuts"))
    return [*row.select(F.aggregate(F.sequence(F.lit(shards - 1), F.lit(1), F.lit(-1)), begin, step, lambda s: s["cuts"])).first()[0], total]


def shard(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``key, size, text_crc32, law, shard, slot, grown_shard``.

    A row's size is its text's UTF-8 bytes and ``ROW_BYTES``; a null text has no bytes and goes with the empty ones.
    Equal texts share a shard. ``law`` is ``bytes``: the largest shard is as small as contiguous
    groups allow; ``grown_shard`` is null. Slots count up from 0 in each shard, in the order of groups and keys. Null
    keys come first; repeated rows are rows. With fewer groups than shards, some shards stay empty. An empty table
    gives no rows. Columns other than key and text are ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).cast("long").alias("key"), (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("digest"))
    rows = common.written(rows)
    # Only texts that occur again need a look at their group; a hot one is dealt out by the skew join of its rows.
    lowest = F.lit(-(1 << 63)).cast("long")
    copied = rows.groupBy("digest").agg(F.min(F.coalesce("key", lowest)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ranked = rows.join(copied, "digest", "left").withColumn("first", F.coalesce("first", "key", lowest))
    # The digest keeps groups of equal first keys (null or repeated ones) apart.
    placed = common.written(common.ordered_sums(ranked.withColumn("k", F.coalesce("key", lowest)), ["first", "digest", "k"], {"before": "size", "rank": "1"}))
    groups = placed.groupBy("first", "digest").agg(F.min("before").alias("start"), F.sum("size").alias("size")).select("start", "size")
    _, cuts = minimax_cuts(common.written(groups), shards)
    # A row lies in the shard whose end is the first beyond its place; ends are at most as many as shards.
    number = F.size(F.filter(_longs(cuts), lambda c: c <= F.col("before"))).cast("int")
    dealt = placed.withColumn("shard", number)
    firsts = dealt.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    out = dealt.join(F.broadcast(firsts), "shard")  # a row for each shard
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
