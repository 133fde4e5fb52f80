"""Mixing sources to target weights: a token budget is handed down a domain-language-source tree.

Native: DataFrame functions only. Each node's budget goes to its children by their weights. A child that can't use its
share (its leaves hold too few tokens, even over all allowed epochs) gives the rest to its siblings by theirs, and
only what all siblings can't use goes to its parent's siblings: a node never gets more than its leaves can hold. Each
leaf then takes whole seeded epochs, and of its last one the documents that come first in the epoch's order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Target tables of up to so many leaves go to every task with their join.
BROADCAST_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")
_TARGETS = "domain string, lang string, source string, domain_weight long, lang_weight long, source_weight long"


def targets_table(spark, tree: dict) -> DataFrame:
    """Leaves of ``{domain: (weight, {lang: (weight, {source: weight})})}``; weights are whole numbers."""
    rows = [(d, g, s, dw, gw, sw) for d, (dw, langs) in tree.items() for g, (gw, sources) in langs.items() for s, sw in sources.items()]
    return spark.createDataFrame(rows, _TARGETS)


def token_count(text: str):
    """Runs of bytes other than white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _filled(children: DataFrame, parent: list[str], name: str, budget: str, out: str) -> DataFrame:
    """Adds ``out``: what each child of a parent gets of its ``budget``, given ``weight`` and ``room`` of each.

    In ascending order of room per weight, children are full for as long as their fair share of what is left is no
    less than their room; the others share the rest by weight, in whole tokens."""
    ratio = F.when(F.col("weight") > 0, F.col("room") / F.col("weight")).otherwise(F.lit(0.0))
    w = Window.partitionBy(*parent).orderBy(ratio, name)
    before, onward = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    seen = children.withColumn("_left", F.col(budget) - F.coalesce(F.sum("room").over(before), F.lit(0))).withColumn("_weights", F.sum("weight").over(onward))
    full = seen.withColumn("_full", F.col("room") * F.col("_weights") <= F.col("_left") * F.col("weight"))
    every = Window.partitionBy(*parent)
    first = F.min_by(F.when(~F.col("_full"), F.struct("_left", "_weights")), F.when(~F.col("_full"), F.struct(ratio, F.col(name)))).over(every)
    got = full.withColumn("_first", first).withColumn(out, F.when(F.col("_full"), F.col("room")).otherwise(F.expr("(_first._left * weight) div _first._weights")))
    return got.drop("_left", "_weights", "_full", "_first")


def budgets(leaves: DataFrame, budget: int | None = None, share: float | None = None) -> DataFrame:
    """``domain, lang, source, supply, alloc`` from leaves with weights, ``supply`` and ``room``. The budget is so many
    tokens, or so great a share of all supplies, and no more than all rooms. One row for each leaf comes out."""
    top = F.lit(budget) if budget is not None else F.floor(F.sum("supply") * F.lit(share))
    root = leaves.agg(F.least(F.coalesce(top, F.lit(0)), F.coalesce(F.sum("room"), F.lit(0))).cast("long").alias("root")).first()["root"]
    domains = leaves.groupBy("domain").agg(F.max("domain_weight").alias("weight"), F.sum("room").alias("room")).withColumn("b", F.lit(root).cast("long")).withColumn("top", F.lit(0))
    domains = _filled(domains, ["top"], "domain", "b", "given").select("domain", F.col("given").alias("b"))
    langs = leaves.groupBy("domain", "lang").agg(F.max("lang_weight").alias("weight"), F.sum("room").alias("room")).join(domains, "domain")
    langs = _filled(langs, ["domain"], "lang", "b", "given").select("domain", "lang", F.col("given").alias("b"))
    own = leaves.withColumn("weight", F.col("source_weight")).join(langs, ["domain", "lang"])
    return _filled(own, ["domain", "lang"], "source", "b", "alloc").select(*LEVELS, "supply", "alloc")


def mix(docs: DataFrame, targets: DataFrame, *, budget: int | None = None, share: float | None = None, epochs: int = 1, seed: int = 0, key: str = "doc_id", text: str = "text", repeat: bool = False) -> DataFrame:
    """``docs`` with ``domain, tokens, alloc, copies``, only rows with at least one copy; with ``repeat`` each row as
    many times as it has copies and the columns of ``docs`` alone.

    ``docs`` must have ``lang`` and ``source``; a pair of them belongs to one domain in ``targets``. Rows of other
    pairs, and rows with a null in either, have no weight and are left out; so are leaves of weight 0. An epoch's order is
    that of md5(seed:epoch:key); rows of one key come together, a null key counts as the text "null". A leaf's prefix
    ends before the first document that would go beyond its budget. Null and empty texts have no tokens and come with
    the prefix they lie in. Leaves without rows give up their share; an empty table gives no rows. Other columns, also
    such as clash in name with those added, are kept and win (none may be named __leaf, __copies or __i).
    """
    spark = docs.sparkSession
    leaves = common.written(targets.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], _TARGETS).schema]))
    small = F.broadcast if leaves.count() <= BROADCAST_LEAVES else (lambda x: x)
    ids = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    sized = docs.select(ids.alias("k"), "lang", "source", token_count(text).alias("tokens")).join(small(leaves.select(*LEVELS)), ["lang", "source"])
    sized = common.written(sized.groupBy(*LEVELS, "k").agg(F.sum("tokens").alias("tokens")))
    supply = sized.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"))
    room = F.when((F.col("domain_weight") > 0) & (F.col("lang_weight") > 0) & (F.col("source_weight") > 0), F.col("supply") * epochs).otherwise(F.lit(0))
    stocked = common.written(leaves.join(supply, list(LEVELS), "left").withColumn("supply", F.coalesce("supply", F.lit(0))).withColumn("room", room.cast("long")))
    plan = budgets(stocked, budget, share)
    plan = plan.withColumn("full", F.when(F.col("supply") > 0, F.expr("alloc div supply")).otherwise(F.lit(0)).cast("int"))
    plan = common.written(plan.withColumn("rest", F.col("alloc") - F.col("full") * F.col("supply")))

    def rank(epoch, k):
        return F.md5(F.concat(F.lit(f"{seed}:"), (epoch + 1).cast("string"), F.lit(":"), k).cast("binary"))

    # Of the last epoch: the first 3 digits of a rank make 4,096 ranges of a leaf. Their sums show the one that the
    # budget ends in; only that range's rows are put in order.
    ranked = sized.join(small(plan.select(*LEVELS, "full", "rest")), list(LEVELS)).withColumn("rank", rank(F.col("full"), F.col("k")))
    ranked = ranked.withColumn("part", F.substring("rank", 1, 3))
    sums = ranked.groupBy(*LEVELS, "part", "rest").agg(F.sum("tokens").alias("n"))
    order = Window.partitionBy(*LEVELS).orderBy("part")
    ends = sums.withColumn("end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = ends.where("end > rest").groupBy(*LEVELS).agg(F.min_by(F.struct("part", (F.col("end") - F.col("n")).alias("base")), "part").alias("last"))
    last = common.written(last.select(*LEVELS, F.col("last.part").alias("last_part"), F.col("last.base").alias("base")))
    inside = ranked.join(small(last), list(LEVELS)).where("part = last_part")
    run = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("rank", "k").rowsBetween(Window.unboundedPreceding, 0))
    cut = inside.withColumn("end", run + F.col("base")).where("end <= rest").groupBy(*LEVELS).agg(F.max(F.struct("rank", "k")).alias("cut"))
    final = plan.join(last, list(LEVELS), "left").join(cut, list(LEVELS), "left").select(*LEVELS, "alloc", "full", "last_part", "cut")
    # One column, so that no name of the documents clashes.
    final = common.written(final.select(F.struct("*").alias("__leaf")))
    held = docs.join(small(final), (F.col("lang") == F.col("__leaf.lang")) & (F.col("source") == F.col("__leaf.source")))
    mine = rank(F.col("__leaf.full"), ids)
    part = F.substring(mine, 1, 3)
    taken = (part < F.col("__leaf.last_part")) | ((part == F.col("__leaf.last_part")) & (F.struct(mine, ids) <= F.struct("__leaf.cut.rank", "__leaf.cut.k")))
    held = held.withColumn("__copies", F.col("__leaf.full") + F.coalesce(taken, F.lit(False)).cast("int")).where("__copies > 0")
    if repeat:
        return held.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
    more = {"domain": F.col("__leaf.domain"), "tokens": token_count(text), "alloc": F.col("__leaf.alloc"), "copies": F.col("__copies")}
    return held.select(*docs.columns, *[c.alias(n) for n, c in more.items() if n not in docs.columns])
