"""License scans: MinHash bands over overlapping word windows retrieve templates; exact shingle containment decides.

Native: DataFrame functions only. A template of m shingles (runs of five words) is looked for in windows that begin at
every quarter of m and are long enough to hold it at any offset, so a window that holds a copy has a Jaccard
similarity with it of 0.67 or more. A window's signature has ``BANDS`` bands of one row each: the least shingle hash under as
many orders (exclusive or with a constant). Window and template collide in a band if they have the same least shingle.
All twelve bands miss in 0.000002 of cases at 0.67; a window that holds just 80 hundredths of the shingles can have a
similarity as low as 0.54, at which they miss in 0.0001.

A window can only collide in a band if it holds the template's least shingle of that band. So the places of those few
shingles are looked up first, and the windows over them are then compared by their own least shingle: the same
collisions as from a table of all windows' signatures, without making it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, BANDS = 5, 12
#: Shares of a template's shingles that a window must hold, in hundredths.
CONTAINED = 80
#: Templates up to so many shingles together are held by every task.
BROADCAST_SHINGLES = 200_000
#: Least shingles up to so many are listed in the scan's filter; beyond, all places of a text are joined with them.
LISTED = 20_000
#: Constants of the bands' orders.
ORDERS = [(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)) - (1 << 63) for i in range(BANDS)]


@dataclass(frozen=True)
class Template:
    name: str
    text: str


# Short license notices as their owners publish them.
NOTICES = [
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("mit", "Released under the MIT License."),
    Template("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]


def shingles(text: Column) -> Column:
    """64-bit hashes of all runs of five words (letters and digits, lower-cased), in order."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(SHINGLE)]))

    # The words are made once and bound as the one element of an array.
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) >= SHINGLE, runs(w)).otherwise(F.array().cast("array<bigint>")))
    return F.get(made, F.lit(0))


def _least(hashes: Column, order: Column) -> Column:
    """The hash that is least under an order."""
    return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(order))).bitwiseXOR(order)


def template_index(spark: SparkSession, templates: DataFrame | list[Template]) -> DataFrame:
    """``id, name, shingles, m, step, span`` of each template of five words or more."""
    rows = templates if isinstance(templates, DataFrame) else spark.createDataFrame([(t.name, t.text) for t in templates], "name string, text string")
    rows = rows.select(F.monotonically_increasing_id().alias("id"), "name", F.array_distinct(shingles(F.col("text"))).alias("shingles")).where(F.size("shingles") > 0).withColumn("m", F.size("shingles"))
    step = F.greatest(F.lit(1), F.floor((F.col("m") + 3) / 4)).cast("int")
    rows = rows.withColumn("step", step)
    # m shingles from any offset lie in so many whole steps.
    return rows.withColumn("span", ((F.ceil((F.col("m") - 1) / F.col("step")) + 1) * F.col("step")).cast("int"))


def scan(docs: DataFrame, templates: DataFrame | list[Template] = NOTICES, *, key: str = "doc_id", text: str = "text", contained: int = CONTAINED) -> DataFrame:
    """``key, license, windows, containment, first_word`` for each row and template of which a window holds
    ``contained`` hundredths of the shingles: matching windows, the greatest share, and the first word (from 0) of the
    first matching window.

    ``templates`` may be a table of ``name`` and ``text`` (whole licenses, say); templates of one name count together.
    Texts are scanned whole. Null and empty texts, and texts and templates of fewer than five words, match nothing.
    Rows with null keys are scanned, and rows of one key and text are counted together. No templates or an empty table
    give no rows. Columns other than key and text are ignored. A place that can match carries the words around it
    alone, twice the widest window, however long its text is.
    """
    spark = docs.sparkSession
    index = common.written(template_index(spark, templates))
    n, total, reach = index.agg(F.count(F.lit(1)), F.sum("m"), F.max("span")).first()
    if not n:
        schema = "license string, windows long, containment double, first_word int"
        return spark.createDataFrame([], f"`{key}` {docs.schema[key].dataType.simpleString()}, {schema}")
    small = F.broadcast if total <= BROADCAST_SHINGLES else (lambda x: x)
    order = F.element_at(F.array(*[F.lit(c).cast("long") for c in ORDERS]), F.col("band") + 1)
    banded = index.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn("least", _least(F.col("shingles"), order))
    banded = common.written(banded.select("id", "band", "least", "step", "span"))
    rows = docs.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("t")).select("k", "row", shingles(F.col("t")).alias("hashes"))
    spots = F.transform("hashes", lambda h, i: F.struct(i.alias("at"), h.alias("least")))
    if n * BANDS <= LISTED:
        held = [r.least for r in banded.select("least").distinct().collect()]
        spots = F.filter(spots, lambda s: s["least"].isin(held))
    begin = lambda s: F.greatest(s["at"] - (reach - 1), F.lit(0))
    spots = F.transform(spots, lambda s: F.struct(s["at"].alias("at"), s["least"].alias("least"), begin(s).alias("base"), F.slice("hashes", begin(s) + 1, 2 * reach).alias("around")))
    # An outer explode: an inner one would have its filter pushed down and the hashes made twice.
    found = rows.withColumn("spots", spots).select("k", "row", F.explode_outer("spots").alias("spot")).where("spot is not null")
    hits = found.select("k", "row", "spot.*").join(small(banded), "least")
    # Windows begin at multiples of the step; those over the place are compared.
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("span") + 1) / F.col("step"))).cast("int")
    last = F.floor(F.col("at") / F.col("step")).cast("int")
    hits = hits.withColumn("window", F.explode(F.sequence(first, last))).withColumn("start", F.col("window") * F.col("step"))
    inside = F.slice("around", F.col("start") - F.col("base") + 1, F.col("span"))
    collided = hits.withColumn("inside", inside).where(_least(F.col("inside"), order) == F.col("least"))
    checked = collided.join(small(index.select("id", "name", "shingles", "m")), "id").withColumn("shared", F.size(F.array_intersect("shingles", "inside")))
    matched = checked.where(F.col("shared") * 100 >= F.col("m") * contained).select("k", "row", "name", "start", "shared", "m").distinct()
    out = matched.groupBy("k", "name").agg(F.countDistinct("row", "start").alias("windows"), F.round(F.max(F.col("shared") / F.col("m")), 4).alias("containment"), F.min("start").cast("int").alias("first_word"))
    return out.select(F.col("k").alias(key), F.col("name").alias("license"), "windows", "containment", "first_word")
