"""A training corpus in five stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return rows of ``docs`` with their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, mixing, ngram_join, quality, queries

#: Share of the tokens that come in which the mixture spends; no document comes twice.
MIX_SHARE = 0.95


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 1."""
    return quality.keep_good(docs, quality.fit(docs, quality.learnable(queries.table(spark, sf_dir, "labels"))))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row with the least id; rows without an id or with a blank text stay. Rows are
    told apart by id and text, so that rows of one id with other texts stay or go by themselves. Of several rows with that
    id and text the one whose columns, as JSON, have the least digest stays. A row's columns travel as one value, so that
    they may have any names and kinds."""
    found = common.written(ngram_join.near_rows(docs).where("key is not null and n > 0").select("row", "key", "root"))
    least = found.groupBy("root").agg(F.min(F.struct("key", "row")).alias("least")).select(F.col("least.row").alias("row"))
    rows = found.groupBy("row").count()
    copies = rows.join(least, "row", "left_anti").select("row")
    repeated = rows.join(least, "row", "left_semi").where("count > 1").select("row")
    whole = docs.select(ngram_join.row_hash().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    stay = whole.join(copies, "row", "left_anti")
    once = stay.join(repeated, "row", "left_semi").groupBy("row").agg(F.min_by("doc", F.md5(F.to_json("doc").cast("binary"))).alias("doc"))
    return stay.join(repeated, "row", "left_anti").unionByName(once).select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture of sources with target weights."""
    return mixing.mix(docs, mixing.targets_table(spark, queries.MIX_TREE), share=MIX_SHARE, epochs=1, seed=20240229, repeat=True)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus, and each document's place in them."""
    return queries.token_output(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", token_files),
]

#: The stages train, search and tokenize, which SQL can't express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
