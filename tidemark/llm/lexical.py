"""Ranked lexical search: the k best documents of each item by summed term impacts, exact for any number of documents.

A document's score for an item is the sum, over the item's terms, of the term's weight (rarer is more) times a share that
grows with the term's occurrences and falls with the document's length; everything is in integers. The search is a join of
items and documents that is seeded by thresholds:

1. One pass over the texts keeps, of each document, its number of terms and the occurrences of terms that some item has.
2. For each term the k highest shares among all documents are found. k documents have at least the term's k-th impact, so
   the greatest of an item's k-th impacts is a bound that the item's k-th score can't fall below.
3. An item's terms are put in order of their highest impact. Where the sum of the last ones stays below the bound, a
   document that has none of the others can't be among the best: only the others ("leading" terms) make candidates.
4. Each task scores the candidates among its documents by their leading terms, drops those which the bound of the other
   terms shows to be too low, and adds the exact impacts of the other terms for what is left. The bound rises to the k-th
   score that the task has seen. Tasks give the best k of their documents, of which the best k are taken.

Documents are never sorted or shuffled as texts; what is shuffled is at most k rows for each task and term, or item.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textcore

#: Terms of items in a block, at most (or those of one item); a pass over the documents searches one block.
BLOCK_TERMS = 1 << 20
#: Pairs of documents' and items' terms that are handled at once.
PAIRS = 1 << 20
#: Fixed values of the score: parts of a share, the length's part of a hundred and its factor, and a weight's scale.
SHARE, LENGTH_PART, LENGTH_FACTOR, SCALE = 1_000_000_000, 75, 8, 1000


def _counted(words: np.ndarray, bounds: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, terms and occurrences of each term in each text, sorted by both; with ``known`` (sorted) of those terms."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    known = np.unique(words) if known is None else known
    if not len(known):
        return text[:0], words[:0], text[:0]
    at = np.searchsorted(known, words)
    at[at == len(known)] = 0
    keep = known[at] == words
    pairs, n = np.unique(text[keep] * len(known) + at[keep], return_counts=True)
    return pairs // len(known), known[pairs % len(known)], n


def _lists(values: np.ndarray, text: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values of sorted texts as a list for each of n texts."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


def _terms_of(known_files: list[str] | None, key: str) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if known_files is None else np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(common.map_in(f), np.int64) for f in known_files)])
        for batch in batches:
            data, offs = textcore.buffers(batch.column(1))
            for lo, hi in textcore.chunks(offs):
                part, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, ends, bounds = textcore.spans(part, o, textcore.BY_LETTER)
                text, term, n = _counted(textcore.signed(textcore.word_hashes(part, starts, ends)), bounds, known)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64()), _lists(term, text, hi - lo, pa.int64()), _lists(n, text, hi - lo, pa.int64())],
                    names=[key, "n", "terms", "counts"],
                )

    return count


_ROW = "n long, terms array<long>, counts array<long>"


def _write_vocabulary(folder: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/terms-{uuid.uuid4().hex}"
        n = 0
        with common.open_out(name) as f:
            for batch in batches:
                values = batch.column(0).to_numpy()
                f.write(values.tobytes())
                n += len(values)
        if n:
            yield pa.RecordBatch.from_pydict({"file": [name]})

    return write


def _vocabulary(wanted: DataFrame) -> list[str]:
    """Files of the distinct terms, in ascending order over all files; a task maps them all: 8 bytes for each term that
    items have."""
    folder = common.shared_dir(wanted.sparkSession)
    terms = wanted.select("term").distinct().repartitionByRange(8, "term").sortWithinPartitions("term")
    files = common.written(terms.mapInArrow(_write_vocabulary(folder), "file string").withColumn("part", F.spark_partition_id()), f"{folder}/files.parquet")
    return [r.file for r in files.orderBy("part").collect()]  # eight names


def _shares(n: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return SHARE * counts // (SCALE * counts + LENGTH_FACTOR * np.repeat(n, sizes))


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _highest(k: int) -> Callable:
    """For each term of a task's documents: its documents, and its k highest shares."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        seen, n_docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            sizes = np.diff(batch.column("terms").offsets.to_numpy())
            term = _flat(batch, "terms")
            share = _shares(batch.column("m").to_numpy(), _flat(batch, "counts"), sizes)
            both = np.concatenate([seen, term])
            seen, at = np.unique(both, return_inverse=True)
            n_docs = np.bincount(at, np.concatenate([n_docs, np.ones(len(term), np.int64)]), len(seen)).astype(np.int64)
            term, share = np.concatenate([held[0], term]), np.concatenate([held[1], share])
            order = np.lexsort((-share, term))
            term, share = term[order], share[order]
            place = np.arange(len(term)) - np.searchsorted(term, term)
            held = (term[place < k], share[place < k])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n_docs), pa.ListArray.from_arrays(pa.array(np.searchsorted(held[0], np.append(seen, np.iinfo(np.int64).max)).astype(np.int32)), pa.array(held[1]))], names=["term", "df", "shares"])

    return find


class Block:
    """Items of a block: for each term the items that have it, leading ones first."""

    def __init__(self, names: list[str]):
        read = lambda kind: np.concatenate([np.frombuffer(common.map_in(f"{name}.{kind}"), np.int64) for name in names])
        self.item, self.term, self.impact, self.leading, self.most = read("item"), read("term"), read("impact"), read("leading") > 0, read("most")
        self.items, at = np.unique(self.item, return_inverse=True)
        self.floor = np.zeros(len(self.items), np.int64)
        self.floor[at] = read("floor")
        self.item = at
        lead = np.flatnonzero(self.leading)
        lead = lead[np.argsort(self.term[lead], kind="stable")]
        #: Leading terms with their items, in the order of terms.
        self.lead_terms, first = np.unique(self.term[lead], return_index=True)
        self.lead_from, self.lead = np.append(first, len(lead)), lead
        rest = np.flatnonzero(~self.leading)
        self.rest = rest[np.argsort(self.item[rest], kind="stable")]
        self.rest_from = np.searchsorted(self.item[self.rest], np.arange(len(self.items) + 1))
        #: What the terms that don't lead can add to an item's score at most.
        self.rest_most = np.zeros(len(self.items), np.int64)
        np.add.at(self.rest_most, self.item[rest], self.most[rest])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (sizes[i] numbers) for all i."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


class Best:
    """The k best documents of each item so far: by score, then key (the missing last)."""

    def __init__(self, block: Block, k: int):
        self.k, self.floor, self.rows = k, block.floor.copy(), None

    def add(self, item: np.ndarray, score: np.ndarray, key: pa.Array) -> None:
        made = pa.table({"item": item, "score": score, "key": key})
        made = made if self.rows is None else pa.concat_tables([self.rows, made])
        made = made.sort_by([("item", "ascending"), ("score", "descending"), ("key", "ascending")])
        item = made.column("item").to_numpy()
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.rows = made.take(pa.array(np.flatnonzero(place < self.k))).combine_chunks()
        full = np.flatnonzero(place == self.k - 1)
        np.maximum.at(self.floor, item[full], made.column("score").to_numpy()[full])


def _score(block: Block, best: Best, keys: pa.Array, doc: np.ndarray, term: np.ndarray, share: np.ndarray, most: int) -> None:
    """Scores documents (numbers of ``keys``; terms sorted within each) against all items of a block."""
    at = np.searchsorted(block.lead_terms, term)
    at[at == len(block.lead_terms)] = 0
    hit = np.flatnonzero(block.lead_terms[at] == term) if len(block.lead_terms) else np.zeros(0, np.int64)
    starts, sizes = block.lead_from[at[hit]], block.lead_from[at[hit] + 1] - block.lead_from[at[hit]]
    ends = np.cumsum(sizes)
    hit_doc = doc[hit]
    n_items, n_terms = len(block.items), len(term)
    names, where = np.unique(term, return_inverse=True)
    have = doc * len(names) + where
    lo = 0
    while lo < len(hit):
        # Whole documents, of some ``most`` pairs of terms.
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right"))
        hi = len(hit) if hi >= len(hit) else int(np.searchsorted(hit_doc, hit_doc[hi], "left"))
        if hi <= lo:
            hi = int(np.searchsorted(hit_doc, hit_doc[lo], "right"))
        row = block.lead[_spread(starts[lo:hi], sizes[lo:hi])]
        of = np.repeat(hit[lo:hi], sizes[lo:hi])
        pair = doc[of] * n_items + block.item[row]
        pairs, place = np.unique(pair, return_inverse=True)
        score = np.zeros(len(pairs), np.int64)
        np.add.at(score, place, block.impact[row] * share[of])
        item = pairs % n_items
        keep = score + block.rest_most[item] >= best.floor[item]
        pairs, score, item = pairs[keep], score[keep], item[keep]
        # The other terms of the candidates, looked up among their documents' terms.
        n_rest = block.rest_from[item + 1] - block.rest_from[item]
        for a, z in _cuts(n_rest, most):
            row = block.rest[_spread(block.rest_from[item[a:z]], n_rest[a:z])]
            of = np.repeat(np.arange(a, z), n_rest[a:z])
            slot = np.searchsorted(names, block.term[row])
            slot[slot == len(names)] = 0
            want = (pairs[of] // n_items) * len(names) + slot
            found = np.searchsorted(have, want)
            found[found == n_terms] = 0
            ok = np.flatnonzero((have[found] == want) & (names[slot] == block.term[row]))
            np.add.at(score, of[ok], block.impact[row[ok]] * share[found[ok]])
        keep = (score >= best.floor[item]) & (score > 0)
        best.add(item[keep], score[keep], keys.take(pa.array(pairs[keep] // n_items)))
        lo = hi


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges whose sizes sum up to some ``most``."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _searcher(names: list[str], k: int, most: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = best = None
        for batch in batches:
            if block is None:
                block = Block(names)
                best = Best(block, k)
            sizes = np.diff(batch.column("terms").offsets.to_numpy())
            share = _shares(batch.column("m").to_numpy(), _flat(batch, "counts"), sizes)
            _score(block, best, batch.column("key"), np.repeat(np.arange(batch.num_rows), sizes), _flat(batch, "terms"), share, most)
        if best is not None and best.rows is not None and len(best.rows):
            item, score, key = (best.rows.column(c).combine_chunks() for c in ("item", "score", "key"))
            yield pa.RecordBatch.from_arrays([pa.array(block.items[item.to_numpy()]), score, key], names=["item", "score", "key"])

    return search


def _block_writer(folder: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = f"{folder}/items-{uuid.uuid4().hex}", [b for b in batches if b.num_rows]
        if not held:
            return
        for kind in ("item", "term", "impact", "leading", "most", "floor"):
            with common.open_out(f"{name}.{kind}") as f:
                f.write(np.concatenate([b.column(kind).to_numpy() for b in held]).tobytes())
        yield pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([sum(b.num_rows for b in held)], pa.int64())})

    return write


def _grouped(files: list) -> list[list[str]]:
    """Names of files, put together up to BLOCK_TERMS rows."""
    out, n = [], 0
    for r in files:
        if not out or n + r.n > BLOCK_TERMS:
            out, n = [*out, []], 0
        out[-1].append(r.file)
        n += r.n
    return out


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_key, rank, key, score``: the k documents with the highest scores above 0 for each row of ``items``, equal
    scores by key (null last); fewer where fewer have one.

    Terms are runs of letters, digits and non-ASCII characters, with A-Z lower-cased, and an item's repeats count. Null and
    empty texts have no terms, and such items no rows. Rows with null or repeated keys, of either table, are documents and
    items of their own. Texts are whole; other columns are ignored; empty tables give no rows. A task holds one block of
    items (some 100 MB at most) with k rows for each; more items take more passes over the counted terms, not over the
    texts. A term is known by 64 bits of hash.
    """
    spark = docs.sparkSession
    # Items are numbered by ranges: a number has the range in its upper bits.
    asked = common.written(items.select(F.col(item_key).alias("key"), F.col(item_text).cast("string").alias("t")).withColumn("item", F.monotonically_increasing_id()))
    names = asked.select("item", F.col("key").alias(item_key))
    wanted = asked.select("item", "t").mapInArrow(_terms_of(None, "item"), f"item long, {_ROW}")
    wanted = common.written(wanted.select("item", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("item", "t.terms", "t.counts").toDF("item", "term", "times"))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    counted = common.written(rows.mapInArrow(_terms_of(_vocabulary(wanted), "key"), f"key {kind}, {_ROW}").where("n > 0"))
    n, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    # Decimals, since the product may need more than 64 bits.
    m = F.expr(f"{100 - LENGTH_PART} + cast((cast({LENGTH_PART * n} as decimal(38,0)) * n) div {length or 1} as long)")
    having = counted.where("size(terms) > 0").select("key", m.alias("m"), "terms", "counts")
    parts = common.written(having.select("m", "terms", "counts").mapInArrow(_highest(k), "term long, df long, shares array<long>"))
    df = parts.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(float(SCALE)) * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("share")))
    top = parts.select("term", F.explode("shares").alias("share")).withColumn("place", place).where(F.col("place") <= k)
    top = top.groupBy("term").agg(F.max("share").alias("first"), F.max(F.when(F.col("place") == k, F.col("share"))).alias("last"))
    terms = df.join(top, "term").select("term", weight.alias("w"), "first", F.coalesce("last", F.lit(0)).alias("last")).where("w > 0")
    made = wanted.join(terms, "term").withColumn("impact", F.col("w") * F.col("times"))
    made = made.withColumns({"most": F.col("impact") * F.col("first"), "floor": F.max(F.col("impact") * F.col("last")).over(Window.partitionBy("item"))})
    # From the least impact up: while the sum stays below the item's bound, a term need not lead.
    rising = Window.partitionBy("item").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumn("leading", (F.sum("most").over(rising) >= F.col("floor")).cast("long"))
    made = common.written(made.select("item", "term", "impact", "leading", "most", "floor"))
    folder = common.shared_dir(spark)
    dealt = made.repartition(-(-made.count() // BLOCK_TERMS) or 1, "item").sortWithinPartitions("item", "term")
    files = common.written(dealt.mapInArrow(_block_writer(folder), "file string, n long"), f"{folder}/files.parquet")
    ddl = f"item long, score long, key {kind}"
    found = spark.createDataFrame([], ddl)
    for block in _grouped(files.orderBy("file").collect()):  # a name for each block of up to a million terms
        found = found.unionByName(having.mapInArrow(_searcher(block, k, PAIRS), ddl))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(names, "item").select(item_key, "rank", F.col("key").alias(key), "score")
