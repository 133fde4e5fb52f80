"""Benchmark decontamination: sparse word suffix arrays of the documents, searched for every suffix of every test item.

The test items are hashed word by word and written as blocks in the shared folder; a task takes a batch of documents as
shards and maps one block after the other for it, so neither side has to fit in memory. For a block, the shard's suffix array has
the suffixes whose first word pair occurs in the block (no other suffix can match two words), in the order of their
word hashes. All test suffixes are binary-searched in it together, word by word; what is left of a suffix's range
after ``window`` words are its verbatim occurrences, which are then extended to the longest match.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textcore

WINDOW = 13
#: Bytes of text in a shard of documents, and in a block of test items; a longer text stands alone, whole.
SHARD_BYTES, BLOCK_BYTES = 2 << 20, 4 << 20
_LEAD_BITS = 22
#: Words of the items of a block, at most (or those of one file).
BLOCK_WORDS = 1 << 20
#: Blocks that a task holds at once, each some 100 MB at most.
HELD_BLOCKS = 2
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_pos", pa.int64()), ("doc_pos", pa.int64()), ("length", pa.int64())]))


def _block_writer(folder: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ["null" if x is None else x for x in batch.column(0).to_pylist()]
            data, offs = textcore.buffers(batch.column(1))
            for lo, hi in textcore.chunks(offs, BLOCK_BYTES):
                part, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, ends, bounds = textcore.spans(part, o, textcore.BY_LETTER)
                if not len(starts):
                    continue
                name = f"{folder}/items-{uuid.uuid4().hex}"
                for kind, values in (("words", textcore.word_hashes(part, starts, ends)), ("bounds", bounds.astype(np.int64))):
                    with common.open_out(f"{name}.{kind}") as f:
                        f.write(values.tobytes())
                with common.open_out(f"{name}.ids") as f:
                    f.write(json.dumps(ids[lo:hi]).encode())
                yield pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([len(starts)], pa.int64())})

    return write


class Block:
    """Hashed items, mapped from written files."""

    def __init__(self, names: tuple[str, ...], window: int):
        words, bounds = ([np.frombuffer(common.map_in(f"{name}.{kind}"), dtype) for name in names] for kind, dtype in (("words", np.uint64), ("bounds", np.int64)))
        before = np.cumsum([0, *map(len, words[:-1])])
        self.words = np.concatenate(words)
        self.bounds = np.concatenate([np.zeros(1, np.int64), *(b[1:] + n for b, n in zip(bounds, before, strict=True))])
        self.ids = [x for name in names for x in json.loads(bytes(common.map_in(f"{name}.ids")))]
        n = np.diff(self.bounds)
        item = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(self.words))
        #: What each suffix must match: a window, or all of a shorter item.
        need = np.minimum(n, window)[item]
        keep = self.bounds[1:][item] - pos >= need
        self.at, self.item, self.need = pos[keep], item[keep], need[keep]
        self.pairs = int(self.need.min()) >= 2
        lead = lead_hashes(self.words, self.pairs)[self.at]
        self.seen = np.zeros(1 << _LEAD_BITS, bool)
        self.seen[lead >> np.uint64(64 - _LEAD_BITS)] = True


def lead_hashes(words: np.ndarray, pairs: bool) -> np.ndarray:
    """A hash of each word and, with ``pairs``, the next."""
    if not pairs:
        return words
    out = words.copy()
    out[:-1] += words[1:] * np.uint64(0xD1342543DE82EF95)
    return textcore.mix(out)


def _bisect(column: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while len(act := np.flatnonzero(lo < hi)):
        mid = (lo[act] + hi[act]) >> 1
        below = column[mid] <= key[act] if right else column[mid] < key[act]
        lo[act[below]] = mid[below] + 1
        hi[act[~below]] = mid[~below]
    return lo


def search(words: np.ndarray, bounds: np.ndarray, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Occurrences in the shard of what the block's suffixes must match: places in the shard, and suffixes."""
    lead = lead_hashes(words, block.pairs)
    sa = np.flatnonzero(block.seen[lead >> np.uint64(64 - _LEAD_BITS)])
    if not len(sa):
        return
    stop = bounds[1:][np.searchsorted(bounds, sa, "right") - 1]
    depth = int(block.need.max())
    # Column d holds each suffix's d-th next word, or 0 beyond its text's end; the array is in their order.
    columns = [np.where(sa + d < stop, words[np.minimum(sa + d, len(words) - 1)], np.uint64(0)) for d in range(depth)]
    order = np.lexsort(columns[::-1])
    sa, columns = sa[order], [c[order] for c in columns]
    suffix = np.arange(len(block.at))
    lo, hi = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(sa), np.int64)
    for d in range(depth):
        key = block.words[block.at[suffix] + d]
        lo, hi = _bisect(columns[d], key, lo, hi, False), _bisect(columns[d], key, lo, hi, True)
        left = lo < hi
        suffix, lo, hi = suffix[left], lo[left], hi[left]
        if len(done := np.flatnonzero(block.need[suffix] == d + 1)):
            n = hi[done] - lo[done]
            skip = np.repeat(lo[done] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            yield sa[np.arange(n.sum()) + skip], np.repeat(suffix[done], n)
            more = block.need[suffix] > d + 1
            suffix, lo, hi = suffix[more], lo[more], hi[more]
        if not len(suffix):
            return


def longest(words: np.ndarray, bounds: np.ndarray, block: Block, at: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, ...]:
    """The matches that don't go on to the left, extended to the right: place, item, place in the item, words."""
    doc = np.searchsorted(bounds, at, "right") - 1
    item, pos = block.item[suffix], block.at[suffix]
    begun = (at > bounds[doc]) & (pos > block.bounds[item])
    begun &= words[at - 1] == block.words[pos - 1]
    at, item, pos, doc, n = at[~begun], item[~begun], pos[~begun], doc[~begun], block.need[suffix][~begun].astype(np.int64)
    act = np.arange(len(at))
    while len(act):
        on = (at[act] + n[act] < bounds[doc[act] + 1]) & (pos[act] + n[act] < block.bounds[item[act] + 1])
        act = act[on]
        act = act[words[at[act] + n[act]] == block.words[pos[act] + n[act]]]
        n[act] += 1
    return at, item, pos - block.bounds[item], n


class _Shard:
    """Some texts of a batch as hashed words, and what was found in them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int, last: int):
        part, o = data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        starts, ends, self.bounds = textcore.spans(part, o, textcore.BY_LETTER)
        self.first, self.last, self.words = first, last, textcore.word_hashes(part, starts, ends)
        self.cover, self.longest = np.zeros(len(self.words) + 1, np.int32), np.zeros(last - first, np.int64)
        self.items: dict[int, set] = defaultdict(set)
        self.matches: dict[int, list] = defaultdict(list)

    def search(self, block: Block, listed: bool, detail: bool) -> None:
        for at, suffix in search(self.words, self.bounds, block) if len(self.words) else ():
            at, item, pos, n = longest(self.words, self.bounds, block, at, suffix)
            np.add.at(self.cover, at, 1)
            np.add.at(self.cover, at + n, -1)
            doc = np.searchsorted(self.bounds, at, "right") - 1
            np.maximum.at(self.longest, doc, n)
            if listed:
                for d, i in zip(*np.unique(np.stack([doc, item]), axis=1).tolist(), strict=True):
                    self.items[d].add(block.ids[i])
            if detail:
                for d, i, p, a, m in zip(doc.tolist(), item.tolist(), pos.tolist(), (at - self.bounds[doc]).tolist(), n.tolist(), strict=True):
                    self.matches[d].append({"item_id": block.ids[i], "item_pos": p, "doc_pos": a, "length": m})


def _finder(blocks: list[tuple[str, ...]], window: int, share: int, text_at: int, only_clean: bool, detail: bool = True) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lru_cache(HELD_BLOCKS)(lambda names: Block(names, window))
        for batch in batches:
            data, offs = textcore.buffers(batch.column(text_at))
            shards = [_Shard(data, offs, first, last) for first, last in textcore.chunks(offs, SHARD_BYTES)]
            for names in blocks:  # each is read once for a batch
                for shard in shards:
                    shard.search(load(names), not only_clean, detail and not only_clean)
            for s in shards:
                hit = np.concatenate([[0], np.cumsum(np.cumsum(s.cover[:-1]) > 0)])
                n_words, n_hit, rows = np.diff(s.bounds), hit[s.bounds[1:]] - hit[s.bounds[:-1]], batch.slice(s.first, s.last - s.first)
                contaminated = (n_hit > 0) & (share * n_hit >= n_words)
                if only_clean:
                    yield rows.filter(pa.array(~contaminated))
                    continue
                docs = range(s.last - s.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(s.items.get(d, ())) for d in docs], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(s.items.get(d, ()))).encode()).hexdigest() for d in docs], pa.string()),
                        pa.array(contaminated),
                        pa.array(s.longest),
                        pa.array([s.matches.get(d, []) if detail else None for d in docs], _MATCHES),
                    ],
                    names=["key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "matches"],
                )

    return find


def _write_blocks(spark: SparkSession, items: DataFrame, item_key: str, item_text: str) -> list[tuple[str, ...]]:
    """Files of items, put together to blocks of some BLOCK_WORDS words (a file has up to 4 MB of text)."""
    folder = common.shared_dir(spark)
    tests = items.select(F.col(item_key).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    files = common.written(tests.mapInArrow(_block_writer(folder), "file string, n long"), f"{folder}/blocks.parquet")
    out, n = [], 0
    for r in files.orderBy("file").collect():  # one name for each file
        if not out or n + r.n > BLOCK_WORDS:
            out, n = [*out, ()], 0
        out[-1] += (r.file,)
        n += r.n
    return out


def find_matches(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20, detail: bool = True) -> DataFrame:
    """One row for each row of ``docs``: its words, words inside occurrences, items found (count and digest of their
    ids), whether ``share`` times the hit words reach its words, its longest match, and all maximal matches (null without
    ``detail``).

    Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased. An item of fewer than
    ``window`` words, but not none, must occur whole. Null and empty texts have no words, are hit by nothing and hit
    nothing; rows with null or repeated keys are judged each by itself. An item with a null id is listed as "null".
    No items, or no documents, give no hits, or no rows. Columns other than key and text are ignored.
    """
    names = _write_blocks(docs.sparkSession, items, item_key, item_text)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("t"))
    ddl = "key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, matches array<struct<item_id:string,item_pos:bigint,doc_pos:bigint,length:bigint>>"
    return rows.mapInArrow(_finder(names, window, share, 1, False, detail), ddl).withColumnRenamed("key", key)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns. Each row is judged by its own text,
    so keys may be null or repeated."""
    names = _write_blocks(docs.sparkSession, items, item_key, item_text)
    return docs.mapInArrow(_finder(names, window, share, docs.columns.index(text), True), docs.schema)
