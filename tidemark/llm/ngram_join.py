"""N-gram Jaccard self-join: near-duplicate documents by exact shingle overlap, found under several token orders.

Two texts with Jaccard similarity of 0.8 or more share a token among the first fifth of their tokens, under any one
order of all tokens. So under each of several orders, documents are candidates only if they share a prefix token, and
what one order leaves is all that the next looks at:

1. Order one puts tokens of a fixed part of the hash space that only one text has before all others. A text with more
   than a fifth of such tokens has them as its prefix, shares none of it, and is out. (Exact copies are one text.)
2. Each further order puts rarer tokens first, counted among the candidates left, and equally rare ones by a hash of
   its own. Texts that share a prefix token are joined into candidate groups; the next order works inside them.
3. In each group, overlaps are counted exactly through an inverted index. A group too large for one task is dealt out
   in blocks, each pair of blocks to a task. Only a spanning forest of links leaves a task, never all pairs.

Tokens travel packed in binary columns, by ranges of the token hash; Spark shuffles the packs, numpy sorts them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph, textcore

SHINGLE = 5
#: Similarity in hundredths.
SIMILAR = 80
#: Part of the hash space that order one counts; any part is exact, a greater one leaves fewer candidates.
COUNTED = 0.28
#: Orders after the first.
ORDERS = 2
#: Documents of a block of a large candidate group.
BLOCK_DOCS = 1024
#: Bytes of text packed together.
PACK_BYTES = 8 << 20
#: Bytes of tokens that a task holds as one group; as many ranges are made as the tokens need.
RANGE_BYTES = 32 << 20
#: Candidates (two numbers each) up to so many rows go to every task with their join; beyond it the token sets are shuffled.
BROADCAST_NODES = 500_000
#: Bits of the filter of candidates' keys that every task gets: 1 MB, however many candidates there are.
FILTER_BITS = 23

_PACK = "b int, nodes binary, sizes binary, counts binary, tokens binary"
_SEED = np.uint64(0xA24BAED4963EE407)


def ranges_for(tokens: float, least: int) -> int:
    """Ranges for so many tokens of 8 bytes, with their texts' hashes and sizes."""
    return max(least, -(-int(16 * tokens) // RANGE_BYTES))


def _dealt(rows: DataFrame, ranges: int, *columns: str) -> DataFrame:
    """Rows dealt out into more partitions than the session has, if there are more ranges; else as Spark deals them."""
    return rows.repartition(ranges, *columns) if ranges > common.parts(rows.sparkSession) else rows


def _small(rows: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has few enough rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_NODES else rows


def token_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within it; their bounds; and a hash of each text's set."""
    starts, ends, bounds = textcore.spans(data, offs, textcore.BY_SPACE)
    runs, at = textcore.shingle_hashes(textcore.word_hashes(data, starts, ends), bounds, k)
    pieces = [np.unique(runs[lo:hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    tokens = np.concatenate(pieces) if len(runs) else runs
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textcore.mix(tokens ^ _SEED))])
    return tokens, bounds, textcore.mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64) * _SEED)


def _range_of(x: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the 64-bit numbers; in few bits, so that numpy sorts by it in linear time."""
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.uint16 if n <= 1 << 16 else np.uint32)


def _packs(nodes: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, tokens: np.ndarray, n: int, by: np.ndarray, extra: np.ndarray | None = None) -> Iterator[dict]:
    """Rows of _PACK: tokens of all nodes, grouped by ``by`` (the pack of each token), and in it by node."""
    of = np.repeat(np.arange(len(nodes)), np.diff(bounds))
    order = np.argsort(by, kind="stable")
    by, of, tokens = by[order], of[order], tokens[order]
    extra = None if extra is None else extra[order]
    cuts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=False):
        own = of[lo:hi]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        row = {"b": int(by[lo]), "nodes": nodes[own[first]].tobytes(), "sizes": sizes[own[first]].astype(np.int32).tobytes(), "counts": np.diff(np.append(first, hi - lo)).astype(np.int32).tobytes(), "tokens": tokens[lo:hi].tobytes()}
        yield row if extra is None else row | {"extra": extra[lo:hi].tobytes()}


def _batch(rows: list[dict], extra: bool = False) -> pa.RecordBatch:
    schema = pa.schema([("b", pa.int32()), *[(c, pa.binary()) for c in ("nodes", "sizes", "counts", "tokens", *["extra"] * extra)]])
    return pa.RecordBatch.from_pylist(rows, schema)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all packs of a group: node of each run, its size and count, and all tokens, run after run."""
    join = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    return join("nodes", np.int64), join("sizes", np.int32), join("counts", np.int32), join("tokens", np.uint64)


def _texts(batches: Iterator[pa.RecordBatch], k: int, most: int = textcore.CHUNK_BYTES) -> Iterator[tuple]:
    for batch in batches:
        data, offs = textcore.buffers(batch.column(1))
        for lo, hi in textcore.chunks(offs, most):
            yield batch.slice(lo, hi - lo), *token_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)


def _meta(k: int) -> Callable:
    def meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, bounds, sids in _texts(batches, k):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(textcore.signed(sids)), pa.array(np.diff(bounds))], names=["row", "key", "sid", "n"])

    return meta


def _counted(k: int, n: int, part: float) -> Callable:
    """Packs of the tokens that order one counts."""
    most = np.uint64(int(part * 2**64) - 1 if part < 1 else 2**64 - 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            sids, tokens = (np.concatenate(x) for x in zip(*[(s, t) for s, t, _ in held], strict=True))
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([c for _, _, c in held]))])
            spread = (tokens.astype(np.float64) * (n / (float(most) + 1))).astype(np.int64).clip(0, n - 1).astype(np.uint16 if n <= 1 << 16 else np.uint32)
            return _batch([{**r, "sizes": b""} for r in _packs(sids, np.zeros(len(sids), np.int32), bounds, tokens, n, spread)])

        for _, tokens, bounds, sids in _texts(batches, k):
            keep = tokens <= most
            kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
            held.append((textcore.signed(sids), tokens[keep], np.diff(kept)))
            size += 8 * int(bounds[-1])
            if size >= PACK_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return counted


def _runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the tokens, and where each distinct one begins in it."""
    order = np.argsort(tokens)
    t = tokens[order]
    return order, np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)


def _unique(n: int) -> Callable:
    """For each text, how many of the group's tokens it alone has; packed by ranges of the text's hash."""

    def unique(table: pa.Table) -> pa.Table:
        sids, _, counts, tokens = _unpack(table)
        order, first = _runs(tokens)
        own = np.repeat(sids, counts)[order]
        alone = np.minimum.reduceat(own, first) == np.maximum.reduceat(own, first) if len(first) else np.zeros(0, bool)
        who, times = np.unique(own[first[alone]], return_counts=True)
        by = _range_of(textcore.mix(who), n)
        rows = [{"b": int(b), "nodes": who[by == b].tobytes(), "counts": times[by == b].astype(np.int32).tobytes()} for b in np.unique(by)]
        return pa.Table.from_pylist(rows, pa.schema([("b", pa.int32()), ("nodes", pa.binary()), ("counts", pa.binary())]))

    return unique


def _summed(table: pa.Table) -> pa.Table:
    who = np.frombuffer(b"".join(table.column("nodes").to_pylist()), np.int64)
    times = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32)
    who, at = np.unique(who, return_inverse=True)
    return pa.table({"sid": who, "alone": np.bincount(at, times, len(who)).astype(np.int64)})


def _key_bits(keys: np.ndarray) -> np.ndarray:
    return (textcore.mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _bit_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.unique(_key_bits(np.asarray(batch.column(0).drop_null())))
        for s in np.unique(bits >> 16):
            yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int32()), "bits": [(bits[bits >> 16 == s] & 0xFFFF).astype(np.uint16).tobytes()]})


def _or_bits(table: pa.Table) -> pa.Table:
    held = np.zeros(1 << 16, bool)
    for bits in table.column("bits").to_pylist():
        held[np.frombuffer(bits, np.uint16)] = True
    return pa.table({"s": table.column("s").slice(0, 1).cast(pa.int32()), "bits": [np.packbits(held).tobytes()]})


def key_filter(keys: DataFrame) -> np.ndarray:
    """A filter of 1 MB that holds every key, and by chance a few more; made by tasks from slices."""
    slices = keys.mapInArrow(_bit_slices, "s int, bits binary").groupBy("s").applyInArrow(_or_bits, "s int, bits binary").collect()
    held = np.zeros((1 << FILTER_BITS - 16, 1 << 13), np.uint8)
    for r in slices:
        held[r.s] = np.frombuffer(r.bits, np.uint8)
    return held.reshape(-1)


def _sets(k: int, held: np.ndarray) -> Callable:
    """Token sets of the documents whose row hashes pass the filter."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passing() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = _key_bits(np.asarray(batch.column(0)))
                yield batch.filter(pa.array((held[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8) & 1).astype(bool)))

        for rows, tokens, bounds, sids in _texts(passing(), k):
            hashes = rows.column(0)
            pairs = np.unique(np.stack([np.asarray(hashes), textcore.signed(sids)]), axis=1, return_index=True)[1]
            packed = [tokens[bounds[i] : bounds[i + 1]].tobytes() for i in pairs]
            yield pa.RecordBatch.from_arrays([hashes.take(pa.array(pairs)), pa.array(textcore.signed(sids)[pairs]), pa.array(packed, pa.binary())], names=["row", "sid", "tokens"])

    return sets


def _needed(n: np.ndarray) -> np.ndarray:
    """Tokens that a partner must share at least."""
    return (SIMILAR * n + 99) // 100


def _pack_sets(n: int) -> Callable:
    """Packs of all tokens, which are told apart by candidate group."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, groups = np.asarray(batch.column("node")), np.asarray(batch.column("grp"))
            pieces = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            tokens = textcore.mix(np.concatenate(pieces) + np.repeat(textcore.mix(groups.view(np.uint64)), sizes))
            yield _batch(list(_packs(nodes, sizes, bounds, tokens, n, _range_of(tokens, n))))

    return pack


def _shared(n: int) -> Callable:
    """Tokens that several texts have, with how many have them, sent back by text."""

    def shared(table: pa.Table) -> pa.Table:
        nodes, sizes, counts, tokens = _unpack(table)
        order, first = _runs(tokens)
        times = np.diff(np.append(first, len(tokens)))
        of = np.empty(len(tokens), np.int64)
        of[order] = np.repeat(times, times)
        keep = of > 1
        kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(counts)])]
        by = np.repeat(_range_of(textcore.mix(nodes.view(np.uint64)), n), np.diff(kept))
        rows = list(_packs(nodes, sizes, kept, tokens[keep], n, by, of[keep].astype(np.int32)))
        return pa.Table.from_batches([_batch(rows, True)])

    return shared


def _prefixes(n: int, seed: int) -> Callable:
    """For each text its prefix under the order (how many have a token, a hash), less the tokens it alone has."""

    def prefixes(table: pa.Table) -> pa.Table:
        nodes, sizes, counts, tokens = _unpack(table)
        df = np.frombuffer(b"".join(table.column("extra").to_pylist()), np.int32)
        ids, which = np.unique(nodes, return_inverse=True)
        size = np.zeros(len(ids), np.int64)
        size[which] = sizes
        of = np.repeat(which, counts)
        order = np.lexsort([textcore.mix(tokens ^ np.uint64(seed)), df, of])
        of, tokens = of[order], tokens[order]
        begin = np.searchsorted(of, np.arange(len(ids) + 1))
        alone = size - np.diff(begin)
        most = size - _needed(size) + 1 - alone
        keep = np.arange(len(of)) - begin[of] < most[of]
        bounds = np.concatenate([[0], np.cumsum(keep)])[begin]
        tokens = tokens[keep]
        return pa.Table.from_batches([_batch(list(_packs(ids, size, bounds, tokens, n, _range_of(tokens, n))))])

    return prefixes


def _edges(table: pa.Table) -> pa.Table:
    """Texts that share a prefix token, as stars around the least of each local component."""
    nodes, _, counts, tokens = _unpack(table)
    order, first = _runs(tokens)
    own = np.repeat(nodes, counts)[order]
    least = np.minimum.reduceat(own, first) if len(first) else own
    head = np.repeat(least, np.diff(np.append(first, len(own))))
    pairs = np.unique(np.stack([own[own != head], head[own != head]]), axis=1)
    node, root = graph.local_components(pairs[0], pairs[1])
    return pa.table({"a": node[node != root], "b": root[node != root]})


def candidate_groups(sets: DataFrame, seed: int, tokens: int) -> DataFrame:
    """``(node, grp)`` of the texts that share a prefix token with another of their group, under one order; the sets
    have ``tokens`` tokens at most."""
    n = common.parts(sets.sparkSession)
    whole = ranges_for(tokens, n)
    # Prefixes are a fifth of some of the tokens: fewer, wider ranges, so that a text meets its partners in few.
    few = ranges_for(tokens * (100 - SIMILAR) / 100, max(1, n // 8))
    packed = sets.select("node", "grp", "tokens").mapInArrow(_pack_sets(whole), _PACK)
    counted = _dealt(packed, whole, "b").groupBy("b").applyInArrow(_shared(whole), f"{_PACK}, extra binary")
    chosen = _dealt(counted, whole, "b").groupBy("b").applyInArrow(_prefixes(few, seed), _PACK)
    edges = _dealt(chosen, few, "b").groupBy("b").applyInArrow(_edges, "a long, b long")
    return graph.components(edges).withColumnRenamed("root", "grp")


def linked(sizes: np.ndarray, bounds: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """For each text the first text of its component by exact links. Tokens must be distinct within each text."""
    n = len(sizes)
    label = np.arange(n)
    of = np.repeat(np.arange(n), np.diff(bounds))
    order, first = _runs(tokens)
    times = np.diff(np.append(first, len(tokens)))
    of_sorted = of[order]
    rank = np.empty(len(tokens), np.int64)
    rank[order] = np.repeat(np.arange(len(first)), times)
    ends = np.append(first, len(tokens))
    for i in range(n - 1):
        mine = rank[bounds[i] : bounds[i + 1]]
        mine = mine[times[mine] > 1]
        if not len(mine):
            continue
        lengths = times[mine]
        at = np.arange(lengths.sum()) + np.repeat(ends[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        overlap = np.bincount(of_sorted[at], minlength=n)[i + 1 :]
        union = sizes[i] + sizes[i + 1 :] - overlap
        near = np.flatnonzero(100 * overlap >= SIMILAR * union) + i + 1
        joined = np.unique(label[np.append(near, i)])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return label


def _verify(table: pa.Table) -> pa.Table:
    """Stars of verified links, in each candidate group that the table holds."""
    nodes, groups = np.asarray(table.column("node")), np.asarray(table.column("grp"))
    pieces = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
    order = np.lexsort([nodes, groups])
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(groups[order]) != 0]))
    a, b = [], []
    for own in np.split(order, cuts[1:]):
        sizes = np.array([len(pieces[i]) for i in own], np.int64)
        label = linked(sizes, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([pieces[i] for i in own]))
        moved = np.flatnonzero(label != np.arange(len(own)))
        a.append(nodes[own[moved]])
        b.append(nodes[own[label[moved]]])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def exact_components(sets: DataFrame, tokens: int) -> DataFrame:
    """``(node, root)`` by exact links between texts of one candidate group; texts without a link are left out."""
    n = ranges_for(tokens, common.parts(sets.sparkSession))
    blocks = sets.groupBy("grp").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK_DOCS).cast("int"))
    large = common.written(blocks.where("blocks > 1").select("grp", "blocks"))
    small = sets.join(large, "grp", "left_anti").select("node", "grp", "tokens", F.pmod(F.xxhash64("grp"), F.lit(n)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    whole = _dealt(small, n, "g", "i", "j").groupBy("g", "i", "j").applyInArrow(_verify, "a long, b long")
    if large.isEmpty():
        return whole.toDF("node", "root")
    # Each document meets every block of its group in one task; a pair of blocks is a task.
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.join(large, "grp").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "grp", "tokens", F.col("grp").alias("g"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    pairs = dealt.groupBy("g", "i", "j").applyInArrow(_verify, "a long, b long")
    return whole.toDF("node", "root").union(graph.components(pairs))


def row_hash(key: str = "doc_id", text: str = "text") -> Column:
    """A hash of a row's key and text."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string"))


def near_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, orders: int = ORDERS, counted: float = COUNTED) -> DataFrame:
    """One row for each row of ``docs``: ``key, n_shingles, component_id``.

    Words are runs of bytes other than white space, A-Z lower-cased. A text of fewer than ``shingle`` words has all of
    them as its one shingle. Null, empty and blank texts have none, link with nothing and are their own component.
    Component ids are the least key reachable by links of ``SIMILAR`` hundredths or more; equal texts are linked, and
    links go by text, whether its rows have keys or not, or one key has several texts. A row with a null key has its
    text's component, or null if no row with a key is in it. Repeated keys and rows each get a row. An empty table
    gives no rows. Texts are compared whole, by 64-bit hashes of their shingles. Columns other than key and text are
    ignored.
    """
    out = near_rows(docs, key=key, text=text, shingle=shingle, orders=orders, counted=counted)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def near_rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, orders: int = ORDERS, counted: float = COUNTED) -> DataFrame:
    """``row`` (its ``row_hash``), ``key, n, root, component_id`` of each row of ``docs``, as in ``near_components``.
    Of two components that one key is the least of, the roots differ; a text without shingles has none."""
    spark = docs.sparkSession
    n = common.parts(spark)
    rows = docs.select(row_hash(key, text).alias("row"), F.col(text).cast("string").alias("t"), F.col(key).cast("long").alias("key"))
    meta = common.written(rows.mapInArrow(_meta(shingle), "row long, key long, sid long, n long"))
    # Order one: what only one text has.
    whole = ranges_for(counted * (meta.agg(F.sum("n")).first()[0] or 0), n)
    packs = rows.mapInArrow(_counted(shingle, whole, counted), _PACK)
    alone = _dealt(packs, whole, "b").groupBy("b").applyInArrow(_unique(n), "b int, nodes binary, counts binary").groupBy("b").applyInArrow(_summed, "sid long, alone long")
    # A text is its own node; one of its rows stands for it where its tokens are made again.
    texts = common.written(meta.where("n > 0").groupBy("sid").agg(F.max("n").alias("n"), F.min("key").alias("least"), F.min("row").alias("row")))
    left = texts.join(alone, "sid", "left").where(f"100 * (n - coalesce(alone, 0)) >= {SIMILAR} * n")
    left = common.written(left.select("sid", "row", "n"))
    tokens = left.agg(F.sum("n")).first()[0] or 0
    left = left.drop("n")
    held = key_filter(left.select("row"))
    # Joined by text alone, so that a shuffle for the join serves for the grouping by text as well.
    sets = rows.mapInArrow(_sets(shingle, held), "row long, sid long, tokens binary").join(_small(left.withColumnRenamed("row", "_row")), "sid").where("(row ^ _row) = 0")
    sets = common.written(sets.groupBy(F.col("sid").alias("node")).agg(F.first("tokens").alias("tokens")).withColumn("grp", F.lit(0).cast("long")))
    for order in range(orders):
        # Written first, so that its size is known: a small one goes to the sets, which stay where they are.
        groups = common.written(candidate_groups(sets, 0x5851F42D4C957F2D * (order + 1) % (1 << 63), tokens))
        sets = common.written(sets.drop("grp").join(_small(groups), "node").select("node", "tokens", "grp"))
    found = common.written(exact_components(sets, tokens).join(texts.select(F.col("sid").alias("node"), "least"), "node"))
    # The roots have stars of their other texts alone, so each root is added to its component.
    roots = found.select(F.col("root").alias("node")).distinct().join(texts.select(F.col("sid").alias("node"), "least"), "node")
    least = found.select("root", "least").union(roots).groupBy("root").agg(F.min("least").alias("of_root"))
    of_text = texts.select("sid", "least").join(found.select(F.col("node").alias("sid"), "root"), "sid", "left")
    of_text = of_text.withColumn("root", F.coalesce("root", "sid")).join(least, "root", "left")
    out = meta.join(of_text.select("sid", "root", F.coalesce("of_root", "least").alias("component_id")), "sid", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select("row", "key", "n", "root", own.alias("component_id"))
