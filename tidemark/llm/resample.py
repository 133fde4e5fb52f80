"""Importance resampling: documents drawn by how their hashed n-grams fit a target set.

Runs of words are hashed into buckets; a bucket's gain is the logarithm of its share in the target over its share in the
documents, and a document's weight is the mean gain of its runs. Noise from the document's id turns weights into scores,
of which the highest are drawn, so that the draw follows the weights without replacement and needs no random state.

Weights are integers made in numpy, a batch of whole texts at a time. Ranks need no global sort: scores are integers in a
range that the logarithms bound, so a histogram of them, summed up from the highest down, gives each score the number of
rows before it and the score at which the draw ends; only rows of the scores that survive are numbered, by id, within
their score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, textcore

BUCKETS = 10_000
#: Scores of one range of the histogram; the ranges' totals are summed up first.
RANGE_SCORES = 256
#: Bytes of text that are hashed at once.
PIECE_BYTES = textcore.CHUNK_BYTES
#: Bytes of a word up to which words are hashed together; longer ones one by one.
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    """What a crc32's low byte adds when it is shifted out."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_TABLE = _crc_table()


def _shifts(longest: int) -> np.ndarray:
    """For each length, and byte of a crc, what the crc becomes when so many bytes follow it: four look-ups a crc."""
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(longest):
        out[n + 1] = _TABLE[out[n] & 255] ^ (out[n] >> 8)
    return out.reshape(-1)


_SHIFTS = _shifts(LONG_WORD)
_SPACE = np.uint32(zlib.crc32(b" "))


def _followed(crc: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    at = np.asarray(n) * 1024
    return _SHIFTS[at + (crc & 255)] ^ _SHIFTS[at + 256 + ((crc >> 8) & 255)] ^ _SHIFTS[at + 512 + ((crc >> 16) & 255)] ^ _SHIFTS[at + 768 + (crc >> 24)]


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each word of ``data``, byte by byte for all words that are long enough."""
    n = ends - starts
    out = np.empty(len(n), np.uint32)
    short = np.flatnonzero(n <= LONG_WORD)
    order = short[np.argsort(n[short].astype(np.uint8), kind="stable")]
    at, size = starts[order], n[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for d in range(int(size[-1]) if len(size) else 0):
        k = int(np.searchsorted(size, d, "right"))
        crc[k:] = _TABLE[(crc[k:] ^ data[at[k:] + d]) & 255] ^ (crc[k:] >> 8)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def pair_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """The crc32 of each word, a space and the next word, from those of the words."""
    n = ends[1:] - starts[1:]
    spaced = _followed(crcs[:-1], 1) ^ _SPACE
    out = _followed(spaced, np.minimum(n, LONG_WORD)) ^ crcs[1:]
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[starts[i + 1] : ends[i + 1]], int(spaced[i]))
    return out


def pieces(data: np.ndarray, offs: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """Runs of texts of some ``size`` bytes: the first text's number, bytes, offsets, and whether the first text goes on
    from the piece before. A longer text comes in several pieces, cut between words."""
    for lo, hi in textcore.chunks(offs, size):
        part, o = textcore.LOWER[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
        at = 0
        while len(part) - at > size:
            gaps = np.flatnonzero(~textcore.BY_LETTER[part[at : at + size]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word: on to its end
                end = at + size
                while end < len(part) and textcore.BY_LETTER[part[end]]:
                    more = ~textcore.BY_LETTER[part[end : end + size]]
                    end += int(more.argmax()) if more.any() else len(more)
            yield lo, part[at:end], np.array([0, end - at]), at > 0
            at = end
        yield lo, part[at:], np.maximum(o - at, 0), at > 0


def features(data: np.ndarray, offs: np.ndarray, buckets: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece: its first text, the buckets of its words and of its word pairs, and the texts (from the first) that
    they are of."""
    last = None
    for lo, part, o, goes_on in pieces(data, offs, size):
        starts, ends, bounds = textcore.spans(part, o, textcore.BY_LETTER)
        crcs = word_crcs(part, starts, ends)
        text = np.repeat(np.arange(len(o) - 1), np.diff(bounds))
        pairs = pair_crcs(part, starts, ends, crcs) if len(starts) > 1 else np.zeros(0, np.uint32)
        same = text[1:] == text[:-1]
        pairs, of = pairs[same], text[1:][same]
        if goes_on and last is not None and len(starts):
            first = zlib.crc32(part[starts[0] : ends[0]], int(_followed(np.array([last], np.uint32), 1)[0] ^ _SPACE))
            pairs, of = np.append(pairs, np.uint32(first)), np.append(of, 0)
        last = crcs[-1] if len(crcs) else last if goes_on else None
        yield lo, crcs.astype(np.int64) % buckets, pairs.astype(np.int64) % buckets, text, of


def _counter(buckets: int, size: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, words, pairs, _, _ in features(*textcore.buffers(batch.column(0)), buckets, size):
                total += np.bincount(words, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    return count


def bucket_counts(docs: DataFrame, *, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all texts in each bucket that has any. Each task sends at most a row a bucket."""
    made = docs.select(F.col(text).cast("string")).mapInArrow(_counter(buckets, PIECE_BYTES), "bucket int, n long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, *, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket; both sides' counts are collected, a number for each bucket."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for at, rows, column in ((s, docs, text), (t, target, target_text)):
        for r in bucket_counts(rows, text=column, buckets=buckets).collect():
            at[r.bucket] = r.n
    over, under = (t + 1) * (s.sum() + buckets), (s + 1) * (t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(x)) for x in over / under], np.int64)


def _weigher(sent, text_at: int, size: int) -> Callable:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            n_words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, words, pairs, text, of in features(*textcore.buffers(batch.column(text_at)), len(gain), size):
                if not len(text):
                    continue
                k = int(text[-1]) + 1
                # Sums of integers below 2^53 are exact in doubles.
                n_words[lo : lo + k] += np.bincount(text, minlength=k)
                n[lo : lo + k] += np.bincount(text, minlength=k) + np.bincount(of, minlength=k)
                total[lo : lo + k] += (np.bincount(text, gain[words], k) + np.bincount(of, gain[pairs], k)).astype(np.int64)
            weight = total // np.maximum(n, 1)
            rest = [batch.column(i) for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words), pa.array(n), pa.array(weight)], names=[*(f"c{i}" for i in range(len(rest))), "n_words", "n_features", "weight"])

    return weigh


def noise(key: Column, seed: int) -> Column:
    """A whole number for each key, of the law that turns the greatest of log weights plus noise into a weighted draw."""
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(first, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def scores(docs: DataFrame, gain: np.ndarray, *, key: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """``key, n_words, n_features, weight, score`` of each row of ``docs``."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket
    made = rows.mapInArrow(_weigher(sent, 1, PIECE_BYTES), f"key {rows.schema['k'].dataType.simpleString()}, n_words long, n_features long, weight long")
    return made.withColumn("score", F.col("weight") + noise(F.col("key"), seed))


def offsets(able: DataFrame) -> DataFrame:
    """``score, before, n``: rows with each score, and with a higher one. Scores lie within some 100,000 numbers, however
    many rows there are; they are summed up within ranges of scores, and over the ranges."""
    counts = able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.floor(F.col("score") / RANGE_SCORES))
    higher = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = counts.groupBy("range").agg(F.sum("n").alias("t")).select("range", F.coalesce(F.sum("t").over(higher), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counts.join(totals, "range").select("score", (F.col("base") + F.col("inside")).alias("before"), "n")


def ranked(rows: DataFrame, *, share: int = 25, least_words: int = 20) -> DataFrame:
    """``rows`` of ``scores`` with ``rank``: of those with enough words, the highest scores get ranks from 1, equal ones by
    key (null last), until ``share`` hundredths of them are drawn; the rest have none. Rows that are alike in all columns
    count once each, are numbered as one, and get ranks that follow each other."""
    rows = common.written(rows)
    enough = F.col("n_words") >= least_words
    places = common.written(offsets(rows.where(enough)))
    total = places.agg(F.max(F.col("before") + F.col("n"))).first()[0] or 0
    drawn = share * total // 100
    end = places.where(F.col("before") < drawn).agg(F.min("score")).first()[0]
    survive = enough & (F.col("score") >= F.lit(end).cast("long")) if end is not None else F.lit(False)
    alike = rows.where(survive).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    by_key = Window.partitionBy("score").orderBy(F.asc_nulls_last("key"), "n_features", "n_words")
    last = F.col("before") + F.sum("_copies").over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    numbered = alike.join(places.select("score", "before"), "score").withColumn("_last", last)
    numbered = numbered.withColumn("rank", F.explode(F.sequence(F.col("_last") - F.col("_copies") + 1, F.col("_last"))))
    numbered = numbered.select(*rows.columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return numbered.unionByName(rows.where(~survive).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, seed: int = 7, share: int = 25, least_words: int = 20) -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` for each row of ``docs``; the rows with a rank are the draw.

    Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased; features are words and pairs of
    neighbours. Null and empty texts have none, and weight 0. A null key draws noise of its own, as an empty text, and
    comes after all keys of its score; rows with one key are told apart by their texts alone. Without any target text the
    gains favour what is rare in the documents; no documents give no rows. Texts are taken whole, in pieces; all texts are
    counted, and other columns are ignored.
    """
    gain = gains(docs, target, text=text, target_text=target_text, buckets=buckets)
    made = ranked(scores(docs, gain, key=key, text=text, seed=seed), share=share, least_words=least_words)
    return made.withColumnRenamed("key", key)
