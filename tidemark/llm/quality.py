"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent-semantic space.

A text's terms are hashed trigrams of character shapes (letters, capitals, digits, spaces and line ends by kind, other
characters as they are), hashed words and, for each word, whether it repeats the word before, an earlier one, or none.
Their square-root frequencies, weighted by inverse document frequency, are projected on the leading singular directions
of the labelled sample. Every document's cosines with all labelled vectors are computed in blocks, exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textcore

#: At most so many labelled rows are fitted on, the first in the order of a hash of their keys.
SAMPLE_ROWS = 4096
#: Terms: hashed trigrams, hashed words, and three for repeats.
TRIGRAMS, WORDS = 1024, 1021
TERMS = TRIGRAMS + WORDS + 3
#: Latent dimensions, voting neighbours, documents of a block.
DIMENSIONS, NEIGHBOURS, BLOCK_DOCS = 64, 15, 256
#: Cosines are compared to so many decimals; of equal ones the neighbour that comes first in the sample's order counts.
DECIMALS = 5
#: A neighbour's vote counts as its cosine (0 at least) to this power.
SHARPNESS = 8

_SHAPE = np.zeros(256, np.int64)
_SHAPE[0x30:0x3A] = 1
_SHAPE[0x41:0x5B] = 2
_SHAPE[0x61:0x7B] = _SHAPE[0x80:] = 3
_SHAPE[0x20] = 4
_SHAPE[0x09:0x0E] = 5
_marks = [i for i in range(0x21, 0x7F) if not chr(i).isalnum()]
_SHAPE[_marks] = 6 + np.arange(len(_marks))
_KINDS = 64
_TERM = (textcore.mix(np.arange(_KINDS**3, dtype=np.uint64)) % np.uint64(TRIGRAMS)).astype(np.int64)


def _roots(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))


def _trigram_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How often each text has each trigram, counted by pieces of the bytes."""
    n, piece = len(offs) - 1, textcore.CHUNK_BYTES
    counts = np.zeros(n * TRIGRAMS, np.int64)
    for lo in range(0, len(data) - 2, piece):
        shape = _SHAPE[data[lo : lo + piece + 2]]
        term = _TERM[(shape[:-2] * _KINDS + shape[1:-1]) * _KINDS + shape[2:]]
        of = np.repeat(np.arange(n), np.diff(np.clip(offs, lo, lo + len(shape))))
        inside = of[:-2] == of[2:]
        counts += np.bincount(of[:-2][inside] * TRIGRAMS + term[inside], minlength=len(counts))
    return counts.reshape(n, TRIGRAMS)


def _word_counts(of: np.ndarray, term: np.ndarray, n: int, terms: int) -> np.ndarray:
    """How often each text has each of its words' terms, counted by pieces of the words."""
    counts, piece = np.zeros(n * terms, np.int64), textcore.CHUNK_BYTES
    for lo in range(0, len(of), piece):
        at = slice(lo, lo + piece)
        counts += np.bincount(of[at] * np.int64(terms) + (term[at] % term.dtype.type(terms)).astype(np.int64), minlength=len(counts))
    return counts.reshape(n, terms)


def term_shares(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Square roots of the shares of each text's terms: a row for each text; trigrams, words and repeats each of length 1.
    A long text takes a few bytes for each of its bytes, and some 50 for each of its words, whose repeats are found whole."""
    n = len(offs) - 1
    out = np.zeros((n, TERMS), np.float32)
    out[:, :TRIGRAMS] = _roots(_trigram_counts(data, offs))
    starts, ends, bounds = textcore.spans(data, offs, textcore.BY_SPACE)
    if len(starts):
        words = textcore.word_hashes(data, starts, ends)
        del starts, ends
        of = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
        out[:, TRIGRAMS : TRIGRAMS + WORDS] = _roots(_word_counts(of, words, n, WORDS))
        order = np.lexsort([words, of])  # stable: of equal words the first comes first
        again = np.zeros(len(words), np.int8)
        again[order[1:]] = (words[order[1:]] == words[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        again[1:] += (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        out[:, TERMS - 3 :] = _roots(_word_counts(of, again, n, 3))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of each row; of equal ones those with the least numbers."""
    best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosines, best, 1).min(1, keepdims=True)
    tied = np.flatnonzero((cosines >= least).sum(1) > k)
    best[tied] = np.argsort(-cosines[tied], axis=1, kind="stable")[:, :k]
    return best


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows with terms x dimensions, of length 1
    labels: np.ndarray
    #: Score of texts without terms, to which no labelled text is nearer than another.
    blank: float = 0.5

    def score(self, shares: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``blank`` for texts without terms, and 0.5 without labelled rows or similar ones."""
        out = np.where((shares > 0).any(1), 0.5, self.blank)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(shares), BLOCK_DOCS):
            block = shares[lo : lo + BLOCK_DOCS]
            cosines = np.round(_unit(block @ self.weights) @ self.vectors.T, DECIMALS)
            best = nearest(cosines, k)
            votes = np.maximum(np.take_along_axis(cosines, best, 1), 0).astype(np.float64) ** SHARPNESS
            total = votes.sum(1)
            voted = (votes * self.labels[best]).sum(1) / np.maximum(total, 1e-300)
            out[lo : lo + len(votes)] = np.where(total > 0, voted, out[lo : lo + len(votes)])
        return out


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = textcore.buffers(batch.column(2))
        for lo, hi in textcore.chunks(offs, texts=BLOCK_DOCS):
            shares = term_shares(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([x.tobytes() for x in shares], pa.binary())], names=["place", "label", "shares"])


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_ROWS) -> Model:
    """A model of ``label`` (0 or 1) from at most ``sample`` labelled keys, the first by a hash of the key; which rows may
    be learnt from is up to the caller. Rows with a null key or label are left out; of repeated keys the greatest label
    holds, and of several texts of one key the least. A null text counts as empty. Labelled texts without terms give
    the score of such texts: the share of 1 among them and one 0."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("double").alias("_l"))
    chosen = chosen.orderBy(F.xxhash64("_k"), "_k").limit(sample)
    texts = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_k")  # SAMPLE_ROWS rows at most
    one = texts.groupBy("_k").agg(F.first("_l").alias("_l"), F.min("_t").alias("_t"))  # a key's labels are all the same
    rows = one.select(F.xxhash64("_k").alias("place"), "_l", "_t").mapInArrow(_shares, "place long, label double, shares binary")
    rows = rows.orderBy("place", "label", "shares").toPandas()
    x = np.frombuffer(b"".join(rows["shares"]), np.float16).reshape(-1, TERMS).astype(np.float32)
    y, full = rows["label"].to_numpy(np.float64), (x > 0).any(1)
    blank = float(y[~full].sum() / (1 + (~full).sum())) if len(y) else 0.5
    x, y = x[full], y[full]
    if not len(x):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), blank)
    idf = 1 + np.log((1 + len(x)) / (1 + (x > 0).sum(0)))
    weighted = x * idf.astype(np.float32)
    _, axes = np.linalg.eigh(weighted.T.astype(np.float64) @ weighted)
    weights = (idf[:, None] * axes[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
    return Model(weights, _unit(x @ weights), y, blank)


def _scorer(model, text_at: int, only_good: bool) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textcore.buffers(batch.column(text_at))
            for lo, hi in textcore.chunks(offs, texts=BLOCK_DOCS):
                scores = model.value.score(term_shares(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
                rows = batch.slice(lo, hi - lo)
                if only_good:
                    yield rows.filter(pa.array(scores >= 0.5))
                else:
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(scores)], names=["key", "held_out", "score"])

    return score


def classify(docs: DataFrame, model: Model, held_out, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` for each row. Null and empty texts have no terms; they
    get the score that labelled ones of the kind give (0 if none of these is labelled 1). Repeated keys and rows are
    each scored, and equal texts alike. Texts are taken whole; other columns are ignored; an empty table gives no rows."""
    rows = docs.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(text).cast("string").alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE_ROWS vectors at most
    out = rows.mapInArrow(_scorer(sent, 2, False), f"key {rows.schema['key'].dataType.simpleString()}, held_out boolean, score double")
    return out.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted 1, with all their columns; each row is judged by its own text, so null and
    repeated keys don't matter. Null and empty texts go, unless labelled ones of the kind are good."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scorer(sent, docs.columns.index(text), True), docs.schema)


def learnable(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows that may be learnt from: those whose crc32(key as text) mod 3 is not 1."""
    return labels.where(common.crc32_mod(key, 3) != 1)
