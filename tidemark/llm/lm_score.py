"""LM scoring: a hashed maximum-entropy model, a softmax over classes of words, one over the places of a class, and then
choices down a tree of the words of a place.

The log-probability of a token given the tokens before it has three terms.

1. Its class: a softmax over classes. Weights belong to hashed features of the context: the pair of tokens just before
   (n-gram), and the place (see 2) of the word before, of the second, third, fourth and fifth before, each alone (skips):
   a common word's own place, or that of all words of one form. A text's first tokens have fewer.
2. Its word among the class: a softmax over the places of the class, with weights of the same features hashed
   together with the class. The commonest words have a place each. All others share the rest of the places by their
   kind, a hash of their last letters and length, so that rare words are told apart by form.
3. For a shared place, its word: a choice of one of two branches at each fork of a tree of all training words of the
   place, by the bits of their kinds and hashes, down to the one word; however many words there are, each has a path of its
   own. A choice is a softmax of two, whose weights belong to the same features hashed together with the fork: with the first
   of four on the path, whose weights lie side by side. One part of the place is for what training has never seen:
   1 / (tokens + distinct tokens + 1).

Without weights, classes, places and branches have their shares of the training tokens (of branches, tokens and distinct
tokens together), so that a word of a shared place has (c + 1) / (tokens + distinct tokens + 1) of it for its c training
tokens. The words of a place and what is unseen add up to 1, and so does all. Weights are learnt by distributed
gradient steps: in each, tasks add up observed and expected features over a part of all training texts, the sums are
shuffled by ranges of weights, and the driver adds the step. A text's part is a hash of it, and all parts together are
every training text once. Sums are whole numbers (a probability counts in units), so that neither weights nor scores
depend on how texts are dealt out to tasks. Classes,
places and feature buckets grow with the number of distinct training tokens up to stated sizes.

Counts of tokens are exact and distributed: each chunk of documents writes its tokens once, numbered within the chunk,
to a file in the shared folder, and sends its distinct tokens to ranges of their hash and kind, which send the totals
back, and for each fork on a word's path the total of its other branch. Forks by the first bits, which lie in several
ranges, come from a table of kinds and first bits that every task has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textcore

#: Gradient steps; each sees one of as many parts of the training texts.
STEPS = 4
#: Of a step, shared among a context's features.
RATE = 2.0
#: Context words that are features by themselves, and all features of a context.
BACK, FEATURES = 5, 6
#: Bytes of text of a chunk; a longer text is one, whole.
CHUNK_BYTES = 3 << 20
#: Tokens whose softmaxes are computed together.
BLOCK_TOKENS = 16_384
#: Tokens whose expected features are computed together: fewer than SUM_UNIT / UNITS.
SEEN_TOKENS = 8192
#: Tokens whose features are counted together.
PIECE_TOKENS = 8 * BLOCK_TOKENS
#: Classes (and places of a class) at most; weight rows of classes, of places and of forks, at most.
MOST_SIDE, MOST_CLASS_ROWS, MOST_PLACE_ROWS, MOST_FORK_ROWS = 64, 1 << 13, 1 << 16, 1 << 18
#: Kinds that are told apart, and first bits of a hash that ranges are made by; forks by later bits lie in one range each.
KINDS, FIRST_BITS = MOST_SIDE**2, 6
#: Bits of a hash by which words of a place and kind are told apart.
FORK_BITS = 52
#: Bytes of distinct tokens of a range, in which their counts are summed up.
RANGE_BYTES = 32 << 20
#: Forks of a path whose weights lie side by side, in a block of two for each way to come to each.
BLOCK_FORKS = 4
#: Tokens whose forks are computed together.
FORK_TOKENS = 16_384
#: Units of a probability in the sums of what is expected.
UNITS = 4096
#: Two sums in one number: the second is in these units, and the first stays below one.
SUM_UNIT = 1 << 26
#: The same for forks, where numbers are looked at after so many additions: twice as many of UNITS stay below one unit.
FORK_UNIT_BITS, MOST_ADDED = 33, 1 << 19
#: Rows of weights that are summed up together; of forks as many more as they are shorter.
SLICE_ROWS = 2048
_END = textcore.mix(np.array([0x454E44], np.uint64))[0]
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_kinds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of a word's last two bytes and its length up to 4."""
    last = textcore.LOWER[data[ends - 1]].astype(np.uint64)
    other = np.where(ends - starts > 1, textcore.LOWER[data[np.maximum(ends - 2, 0)]], 0).astype(np.uint64)
    kind = (last << np.uint64(16)) | (other << np.uint64(8)) | np.minimum(ends - starts, 4).astype(np.uint64)
    return (textcore.mix(kind ^ _SALT) >> np.uint64(32)).astype(np.uint32)


def _power_of_two(x: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))))


@dataclass(frozen=True)
class Layout:
    """Places of words, and the training counts of each. ``common_words`` are hashes in ascending order."""

    side: int
    class_rows: int
    place_rows: int
    common_words: np.ndarray
    common_places: np.ndarray
    tokens: np.ndarray  # training tokens of each place
    distinct: np.ndarray  # distinct training tokens of each place; what shares a place is counted alone
    train_tokens: int
    train_distinct: int

    @staticmethod
    def sizes(distinct: int) -> tuple[int, int, int]:
        """Classes (as many as places of a class), and weight rows of classes and of places, for so many words."""
        side = 8 if distinct < 1 << 10 else 16 if distinct < 1 << 24 else 32 if distinct < 1 << 30 else MOST_SIDE
        return side, _power_of_two(distinct / 1024, 1 << 10, MOST_CLASS_ROWS), _power_of_two(distinct / 256, 1 << 12, MOST_PLACE_ROWS)

    @staticmethod
    def shared_places(kinds: np.ndarray, side: int) -> np.ndarray:
        """Places by kind: the second half of a class's places."""
        k, half = kinds.astype(np.int64), side // 2
        return k % side * side + half + k // side % (side - half)

    @classmethod
    def of(cls, words: np.ndarray, kinds: np.ndarray, counts: np.ndarray, shared_tokens: np.ndarray, shared_distinct: np.ndarray, side: int, rows: tuple[int, int]) -> Layout:
        """From the commonest words, most common first, and tokens and distinct tokens of all words by their kind's place."""
        half = side // 2
        words, kinds, counts = words[: side * half], kinds[: side * half], counts[: side * half]
        tokens, distinct = shared_tokens.copy(), shared_distinct.copy()
        total, whole = int(tokens.sum()), int(distinct.sum())
        np.subtract.at(tokens, cls.shared_places(kinds, side), counts)
        np.subtract.at(distinct, cls.shared_places(kinds, side), 1)
        rank = np.arange(len(words))
        places = rank % side * side + rank // side
        tokens[places], distinct[places] = counts, 1
        order = np.argsort(words)
        return cls(side, *rows, words[order], places[order], tokens, distinct, total, whole)

    def places_of(self, words: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place, and whether it shares it."""
        places, shares = self.shared_places(kinds, self.side), np.ones(len(words), bool)
        if len(self.common_words):
            at = np.minimum(np.searchsorted(self.common_words, words), len(self.common_words) - 1)
            known = self.common_words[at] == words
            places[known], shares[known] = self.common_places[at[known]], False
        return places, shares

    def priors(self) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the shares of classes, and of places in each class."""
        by_class = self.tokens.reshape(self.side, self.side)
        classes, places = by_class.sum(1) + 1.0, by_class + 0.5
        return np.log(classes / classes.sum()).astype(np.float32), np.log(places / places.sum(1, keepdims=True)).astype(np.float32)

    def log_shared(self, places: np.ndarray, shares: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of each word's part in its place, before any weights of forks."""
        return np.where(shares, np.log10(counts + 1.0) - np.log10(self.tokens[places] + self.distinct[places] + 1.0), 0.0)


@dataclass(frozen=True)
class Tree:
    """First forks of the words that share places, and the common words, which have left their kinds' branches.

    ``masses`` are training tokens and distinct training tokens of all other words by place, kind in the place and first
    bits of the hash. Common words are in the order of kind and hash; ``common_sums`` adds up their masses."""

    kind_bits: int
    rows: int
    masses: np.ndarray
    common_keys: np.ndarray
    common_sums: np.ndarray

    @staticmethod
    def keys(kinds: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (kinds.astype(np.uint64) << np.uint64(FORK_BITS)) | (words >> np.uint64(64 - FORK_BITS))

    @classmethod
    def of(cls, side: int, by_kind: np.ndarray, words: np.ndarray, kinds: np.ndarray, counts: np.ndarray, distinct: int) -> Tree:
        """From masses of all words by kind and first bits, and the commonest words."""
        half = side // 2
        words, kinds, counts = words[: side * half], kinds[: side * half].astype(np.int64) % KINDS, counts[: side * half]
        masses = by_kind.copy()
        np.subtract.at(masses, (kinds, (words >> np.uint64(64 - FIRST_BITS)).astype(np.int64)), counts + 1)
        k = np.arange(KINDS)
        order = np.lexsort([k // (side * half), k // side % half, k % side])
        keys = cls.keys(kinds, words)
        by_key = np.argsort(keys, kind="stable")
        sums = np.concatenate([[0], np.cumsum(counts[by_key] + 1)]).astype(np.int64)
        return cls((KINDS // (side * half)).bit_length() - 1, _power_of_two(2 * distinct, 1 << 12, MOST_FORK_ROWS), masses[order].reshape(side * half, -1), keys[by_key], sums)

    @cached_property
    def logits(self) -> list[np.ndarray]:
        """For each of the first forks' bits, by place and the bits up to it: logarithm of the mass of that branch over the
        other one's; NaN where the other one has none."""
        masses, out = self.masses, []
        while masses.shape[1] > 1:
            other = masses.reshape(len(masses), -1, 2)[:, :, ::-1].reshape(masses.shape)
            with np.errstate(divide="ignore", invalid="ignore"):
                out.append(np.where(other > 0, np.log(masses / other), np.nan).astype(np.float32))
            masses = masses.reshape(len(masses), -1, 2).sum(2)
        return out[::-1]

    def common_mass(self, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Mass of the common words that have a key's kind and first bits."""
        low = (np.uint64(1) << (FORK_BITS - bits).astype(np.uint64)) - np.uint64(1)
        return self.common_sums[np.searchsorted(self.common_keys, keys | low, "right")] - self.common_sums[np.searchsorted(self.common_keys, keys & ~low)]


@dataclass(frozen=True)
class Paths:
    """Paths of words that have equally many forks: a column for each word, a row for each fork (or block of forks)."""

    blocks: np.ndarray  # a hash of the first fork of each block
    cells: np.ndarray  # where in its block the word's branch is, by the choices in it so far and its own
    logits: np.ndarray  # logarithm of the word's branch's mass over the other one's
    priors: np.ndarray  # minus the logarithm of the word's part in the mass of its place

    def leads(self, columns: np.ndarray, hashes: np.ndarray, lead: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For tokens with these words and features, block by block: the logits of the words' branches (a row for each fork),
        and these branches' weights of each feature. Both are good until the next block."""
        shift, within = np.uint32(33 - len(lead).bit_length()), np.uint32(len(lead) - 2)
        at, start = np.empty(len(columns), np.uint32), np.empty(len(columns), np.int64)
        most = min(BLOCK_FORKS, len(self.cells))
        all_cells, all_every = np.empty((most, len(columns)), np.int64), np.empty((FEATURES, most, len(columns)), np.int64)
        all_x, all_one = np.empty((2, most, len(columns)), np.float32)
        for lo in range(0, len(self.cells), BLOCK_FORKS):
            n = min(BLOCK_FORKS, len(self.cells) - lo)
            block = np.take(self.blocks[lo // BLOCK_FORKS], columns, mode="clip")
            cells, x, one, every = all_cells[:n], all_x[:n], all_one[:n], all_every[:, :n]
            for k in range(n):
                np.take(self.cells[lo + k], columns, out=cells[k], mode="clip")
                np.take(self.logits[lo + k], columns, out=x[k], mode="clip")
            for row, h in zip(every, hashes, strict=True):
                np.add(h, block, out=at)  # 32 mixed bits of each
                at *= np.uint32(0x9E3779B1)
                at >>= shift
                at &= within
                start[:] = at
                np.bitwise_xor(cells, start, out=row)  # in one block, and no weight of it is used more than another
                x += np.take(lead, row, out=one, mode="clip")
            yield x, every


@dataclass(frozen=True)
class Forks:
    """Forks on the paths of a chunk's words: word w has ``first[w + 1] - first[w]``. ``ranks`` are the words in the order of
    their numbers of forks; ``paths`` are those of each number, from rank ``starts`` on."""

    first: np.ndarray
    ranks: np.ndarray
    starts: np.ndarray
    paths: list[Paths]

    @classmethod
    def of(cls, layout: Layout, tree: Tree, words: np.ndarray, kinds: np.ndarray, counts: np.ndarray, inner: tuple[np.ndarray, ...]) -> Forks:
        """``counts`` are training tokens; ``inner`` are, below the first forks, each word's number of forks, and in the order
        of words the bits before each and the mass of the other branch, common words included. Words of no shared place and
        those that training hasn't seen have no forks."""
        side, half = layout.side, layout.side // 2
        kinds = kinds.astype(np.int64) % KINDS
        place, shares = layout.places_of(words, kinds)
        path = ((kinds // (side * half)).astype(np.uint64) << np.uint64(64 - tree.kind_bits)) | (words >> np.uint64(tree.kind_bits))
        known = np.flatnonzero(shares & (counts > 0))
        at, child = (kinds % side * half + kinds // side % half)[known], path[known]
        top, priors = np.empty((len(known), len(tree.logits)), np.float32), np.zeros(len(words))
        for depth, logits in enumerate(tree.logits):
            top[:, depth] = logits.reshape(-1)[(at << (depth + 1)) | (child >> np.uint64(63 - depth)).astype(np.int64)]
        priors[known] = np.log(tree.masses.sum(1)[at]) - np.log(counts[known] + 1.0)
        is_fork = ~np.isnan(top)
        depth1, logits1 = np.nonzero(is_fork)[1].astype(np.uint8), top[is_fork]
        n1 = np.zeros(len(words), np.int64)
        n1[known] = is_fork.sum(1)
        # A branch has the mass of what is below it: of the word itself, and of the other branches of further forks.
        n, bits, other = inner
        so_far = np.concatenate([[0], np.cumsum(other)])
        ends = np.cumsum(n)
        own = np.repeat(counts + 1 + so_far[ends], n) - so_far[1:]
        # Common words have left their branches: those that begin as one of them does.
        begins = np.zeros(KINDS << FIRST_BITS, bool)
        begins[(tree.common_keys >> np.uint64(FORK_BITS - FIRST_BITS)).astype(np.int64)] = True
        less = np.flatnonzero(np.repeat(begins[(kinds << FIRST_BITS) | (words >> np.uint64(64 - FIRST_BITS)).astype(np.int64)] & shares, n))
        if len(less):
            w = np.searchsorted(ends, less, "right")
            keys, other = Tree.keys(kinds[w], words[w]), other.copy()
            below = tree.common_mass(keys, bits[less] + 1)
            other[less] -= tree.common_mass(keys, bits[less]) - below
            own[less] -= below
        is_fork = np.repeat(shares, n) & (other > 0)
        depth2, logits2 = (bits[is_fork] + tree.kind_bits).astype(np.uint8), np.log((own[is_fork] / other[is_fork]).astype(np.float32))
        kept = np.concatenate([[0], np.cumsum(is_fork)])
        n2 = kept[ends] - kept[ends - n]
        # First forks, and then the others of each word.
        count = n1 + n2
        first = np.concatenate([[0], np.cumsum(count)])
        from1, from2 = np.cumsum(n1) - n1, np.cumsum(n2) - n2 + len(depth1) - n1
        depth, logits = np.concatenate([depth1, depth2]), np.concatenate([logits1, logits2])
        order = np.argsort(count.astype(np.uint8), kind="stable")
        ranks, starts = np.empty(len(words), np.int32), np.searchsorted(count[order], np.arange(1, count.max(initial=0) + 2))
        ranks[order] = np.arange(len(words))
        hashes = textcore.mix(place.astype(np.uint64))
        return cls(first, ranks, starts, [cls._paths(w, k + 1, n1[w], from1[w], from2[w], depth, logits, path[w], hashes[w], priors[w]) for k, w in enumerate(np.split(order, starts)[1:-1])])

    @staticmethod
    def _paths(w: np.ndarray, n: int, n1: np.ndarray, from1: np.ndarray, from2: np.ndarray, depth: np.ndarray, logits: np.ndarray, path: np.ndarray, place: np.ndarray, priors: np.ndarray) -> Paths:
        blocks, cells, own = np.empty((-(-n // BLOCK_FORKS), len(w)), np.uint32), np.empty((n, len(w)), np.int64), np.empty((n, len(w)), np.float32)
        for k in range(n):
            at = np.where(k < n1, from1, from2) + k
            d = depth[at].astype(np.uint64)
            bits = path >> (np.uint64(63) - d)
            if k % BLOCK_FORKS == 0:
                blocks[k // BLOCK_FORKS] = textcore.mix((bits >> np.uint64(1)) * _ODD + d * _SALT + place).astype(np.uint32)
            cells[k] = (2 * cells[k - 1] if k % BLOCK_FORKS else 2) + (bits & np.uint64(1)).astype(np.int64)
            own[k] = logits[at]
        return Paths(blocks, cells, own, priors)

    def _tokens(self, ids: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[Paths, np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens whose words have forks, in the order of words: paths, columns in them, which tokens, and their features."""
        ranks = self.ranks[ids]
        order = np.argsort(ranks.astype(np.uint16), kind="stable")  # 16 bits: linear
        order = order[np.argsort((ranks >> 16).astype(np.uint16)[order], kind="stable")]
        ranks, short = ranks[order], np.take(hashes.astype(np.uint32), order, axis=1)
        cuts = np.searchsorted(ranks, self.starts)
        for paths, start, lo, hi in zip(self.paths, self.starts[:-1], cuts[:-1], cuts[1:], strict=True):
            for at in range(lo, hi, FORK_TOKENS):
                part = slice(at, min(hi, at + FORK_TOKENS))
                yield paths, ranks[part].astype(np.int64) - start, order[part], short[:, part]

    def log_gains(self, ids: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """By how much each token's path has a higher log10 probability than its words' masses give it."""
        out, lead = np.zeros(len(ids)), (weights - weights[:, ::-1]).reshape(-1)
        for paths, columns, tokens, short in self._tokens(ids, hashes):
            gain = paths.priors[columns]
            for x, _ in paths.leads(columns, short, lead):
                np.exp(np.negative(x, out=x), out=x)
                x += 1
                gain -= np.log(x, out=x).sum(0)
            out[tokens] = gain / np.log(10)
        return out

    def seen(self, ids: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed counts, and expected ones in UNITS, of (feature row, branch)."""
        seen, own = np.zeros((2, weights.size), np.int64)
        lead = (weights - weights[:, ::-1]).reshape(-1)
        # One addition for two sums: how many, times FORK_UNIT, and of how many units.
        sums, added = np.zeros(weights.size), 0

        def take_apart() -> None:
            whole = sums.astype(np.int64)
            seen[:] += whole >> FORK_UNIT_BITS
            own[:] += whole & ((1 << FORK_UNIT_BITS) - 1)
            sums[:] = 0

        for paths, columns, _, short in self._tokens(ids, hashes):
            for x, every in paths.leads(columns, short, lead):
                np.exp(np.negative(x, out=x), out=x)
                x += 1
                np.floor(np.divide(np.float32(UNITS), x, out=x) + np.float32(0.5), out=x)
                value = x.reshape(-1) + np.float64(1 << FORK_UNIT_BITS)
                added += every.size
                if added > MOST_ADDED:
                    if sums.max() > MOST_ADDED << FORK_UNIT_BITS:
                        take_apart()
                    added = every.size
                for row in every:
                    np.add.at(sums, row.reshape(-1), value)
        take_apart()
        seen, own = seen.reshape(weights.shape), own.reshape(weights.shape)
        return seen, own + (UNITS * seen - own)[:, ::-1]


def contexts(tokens: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each feature of each token's context: a row for each feature. Before a text's first token is nothing."""
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def back(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(x), x.dtype)
        out[k:] = x[: len(x) - k]
        out[at < k] = 0
        return out

    single, out = places + 1, np.empty((FEATURES, len(tokens)), np.uint64)
    every = np.arange(places.max(initial=0) + 2, dtype=np.uint64)
    for i in range(FEATURES):
        salt = np.uint64((i + 1) * int(_ODD) % (1 << 64))
        if i < BACK:
            np.take(textcore.mix(every + salt), back(single, i + 1), out=out[i], mode="clip")
        else:
            out[i] = textcore.mix(back(tokens, 1) * _ODD + back(tokens, 2) + salt)
    return out


def _rows(hashes: np.ndarray, classes: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of each feature, for the class and, given the class, for the place."""
    of_class = hashes.astype(np.uint16) & np.uint16(layout.class_rows - 1)  # as many as a power of two, of 16 bits at most
    mixed = textcore.mix(hashes + classes.astype(np.uint64) * _SALT)
    return of_class, mixed.astype(np.uint16) & np.uint16(layout.place_rows - 1)


def softmax(weights: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of what has the logits ``prior`` (0 at most) and the sum of the features' weight rows, each times its
    row's total, and these totals. A step moves a weight by less than one, so no logit comes near what ``exp`` of 32 bits
    can't hold."""
    x, row = np.empty((2, rows.shape[1], weights.shape[1]), np.float32)
    x[:] = prior
    for r in rows:
        x += np.take(weights, r, axis=0, out=row, mode="clip")
    np.exp(x, out=x)
    return x, np.einsum("ij->i", x)  # row by row in one order, unlike a product of matrices


def log_probabilities(hashes: np.ndarray, places: np.ndarray, layout: Layout, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each token's place after its context."""
    of_class, of_place = layout.priors()
    out = np.zeros(len(places))
    for lo in range(0, len(places), BLOCK_TOKENS):
        part = slice(lo, lo + BLOCK_TOKENS)
        cls, place = np.divmod(places[part], layout.side)
        i = np.arange(len(cls))
        for w, rows, prior, is_ in zip(weights, _rows(hashes[:, part], cls, layout), (of_class, of_place[cls]), (cls, place), strict=True):
            x, totals = softmax(w, rows, prior)
            out[part] += np.log10((x[i, is_] / totals).astype(np.float64))
    return out


class RowSums:
    """Sums of rows of whole numbers of UNITS at most, by weight row. Neighbours are summed up in one number, the second in
    SUM_UNIT, and two such numbers in one addition; they are taken apart before the first reaches SUM_UNIT."""

    def __init__(self, shape: tuple[int, int]):
        self.sums, self.rows, self.out = np.zeros((shape[0], shape[1] // 4), np.complex128), np.zeros(shape[0], np.int64), np.zeros(shape, np.int64)

    @staticmethod
    def packed(values: np.ndarray) -> np.ndarray:
        two = values.astype("<i4").view("<i8")
        return (two - (two >> 32) * ((1 << 32) - SUM_UNIT)).astype(np.float64).view(np.complex128).reshape(-1)

    def add(self, rows: np.ndarray, packed: np.ndarray) -> None:
        n = np.bincount(rows, minlength=len(self.rows))
        if (self.rows + n).max() >= SUM_UNIT // UNITS:
            self.take_apart()
        self.rows += n
        each = self.sums.shape[1]
        at = np.empty((len(rows), each), np.int64)
        at[:, 0] = rows
        at[:, 0] *= each
        for k in range(1, each):
            np.add(at[:, 0], k, out=at[:, k])
        np.add.at(self.sums.reshape(-1), at.reshape(-1), packed)

    def take_apart(self) -> None:
        two = self.sums.view(np.float64).astype(np.int64)
        self.out[:, ::2] += two % SUM_UNIT
        self.out[:, 1::2] += two // SUM_UNIT
        self.sums[:], self.rows[:] = 0, 0


def features_seen(hashes: np.ndarray, places: np.ndarray, layout: Layout, weights: tuple[np.ndarray, np.ndarray]) -> tuple[tuple, tuple]:
    """Observed counts, and expected ones in UNITS, of (feature row, class) and of (feature row, place)."""
    side, priors = layout.side, layout.priors()
    seen, expected = tuple(np.zeros(w.shape, np.int64) for w in weights), tuple(RowSums(w.shape) for w in weights)
    for at in range(0, len(places), PIECE_TOKENS):
        piece = slice(at, at + PIECE_TOKENS)
        classes, place = np.divmod(places[piece], side)
        every = _rows(hashes[:, piece], classes, layout)
        for k, is_ in enumerate((classes, place)):
            for r in every[k]:
                seen[k].reshape(-1)[:] += np.bincount(r.astype(np.int64) * side + is_, minlength=seen[k].size)
        for lo in range(0, len(classes), SEEN_TOKENS):
            part = slice(lo, lo + SEEN_TOKENS)
            for k, prior in enumerate((priors[0], priors[1][classes[part]])):
                x, totals = softmax(weights[k], every[k][:, part], prior)
                x *= (np.float32(UNITS) / totals)[:, None]
                x += np.float32(0.5)
                p = RowSums.packed(x)
                for r in every[k][:, part]:
                    expected[k].add(r, p)
    for sums in expected:
        sums.take_apart()
    return seen, tuple(sums.out for sums in expected)


_SIZES = [("at", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("size", pa.int64()), ("raw", pa.int64())]
_CHUNK = pa.schema([("part", pa.int32()), ("chunk", pa.string()), ("file", pa.string()), *_SIZES, ("keys", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))])
_PLACE = ["chunk", "file", *(c for c, _ in _SIZES)]
_CHUNK_DDL = "part int, chunk string, file string, at long, n_docs long, n_tokens long, n_words long, size long, raw long, keys array<bigint>, held array<boolean>"


def _chunks(folder: str, steps: int) -> Callable:
    """Rows of the chunks of texts of one part; their numbered tokens lie in a file for each task, which the rows point
    into."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, out = 0, None
        # Each attempt writes a file of its own; the table of chunks, which is committed, names those that count.
        name = f"{folder}/chunks-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        for whole in batches:
            for part in range(steps):
                batch = whole.filter(pc.equal(whole.column(3), part))
                data, offs = textcore.buffers(batch.column(2))
                for lo, hi in textcore.chunks(offs, CHUNK_BYTES):
                    sizes, tokens, kinds = _tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                    words, first, ids = np.unique(tokens, return_index=True, return_inverse=True)
                    held = np.asarray(batch.column(1).slice(lo, hi - lo).fill_null(False))
                    counts = np.bincount(ids[np.repeat(~held, sizes)], minlength=len(words))
                    out = out or common.open_out(name)
                    # Words ascend: steps between them are shorter.
                    packed, raw = _packed([np.diff(words, prepend=np.uint64(0)), kinds[first] % np.uint32(KINDS), counts, ids, sizes])
                    out.write(packed)
                    yield pa.RecordBatch.from_pylist([{"part": part, "chunk": uuid.uuid4().hex, "file": name, "at": at, "n_docs": hi - lo, "n_tokens": len(tokens), "n_words": len(words), "size": len(packed), "raw": raw, "keys": batch.column(0).slice(lo, hi - lo).to_pylist(), "held": held.tolist()}], _CHUNK)
                    at += len(packed)
        if out is not None:
            out.close()

    return chunks


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text (their number), and hash and kind of each token."""
    starts, ends, bounds = textcore.spans(data, offs, textcore.BY_SPACE)
    n_docs = len(offs) - 1
    # Token i of text d stands at i + d: each text before has an end.
    at = np.arange(len(starts)) + np.repeat(np.arange(n_docs), np.diff(bounds))
    tokens, kinds = np.full(len(starts) + n_docs, _END, np.uint64), np.zeros(len(starts) + n_docs, np.uint32)
    tokens[at] = textcore.word_hashes(data, starts, ends)
    kinds[at] = word_kinds(data, starts, ends) if len(starts) else 0
    return np.diff(bounds) + 1, tokens, kinds


@dataclass(frozen=True)
class Chunk:
    """A chunk as read from its file: distinct tokens, their kinds and training counts, and the texts as ids of them."""

    words: np.ndarray
    kinds: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        with common.open_in(row["file"]) as f:
            f.seek(row["at"])
            steps, kinds, counts, ids, sizes = _unpacked(f.read(row["size"]), row["raw"], 5)
        return cls(np.cumsum(steps.view(np.uint64)), kinds.astype(np.uint32), counts.astype(np.int32), ids, sizes)


_DEALT = pa.schema([("b", pa.int32()), ("chunk", pa.string()), ("words", pa.binary()), ("kinds", pa.binary()), ("counts", pa.binary())])


def _ranges_of(words: np.ndarray, kinds: np.ndarray, n: int) -> np.ndarray:
    """Ranges of words: by the first bits of their hash, and by n groups of kinds."""
    group = textcore.mix((kinds % np.uint32(KINDS)).astype(np.uint64)) % np.uint64(n)
    return (words >> np.uint64(64 - FIRST_BITS)).astype(np.int64) * n + group.astype(np.int64)


def _by_range(n: int) -> Callable:
    """A chunk's distinct tokens, dealt out by ranges."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk, read = row["chunk"], Chunk.of(row)
                b = _ranges_of(read.words, read.kinds, n)
                order = np.argsort(b, kind="stable")
                words, kinds, counts = read.words[order], read.kinds[order], read.counts[order]
                cuts = np.searchsorted(b[order], np.arange((n << FIRST_BITS) + 1))
                rows = [{"b": i, "chunk": chunk, "words": words[a:z].tobytes(), "kinds": kinds[a:z].tobytes(), "counts": counts[a:z].tobytes()} for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
                yield pa.RecordBatch.from_pylist(rows, _DEALT)

    return deal


_BACK = ["b", "file", "at", "size", "raw"]
_TOTALS_DDL = "chunk string, b int, file string, at long, size long, raw long, distinct long, words binary, kinds binary, counts binary, tokens binary"


def _forks(words: np.ndarray, kinds: np.ndarray, masses: np.ndarray) -> tuple[np.ndarray, ...]:
    """Forks below the first bits on the paths of different words: each word's number of forks, and in the order of words
    the bits before each and the mass of the branch that the word is not on."""
    order = np.lexsort([words, kinds])
    kinds, words = kinds[order], words[order]
    sums = np.concatenate([[0], np.cumsum(masses[order])])
    prefix = np.stack([kinds.astype(np.int64), (words >> np.uint64(64 - FIRST_BITS)).astype(np.int64)])
    new = np.flatnonzero(np.concatenate([[True], (prefix[:, 1:] != prefix[:, :-1]).any(0)])) if len(words) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(new, len(words)))
    lo, hi, at = np.repeat(new, sizes), np.repeat(new + sizes, sizes), np.arange(len(words))
    found = [np.zeros((3, 0), np.int64)]
    for bits in range(FIRST_BITS, FORK_BITS):
        at = at[hi[at] - lo[at] > 1]
        if not len(at):
            break
        one = (words >> np.uint64(63 - bits)) & np.uint64(1)
        zeros = np.concatenate([[0], np.cumsum(one == 0)])
        cut = lo[at] + zeros[hi[at]] - zeros[lo[at]]
        right = one[at] == 1
        left, whole = sums[cut] - sums[lo[at]], sums[hi[at]] - sums[lo[at]]
        own = np.where(right, whole - left, left)
        fork = (cut > lo[at]) & (cut < hi[at])
        found.append(np.stack([order[at], np.full(len(at), bits), whole - own])[:, fork])
        lo[at], hi[at] = np.where(right, cut, lo[at]), np.where(right, hi[at], cut)
    w, bits, other = np.concatenate(found, axis=1)
    by_word = np.argsort(w, kind="stable")
    return np.bincount(w, minlength=len(words)), bits[by_word], other[by_word]


def _packed(arrays: list[np.ndarray]) -> tuple[bytes, int]:
    planes = [_planes(x) if len(x) else b"" for x in arrays]
    raw = np.array([*map(len, arrays), *map(len, planes)], "<i8").tobytes() + b"".join(planes)
    return pa.compress(raw, "zstd", asbytes=True), len(raw)


def _unpacked(packed: bytes, raw: int, n: int = 4) -> list[np.ndarray]:
    data = pa.decompress(packed, raw, "zstd", asbytes=True)
    cells, sizes = np.frombuffer(data, "<i8", 2 * n).reshape(2, n)
    ends = 16 * n + np.cumsum(sizes)
    return [_numbers(data[z - n : z], c) for c, n, z in zip(cells, sizes, ends, strict=True)]


def _totals(folder: str) -> Callable:
    """Each chunk's tokens with their counts in all training texts, and the forks on their paths: in a file for each range,
    which the rows point into. Once for a range: its distinct training tokens, the commonest of them, and for each kind its
    tokens and distinct tokens."""
    return lambda table: _range_totals(folder, table)


def _range_totals(folder: str, table: pa.Table) -> pa.Table:
    pieces = table.column("words").to_pylist()
    sizes = [len(p) // 8 for p in pieces]
    words, kinds, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("words", np.uint64), ("kinds", np.uint32), ("counts", np.int32)))
    words, first, at = np.unique(words, return_index=True, return_inverse=True)
    sums, kinds = np.bincount(at, counts, len(first)).astype(np.int64), kinds[first]
    known = np.flatnonzero(sums)
    best = known[np.lexsort([textcore.signed(words[known]), -sums[known]])][: MOST_SIDE**2 // 2]
    # Shares of kinds by the two numbers that any layout takes its places from.
    folded = kinds[known].astype(np.int64) % KINDS
    by_kind = np.stack([np.bincount(folded, sums[known], KINDS), np.bincount(folded, minlength=KINDS)]).astype(np.int64)
    n_forks = np.zeros(len(words), np.int64)
    n_forks[known], *path = _forks(words[known], folded, sums[known] + 1)
    starts = np.cumsum(n_forks) - n_forks
    name, back = f"{folder}/range-{table.column('b')[0].as_py():05d}-{uuid.uuid4().hex}", []
    with common.open_out(name) as out:
        for ids in np.split(at, np.cumsum(sizes)[:-1]):
            n = n_forks[ids]
            taken = np.arange(n.sum()) + np.repeat(starts[ids] - np.cumsum(n) + n, n)
            packed, raw = _packed([sums[ids], n, *(x[taken] for x in path)])
            back.append((back[-1][0] + back[-1][1] if back else 0, len(packed), raw))
            out.write(packed)
    once = lambda x: [x, *[None] * (len(pieces) - 1)]
    columns = {
        "chunk": table.column("chunk").cast(pa.string()), "b": table.column("b").cast(pa.int32()), "file": pa.array([name] * len(back)), **{c: pa.array(x, pa.int64()) for c, x in zip(("at", "size", "raw"), zip(*back, strict=True), strict=True)},
        "distinct": pa.array(once(len(known)), pa.int64()), "words": pa.array(once(words[best].tobytes()), pa.binary()), "kinds": pa.array(once(kinds[best].tobytes()), pa.binary()),
        "counts": pa.array(once(sums[best].tobytes()), pa.binary()), "tokens": pa.array(once(by_kind.tobytes()), pa.binary()),
    }
    return pa.table(columns)


def _merged(table: pa.Table) -> pa.Table:
    """One row of several ranges: their commonest words, and the sums of their kinds. ``g`` is that of the first."""
    words, kinds, counts, tokens = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("words", np.uint64), ("kinds", np.uint32), ("counts", np.int64), ("tokens", np.int64)))
    best = np.lexsort([textcore.signed(words), -counts])[: MOST_SIDE**2 // 2]
    row = {"g": table.column("g")[0].as_py(), "distinct": sum(table.column("distinct").to_pylist()), "words": words[best].tobytes(), "kinds": kinds[best].tobytes(), "counts": counts[best].tobytes(), "tokens": tokens.reshape(-1, 2 * KINDS).sum(0).tobytes()}
    return pa.Table.from_pylist([row], pa.schema([("g", pa.int32()), ("distinct", pa.int64()), *[(c, pa.binary()) for c in ("words", "kinds", "counts", "tokens")]]))


def _layout(totals: DataFrame, n: int) -> tuple[Layout, Tree]:
    """From one row for each value of a hash's first bits, of 200 kB at most."""
    once = totals.where("distinct is not null").select(F.floor(F.col("b") / n).cast("int").alias("g"), "distinct", "words", "kinds", "counts", "tokens")
    rows = once.groupBy("g").applyInArrow(_merged, "g int, distinct long, words binary, kinds binary, counts binary, tokens binary").toArrow()
    by_kind = np.zeros((KINDS, 1 << FIRST_BITS), np.int64)
    if not rows.num_rows:
        none = np.zeros((3, 0), np.int64)
        return Layout.of(*none, *np.zeros((2, 64), np.int64), 8, Layout.sizes(0)[1:]), Tree.of(8, by_kind, none[0].astype(np.uint64), *none[1:], 0)
    for row in rows.select(["g", "tokens"]).to_pylist():
        by_kind[:, row["g"]] = np.frombuffer(row["tokens"], np.int64).reshape(2, -1).sum(0)
    whole = _merged(rows).to_pylist()[0]
    side, *weight_rows = Layout.sizes(whole["distinct"])
    shared = np.zeros((2, side * side), np.int64)
    for k, of_kind in enumerate(np.frombuffer(whole["tokens"], np.int64).reshape(2, -1)):
        np.add.at(shared[k], Layout.shared_places(np.arange(KINDS), side), of_kind)
    common = np.frombuffer(whole["words"], np.uint64), np.frombuffer(whole["kinds"], np.uint32), np.frombuffer(whole["counts"], np.int64)
    return Layout.of(*common, *shared, side, tuple(weight_rows)), Tree.of(side, by_kind, *common, whole["distinct"])


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers, not negative, by bytes: first the lowest of all, and as many as the greatest needs. Most are small,
    so that what is shuffled packs well."""
    n = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(x.reshape(-1).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _numbers(x: bytes, cells: int) -> np.ndarray:
    out = np.zeros((cells, 8), np.uint8)
    if not cells:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(x, np.uint8).reshape(-1, cells)
    out[:, : len(planes)] = planes.T
    return out.view("<i8").reshape(-1)


def _placed(layout: Layout, tree: Tree, chunk: Chunk, n: int, parts: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Forks]:
    """Places of the chunk's words, which of these share one, the context features of its tokens, and of its words the
    training counts and the forks, by what the ranges have sent back."""
    places, shares = layout.places_of(chunk.words, chunk.kinds % np.uint32(KINDS))
    order = np.argsort(_ranges_of(chunk.words, chunk.kinds, n), kind="stable")
    back = []
    for part in sorted(parts, key=lambda p: p["b"]):
        with common.open_in(part["file"]) as f:
            f.seek(part["at"])
            back.append(_unpacked(f.read(part["size"]), part["raw"]))
    sums, n_forks, *inner = (np.concatenate(x) for x in zip(*back, strict=True))
    c, of_word = np.empty((2, len(order)), np.int64)
    c[order], of_word[order] = sums, n_forks
    # From the order of ranges to that of words.
    starts = np.empty(len(order), np.int64)
    starts[order] = np.cumsum(n_forks) - n_forks
    at = np.arange(len(inner[0])) + np.repeat(starts - np.cumsum(of_word) + of_word, of_word)
    forks = Forks.of(layout, tree, chunk.words, chunk.kinds, c, (of_word, *(x[at] for x in inner)))
    return places, shares, contexts(chunk.words[chunk.ids], places[chunk.ids], chunk.sizes), c, forks


def _gradient(model, n: int) -> Callable:
    def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, tree, weights = model.value
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row)
                places, _, hashes, _, forks = _placed(layout, tree, chunk, n, row["parts"])
                learn = np.repeat(~np.array(row["held"], bool), chunk.sizes)
                hashes, ids = hashes[:, learn], chunk.ids[learn]
                made = tuple((*a, b) for a, b in zip(features_seen(hashes, places[ids], layout, weights[:2]), forks.seen(ids, hashes, weights[2]), strict=True))
                if total is None:
                    total = made
                else:
                    for a, b in zip((*total[0], *total[1]), (*made[0], *made[1]), strict=True):
                        a += b
        if total is None:
            return
        for k in range(3):
            for lo in range(0, len(weights[k]), _slice_rows(weights[k], layout)):
                part = slice(lo, lo + _slice_rows(weights[k], layout))
                yield pa.RecordBatch.from_pydict({"factor": [k], "lo": [lo], "cells": [total[0][k][part].size], "seen": [_planes(total[0][k][part])], "expected": [_planes(total[1][k][part])]})

    return gradient


def _dealt(chunks: DataFrame) -> DataFrame:
    """Rows of chunks are short, since texts and what came back lie in files: Spark would read many of them in one task."""
    return chunks.repartition(common.parts(chunks.sparkSession), "file", "at")


def _slice_rows(weights: np.ndarray, layout: Layout) -> int:
    return SLICE_ROWS * layout.side // weights.shape[1]


def _step(table: pa.Table) -> pa.Table:
    """What one slice of the weights moves by: the gradient over the curvature that it can have."""
    cells = table.column("cells")[0].as_py()
    seen, expected = (sum(_numbers(x, cells) for x in table.column(c).to_pylist()) for c in ("seen", "expected"))
    expected = expected / UNITS
    return pa.table({"factor": table.column("factor").slice(0, 1), "lo": table.column("lo").slice(0, 1), "move": [((seen - expected) / ((seen + expected) / 2 + 1)).astype(np.float32).tobytes()]})


def train(chunks: DataFrame, layout: Layout, tree: Tree, n: int, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, ...]:
    """Weights of classes, of places and of forks. A step is one job over the chunks of its part, which have what the ranges
    sent back. What comes to the driver, and goes out again, has the weights' size (21 MB at most) however large the corpus is."""
    spark = chunks.sparkSession
    weights = tuple(np.zeros(shape, np.float32) for shape in ((layout.class_rows, layout.side), (layout.place_rows, layout.side), (tree.rows, 2)))
    rows = chunks.select("part", "held", *_PLACE, "parts")
    for k in range(steps):
        sent = spark.sparkContext.broadcast((layout, tree, weights))
        sums = _dealt(rows.where(F.col("part") == k).drop("part")).mapInArrow(_gradient(sent, n), "factor long, lo long, cells long, seen binary, expected binary")
        moves = sums.groupBy("factor", "lo").applyInArrow(_step, "factor long, lo long, move binary").collect()
        weights = tuple(w.copy() for w in weights)
        for r in moves:
            w = weights[r.factor]
            w[r.lo : r.lo + _slice_rows(w, layout)] += rate / FEATURES * np.frombuffer(r.move, np.float32).reshape(-1, w.shape[1])
        sent.unpersist()
    return weights


def _scorer(model, n: int) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, tree, weights = model.value
        base = np.log10(float(layout.train_tokens + layout.train_distinct + 1))
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row)
                sizes, ids = chunk.sizes, chunk.ids
                places, shares, hashes, c, forks = _placed(layout, tree, chunk, n, row["parts"])
                own = layout.log_shared(places, shares, c)[ids] + log_probabilities(hashes, places[ids], layout, weights[:2]) + forks.log_gains(ids, hashes, weights[2])
                firsts = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64)[ids], firsts)), pa.array(np.full(len(sizes), layout.train_tokens)), pa.array(np.add.reduceat((np.log10(c + 1.0) - base)[ids], firsts)), pa.array(np.add.reduceat(own, firsts))],
                    names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


def score_texts(docs: DataFrame, held_out, *, key: str = "doc_id", text: str = "text", steps: int = STEPS) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    Learns from the rows for which ``held_out`` is not true. Tokens are runs of bytes other than white space, A-Z
    lower-cased, then one end. ``base_score`` is the add-one unigram log10 probability, ``score`` the model's. A null
    or empty text has the end alone. Null and repeated keys keep their rows; with nothing to learn from, all tokens
    are unknown; an empty table gives no rows. Texts are taken whole; other columns are ignored. Keys must be whole
    numbers or text of such.

    Neither counts nor scores depend on how the table is partitioned.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), held_out.alias("h"), F.col(text).cast("string").alias("t"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.coalesce("t", F.lit(""))), F.lit(steps)).cast("int"))
    folder = common.shared_dir(spark)
    chunks = common.written(rows.mapInArrow(_chunks(folder, steps), _CHUNK_DDL), f"{folder}/chunks.parquet")
    n = max(1, -(-16 * (chunks.agg(F.sum("n_words")).first()[0] or 0) // (RANGE_BYTES << FIRST_BITS)))
    dealt = chunks.select(*_PLACE).mapInArrow(_by_range(n), "b int, chunk string, words binary, kinds binary, counts binary")
    totals = common.written(dealt.repartition(n << FIRST_BITS, "b").groupBy("b").applyInArrow(_totals(folder), _TOTALS_DDL))
    layout, tree = _layout(totals, n)
    parts = totals.groupBy("chunk").agg(F.collect_list(F.struct(*_BACK)).alias("parts"))
    whole = common.written(chunks.join(parts, "chunk"))
    weights = train(whole, layout, tree, n, steps)
    sent = spark.sparkContext.broadcast((layout, tree, weights))  # 23 MB at most
    out = _dealt(whole.select("keys", "held", *_PLACE, "parts")).mapInArrow(_scorer(sent, n), "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)
