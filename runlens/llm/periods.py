"""Runs of repeated word sequences, found by internal pattern matching.

A run of smallest period q covers an aligned block of length b = 2^k <= q < 2b that occurs again q words later.  For
every aligned block of every dyadic length, the occurrences that start in the next window [i + b, i + 2b) are asked of a
wavelet tree over the suffix array: the block's suffixes are one interval of the array, and the range successor is the
least value in that interval from a position on.  Occurrences of a block in a window of its own length form one
arithmetic progression.  One or two of them are candidate periods themselves.  A longer progression, or one whose
difference fits twice into the block, means that the block repeats a shorter period, and only the distance of the ends
of the two stretches that repeat it can be a period.  So a block has at most two candidates, each is extended both ways
by equal dyadic blocks, and the work is near linear in the words whatever repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textwords import slices, span_hashes, text_bytes, word_spans

#: A run has at least this many words and this many periods.
MIN_WORDS = 6
MIN_PERIODS = 4


class BlockRanks:
    """Suffix array of several sequences at once, and the rank of every block of 2^k symbols, by prefix doubling.

    Blocks are equal when their ranks are; a rank is the first place of the block's suffixes in ``order``.  Only
    positions whose block occurs again are sorted further, so sequences without long repeats end after a few levels.
    """

    def __init__(self, symbols: np.ndarray, owner: np.ndarray):
        n = len(symbols)
        self.order = np.lexsort((symbols, owner))
        new = np.ones(n, dtype=bool)
        s, o = symbols[self.order], owner[self.order]
        new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[self.order] = self._first_places(np.arange(n), new)
        self.levels, self.sizes = [], []
        last = np.searchsorted(owner, owner, side="right")  # where the position's sequence ends
        width = 1
        while True:
            sizes = np.bincount(rank, minlength=n + 1)
            self.levels.append(rank.astype(np.int32))
            self.sizes.append(sizes.astype(np.int32))
            places = np.flatnonzero(sizes[rank[self.order]] > 1)
            if not len(places):
                return
            at = self.order[places]
            follow = np.where(at + width < last[at], rank[np.minimum(at + width, n - 1)], -1)
            by = np.lexsort((follow, rank[at]))
            at, follow, group = at[by], follow[by], rank[at][by]
            self.order[places] = at
            new = np.ones(len(at), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
            rank = rank.copy()
            rank[at] = self._first_places(places, new)
            width *= 2

    @staticmethod
    def _first_places(places: np.ndarray, new: np.ndarray) -> np.ndarray:
        return places[np.flatnonzero(new)][np.cumsum(new) - 1]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest equal stretches that start at ``a`` and ``b`` (a < b)."""
        n, out = len(self.order), np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            x, y = a + out, b + out
            inside = y < n
            same = inside & (self.levels[k][np.where(inside, x, 0)] == self.levels[k][np.where(inside, y, 0)])
            out[same] += 1 << k
        return out

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest equal stretches that end before ``a`` and ``b`` (a < b)."""
        out = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            x, y = a - out - (1 << k), b - out - (1 << k)
            inside = x >= 0
            same = inside & (self.levels[k][np.where(inside, x, 0)] == self.levels[k][np.where(inside, y, 0)])
            out[same] += 1 << k
        return out


class WaveletTree:
    """Counts and order statistics of value ranges in slices of an array; each level is a bit vector with prefix sums."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(len(values)).bit_length(), 1)
        self.ones, self.zeros = [], []
        values = values.astype(np.int64)
        for bit in reversed(range(self.bits)):
            one = (values >> bit) & 1 == 1
            sums = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(one, out=sums[1:])
            self.ones.append(sums)
            self.zeros.append(len(values) - int(sums[-1]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in [lo, hi) are less than ``x`` (0 <= x < 2^bits)."""
        out = np.zeros(len(lo), dtype=np.int64)
        for bit, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            l1, h1 = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            up = (x >> bit) & 1 == 1
            out += np.where(up, (hi - h1) - (lo - l1), 0)
            lo, hi = np.where(up, zeros + l1, lo - l1), np.where(up, zeros + h1, hi - h1)
        return out

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least value in [lo, hi), from 0."""
        out, k = np.zeros(len(lo), dtype=np.int64), k.copy()
        for bit, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            l1, h1 = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            low = (hi - h1) - (lo - l1)
            up = k >= low
            out |= up.astype(np.int64) << bit
            k = np.where(up, k - low, k)
            lo, hi = np.where(up, zeros + l1, lo - l1), np.where(up, zeros + h1, hi - h1)
        return out


def _candidates(ranks: BlockRanks, tree: WaveletTree, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, period) of the candidates of blocks of 2^k symbols."""
    n, b = len(ranks.order), 1 << k
    i = np.arange(0, n - b, b)
    size = ranks.sizes[k][ranks.levels[k][i]].astype(np.int64)
    i, size = i[size > 1], size[size > 1]
    lo = ranks.levels[k][i].astype(np.int64)
    hi = lo + size
    before, upto = tree.below(lo, hi, np.minimum(i + b, n)), tree.below(lo, hi, np.minimum(i + 2 * b, n))
    count = upto - before
    some = count > 0
    i, lo, hi, before, count = i[some], lo[some], hi[some], before[some], count[some]
    first = tree.nth(lo, hi, before)
    more = np.flatnonzero(count > 1)
    second = tree.nth(lo[more], hi[more], before[more] + 1)
    step = second - first[more]
    short = 2 * step <= b
    m, p = more[short], step[short]
    # the block repeats p: only the ends of the two stretches of period p can lie a period apart
    end, other = i[m] + p + ranks.ahead(i[m], i[m] + p), first[m] + p + ranks.ahead(first[m], first[m] + p)
    single = np.ones(len(i), dtype=bool)
    single[m] = False
    two = more[~short]
    start = np.concatenate([i[single], i[two], i[m]])
    period = np.concatenate([(first - i)[single], second[~short] - i[two], other - end])
    fits = (period >= b) & (period < 2 * b)
    return start[fits], period[fits]


def find_runs(symbols: np.ndarray, owner: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; ``owner`` ascends and parts the sequences.

    A run is a stretch of smallest period ``period`` that neither neighbour extends, of at least ``min_words`` symbols
    and ``min_periods`` (4 or more) periods.
    """
    if min_periods < 4:
        raise ValueError("a run of fewer than four periods need not hold an aligned block and its next occurrence")
    none = np.zeros(0, dtype=np.int64)
    if not len(symbols):
        return none, none, none
    ranks = BlockRanks(symbols, owner)
    tree = WaveletTree(ranks.order)
    found = []
    for k in range(len(ranks.levels)):
        start, period = _candidates(ranks, tree, k)
        lo = start - ranks.back(start, start + period)
        hi = start + period + ranks.ahead(start, start + period)
        long = hi - lo >= np.maximum(min_words, min_periods * period)
        found.append(np.stack([lo[long], hi[long], period[long]]))
    lo, hi, period = np.concatenate(found, axis=1)
    by = np.lexsort((period, hi, lo))
    lo, hi, period = lo[by], hi[by], period[by]
    # a stretch that also repeats a multiple of its period is one run
    new = np.ones(len(lo), dtype=bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    lo, hi, period = lo[new], hi[new], period[new]
    by = np.lexsort((period, lo))
    return lo[by], (hi - lo)[by], period[by]


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, borders) of texts of ``counts`` words each, joined by one space."""
    upto = np.cumsum(counts)
    size = ends - starts + 1
    size[upto[counts > 0] - 1] -= 1  # no space behind the last word
    after = np.cumsum(size)
    source = np.repeat(starts - (after - size), size) + np.arange(int(after[-1]) if len(after) else 0)
    out = buf[np.minimum(source, max(len(buf) - 1, 0))] if len(source) else np.zeros(0, dtype=np.uint8)
    out[(after - 1)[size > ends - starts]] = 0x20
    return out, np.r_[0, after][np.r_[0, upto]] if len(upto) else np.zeros(1, dtype=np.int64)


def _runs(column: str, keep: list[str], min_words: int, min_periods: int):
    def run(batches):
        for part in slices(batches, column):
            buf, offs = text_bytes(part.column(column))
            starts, ends, first = word_spans(buf, offs)
            counts = np.diff(first)
            owner = np.repeat(np.arange(len(counts)), counts)
            at, length, period = find_runs(span_hashes(buf, starts, ends), owner, min_words, min_periods)
            doc = owner[at]
            # words behind a run's first period go
            gone = np.zeros(len(starts) + 1, dtype=np.int64)
            np.add.at(gone, at + period, 1)
            np.add.at(gone, at + length, -1)
            kept = np.cumsum(gone)[:-1] == 0
            out, borders = _joined(buf, starts[kept], ends[kept], np.bincount(owner[kept], minlength=len(counts)))
            entry = pa.StructArray.from_arrays([pa.array(x) for x in (at - first[doc], length, period)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(counts) + 1)), pa.int32()), entry)
            text = pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(out)])
            columns = [*[part.column(c) for c in keep], pa.array(counts), runs, text]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """(keep..., n_words, runs, collapsed), one row per row of ``docs``.

    ``runs`` are (start, length, period) in words, by start and period; ``collapsed`` holds the words that no run
    contains behind its first period, joined by one space.  Words are compared by a 64-bit hash inside one text.  A
    null or empty text has no words, no runs and an empty ``collapsed``; repeated rows and ids are rows like others;
    other columns are ignored; an empty table gives an empty result.  Rows are independent: nothing is shuffled, and a
    task holds one slice of texts, or one longer text, at a time.
    """
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(*keep, docs[text].cast("string").alias(text)).mapInArrow(_runs(text, list(keep), min_words, min_periods), schema)
