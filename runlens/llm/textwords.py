"""Words and word hashes of whole Arrow text columns, as flat numpy arrays.

Words are maximal runs of bytes other than space and 0x09-0x0D.  All functions take the UTF-8 bytes of
many texts at once (``buf``) and the text borders (``offs``), so their cost is per byte, not per Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes (a longer text is a slice of its own).
SLICE_BYTES = 1 << 21

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection of 64-bit words that spreads every input bit."""
    x = np.asarray(x, dtype=_U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about ``limit`` text bytes; no row is cut."""
    for batch in batches:
        sizes = np.diff(offsets(batch.column(column)))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def offsets(column: pa.Array) -> np.ndarray:
    """Borders of the texts in the column's data buffer, as they lie there."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, borders of the texts); a null text is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    offs = offsets(column)
    data = column.buffers()[2] if len(column) else None
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte of every word; index of the first word of every text, and the word count at the end)."""
    inside = ~_SPACE[buf]
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offs] = True  # a text border also parts words
    before = np.empty(len(buf), dtype=bool)
    if len(buf):
        before[0] = False
        before[1:] = inside[:-1]
    after = np.empty(len(buf), dtype=bool)
    if len(buf):
        after[-1] = False
        after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Base of the polynomial hash and its inverse modulo 2^64.
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span.

    The sum of table[byte] * base^position over a span is a difference of two prefix sums; times base^-start it does
    not depend on where the span lies.
    """
    if not len(starts):
        return np.zeros(0, dtype=_U)
    table = mix64(np.arange(256, dtype=_U) + _U(seed * 1000003 + 7919))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, dtype=_U)
        np.cumsum(table[buf] * _powers(_BASE, len(buf)), out=sums[1:])
        spans = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(buf) + 1)[starts]
        return mix64(mix64(spans) + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values (len(words) - width + 1 of them, also across texts).

    By doubling: two windows of half the width make one, and two overlapping ones make up the rest.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out, have = mix64(words + _U(width)), 1
    with np.errstate(over="ignore"):
        while have < width:
            step = min(have, width - have)
            out = mix64(out[: len(out) - step] * _U(0x9E3779B97F4A7C15) + out[step:])
            have += step
    return out


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its ``width``-word shingles (lower-cased A-Z).

    A text of fewer words is one shingle; one without words has none.
    """
    buf = lower_ascii(buf)
    starts, ends, first = word_spans(buf, offs)
    words = span_hashes(buf, starts, ends)
    windows = window_hashes(words, width)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out
