"""Exact duplicates by counting quotient filters (operator 6).

1. One pass over the texts gives each row the SHA-256 of its normalised text (all of space and 0x09-0x0D
   deleted) and a 64-bit fingerprint.
2. Every partition builds a counting quotient filter of its fingerprints: the high bits (the quotient) name a
   run, the low bits (the remainder) are kept sorted in the run, each with a counter.  The filter is cut into
   blocks of quotients; the blocks of all partitions are merged by their sorted remainders, without loss.
3. Fingerprints counted more than once route their texts to byte verification: texts are grouped by their bytes.

A group of very many copies is one slot with a counter per partition in step 2, and in step 3 is salted and
pre-aggregated, so it costs each task at most one row per (salt, text, length).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.session import materialize

from .textwords import slices

#: Characters deleted before texts are compared.
DELETED = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Quotient bits of a block: about one fingerprint per quotient once all partitions are merged.
BLOCK_BITS = 16
#: Rows of one fingerprint go to this many places before their partial groups meet.
SALTS = 16

_U = np.uint64


class CountingQuotientFilter:
    """Occupied quotients with the length of their runs, and per slot a sorted remainder and a counter."""

    def __init__(self, quotients: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray, bits: int):
        self.quotients, self.lengths, self.remainders, self.counts, self.bits = quotients, lengths, remainders, counts, bits

    @classmethod
    def _of(cls, values: np.ndarray, weights: np.ndarray, bits: int) -> CountingQuotientFilter:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=np.int64)
        counts = np.add.reduceat(weights, first) if len(first) else weights
        values = values[first]
        quotient = values >> _U(bits)
        runs = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]]) if len(values) else first
        return cls(quotient[runs], np.diff(np.r_[runs, len(values)]), values & _U((1 << bits) - 1), counts, bits)

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int) -> CountingQuotientFilter:
        """``bits``: low bits that are the remainder."""
        return cls._of(np.asarray(fingerprints, dtype=_U), np.ones(len(fingerprints), dtype=np.int64), bits)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Runs of equal quotients are merged by their sorted remainders; counters of equal slots add up."""
        return cls._of(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]), filters[0].bits)

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients, self.lengths) << _U(self.bits)) | self.remainders

    def count(self, fingerprint: int) -> int:
        run = int(np.searchsorted(self.quotients, _U(fingerprint >> self.bits)))
        if run == len(self.quotients) or int(self.quotients[run]) != fingerprint >> self.bits:
            return 0
        a = int(self.lengths[:run].sum())
        b = a + int(self.lengths[run])
        slot = a + int(np.searchsorted(self.remainders[a:b], _U(fingerprint & ((1 << self.bits) - 1))))
        return int(self.counts[slot]) if slot < b and int(self.remainders[slot]) == fingerprint & ((1 << self.bits) - 1) else 0

    def cut(self, block_bits: int):
        """(block number, bytes) of each non-empty block of quotients."""
        if not len(self.quotients):
            return
        block = self.quotients >> _U(block_bits)
        at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        slot = np.r_[0, np.cumsum(self.lengths)]
        for a, b in zip(at, np.r_[at[1:], len(block)], strict=True):
            s = slice(int(slot[a]), int(slot[b]))
            parts = (self.quotients[a:b], self.lengths[a:b].astype(_U), self.remainders[s], self.counts[s].astype(_U))
            yield int(block[a]), np.concatenate([np.array([b - a, s.stop - s.start], dtype=_U), *parts]).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, bits: int) -> CountingQuotientFilter:
        x = np.frombuffer(raw, dtype=_U)
        r, n = int(x[0]), int(x[1])
        return cls(x[2 : 2 + r], x[2 + r : 2 + 2 * r].astype(np.int64), x[2 + 2 * r : 2 + 2 * r + n], x[2 + 2 * r + n :].astype(np.int64), bits)


def _normalised(batches, with_text: bool):
    """Rows (doc_id, n_chars, fp, text_sha256[, norm]) of rows (doc_id, text)."""
    for part in slices(batches, "text"):
        shas, fps, chars, norms = [], [], [], []
        for text in part.column("text").to_pylist():
            text = text or ""
            norm = text.encode("utf-8", "surrogatepass").translate(None, DELETED)
            digest = hashlib.sha256(norm)
            shas.append(digest.hexdigest())
            fps.append(int.from_bytes(digest.digest()[:8], "big", signed=True))
            chars.append(len(text))
            norms.append(norm)
        columns = [part.column("doc_id"), pa.array(chars, pa.int64()), pa.array(fps, pa.int64()), pa.array(shas, pa.string())]
        names = ["doc_id", "n_chars", "fp", "text_sha256"]
        if with_text:
            columns, names = [*columns[:3], pa.array(norms, pa.binary())], [*names[:3], "norm"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def counted_fingerprints(rows: DataFrame, total: int, column: str = "fp") -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once; ``total`` (rows) sets the number of blocks."""
    blocks = max(1, math.ceil(total / (1 << BLOCK_BITS)))
    bits = 64 - BLOCK_BITS - max(0, math.ceil(math.log2(blocks)))

    def build(batches):
        fps = [b.column(0).drop_null().to_numpy(zero_copy_only=False).view(_U) for b in batches]
        if fps:
            cut = list(CountingQuotientFilter.build(np.concatenate(fps), bits).cut(BLOCK_BITS))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in cut], pa.int64()), pa.array([x for _, x in cut], pa.binary())], names=["block", "filter"])

    def merge(table):
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x, bits) for x in table.column("filter").to_pylist()])
        more = whole.counts > 1
        return pa.table({"fp": pa.array(whole.fingerprints()[more].view(np.int64)), "n": pa.array(whole.counts[more], pa.int64())})

    return rows.select(column).mapInArrow(build, "block long, filter binary").groupBy("block").applyInArrow(merge, "fp long, n long")


def exact_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs`` (doc_id, text).

    Texts are equal when they are the same bytes after the deletion of every character of [\\x20\\x09-\\x0D]; a
    null text counts as empty, and all empty texts are one group.  Of equal texts the one with the most code
    points, then the smallest ``doc_id``, stays.  Rows that repeat a ``doc_id`` and its text get the same verdict
    and all count in ``group_size``.  A null ``doc_id`` stays only in a group that has no other id.  Other columns
    of ``docs`` are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    meta = materialize(docs.mapInArrow(lambda b: _normalised(b, False), f"doc_id {kind}, n_chars long, fp long, text_sha256 string"), "fingerprints")
    many = counted_fingerprints(meta, meta.count()).select("fp", F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("salt"))
    texts = docs.mapInArrow(lambda b: _normalised(b, True), f"doc_id {kind}, n_chars long, fp long, norm binary")
    routed = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(salts)).cast("int")).join(many, ["fp", "salt"])
    partial = routed.groupBy("fp", "salt", "norm", "n_chars").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    equal = partial.groupBy("fp", "norm", "n_chars").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    groups = (
        equal.select("fp", F.sha2("norm", 256).alias("text_sha256"), "n_chars", "n", "least")
        .groupBy("fp", "text_sha256")
        .agg(F.sum("n").alias("group_size"), F.min(F.struct(F.col("least").isNull().alias("none"), (-F.col("n_chars")).alias("short"), F.col("least").alias("id"))).alias("best"))
        .select("fp", "text_sha256", "group_size", F.col("best.id").alias("keep_id"))
    )
    groups = materialize(groups, "groups")  # a plain join then splits a group of very many rows
    out = meta.join(groups.withColumnRenamed("text_sha256", "sha"), (meta["fp"] == groups["fp"]) & (F.col("text_sha256") == F.col("sha")), "left")
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


@F.pandas_udf(T.StringType())
def normalised_sha256(texts: pd.Series) -> pd.Series:
    """SHA-256 (lowercase hex) of the normalised texts; null counts as empty."""
    return texts.map(lambda t: hashlib.sha256((t or "").encode("utf-8", "surrogatepass").translate(None, DELETED)).hexdigest())
