"""Repeated passages by super-k-mers (operator 10).

A window is ``WINDOW`` consecutive words.  Its minimiser is the least hash among its ``SEED``-word runs;
consecutive windows with the same minimiser travel as one packed string, the super-k-mer, to the bucket of the
minimiser, where sorting the windows finds the smallest document of every window sequence.

1. One pass lists the super-k-mers as (minimiser, doc, first word, windows).  A window can only repeat in another
   document if its minimiser does, so minimisers of a single document are dropped before any text moves.
2. The packed strings of the rest travel to their buckets.  A minimiser of very many super-k-mers or windows is dealt
   over several places; these first agree on the smallest document of each window, by one row per place and distinct
   window, and then judge their own super-k-mers like any other bucket.
3. Runs of removed words come back to their documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import materialize

from .textwords import mix64, slices, span_hashes, text_bytes, window_hashes, word_spans

WINDOW = 50
#: Words of a minimiser.
SEED = 12
#: Super-k-mers of one minimiser that one place takes, and their windows (a longer super-k-mer is not cut).
PER_PLACE = 512
WINDOWS_PER_PLACE = 1 << 16

_U = np.uint64


def super_kmers(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, number of windows) of the runs of windows of one text that share a minimiser."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    runs = mix64(window_hashes(words, seed) ^ _U(0x5851F42D4C957F2D))
    span = window - seed + 1
    # sliding minimum by doubling: least[i] = min(runs[i : i + width])
    least, width = runs, 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n], least[span - width : span - width + n])
    least = least[:n]
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[first], first, np.diff(np.r_[first, n])


def _list_runs(window: int, seed: int):
    def run(batches):
        for part in slices(batches, "text"):
            buf, offs = text_bytes(part.column("text"))
            starts, ends, first = word_spans(buf, offs)
            words = span_hashes(buf, starts, ends)
            docs, rows = (part.column(c).to_numpy() for c in ("doc", "row"))
            cols = [[], [], [], [], []]
            for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                m, at, n = super_kmers(words[a:b], window, seed)
                if len(m):
                    for c, v in zip(cols, (m.view(np.int64), np.full(len(m), docs[i]), np.full(len(m), rows[i]), at, n), strict=True):
                        c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["minimiser", "doc", "row", "first", "windows"])

    return run


_PACKED = "minimiser long, place int, doc long, row long, first long, packed binary"


def _pack(window: int):
    """Cut the packed strings of the listed runs out of the texts."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["minimiser", "place", "doc", "row", "first", "packed"]

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    def run(batches):
        for part in slices(batches, "text"):
            buf, offs = text_bytes(part.column("text"))
            starts, ends, first = word_spans(buf, offs)
            out, size = [[] for _ in names], 0
            docs, rows = (part.column(c).to_pylist() for c in ("doc", "row"))
            for i, runs in enumerate(part.column("runs").to_pylist()):
                for r in runs:
                    a = first[i] + r["first"]
                    packed = buf[starts[a] : ends[a + r["windows"] + window - 2]].tobytes()
                    for c, v in zip(out, (r["minimiser"], r["place"], docs[i], rows[i], r["first"], packed), strict=True):
                        c.append(v)
                    size += len(packed)
                    if size > 1 << 21:
                        yield made(out)
                        out, size = [[] for _ in names], 0
            if out[0]:
                yield made(out)

    return run


def _windows(packed: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window's word sequence, the super-k-mer and the offset of the window in it."""
    cols, done = [[np.zeros(0, dtype=kind)] for kind in (_U, _U, np.int64, np.int64)], 0
    for part in slices([pa.RecordBatch.from_arrays([packed], names=["packed"])], "packed"):  # hashing takes some 50 bytes a byte
        buf, offs = text_bytes(part.column("packed"))
        starts, ends, first = word_spans(buf, offs)
        count = np.diff(first) - window + 1
        owner = np.repeat(np.arange(part.num_rows), count)
        offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = first[owner] + offset
        keys = [window_hashes(span_hashes(buf, starts, ends, seed=seed), window)[at] for seed in (2, 3)]
        for c, v in zip(cols, (*keys, owner + done, offset), strict=True):
            c.append(v)
        done += part.num_rows
    return tuple(np.concatenate(c) for c in cols)


def _places(runs: DataFrame) -> DataFrame:
    """(minimiser, places) of the minimisers of several documents."""
    found = runs.groupBy("minimiser").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("windows").alias("windows"))
    places = F.greatest(F.ceil(F.col("n") / PER_PLACE), F.ceil(F.col("windows") / WINDOWS_PER_PLACE))
    return found.where("lo < hi").select("minimiser", F.least(places, "n").cast("int").alias("places"))


def _whole_groups(batches):
    """Tables of sorted rows in which no (minimiser, place) is cut; a place has about PER_PLACE super-k-mers at most."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        m, p = (b.column(c).to_numpy() for c in ("minimiser", "place"))
        cuts = np.flatnonzero((m[1:] != m[:-1]) | (p[1:] != p[:-1])) + 1
        to = int(cuts[-1]) if len(cuts) else 0
        if held and (to or last != (m[0], p[0])):
            yield pa.Table.from_batches([*held, b.slice(0, to)]).combine_chunks()
            held = []
        elif to:
            yield pa.Table.from_batches([b.slice(0, to)]).combine_chunks()
        held.append(b.slice(to))
        last = (m[-1], p[-1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).chunks
    return chunks[0] if chunks else pa.array([], table.schema.field(name).type)


def _least(window: int):
    """(minimiser, place, window, smallest doc there) of every distinct window of a place."""

    def run(batches):
        for table in _whole_groups(batches):
            k0, k1, owner, _ = _windows(_column(table, "packed"), window)
            m, place, doc = (_column(table, c).to_numpy()[owner] for c in ("minimiser", "place", "doc"))
            order = np.lexsort((doc, place, k1, k0))
            k0, k1, m, place, doc = k0[order], k1[order], m[order], place[order], doc[order]
            new = np.r_[True, (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1]) | (place[1:] != place[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(c[new]) for c in (m, place, k0.view(np.int64), k1.view(np.int64), doc)], names=["minimiser", "place", "k0", "k1", "doc"])

    return run


def _judge(window: int):
    """Runs (doc, row, start, stop) of words under windows that also start in a document with a smaller id."""

    def run(batches):
        for table in _whole_groups(batches):
            known = table.filter(pc.equal(table.column("kind"), 0)).combine_chunks()
            own = table.filter(pc.equal(table.column("kind"), 1)).combine_chunks()
            if not own.num_rows:
                continue
            k0, k1, owner, offset = _windows(_column(own, "packed"), window)
            docs, rows, first = (_column(own, c).to_numpy() for c in ("doc", "row", "first"))
            doc = docs[owner]
            a0, a1, ad = (np.concatenate([x, _column(known, c).to_numpy(zero_copy_only=False).astype(np.int64).view(x.dtype)]) for x, c in ((k0, "k0"), (k1, "k1"), (doc, "doc")))
            order = np.lexsort((ad, a1, a0))
            s0, s1 = a0[order], a1[order]
            new = np.r_[True, (s0[1:] != s0[:-1]) | (s1[1:] != s1[:-1])]
            least = np.empty(len(ad), dtype=np.int64)
            least[order] = ad[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            hit = least[: len(doc)] < doc
            mine, at = owner[hit], offset[hit]
            if len(mine):
                cut = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)])
                end = np.r_[cut[1:], len(mine)] - 1
                start, stop = first[mine[cut]] + at[cut], first[mine[end]] + at[end] + window
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (docs[mine[cut]], rows[mine[cut]], start, stop)], names=["doc", "row", "start", "stop"])

    return run


def _cut(batches):
    """Digest columns of each text and its removed runs."""
    for part in slices(batches, "text"):
        buf, offs = text_bytes(part.column("text"))
        starts, ends, first = word_spans(buf, offs)
        words, removed, digests, texts = [], [], [], []
        for i, runs in enumerate(part.column("runs").to_pylist()):
            a, n = first[i], int(first[i + 1] - first[i])
            gone = np.zeros(n + 1, dtype=np.int64)
            for r in runs or ():
                gone[r["start"]] += 1
                gone[r["stop"]] -= 1
            keep = np.flatnonzero(np.cumsum(gone)[:n] == 0) + a
            raw, base = buf[offs[i] : offs[i + 1]].tobytes(), int(offs[i])
            kept = b" ".join([raw[s:e] for s, e in zip((starts[keep] - base).tolist(), (ends[keep] - base).tolist(), strict=True)])
            words.append(n)
            removed.append(n - len(keep))
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept)
        arrays = [part.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def repeated_passages(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text), one row per row of ``docs`` (doc_id, text).

    Each word under a window of ``window`` words whose sequence also starts in a document with a smaller doc_id is
    removed; windows are judged on the input.  ``kept_text`` is the kept words joined by one space.  A null text has
    no words.  Rows that repeat a doc_id don't cost each other words (the same id is not smaller), and all
    come back.  A row with a null doc_id neither removes nor loses words.  Other columns are ignored; an empty table gives
    an empty result.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text")
    named = docs.where("doc IS NOT NULL")
    runs = materialize(named.mapInArrow(_list_runs(window, seed), "minimiser long, doc long, row long, first long, windows long"), "runs")
    shared = materialize(_places(runs), "shared")
    place = F.pmod(F.xxhash64("row", "first"), F.col("places")).cast("int").alias("place")
    # a set, so that rows which repeat a document send its runs once
    listed = runs.join(shared, "minimiser").groupBy("doc", "row").agg(F.collect_set(F.struct("minimiser", place, "first", "windows")).alias("runs"))
    packed = materialize(named.join(listed, ["doc", "row"]).select("doc", "row", "text", "runs").mapInArrow(_pack(window), _PACKED), "packed")
    own = packed.select("*", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("k0"), F.lit(None).cast("long").alias("k1"))
    in_places = lambda df: df.repartition(n, "minimiser", "place").sortWithinPartitions("minimiser", "place")
    split = own.join(shared.where("places > 1").select("minimiser"), "minimiser", "left_semi")
    local = in_places(split).mapInArrow(_least(window), "minimiser long, place int, k0 long, k1 long, doc long")
    # a window has one row per place
    least = F.min("doc").over(Window.partitionBy("minimiser", "k0", "k1"))
    none = {c: F.lit(None).cast("long") for c in ("row", "first")}
    known = local.withColumn("least", least).where("least < doc").select(
        "minimiser", "place", F.col("least").alias("doc"), none["row"].alias("row"), none["first"].alias("first"), F.lit(None).cast("binary").alias("packed"), F.lit(0).alias("kind"), "k0", "k1"
    )
    gone = in_places(own.unionByName(known)).mapInArrow(_judge(window), "doc long, row long, start long, stop long")
    per_doc = gone.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    out = docs.join(per_doc, ["doc", "row"], "left").select(F.col("doc").alias("doc_id"), "text", "runs")
    return out.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
