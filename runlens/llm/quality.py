"""Quality rules with cross-document line frequency (operator 3).

Base rules look at one document (few words, repeated three-word windows).  Line rules look at the host (``source``):

1. normalised lines are hashed, once per document, and the documents that hold a line are counted per host;
2. a line is frequent when it is in more documents than both limits allow; the one that grows with the host ends at
   ``enough_documents``.  Frequent lines are counted again over distinct documents: a document whose 5-word shingles lie
   almost all in runs of frequent lines is a copy, and copies count once a group.  A line that is still in enough
   documents is boilerplate;
3. boilerplate lines are removed, and documents that too few words are left of are rejected.

Counting before confirming keeps a document that was copied a thousand times: its lines are frequent, but they are in
one distinct document, and the choice among copies is left to the duplicate operators.  ``copy_share`` is where these
join two documents of the same runs: two that share s of their shingles have a similarity of s / (2 - s).  Words of
a page's own between the lines break the shingles, so such a page is no copy: it counts.  For a line, copies are one
group when the smallest hash of their other frequent lines is the same, so copies with some lines changed make few
groups, and pages put together from many frequent lines make many.  Groups are counted low rather than high: a line
that only copies hold may have to be in more of them than the limit says.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.session import materialize

from .textwords import slices, span_hashes, text_bytes, window_hashes, word_spans

MIN_WORDS = 50
#: Percent of the words that may lie in repeated three-word windows.
MAX_REPEAT_PERCENT = 50
#: A line is frequent in more than MIN_DOCUMENTS documents and more than MIN_SHARE of the host's documents; in more than
#: ENOUGH_DOCUMENTS it is frequent on a host of any size.
MIN_DOCUMENTS = 10
MIN_SHARE = 0.01
ENOUGH_DOCUMENTS = 100
#: From this share of shingles in runs of frequent lines on, a document counts as a copy: s / (2 - s) is 0.75 at 6/7.
COPY_SHARE = 6 / 7
SHINGLE = 5
#: A document is depleted when less than this share of its words is left.
LEFT_SHARE = 0.3

_U = np.uint64
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeated_words(words: np.ndarray) -> int:
    """Words that lie in a three-word window which the text holds twice or more."""
    windows = window_hashes(words, 3)
    if len(windows) < 2:
        return 0
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    hit = counts[back] > 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(hit), 1)
    np.add.at(covered, np.flatnonzero(hit) + 3, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def line_table(buf: np.ndarray, offs: np.ndarray):
    """Lines (\\n-split) that hold a word: (text index, start byte, end byte, first word, end word)."""
    starts, ends, first = word_spans(buf, offs)
    cut = np.flatnonzero(buf == 0x0A)
    begin = np.unique(np.concatenate([offs[:-1], cut + 1]))
    begin = begin[begin < len(buf)]
    stop = np.minimum(np.append(begin[1:], len(buf)), np.append(cut, len(buf))[np.searchsorted(cut, begin)])
    a, b = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    full = b > a
    text = np.searchsorted(offs, begin, side="right") - 1
    return text[full], begin[full], stop[full], a[full], b[full], (starts, ends, first)


def line_hashes(raw: bytes, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The first 64 bits of the MD5 of each normalised line (its words, joined by one space), in the order of the digests."""
    md5 = hashlib.md5
    digests = b"".join([md5(b" ".join(raw[x:y].split())).digest()[:8] for x, y in zip(begin.tolist(), stop.tolist(), strict=True)])
    # signed numbers ascend as the digests do
    return np.frombuffer(digests, dtype=">u8").astype(_U) ^ _U(1 << 63)


def _measure(batches):
    """Per document the base counts and its lines in order: hash and words."""
    for part in slices(batches, "text"):
        buf, offs = text_bytes(part.column("text"))
        text, begin, stop, a, b, (starts, ends, first) = line_table(buf, offs)
        words = span_hashes(buf, starts, ends)
        raw = span_hashes(buf, begin, stop, seed=1)
        hashes = line_hashes(buf.tobytes(), begin, stop)
        line = np.searchsorted(text, np.arange(len(offs)))
        # continuation bytes of UTF-8 are not code points; spaces are not in words
        char = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        sign = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
        per_word = np.concatenate([[0], np.cumsum(char[ends] - char[starts])])
        out = {c: [] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "words")}
        for i in range(len(offs) - 1):
            x, y = first[i], first[i + 1]
            p, q = line[i], line[i + 1]
            out["n_words"].append(int(y - x))
            out["word_chars"].append(int(per_word[y] - per_word[x]))
            out["n_symbols"].append(int(sign[offs[i + 1]] - sign[offs[i]]))
            out["n_dup_lines"].append(int(q - p - len(np.unique(raw[p:q]))))
            out["n_repeat_words"].append(_repeated_words(words[x:y]))
            out["lines"].append(hashes[p:q].view(np.int64))
            out["words"].append((b - a)[p:q])
        kinds = {"lines": pa.list_(pa.int64()), "words": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_fp"), part.column("host"), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items())], names=["doc_id", "row_fp", "host", *out])


@F.pandas_udf(T.StringType())
def without_lines(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """The texts without the lines whose hashes ``gone`` lists; null stays null."""
    out = list(texts)
    for i, hashes in enumerate(gone):
        if out[i] is not None and hashes is not None and len(hashes):
            raw = out[i].encode("utf-8", "surrogatepass")
            buf, offs = np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)])
            _, begin, stop, *_ = line_table(buf, offs)
            drop = np.isin(line_hashes(raw, begin, stop).view(np.int64), np.asarray(hashes, dtype=np.int64))
            keep = np.ones(len(raw), dtype=bool)
            for s, e in zip(begin[drop], stop[drop], strict=True):
                keep[s : e + 1] = False  # with its line feed
            out[i] = buf[keep].tobytes().decode("utf-8", "surrogatepass")
    return pd.Series(out, dtype=object)


def _above(counted: DataFrame, hosts: DataFrame, min_documents: int, min_share: float, enough: int) -> DataFrame:
    """The counted lines (host, line, n) above the limits; ``hosts`` has the documents of each host."""
    share = (F.col("n") > F.lit(min_share) * F.col("host_docs")) | (F.col("n") > enough)
    return counted.where(F.col("n") > min_documents).join(hosts, "host").where(share).select("host", "line")


def _in_runs() -> Column:
    """Shingles of (lines, words) that lie wholly in runs of consecutive ``frequent`` lines."""
    step = F.struct(F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("run"))
    shingles = lambda run: F.greatest(run - (SHINGLE - 1), F.lit(0).cast("long"))

    def line(s, x):
        hit = F.array_contains("frequent", x["lines"])
        return F.struct(
            F.when(hit, s["done"]).otherwise(s["done"] + shingles(s["run"])).alias("done"), F.when(hit, s["run"] + x["words"]).otherwise(F.lit(0).cast("long")).alias("run")
        )

    return F.aggregate(F.arrays_zip("lines", "words"), step, line, lambda s: s["done"] + shingles(s["run"]))


def row_fp() -> Column:
    """Rows with the same id, host and text are one document to the line rules."""
    return F.xxhash64("doc_id", "source", "text")


def line_verdicts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, enough_documents: int = ENOUGH_DOCUMENTS,
                  copy_share: float = COPY_SHARE) -> tuple[DataFrame, DataFrame]:
    """(measures per document, occurrences (doc_id, row_fp, line, words) of boilerplate lines)."""
    host = F.xxhash64(F.struct(F.col("source").cast("string"))).alias("host")  # a null source is a host of its own
    measured = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_fp().alias("row_fp"), host, "text").mapInArrow(
            _measure,
            "doc_id long, row_fp long, host long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, words array<long>",
        ),
        "measures",
    )
    limits = (min_documents, min_share, enough_documents)
    # rows that repeat a document are one document; a line is counted once a document
    document = ["doc_id", "row_fp", "host"]
    hosts = materialize(measured.select(*document).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")).where(F.col("host_docs") > min_documents), "hosts")
    held_lines = measured.select(*document, "n_words", F.explode(F.array_distinct("lines")).alias("line"))
    # repeated rows only raise this first count, so it loses no line; the second is exact and over its few lines
    likely = materialize(held_lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_documents).select("host", "line"), "likely")
    # joins are written as they are: rows of a hot line are then split, and told apart by document afterwards
    held = materialize(held_lines.join(likely, ["host", "line"]), "occurrences")
    frequent = materialize(_above(held.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")), hosts, *limits), "lines")
    held = materialize(held.join(frequent, ["host", "line"]), "held")
    own = held.groupBy(*document, "n_words").agg(F.array_sort(F.collect_set("line")).alias("frequent"))
    text = measured.select(F.col("doc_id").alias("d"), F.col("row_fp").alias("r"), "lines", "words").dropDuplicates(["d", "r"])
    own = own.join(text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_fp") == F.col("r")))
    copy = _in_runs() >= F.lit(copy_share) * F.greatest(F.col("n_words") - (SHINGLE - 1), F.lit(1))
    # a document that is no copy counts by itself, copies by their group
    voters = own.select(*document, "frequent", F.arrays_zip("lines", "words").alias("all"), copy.alias("copy"))
    words_of = lambda line: F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + F.when(x["lines"] == line, x["words"]).otherwise(F.lit(0)))
    votes = materialize(voters.select(*document, "copy", F.slice("frequent", 1, 2).alias("least"), F.explode("frequent").alias("line"), "all").select(
        *document, "copy", "least", "line", words_of(F.col("line")).alias("words")), "votes")
    other = F.when(F.col("least")[0] != F.col("line"), F.col("least")[0]).otherwise(F.coalesce(F.get("least", F.lit(1)), F.col("line")))
    groups = votes.groupBy("host", "line", F.when(F.col("copy"), other).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    distinct = groups.groupBy("host", "line").agg(F.sum(F.when(F.col("group").isNull(), F.col("n")).otherwise(1)).alias("n"))
    # written, so that no aggregate keeps the hot lines of the last join in one task
    boilerplate = materialize(_above(distinct, hosts, *limits), "boilerplate")
    return measured, votes.join(boilerplate, ["host", "line"]).select("doc_id", "row_fp", "line", "words")


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality_rules(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, enough_documents: int = ENOUGH_DOCUMENTS,
                  copy_share: float = COPY_SHARE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text) with its base counts and verdict.

    Columns: doc_id, row_fp, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words (words
    of removed lines), removed_lines (hashes), depleted, kept.  ``kept`` is false when the base rules fail or the
    removal of boilerplate lines depletes the document.  A null text has no words and fails; a null source is a host
    of its own; rows that repeat a document (id, source and text) count as one and all come back.  An empty table gives
    an empty result; other columns are ignored.
    """
    measured, gone = line_verdicts(docs, min_documents, min_share, enough_documents, copy_share)
    per_doc = gone.groupBy(F.col("doc_id").alias("d"), F.col("row_fp").alias("r")).agg(F.sum("words").alias("removed"), F.collect_list("line").alias("removed_lines"))
    out = measured.drop("lines", "words").join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_fp") == F.col("r")), "left")
    removed = F.coalesce("removed", F.lit(0)).cast("long")
    left = F.col("n_words") - removed
    depleted = left < F.lit(LEFT_SHARE) * F.col("n_words")
    return out.select(
        "doc_id", "row_fp", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _base_failed().alias("base_failed"),
        removed.alias("n_removed_words"), F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"),
        depleted.alias("depleted"), (~_base_failed() & ~depleted).alias("kept"),
    )
