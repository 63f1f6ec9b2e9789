"""Mixing sources to target weights by hash-threshold histograms (operator 9).

A source's target is a number of whole copies of all its documents plus a rest.  The rest is taken from the
documents whose hash lies below the source's threshold: words are summed by (source, hash bucket), the nested
histogram shows in which bucket the budget ends, and only that bucket is refined by the next bits of the hash.
Documents are then filtered by comparing hashes; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.ordering import positions
from runlens.session import materialize

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix takes this share of all words; a source stops at LIMIT times its size.
SHARE = 1.5
LIMIT = 2.0
#: Bits of the hash per histogram level, and levels: 2^-30 of a source is finer than a document in any corpus.
BITS, LEVELS = 10, 3


def word_count(text: str) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Sources in code-point order (null last) get the repeating weights and share ``share`` of all words; a target
    stops at ``limit`` times its source's size and the excess is shared again by weight until none is above.  The
    table of sources stays distributed: the driver only sees sums, once per round.
    """
    order = positions(sizes.select("source", "source_size"), [F.col("source").isNull(), F.col("source")], out="pos")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("pos") - 1) % len(weights) + 1).cast("int"))
    state = materialize(order.select("source", "source_size", weight.alias("weight"), (F.lit(limit) * F.col("source_size")).alias("most")), "sources")
    total = state.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    # the level: words per unit of weight of the sources that have not stopped; it only rises
    level = 0.0
    while True:
        stopped = F.col("most") < F.lit(level) * F.col("weight")
        row = state.agg(F.sum(F.when(stopped, F.col("most"))).alias("full"), F.sum(F.when(~stopped, F.col("weight"))).alias("open")).first()
        new = (share * total - (row["full"] or 0.0)) / row["open"] if row["open"] else level
        if not row["open"] or new <= level:
            break
        level = new
    return state.select("source", "source_size", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def _prefix(level: int) -> Column:
    """The first ``level * BITS`` bits of the hash, as a number."""
    return F.shiftrightunsigned(F.col("h"), 64 - level * BITS)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken), one row per row of ``docs`` (doc_id, source, text).

    ``copies`` is how often the mix takes the document, ``taken`` its words.  The hash is of doc_id and text, so
    reruns agree, and equal rows are taken or left together.  A null text has size 0; null sources are one source
    and come last; a source without words has target 0.  Other columns are ignored; an empty table gives an empty
    result.
    """
    sized = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"), F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("h")), "sizes")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    # whole copies of everything, and the budget that the hash threshold has to fill
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("whole", F.floor(ratio + F.lit(1e-12)).cast("long")).withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    goals = materialize(goals.withColumn("key", F.xxhash64(F.struct("source"))), "targets")
    keyed = sized.withColumn("key", F.xxhash64(F.struct("source")))

    cut = goals.select("key", "budget", F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("below"))
    for level in range(1, LEVELS + 1):
        inside = keyed if level == 1 else keyed.join(cut.select("key", "at"), "key").where(_prefix(level - 1) == F.col("at"))
        histogram = inside.groupBy("key", _prefix(level).alias("cell")).agg(F.sum("size").alias("words"))
        # at most 2^BITS cells of one source and level
        up_to = F.sum("words").over(Window.partitionBy("key").orderBy("cell"))
        walked = histogram.withColumn("up_to", up_to).join(cut.select("key", "budget", "below"), "key")
        # the cell in which the budget ends; cells before it are taken whole
        ends = F.when(F.col("below") + F.col("up_to") > F.col("budget"), F.struct("cell", (F.col("below") + F.col("up_to") - F.col("words")).alias("before"), "words"))
        found = walked.groupBy("key").agg(F.min(ends).alias("e"), F.max(F.struct("cell", (F.col("below") + F.col("up_to")).alias("before"), F.lit(0).cast("long").alias("words"))).alias("all"))
        pick = lambda name, none: F.coalesce(f"e.{name}", f"all.{name}", none)
        cut = materialize(
            cut.join(found, "key", "left").select(
                "key", "budget",
                F.coalesce("e.cell", F.col("all.cell") + 1, F.shiftleft("at", BITS)).alias("at"),
                pick("before", F.col("below")).alias("below"), pick("words", F.lit(0)).alias("words"),
            ),
            "thresholds",
        )
    # the last cell goes in if that comes nearer to the budget
    threshold = cut.select("key", (F.col("at") + F.when(2 * (F.col("budget") - F.col("below")) > F.col("words"), 1).otherwise(0)).alias("threshold"))
    goals = goals.join(threshold, "key", "left")
    copies = F.col("whole") + F.when((F.col("budget") > 0) & (_prefix(LEVELS) < F.col("threshold")), 1).otherwise(0)
    out = keyed.join(goals.drop("source"), "key")
    return out.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
