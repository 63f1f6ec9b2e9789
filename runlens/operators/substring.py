"""Substring joins of two tables through an inverted index of q-grams.

A name can only contain a request if it contains the request's rarest q-gram.  So the names' grams are counted once
(a map-side combined aggregate), every request probes the one of its grams that fewest names hold, and only the
names' postings of probed grams are joined, by equality, and then verified.  Postings of a gram that many names hold
are dealt over places, and the requests that probe it are repeated per place, so no gram is one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.session import materialize

#: Postings of one gram and place.
PER_PLACE = 100_000
#: Probed grams are sent to all tasks up to this number (some 50 bytes each), and joined by shuffle beyond it.
SENT_GRAMS = 200_000


def grams(text: Column, q: int) -> Column:
    """The distinct ``q``-character stretches of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), 1))


def _fold(c: Column, ignore_case: bool) -> Column:
    return F.lower(c) if ignore_case else c


def _matches(requests: DataFrame, names: DataFrame, pattern: str, name: str, keys: list[str], order: list[str], q: int, ignore_case: bool) -> DataFrame:
    """(keys..., __pattern folded, __name, __o0...) of every match."""
    own = names.select(*keys, F.col(name).alias("__name"), *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)]).where(F.col("__name").isNotNull())
    own = own.withColumn("__text", _fold(F.col("__name"), ignore_case))
    wanted = requests.select(*keys, _fold(F.col(pattern), ignore_case).alias("__pattern")).where(F.length("__pattern") > 0).distinct()
    wanted = wanted.withColumn("__size", F.least(F.length("__pattern"), F.lit(q)))
    # only the lengths that some request probes are indexed: q, and those of short requests
    sizes = sorted(r[0] for r in wanted.select("__size").distinct().collect())  # at most q numbers
    if not sizes:
        sizes = [q]
    all_grams = F.concat(*[grams(F.col("__text"), s) for s in sizes])
    counts = own.select(*keys, F.explode(all_grams).alias("__gram")).groupBy(*keys, "__gram").agg(F.count(F.lit(1)).alias("__n"))
    probing = F.when(F.col("__size") < q, F.array("__pattern")).otherwise(grams(F.col("__pattern"), q))
    asked = wanted.select(*keys, "__pattern", F.size(probing).alias("__all"), F.explode(probing).alias("__gram"))
    known = asked.join(counts, [*keys, "__gram"]).groupBy(*keys, "__pattern", "__all").agg(
        F.min(F.struct("__n", "__gram")).alias("__rarest"), F.count(F.lit(1)).alias("__held")
    )
    # a gram that no name holds settles its request
    probes = known.where(F.col("__held") == F.col("__all")).select(
        *keys, "__pattern", F.col("__rarest.__gram").alias("__gram"), F.ceil(F.col("__rarest.__n") / PER_PLACE).cast("int").alias("__places")
    )
    probes = materialize(probes, "probes")
    probed = probes.groupBy(*keys, "__gram").agg(F.max("__places").alias("__places"))
    few = probed.limit(SENT_GRAMS + 1).count() <= SENT_GRAMS
    postings = own.withColumn("__gram", F.explode(all_grams)).join(F.broadcast(probed) if few else probed, [*keys, "__gram"])
    place = F.pmod(F.xxhash64("__name", *[f"__o{i}" for i in range(len(order))]), F.col("__places")).cast("int")
    postings = postings.withColumn("__place", place).drop("__places")
    placed = probes.withColumn("__place", F.explode(F.sequence(F.lit(0), F.col("__places") - 1))).drop("__places")
    hits = postings.join(placed, [*keys, "__gram", "__place"]).where(F.contains("__text", "__pattern"))
    return hits.select(*keys, "__pattern", "__name", *[f"__o{i}" for i in range(len(order))])


def substring_matches(requests: DataFrame, names: DataFrame, pattern: str, name: str, keys: Sequence[str] = (), order: Sequence[str] = (),
                      q: int = 3, ignore_case: bool = True) -> DataFrame:
    """(keys..., pattern, name, order...): every pair of a distinct request and a name of the same ``keys`` that contains it.

    A request shorter than ``q`` is its own gram.  An empty or null request, and null keys or names, match nothing
    here (``first_containing`` gives an empty request the first name).  Repeated names stay repeated.
    """
    keys, order = list(keys), [o for o in order if o != name]
    hits = _matches(requests, names, pattern, name, keys, order, q, ignore_case)
    return hits.select(*keys, F.col("__pattern").alias(pattern), F.col("__name").alias(name), *[F.col(f"__o{i}").alias(o) for i, o in enumerate(order)])


def first_containing(requests: DataFrame, names: DataFrame, pattern: str, name: str, order: Sequence[str], keys: Sequence[str] = (),
                     out: str = "match", q: int = 3, ignore_case: bool = True) -> DataFrame:
    """``requests`` with the first name by ``order`` (of the same ``keys``) that contains the request, and ``n_candidates``.

    Every request row stays: without a match ``out`` is NULL and the count 0.  An empty request is in every name; a null
    one in none.  Matches are aggregated per distinct request before they meet the request rows.
    """
    keys, order = list(keys), list(order)
    hits = _matches(requests, names, pattern, name, keys, order, q, ignore_case)
    best = F.min(F.struct(*[f"__o{i}" for i in range(len(order))], "__name")).alias("__best")
    found = hits.groupBy(*keys, "__pattern").agg(best, F.count(F.lit(1)).alias("__hits"))
    all_names = names.where(F.col(name).isNotNull()).select(*keys, F.col(name).alias("__name"), *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)])
    anywhere = all_names.groupBy(*keys).agg(best, F.count(F.lit(1)).alias("__hits")).select(*keys, F.lit("").alias("__pattern"), "__best", "__hits")
    if not requests.where(F.col(pattern) == "").isEmpty():
        found = found.unionByName(anywhere)
    asked = requests.withColumn("__pattern", _fold(F.col(pattern), ignore_case))
    joined = asked.join(found, [*keys, "__pattern"], "left")
    return joined.select(*[asked[c] for c in requests.columns], F.col("__best.__name").alias(out), F.coalesce("__hits", F.lit(0)).cast("long").alias("n_candidates"))
