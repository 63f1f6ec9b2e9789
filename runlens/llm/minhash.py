"""Near duplicates by HyperMinHash sketches, banding and exact verification (operator 2).

A document is the set of its distinct 5-word shingles.  One pass hashes each shingle once: the high bits choose a
register, which keeps the leading-zero count and the first mantissa bits of the register's smallest remaining
hash.  Bands of registers (empty ones are filled from other registers) propose pairs; the collision-corrected
Jaccard estimate of the raw registers drops the hopeless ones; the rest is confirmed on the full sets.

No group is expanded into all its pairs.  Equal sets are one representative.  In a band bucket every member is
first compared with the bucket's centre only, the member that meets most others; connected components follow.  Then
members of buckets that still span several components are compared where they share a rare shingle that a link cannot
do without (see ``_crossing``), which completes the links of all buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import materialize

from .components import components
from .textwords import mix64, shingle_sets, slices, text_bytes

WIDTH = 5
#: Registers, rows of a band (32 bands: a pair of similarity 0.75 is missed with probability 5e-6) and mantissa bits.
REGISTERS, ROWS, MANTISSA = 128, 4, 10
#: 100 * intersection >= SIMILAR * union
SIMILAR = 75
#: An estimate may fall short of the threshold by this many standard deviations; more where the comparison itself
#: tells how far a member is from its bucket's centre.
SIGMAS, CENTRE_SIGMAS = 5.0, 8.0
#: Rows that are verified against one copy of a centre's set, and that meet one copy of the other side of a hot shingle.
PER_CENTRE, PER_POSTING = 256, 2048
#: A key with more than one in this many rows is hot; at most as many keys can be.
HOT = 2048

_U = np.uint64
_BITS = REGISTERS.bit_length() - 1
_EMPTY = np.uint16(0xFFFF)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Compressed registers of a sorted set: (leading zeros << MANTISSA | mantissa bits), 0xFFFF where empty."""
    out = np.full(REGISTERS, _EMPTY, dtype=np.uint16)
    if not len(shingles):
        return out
    # a second mixing, so that registers don't depend on the order the set is sorted by
    values = np.sort(mix64(shingles))
    bucket = (values >> _U(64 - _BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = values[first] << _U(_BITS)  # the bucket's smallest hash, without the bucket's bits
    zeros = np.clip(63 - np.floor(np.log2(np.maximum(rest, _U(1)).astype(np.float64))), 0, 62).astype(np.uint64)
    zeros = np.where((rest >> (_U(63) - zeros)) == 0, np.minimum(zeros + _U(1), _U(62)), zeros)  # log2 may round up
    mantissa = (rest << (zeros + _U(1))) >> _U(64 - MANTISSA)
    out[bucket[first]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    return out


#: For each register, all registers in an order of its own: an empty register takes the first filled one.
_PROBE = np.argsort(mix64(np.arange(REGISTERS * REGISTERS, dtype=_U) + _U(15485863)).reshape(REGISTERS, REGISTERS), axis=1)
_PROBE = np.concatenate([np.arange(REGISTERS)[:, None], _PROBE], axis=1)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """64-bit keys (rows, bands) of raw registers (rows, REGISTERS), empty registers being filled first."""
    filled = regs.copy()
    for i in range(len(regs)):
        empty = regs[i] == _EMPTY
        if empty.any():
            filled[i] = regs[i][_PROBE[np.arange(REGISTERS), np.argmax(~empty[_PROBE], axis=1)]]
    rows = filled.reshape(len(regs), REGISTERS // ROWS, ROWS).astype(_U)
    packed = np.zeros(rows.shape[:2], dtype=_U)
    for k in range(ROWS):
        packed = (packed << _U(16)) | rows[:, :, k]
    with np.errstate(over="ignore"):
        return mix64(packed + mix64(np.arange(REGISTERS // ROWS, dtype=_U) + _U(32452843))[None, :])


def chance_collision(n: np.ndarray) -> np.ndarray:
    """Probability that the registers of two disjoint sets of about ``n`` shingles agree by chance.

    A register's smallest value falls into one of the cells [2^-z (1 + i/2^r), 2^-z (1 + (i+1)/2^r)); with k = n /
    REGISTERS values a register is in a cell with probability e^(-k a) - e^(-k b), and the squares add up.
    """
    k = np.maximum(np.asarray(n, dtype=float) / REGISTERS, 1e-3)[:, None]
    z = np.arange(1, 48)[None, :]
    # within one leading-zero class the 2^r cells are alike: the class mass times its mean cell mass
    low, high = 2.0 ** -z, 2.0 ** -(z - 1)
    middle = np.exp(-k * low) - np.exp(-k * high)
    return (middle**2 / 2**MANTISSA).sum(axis=1)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected Jaccard estimate, number of registers it rests on) of raw registers, row by row."""
    used = (a != _EMPTY) | (b != _EMPTY)
    same = (a == b) & used
    count = np.maximum(used.sum(axis=1), 1)
    chance = chance_collision(n)
    return (same.sum(axis=1) / count - chance) / (1 - chance), count


def _sketch(batches):
    for part in slices(batches, "text"):
        sets = shingle_sets(*text_bytes(part.column("text")), WIDTH)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "set_fp", "regs"],
        )


def _bands(batches):
    for b in batches:
        if b.num_rows:
            regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(regs)
            ids = np.repeat(b.column("doc_id").to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids, pa.int64())], names=["band", "doc_id"])


def _hopeful(sigmas: float):
    """Pairs whose estimate is not below the threshold by more than ``sigmas`` deviations."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                sides = [np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b")]
                n = (b.column("n_a").to_numpy() + b.column("n_b").to_numpy()) / 2
                jaccard, count = estimate(*sides, n)
                t = SIMILAR / 100
                keep = jaccard >= t - sigmas * np.sqrt(t * (1 - t) / count)
                yield b.select(["member", "centre"]).filter(pa.array(keep))

    return run


def _confirm(batches):
    """Rows come sorted by (centre, salt, kind): each centre's text, then its members; compared pairs go out."""
    at, centre = None, None
    for part in slices(batches, "text"):
        sets = shingle_sets(*text_bytes(part.column("text")), WIDTH)
        rows = zip(*(part.column(c).to_pylist() for c in ("centre", "salt", "kind", "member")), sets, strict=True)
        found = []
        for c, salt, kind, member, own in rows:
            if kind == 0:
                at, centre = (c, salt), own
            elif (c, salt) == at and len(own) and len(centre):
                both = len(np.intersect1d(own, centre, assume_unique=True))
                found.append((member, c, both, 100 * both >= SIMILAR * (len(own) + len(centre) - both)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=["a", "b", "both", "linked"])


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """(a, b, both, linked) of distinct pairs (member, centre) that the estimate leaves, compared on the full sets."""
    sketch = reps.select("doc_id", "regs", "n_shingles")
    side = lambda s, on: sketch.select(F.col("doc_id").alias(on), F.col("regs").alias(f"regs_{s}"), F.col("n_shingles").alias(f"n_{s}"))
    hopeful = materialize(pairs.join(side("a", "member"), "member").join(side("b", "centre"), "centre").mapInArrow(_hopeful(sigmas), "member long, centre long").distinct(), "pairs")
    salts = hopeful.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / PER_CENTRE).cast("int").alias("salts"))
    members = hopeful.join(salts, "centre").select("centre", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "member")
    centres = salts.select("centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("centre").alias("member"))
    rows = members.unionByName(centres).hint("merge").join(docs.withColumnRenamed("doc_id", "member"), "member")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "centre", "salt").sortWithinPartitions("centre", "salt", "kind").mapInArrow(_confirm, "a long, b long, both long, linked boolean")


def _attach(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of ``facts`` (a written table) per key, of which ``size`` is the key's number of rows.

    The keys that hold more than one in HOT of all rows, at most HOT of them, are broadcast to deal their rows over
    places, where a copy of their facts waits; so no key puts more than about one in HOT of the rows in one task.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    share = F.ceil(F.col(size) * HOT / F.lit(max(total, 1))).cast("int")
    hot = facts.where(F.col(size) * HOT > total).select(*keys, share.alias("__places"))
    dealt = rows.join(F.broadcast(hot), keys, "left")
    dealt = dealt.withColumn("__place", F.when(F.col("__places").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("__places"))).cast("int")).drop("__places")
    copies = facts.withColumn("__place", F.explode(F.when(F.col(size) * HOT > total, F.sequence(F.lit(0), share - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [*keys, "__place"], how).drop("__place")


def _sets(batches):
    for part in slices(batches, "text"):
        sets = shingle_sets(*text_bytes(part.column("text")), WIDTH)
        ends = np.cumsum([0, *[len(s) for s in sets]])
        tokens = pa.array(np.concatenate([*sets, np.zeros(0, dtype=_U)]).view(np.int64))
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), tokens).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("variant"), part.column("label"), lists], names=["doc_id", "variant", "label", "tokens"])


def _prefixes(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, label, df, cls, before, n): the classes of rare shingles one of which every partner must share.

    Shingles that the same documents hold are one class, of the weight that a document has of them; classes are
    ordered by the number of documents, rarest first.  When two sets of n and s shingles share i and their first common
    class comes after ``before`` others of n, then i <= n - before.  A link needs 7 * i >= 3 * (n + s), so i >= 3/4 n:
    only classes with 4 * before <= n count.  Private shingles come first, so a document of which they are more than a
    quarter has no partner and goes before its shingles move a second time.  A class whose documents were confused
    with those of another (by 124 bits) would only add pairs, never lose one.
    """
    # repeated rows are one, other texts under one doc_id are sets of their own
    rows = texts.join(open_.select("doc_id", "label").distinct().hint("merge"), "doc_id").withColumn("variant", F.xxhash64("text")).dropDuplicates(["doc_id", "variant"])
    node = ["doc_id", "variant"]
    sets = materialize(rows.select(*node, "label", "text").mapInArrow(_sets, "doc_id long, variant long, label long, tokens array<long>"), "sets")
    tokens = sets.select(*node, F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    part = lambda seed: F.sum(F.pmod(F.xxhash64(*node, F.lit(seed)), F.lit(1 << 30)))
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), part(1).alias("s1"), part(2).alias("s2"), F.min(F.struct(*node, "n")).alias("least"))
    held = materialize(held.select("token", "df", F.xxhash64("df", "s1", "s2", "least").alias("cls"), "least.*"), "shingles")
    alone = held.where("df = 1").groupBy(*node).agg(F.count(F.lit(1)).alias("u"), F.min("n").alias("n")).where("4 * u > n").select(*node)
    tokens = sets.join(alone, node, "left_anti").select(*node, "label", F.explode("tokens").alias("token"))
    classed = _attach(tokens, held.where("df > 1").select("token", "df", "cls"), ["token"], "df", "left")
    weights = classed.groupBy(*node, "label", F.coalesce("df", F.lit(1)).alias("df"), F.coalesce("cls", F.lit(0)).alias("cls")).agg(F.count(F.lit(1)).alias("w"))
    whole = Window.partitionBy(*node)
    before = F.coalesce(F.sum("w").over(whole.orderBy("df", "cls").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = weights.withColumn("before", before).withColumn("n", F.sum("w").over(whole))
    return ordered.where("df > 1 AND 4 * before <= n").select("doc_id", "label", "df", "cls", "before", "n")


def _bin(size: Column) -> Column:
    """Sizes of about one in four; a partner of n or more shingles is in n's bin or the next."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(4 / 3))).cast("int")


def _crossing(open_: DataFrame, compared: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (member, centre) of the documents of ``open_`` (doc_id, label) with different labels that may be linked.

    Every link is among them; documents that only look alike meet no partner unless they share a class of rare shingles
    near the front of both their orders (``_prefixes``).  Of a class's documents, those of its most frequent label
    have nothing to find among themselves, and never meet.
    """
    prefixes = materialize(_prefixes(open_, texts), "prefixes")
    cls = ["df", "cls"]
    labels = prefixes.groupBy(*cls, "label").agg(F.count(F.lit(1)).alias("k"))
    groups = labels.groupBy(*cls).agg(F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("major"), F.count(F.lit(1)).alias("labels"))
    groups = materialize(groups.where("labels > 1").select(*cls, "size", F.col("major.label").alias("major")), "classes")
    rows = _attach(prefixes, groups, cls, "size").withColumn("minor", F.col("label") != F.col("major"))
    rows = materialize(rows.withColumn("places", F.ceil(F.col("size") / PER_POSTING).cast("int")).drop("size", "major"), "postings")
    # the larger partner is dealt over its class's places, the smaller goes to all of them
    large = rows.withColumn("bin", _bin(F.col("n"))).withColumn("place", F.pmod(F.xxhash64("doc_id"), F.col("places")).cast("int"))
    large = large.select(*cls, "bin", "place", *[F.col(c).alias(f"{c}_y") for c in ("doc_id", "label", "n", "before", "minor")])
    small = rows.where("7 * before <= n").withColumn("bin", F.explode(F.sequence(_bin(F.col("n")), _bin(F.floor(F.col("n") * 4 / 3)))))
    small = small.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).drop("places")
    least = 3 * (F.col("n") + F.col("n_y"))
    allowed = (
        (F.col("label") != F.col("label_y"))
        & ((F.col("n") < F.col("n_y")) | ((F.col("n") == F.col("n_y")) & (F.col("doc_id") < F.col("doc_id_y"))))
        & (7 * (F.col("n") - F.col("before")) >= least)
        & (7 * (F.col("n_y") - F.col("before_y")) >= least)
    )
    sides = (small.where("minor"), large), (small.where("NOT minor"), large.where("minor_y"))
    met = [x.join(y, [*cls, "bin", "place"]).where(allowed).select(F.greatest("doc_id", "doc_id_y").alias("member"), F.least("doc_id", "doc_id_y").alias("centre")) for x, y in sides]
    seen = compared.select(F.greatest("a", "b").alias("member"), F.least("a", "b").alias("centre"))
    return met[0].unionByName(met[1]).distinct().join(seen, ["member", "centre"], "left_anti")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs`` (doc_id, text).

    Documents are linked when 100 * |intersection| >= 75 * |union| of their sets of 5-word shingles; component_id
    is the smallest doc_id that links reach.  A text of 1 to 4 words is one shingle; a null text, or one without
    words, has an empty set and no links.  Rows that repeat a ``doc_id`` are one document to the links and all come
    back.  A row with a null ``doc_id`` has no links, a null component_id, and is kept.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialize(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, set_fp binary, regs binary"), "sketches")
    named = sketches.where("doc_id IS NOT NULL AND set_fp IS NOT NULL")
    least = named.groupBy(F.col("set_fp").alias("__fp")).agg(F.min("doc_id").alias("__rep"), F.count(F.lit(1)).alias("rows"))
    reps = materialize(named.join(least, (F.col("set_fp") == F.col("__fp")) & (F.col("doc_id") == F.col("__rep"))).drop("__fp", "__rep", "rows").dropDuplicates(["doc_id", "set_fp"]), "reps")
    bands = reps.select("doc_id", "regs").mapInArrow(_bands, "band long, doc_id long")
    sizes = materialize(bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    buckets = materialize(_attach(bands, sizes, ["band"], "size"), "buckets")
    # the centre of a bucket is the member that meets most others in all its buckets: the likely original of copies
    degree = buckets.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    centres = buckets.join(degree, "doc_id").groupBy("band").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("minus"))).alias("best"), F.count(F.lit(1)).alias("members"))
    centres = materialize(centres.select("band", (-F.col("best.minus")).alias("centre"), "members"), "centres")
    buckets = materialize(_attach(buckets.select("band", "doc_id"), centres, ["band"], "members").select("band", "doc_id", "centre"), "members")
    stars = buckets.where("doc_id <> centre").select(F.col("doc_id").alias("member"), "centre").distinct()
    # the texts that any comparison needs, moved once
    texts = materialize(docs.where("doc_id IS NOT NULL").join(buckets.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    compared = materialize(_verified(stars, reps, texts, CENTRE_SIGMAS), "compared")
    links = compared.where("linked").select("a", "b")
    found = components(links)

    # what the stars leave: members of one bucket in different components
    labelled = materialize(buckets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("label")), "labelled")
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("band", "size")
    open_ = materialize(_attach(labelled, materialize(mixed, "mixed"), ["band"], "size").select("doc_id", "label").distinct(), "open")
    more = materialize(_verified(_crossing(open_, compared, texts), reps, texts).where("linked").select("a", "b"), "links")
    # components of the components that the new links join
    side = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}c"))
    joined = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    merged = components(joined).select(F.col("node").alias("label"), F.col("component").alias("merged"))

    label = F.coalesce("component", "doc_id").alias("label")
    classes = reps.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set_fp", label).join(merged, "label", "left")
    classes = classes.groupBy("set_fp").agg(F.min(F.coalesce("merged", "label")).alias("component_id"))
    # equal sets: the class of the set; rows without a set or an id have no part in it
    classes = materialize(classes.join(least.select(F.col("__fp").alias("set_fp"), "rows"), "set_fp"), "sets-classes")
    full = _attach(sketches.where("set_fp IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "set_fp"), classes, ["set_fp"], "rows")
    none = sketches.where("set_fp IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.select("doc_id", "n_shingles", "component_id").unionByName(none)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
