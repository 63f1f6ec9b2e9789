"""URL filters by a sort-merge range join (operator 8).

A host is written with its labels reversed, each ended by a character that sorts below all others, so a rule's host
is a prefix of the keys of its host and subdomains, and its keys are one interval.  Rules and urls are dealt over
ranges of the key together; a rule also goes to every range at whose start its interval is open.  Each range is sorted
by key and swept once: a stack holds the rules whose interval is open, the innermost on top.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordering import ranged
from runlens.session import materialize

#: Ends each label of a key.
END = "\x01"
#: Ranges per shuffle partition.
RANGES = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> Column:
    """The url behind its first ``://``; null when there is none."""
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substr(F.col(url), at + 3))


def host_of(url: str) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: str) -> Column:
    """From the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: str) -> Column:
    """Labels reversed, each followed by END; an empty host has an empty key."""
    labels = F.transform(F.reverse(F.split(F.col(host), r"\.")), lambda x: F.concat(x, F.lit(END)))
    return F.when(F.col(host) == "", F.lit("")).otherwise(F.array_join(labels, ""))


def _open_at_start(dealt: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules whose interval is open where a range starts, as rows of that range.

    Such a rule's key is a prefix of the range's first key that ends with a label, so the prefixes join the rules by
    equality: a row per range and label, as many labels as the longest rule has.
    """
    labels = rules.agg(F.max(F.size(F.split("key", END)) - 1)).first()[0]
    first = dealt.groupBy("range").agg(F.min("key").alias("first"))
    parts = F.slice(F.split("first", END), 1, F.least(F.size(F.split("first", END)) - 1, F.lit(labels or 0)))
    prefixes = first.select("range", parts.alias("parts")).select(
        "range", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.concat(F.array_join(F.slice("parts", 1, n), END), F.when(n > 0, END).otherwise("")))).alias("key")
    )
    return prefixes.join(rules, "key").select("range", *rules.columns)


def _sweep(batches):
    """Rows come sorted by (range, key, kind), rules before urls of the same key."""
    at, stack = None, []
    for b in batches:
        out = [[], [], [], [], []]
        for row in zip(*(b.column(c).to_pylist() for c in ("range", "key", "kind", "page_id", "host", "path", "rule", "verdict")), strict=True):
            rng, key, kind, page, host, path, rule, verdict = row
            if rng != at:
                at, stack = rng, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                # all rules of one host are one entry: paths by their length
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                stack[-1][1].setdefault(len(path), {})[path] = (rule, verdict)
                continue
            best = None
            for _, paths in reversed(stack):
                for n in sorted(paths, reverse=True):
                    if n <= len(path) and (hit := paths[n].get(path[:n])):
                        if best is None or len(hit[0]) > len(best[0]):
                            best = hit
                        break
            for c, v in zip(out, (page, host, path, *(best or (None, None))), strict=True):
                c.append(v)
        kinds = [b.column("page_id").type, pa.string(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["page_id", "host", "path", "rule", "verdict"])


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages`` (page_id, url).

    ``rules`` has (host, path, verdict).  A rule fits its host and all subdomains when the url's path starts with the
    rule's path; the longest (host and path together, then the longer host) wins.  Without a fitting rule ``rule`` is
    null and the verdict is ``default``.  A null url, or one without ``://``, has an empty host and path and fits no
    rule with a host.  Rules that repeat a host and path must agree; a rule with a null is ignored.  A host with very
    many urls spans several ranges, since borders are of (key, random salt of the row).
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = pages.schema["page_id"].dataType.simpleString()
    keyed = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), F.xxhash64("page_id", "url").alias("salt"))
    keyed = keyed.select(host_key("host").alias("key"), "salt", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    ruled = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").dropna().distinct()
    ruled = ruled.select(host_key("host").alias("key"), F.lit(-1 << 63).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("page_id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    ruled = materialize(ruled, "rules")
    # rules and urls are dealt together, and a written range number is what every later read sees
    dealt = ranged(keyed.unionByName(ruled), ["key", "salt"], RANGES * n, "range")
    dealt = dealt.unionByName(_open_at_start(dealt, ruled))
    swept = dealt.repartition(n, "range").sortWithinPartitions("range", "key", "kind").mapInArrow(_sweep, f"page_id {kind}, host string, path string, rule string, verdict string")
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
