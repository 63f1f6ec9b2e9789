"""Which of very many markers each text holds, in one pass over the text.

A predicate per marker (see ``runs.has_marker``) reads every text once per marker.  Here the markers become an
Aho-Corasick automaton, which a task runs over its texts in Arrow batches: a text costs its length and its finds,
however many markers there are.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.session import materialize

#: Characters of all markers of one automaton, which goes to every task; more markers take several passes.
MAX_CHARS = 4_000_000
#: Rows of a batch of finds.
ROWS = 10_000


def _finder(markers: list[str]):
    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, m in enumerate(markers):
            automaton.add_word(m, i)
        automaton.make_automaton()
        for b in batches:
            at, which, counts, firsts = [], [], [], []

            def rows(b=b, at=at, which=which, counts=counts, firsts=firsts):
                ids = b.column(0).take(pa.array(at, pa.int64()))
                names = pa.array([markers[i] for i in which], pa.string())
                return pa.RecordBatch.from_arrays([ids, names, pa.array(counts, pa.int64()), pa.array(firsts, pa.int64())], names=["id", "marker", "n", "first_at"])

            for row, text in enumerate(b.column(1)):
                found: dict[int, list[int]] = {}
                for end, i in automaton.iter(text.as_py()):
                    hit = found.get(i)
                    if hit is None:
                        found[i] = [1, end - len(markers[i]) + 2]
                    else:
                        hit[0] += 1
                for i, (n, first) in found.items():
                    at.append(row)
                    which.append(i)
                    counts.append(n)
                    firsts.append(first)
                if len(at) >= ROWS:
                    yield rows()
                    for column in (at, which, counts, firsts):
                        column.clear()
            yield rows()

    return run


def find_markers(docs: DataFrame, markers: DataFrame, id_col: str, text_col: str, marker_col: str = "marker", ignore_case: bool = False,
                 max_chars: int = MAX_CHARS) -> DataFrame:
    """(``id_col``, marker, n, first_at): each marker that a row's text holds.

    ``n`` counts all occurrences, overlapping ones too; ``first_at`` is the first one's position, from 1.  Null and
    empty texts hold no marker; null and empty markers are held by none; repeated markers count once, repeated rows
    each give their finds.  Other columns are ignored.  With ``ignore_case`` markers and texts are lower-cased first:
    markers that differ in case are one, and positions are those of the lower-cased text.

    Markers of up to ``max_chars`` characters go to the tasks as one automaton.  More are dealt by hash into parts of
    about that size, each a pass of its own over the texts, so neither the driver nor a task holds more than one
    part at a time.  Nothing of the texts is shuffled.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    distinct = markers.select(fold(F.col(marker_col)).alias("marker")).where("marker <> ''").distinct()
    distinct = materialize(distinct, "markers")
    parts = max(1, math.ceil((distinct.agg(F.sum(F.length("marker"))).first()[0] or 0) / max_chars))
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("marker"), F.lit(parts)))
    texts = docs.select(F.col(id_col).alias("id"), fold(F.col(text_col)).alias("text")).where("text <> ''")
    schema = f"id {texts.schema['id'].dataType.simpleString()}, marker string, n long, first_at long"
    out = None
    for part in range(parts):
        names = dealt.where(F.col("part") == part).select("marker").toArrow().column("marker").to_pylist()
        if names:
            found = texts.mapInArrow(_finder(sorted(names)), schema)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)
