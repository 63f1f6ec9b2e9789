"""The corpus pipeline over ``documents``: quality rules, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.cqf import exact_duplicates, normalised_sha256
from runlens.llm.minhash import near_duplicates
from runlens.llm.mixing import mix
from runlens.llm.quality import quality_rules, row_fp, without_lines
from runlens.llm.queries import TOKENIZER
from runlens.llm.unigram import UnigramModel, encode
from runlens.session import materialize


def _kept(docs: DataFrame, wanted: DataFrame, keys: dict[str, Column], extra: dict[str, str] | None = None) -> DataFrame:
    """(doc, ...): the rows of ``docs``, each as one struct, that ``wanted`` has by its ``keys``.

    Only the struct and the keys meet ``wanted``, so no column of the documents can clash with one of its own.
    """
    whole = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc"), *[k.alias(f"own_{name}") for name, k in keys.items()])
    on = None
    for name in keys:
        same = F.col(f"own_{name}").eqNullSafe(F.col(f"want_{name}"))
        on = same if on is None else on & same
    side = wanted.select(*[F.col(name).alias(f"want_{name}") for name in keys], *[F.col(c).alias(c2) for c, c2 in (extra or {}).items()])
    return whole.join(side, on)


def _columns(docs: DataFrame, kept: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """The documents of ``kept`` under their own column names."""
    changed = changed or {}
    return kept.select(*[changed.get(c, F.col(f"doc.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their boilerplate lines, and ``n_chars`` follows the text.

    A null or empty text is rejected (no words); null ids and sources are values of their own; repeated rows share their
    document's verdict and all stay or go; other columns pass, whatever their names; an empty table gives no rows.
    """
    verdict = quality_rules(docs).where("kept").select("doc_id", "row_fp", "removed_lines").dropDuplicates(["doc_id", "row_fp"])
    kept = _kept(docs, verdict, {"doc_id": F.col("doc_id"), "row_fp": row_fp()}, {"removed_lines": "gone"})
    text = F.col(f"doc.c{docs.columns.index('text')}")
    cut = F.size("gone") > 0
    kept = kept.withColumn("text", F.when(cut, without_lines(F.when(cut, text), F.when(cut, F.col("gone")))).otherwise(text)).withColumn("cut", cut)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col(f"doc.c{docs.columns.index('n_chars')}"))
    return _columns(docs, kept, changed)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space aside); repeated rows go too.

    Null, empty and blank texts are one group; a null id can stay like others; an empty table gives no rows.
    """
    kept = exact_duplicates(docs).where("kept").select("doc_id", F.col("text_sha256").alias("sha")).distinct()
    rows = _kept(docs, kept, {"doc_id": F.col("doc_id"), "sha": normalised_sha256("text")})
    return _columns(docs, rows.dropDuplicates(["own_doc_id", "own_sha"]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates.

    Texts without words and rows without an id have no partners and stay; rows that repeat a kept id stay; an empty
    table gives no rows.
    """
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    return _columns(docs, _kept(docs, kept, {"doc_id": F.col("doc_id")}))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: copies are repeated rows, and those taken 0 times go.

    Null sources are the last source; a text without words is taken like others and adds nothing; rows that repeat an id
    are taken as often as its first row; an empty table gives no rows.
    """
    taken = mix(docs).select("doc_id", "copies").where("copies > 0").dropDuplicates(["doc_id"])
    rows = _kept(docs, taken, {"doc_id": F.col("doc_id")}, {"copies": "copies"})
    return _columns(docs, rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, n_byte_tokens, ids) of every row; a null text has no ids."""
    return encode(docs, UnigramModel.load(TOKENIZER), keep=("doc_id", "source", "lang"))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", tokenize),
]

#: Hash sampling and tokenising have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
