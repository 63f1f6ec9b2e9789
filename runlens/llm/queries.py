"""The registered queries of the ten operators and the pipeline, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import extract
from .chatformat import format_conversations, read_back
from .cqf import exact_duplicates
from .layouts import default_model
from .merkle import build, fold, leaf_hash, proof_text, proofs
from .minhash import near_duplicates
from .mixing import mix
from .periods import periodic_runs
from .pulearn import score_quality, train
from .quality import quality_rules
from .surrogates import replace_private
from .superkmer import repeated_passages
from .unigram import UnigramModel, encode
from .urls import url_filter

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tokenizer's file, a parameter; the file is read on the driver and never copied.
TOKENIZER = os.environ.get("RUNLENS_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    return encode(_table(spark, sf_dir, "documents"), UnigramModel.load(TOKENIZER), verify=True)


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of every document, as components of similarity 0.75 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and line-frequency verdict of every document."""
    return quality_rules(_table(spark, sf_dir, "documents")).drop("row_fp", "removed_lines")


#: Key of the surrogates; a deployment sets its own secret.
SURROGATE_KEY = os.environ.get("RUNLENS_SURROGATE_KEY", "documented test key")


@query
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data and secrets."""
    return replace_private(_table(spark, sf_dir, "documents"), SURROGATE_KEY)


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from trusted positives and unlabelled text."""
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, _table(spark, sf_dir, "labels")))


@query
def op6_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of every document, ASCII white space aside."""
    return exact_duplicates(_table(spark, sf_dir, "documents"))


@query
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word passages that an earlier document holds."""
    return repeated_passages(_table(spark, sf_dir, "documents")).drop("kept_text")


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(_table(spark, sf_dir, "pages"), default_model()).drop("n_blocks", "n_kept")


#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(_table(spark, sf_dir, "pages"), rules)


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mix(_table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion proof of every document, and whether a copy with another n_chars in some of them still gives the root."""
    docs = _table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_hash(["doc_id", "source", "lang", F.col("n_chars") + 1, "text"]))
    manifest = build(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"tampered": tampered})
    folded = fold(F.coalesce("carry.tampered", "leaf"), F.col("siblings"))
    out = proofs(manifest).select(
        F.col("carry.order").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof_text(F.col("siblings")), 256).alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: A conversation that speaks control strings.
AWKWARD_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation's turns and trained texts, read back from its formatted text."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    awkward = spark.createDataFrame(AWKWARD_TURNS, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(awkward)))


def repeat_words(text: Column, h: Column) -> Column:
    """``text`` with its words from a place on in a loop, both drawn from ``h``; a text without words stays."""
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def loop(ws):
        n = F.size(ws)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (g % 8 + 3))
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, source(i).cast("int"))), " "))

    # bound once, not once per word
    return F.coalesce(F.element_at(F.transform(F.array(words), loop), 1), text)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated word sequences in every document, some of which are put into a loop first."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = _table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", F.when(h % 10 == 0, repeat_words(F.col("text"), h)).otherwise(F.col("text")).alias("text")))
    # exact comparison of length / period; runs ascend by start and period, so the first of equal ones stays
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
