"""Batch text generation through a pluggable client, and the refine job.

The reference calls a hosted model once per prompt.  Here ``apply_generator``
is a ``mapInPandas`` stage: each task builds one client from a factory, sends
its Arrow batches row by row through ``generate``, and turns exceptions into
failure rows, so one bad prompt never aborts the job.  Only a deterministic
local generator ships; network clients are the caller's factory.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions import paths as P
from runlens.functions.text import build_prompt, clean_code
from runlens.session import materialize

# The task function and the local generator are shipped by value: executors
# need pandas, not this package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REPLY_SCHEMA = T.StructType(
    [
        T.StructField("success", T.BooleanType()),
        T.StructField("code", T.StringType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


class EchoGenerator:
    """Deterministic local client: replies with the prompt itself.

    ``tokens`` is the reply's character count; prompts whose length is a
    multiple of ``refuse_mod`` are refused (a stand-in for service errors).
    ``wrap=True`` wraps the reply in prose and a code fence, as chat models do.
    """

    def __init__(self, refuse_mod: int = 17, wrap: bool = False, **_params):
        self.refuse_mod = refuse_mod
        self.wrap = wrap

    def generate(self, prompt: str) -> dict:
        if self.refuse_mod and len(prompt) % self.refuse_mod == 0:
            return {"success": False, "error": "refused"}
        code = prompt
        if self.wrap:
            code = "Here is the code:\n```java\nimport x;\n" + prompt + "\n```\nDone"
        return {"success": True, "code": code, "tokens": len(code)}


_REGISTRY: dict[str, Callable[..., object]] = {
    "echo": EchoGenerator,
    "echo_wrapped": lambda **kw: EchoGenerator(wrap=True, **kw),
}


def register_generator(name: str, factory: Callable[..., object]) -> None:
    _REGISTRY[name] = factory


def get_generator(name: str, **params) -> Callable[[], object]:
    """name -> zero-argument factory (resolved on the driver, called once per task)."""
    if name not in _REGISTRY:
        raise ValueError(f"Unknown generator: {name}")
    ctor = _REGISTRY[name]
    return lambda: ctor(**params)


def _replies(client, prompts: list[str]) -> list[dict]:
    """One record per prompt: a client's ``generate_batch`` takes them together, else ``generate`` one by one."""
    if hasattr(client, "generate_batch"):
        try:
            return list(client.generate_batch(prompts))
        except Exception as e:  # the batch failed as a whole
            return [{"success": False, "error": str(e)} for _ in prompts]
    recs = []
    for p in prompts:
        try:
            recs.append(client.generate(p))
        except Exception as e:  # one failed call is one failure row
            recs.append({"success": False, "error": str(e)})
    return recs


def apply_generator(df: DataFrame, prompt_col: str, factory: Callable[[], object], keep: Sequence[str]) -> DataFrame:
    """Add (success, code, tokens, error) per prompt; exceptions become failure rows.

    Size Arrow batches with ``spark.sql.execution.arrow.maxRecordsPerBatch``
    when prompts are long.
    """
    keep = list(keep)
    in_df = df.select(*keep, F.col(prompt_col).alias("__prompt"))
    out_fields = [in_df.schema[k] for k in keep] + list(REPLY_SCHEMA.fields)
    out_schema = T.StructType(out_fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            recs = []
            recs = _replies(client, list(pdf["__prompt"]))
            out = pdf[keep].copy()
            out["success"] = [bool(r.get("success", False)) for r in recs]
            out["code"] = [r.get("code") for r in recs]
            out["tokens"] = pd.array([r.get("tokens") for r in recs], dtype="Int64")
            out["error"] = [r.get("error") for r in recs]
            yield out

    return in_df.mapInPandas(run, out_schema)


def prompts(files: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """``files`` with ``prompt`` made of the text of their ``key``, and ``error`` 'no text' where there is none.

    No file is lost: one without a text is a failure row.  A null text counts as none.
    """
    known = texts.where(F.col(text).isNotNull()).select(key, build_prompt(F.col(text)).alias("prompt"))
    return files.join(known, key, "left").withColumn("error", F.when(F.col("prompt").isNull(), "no text"))


def refined(replies: DataFrame, src_root: str = "generated/baseline", dst_root: str = "generated/refined") -> DataFrame:
    """Refined records of (ordinal, project, class, path, reply) rows whose reply holds code."""
    code = clean_code("reply")
    return replies.withColumn("refined_code", code).where(F.col("refined_code") != "").select(
        "ordinal",
        "project",
        "class",
        F.col("path").alias("original_file"),
        P.rebase(F.col("path"), src_root, dst_root).alias("refined_file"),
        "refined_code",
        F.lit(True).alias("success"),
    )


def failed(replies: DataFrame) -> DataFrame:
    """Failure records of the rows whose reply is missing or holds no code."""
    code = F.coalesce(clean_code("reply"), F.lit(""))
    error = F.when(F.col("reply").isNull(), F.lit("no reply")).otherwise(F.lit("no code in the reply"))
    return replies.where(code == "").select("ordinal", "project", "class", F.col("path").alias("original_file"), error.alias("error"), F.lit(False).alias("success"))


def refine(artifacts: DataFrame, factory: Callable[[], object], src_root: str = "generated/baseline", dst_root: str = "generated/refined") -> tuple[DataFrame, DataFrame]:
    """Prompt -> generate -> clean per artifact; returns (refined records, failures).

    ``artifacts`` = (ordinal, project, class, path, code).  The replies are
    written once and both results read them, so each prompt is sent once.
    """
    prompted = artifacts.select("ordinal", "project", "class", "path", build_prompt(F.col("code")).alias("prompt"))
    replies = materialize(apply_generator(prompted, "prompt", factory, ["ordinal", "project", "class", "path"]), "replies")
    answered = replies.where("success").withColumnRenamed("code", "reply")
    refused = replies.where("NOT success").select("ordinal", "project", "class", F.col("path").alias("original_file"), "error", F.lit(False).alias("success"))
    return refined(answered, src_root, dst_root), failed(answered).unionByName(refused)
