"""Conversation building and chat-template rendering as native column expressions.

No Python runs per row: a conversation is ``ARRAY<STRUCT<...>>`` and rendering
is ``transform`` + ``array_join`` (or plain ``concat`` for one message).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The system message of the training conversations.
SYSTEM_PROMPT = "You are a helpful coding assistant that generates JUnit test cases for Java methods."

# ShareGPT sender names and their chat roles.
ROLE_MAP = {"human": "user", "gpt": "assistant"}

# ChatML markers.
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"

# The alternate (">>>") template.
ALT_HEADER = "You are a helpful assistant to the user\n"
ALT_USER = ">>> User: "
ALT_ASSISTANT = ">>> Assistant: "


def to_conversation(src: str | Column, tgt: str | Column | None = None, system: str | None = SYSTEM_PROMPT) -> Column:
    """ShareGPT-style ``[{from, value}]``: optional system, human = source, gpt = target (omitted for inference)."""
    msgs = []
    if system is not None:
        msgs.append(F.struct(F.lit("system").alias("from"), F.lit(system).alias("value")))
    msgs.append(F.struct(F.lit("human").alias("from"), _c(src).alias("value")))
    if tgt is not None:
        msgs.append(F.struct(F.lit("gpt").alias("from"), _c(tgt).alias("value")))
    return F.array(*msgs)


def map_roles(msgs: str | Column, mapping: dict[str, str] | None = None) -> Column:
    """``{from, value}`` -> ``{role, content}``; unknown senders keep their name."""
    mapping = ROLE_MAP if mapping is None else mapping
    lut = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]) if mapping else None

    def conv(m: Column) -> Column:
        role = F.coalesce(lut[m["from"]], m["from"]) if lut is not None else m["from"]
        return F.struct(role.alias("role"), m["value"].alias("content"))

    return F.transform(_c(msgs), conv)


def chatml_message(role: str | Column, content: str | Column, eos: str | None = None) -> Column:
    """One ChatML message: start marker, role, newline, content, end marker, newline."""
    end = IM_END if eos is None else eos
    return F.concat(F.lit(IM_START), _c(role), F.lit("\n"), F.coalesce(_c(content), F.lit("")), F.lit(end + "\n"))


def generation_header() -> str:
    return f"{IM_START}assistant\n"


def render_chat(msgs: str | Column, style: str = "chatml", generation_prompt: bool = False,
                eos: str | None = None, bos: str = "") -> Column:
    """One training text per conversation (``{role, content}`` messages).

    chatml: every message closed by the end marker (or ``eos``); the generation
    prompt appends an open assistant header.  alt: ``bos`` + header line, user
    and assistant lines (end token after assistant text), system dropped.
    """
    m = _c(msgs)
    if style == "chatml":
        body = F.array_join(F.transform(m, lambda x: chatml_message(x["role"], x["content"], eos)), "")
        return F.concat(body, F.lit(generation_header())) if generation_prompt else body
    if style == "alt":
        end = eos if eos is not None else ""

        def line(x: Column) -> Column:
            content = F.coalesce(x["content"], F.lit(""))
            return (
                F.when(x["role"] == "user", F.concat(F.lit(ALT_USER), content, F.lit("\n")))
                .when(x["role"] == "assistant", F.concat(F.lit(ALT_ASSISTANT), content, F.lit(end + "\n")))
            )

        body = F.concat(F.lit(bos + ALT_HEADER), F.array_join(F.transform(m, line), ""))
        return F.concat(body, F.lit(ALT_ASSISTANT)) if generation_prompt else body
    raise ValueError(f"unknown chat style: {style}")


def render_pair(src: str | Column, tgt: str | Column, system: str = SYSTEM_PROMPT, eos: str | None = None) -> Column:
    """The fixed three-message shape rendered with plain ``concat`` (no higher-order function)."""
    return F.concat(
        chatml_message(F.lit("system"), F.lit(system), eos),
        chatml_message(F.lit("user"), src, eos),
        chatml_message(F.lit("assistant"), tgt, eos),
    )
