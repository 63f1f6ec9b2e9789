"""Text column functions: whitespace trim, reply cleaning, prompt building, truncation.

All are built-in expressions (regex and higher-order array functions), so they
stay inside the JVM and whole-stage code generation where Spark allows it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Unicode whitespace as Python's str.strip() sees it, derived by rule from str.isspace().
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def trim_ws(col: str | Column) -> Column:
    """Remove leading and trailing Unicode whitespace (tab, NBSP, ...), like Python ``strip()``.

    ``btrim`` with an explicit character set: a character loop, no regex.
    """
    return F.btrim(_c(col), F.lit(WHITESPACE))


def rtrim_chars(col: str | Column, chars: str) -> Column:
    """Remove every trailing character found in ``chars`` (``str.rstrip(chars)``)."""
    return F.rtrim(_c(col), F.lit(chars))


def lines(col: str | Column) -> Column:
    """Split on '\\n', keeping empty lines (as Python ``split('\\n')``)."""
    return F.split(_c(col), "\n", -1)


def first_line(col: str | Column) -> Column:
    return F.split_part(_c(col), F.lit("\n"), F.lit(1))


# Words that open code in a model reply, and the fence marker.
CODE_START_WORDS = ("import", "package", "@")
FENCE = "```"

# whitespace other than the line break, Unicode-aware (as Python's strip() sees it)
_WS_NO_NL = r"[[\s\x{1C}-\x{1F}]&&[^\n]]"
_OPEN_RE = rf"(?dmU)^{_WS_NO_NL}*({'|'.join(re.escape(w) for w in CODE_START_WORDS)})"
_FENCE_LINE_RE = rf"(?U)\n{_WS_NO_NL}*{re.escape(FENCE)}[^\n]*"


def clean_code(col: str | Column, strict: bool = False) -> Column:
    """Keep a model reply from its first code line on, without fence lines.

    The first line whose trimmed form starts with ``import``, ``package`` or
    ``@`` opens the code; from there every line whose trimmed form starts with
    three backticks is dropped.  Text after the closing fence is kept (the flag
    never turns off).  No opening line -> ''.  ``strict=True`` stops at the
    first fence after the opening line instead.

    Two regex passes over the whole text (find the opening line, delete
    ``newline + fence line``) instead of splitting into line arrays; the opening
    line is never a fence line, so every dropped fence has a newline before it.
    """
    c = _c(col)
    start = F.regexp_instr(c, F.lit(_OPEN_RE))
    tail = F.substr(c, start)
    if strict:
        stop = F.regexp_instr(tail, F.lit(_FENCE_LINE_RE))
        kept = F.when(stop > 0, F.left(tail, stop - 1)).otherwise(tail)
    else:
        kept = F.regexp_replace(tail, _FENCE_LINE_RE, "")
    return F.when(c.isNull(), F.lit(None).cast("string")).when(start == 0, F.lit("")).otherwise(kept)


# The refinement prompt template (the code goes between the fences).
PROMPT_HEAD = "Refine this Java test to be concise and readable. Remove redundancy.\nORIGINAL:\n```java\n"
PROMPT_TAIL = "\n```\nOUTPUT ONLY JAVA CODE."


# The second prompt wording (adapter smoke test), code between head and tail.
PROMPT_ALT_HEAD = "Refina este test Java para que sea más legible:\n\n"
PROMPT_ALT_TAIL = (
    "\n\nInstrucciones:\n"
    "1. Usa nombres de variable descriptivos\n"
    "2. Añade una aserción más específica\n"
    "3. Retorna SOLO el código refinado, sin explicaciones.\n"
)


def build_prompt(col: str | Column, head: str = PROMPT_HEAD, tail: str = PROMPT_TAIL, style: str | None = None) -> Column:
    """Fixed instruction + the test text in a code fence + the output rule.

    ``style="alt"`` selects the second wording; ``head``/``tail`` set any template.
    """
    if style == "alt":
        head, tail = PROMPT_ALT_HEAD, PROMPT_ALT_TAIL
    return F.concat(F.lit(head), _c(col), F.lit(tail))


# Fixed value: marker appended to a truncated head.
TRUNC_MARKER = "\n... (truncado)"


def head_chars(col: str | Column, n: int, marker: str | None = TRUNC_MARKER) -> Column:
    """First ``n`` characters, plus ``marker`` when the text was longer."""
    c = _c(col)
    h = F.left(c, F.lit(n))
    if marker is None:
        return h
    return F.when(F.length(c) > n, F.concat(h, F.lit(marker))).otherwise(h)


def tail_chars(col: str | Column, n: int) -> Column:
    """Last ``n`` characters."""
    return F.right(_c(col), F.lit(n))


def contains_ci(haystack: str | Column, needle: str | Column) -> Column:
    """Case-insensitive substring test (``a.lower() in b.lower()``)."""
    return F.lower(_c(haystack)).contains(F.lower(_c(needle)))
