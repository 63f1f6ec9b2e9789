"""Chat formatting by columnar byte assembly.

Turns are dealt over ranges of (conversation, turn), so a conversation of any length is spread in order.  A task takes
a slice of its sorted turns at a time: the lengths of all headers, contents, inserted escapes and tails are computed
first, their cumulative sums are the places in one preallocated buffer, and headers, contents and tails are scattered
there by index arrays.  The buffer is handed over as an Arrow string column without another copy.

Control strings inside a text are escaped by one backslash behind their first character; those that are followed by
backslashes already get one more, so that taking one away again gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textwords import SLICE_BYTES, offsets, slices, text_bytes

#: Control strings of the public tokenizers and of common chat templates.
CONTROLS = (
    "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
)

#: A part of a conversation grows to about this many bytes before it is handed on; longer ones come in several parts.
PART_BYTES = 4 * SLICE_BYTES


@dataclass(frozen=True)
class Template:
    """``start`` role ``after_role`` text ``end`` for each turn; the loss covers the texts of role ``trained``."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    trained: str = "assistant"
    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self):
        leads = {c[0] for c in self.controls}
        if any(len(c) < 2 or not c[0].isascii() or "\\" in c or "\n" in c or leads & set(c[1:]) for c in self.controls):
            raise ValueError("a control string has two characters or more, an ASCII one first, no backslash or line feed, and no control's first character behind its own")
        if self.start not in self.controls or self.end.rstrip("\n") not in self.controls or self.after_role != "\n":
            raise ValueError("start and end must be control strings, and a line feed ends the role")

    def pattern(self, backslashes: str) -> str:
        """A control string with backslashes behind its first character."""
        leads = sorted({c[0] for c in self.controls})
        rests = {lead: "|".join(re.escape(c[1:]) for c in self.controls if c[0] == lead) for lead in leads}
        return "|".join(f"{re.escape(lead)}{backslashes}(?:{rest})" for lead, rest in rests.items())

    def escape(self, text: str) -> str:
        return re.sub(self.pattern(r"\\*"), lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(self.pattern(r"\\+"), lambda m: m[0][0] + m[0][2:], text) if "\\" in text else text

    def header(self, role: str | None) -> str:
        return self.start + self.escape((role or "").replace("\\", "\\\\").replace("\n", "\\n")) + self.after_role

    def role(self, written: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(written))


def _ramps(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, length), one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _escaped(buf: np.ndarray, offs: np.ndarray, pattern: re.Pattern) -> np.ndarray:
    """First bytes of the control strings in the texts."""
    found = np.array([m.span() for m in pattern.finditer(buf.tobytes())], dtype=np.int64).reshape(-1, 2)
    # texts lie one behind the other: what begins in one and ends in the next is no control string
    same = np.searchsorted(offs, found[:, 0], side="right") == np.searchsorted(offs, found[:, 1] - 1, side="right")
    return found[same, 0]


def assemble(roles: pa.Array, texts: pa.Array, template: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, border of each turn, start of its text, end of its text) of formatted turns; a null role or text is empty."""
    coded = roles.fill_null("").dictionary_encode()
    headers = [template.header(r).encode() for r in coded.dictionary.to_pylist()]
    pool = np.frombuffer(b"".join(headers), dtype=np.uint8)
    sizes = np.array([len(h) for h in headers], dtype=np.int64)
    role = coded.indices.to_numpy(zero_copy_only=False)
    head, head_at = sizes[role], (np.cumsum(sizes) - sizes)[role]
    buf, offs = text_bytes(texts)
    first = _escaped(buf, offs, re.compile(template.pattern(r"\\*").encode()))
    row = np.searchsorted(offs, first, side="right") - 1
    content, extra = np.diff(offs), np.bincount(row, minlength=len(offs) - 1)
    tail = np.frombuffer(template.end.encode(), dtype=np.uint8)
    lengths = np.stack([head, content + extra, np.full(len(head), len(tail))], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, dtype=np.uint8)
    out[_ramps(starts[:, 0], head)] = pool[_ramps(head_at, head)]
    place = _ramps(starts[:, 1], content)
    if len(first):
        marks = np.zeros(len(buf), dtype=np.int64)
        marks[first + 1] = 1
        place += np.cumsum(marks) - np.repeat(np.cumsum(extra) - extra, content)
        out[place[first] + 1] = ord("\\")
    out[place] = buf
    out[starts[:, 2][:, None] + np.arange(len(tail))] = tail
    return out, np.r_[0, ends[:, 2]], starts[:, 1], ends[:, 1]


def _starts(ids: pa.Array) -> np.ndarray:
    """First row of each conversation in sorted rows; null is a conversation of its own."""
    a, b = ids.slice(1), ids.slice(0, max(len(ids) - 1, 0))
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.r_[0, np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1]


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _format(template: Template):
    def parts(batch, first, whole):
        """A row for each conversation in ``batch``."""
        heads = _starts(batch.column("conv_id"))
        out, borders, starts, ends = assemble(batch.column("role"), batch.column("text"), template)
        points = np.r_[0, np.cumsum((out & 0xC0) != 0x80)]
        cuts = np.r_[borders[heads], borders[-1]]
        trained = np.flatnonzero(pc.fill_null(pc.equal(batch.column("role"), template.trained), False).to_numpy(zero_copy_only=False))
        base = points[cuts[np.searchsorted(heads, trained, side="right") - 1]]
        spans = pa.StructArray.from_arrays([pa.array(points[x[trained]] - base) for x in (starts, ends)], names=["start", "stop"])
        loss = pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(trained, heads), len(trained)], pa.int32()), spans)
        text = pa.Array.from_buffers(pa.string(), len(heads), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out)])
        ids = batch.column("conv_id").take(pa.array(heads))
        sure = np.ones(len(heads), dtype=bool)
        sure[0] &= whole[0]
        sure[-1] &= whole[1]
        columns = [ids, pa.array(first + np.arange(len(heads))), pa.array(sure), pa.array(np.diff(np.r_[heads, batch.num_rows])), text, loss]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "whole", "n_turns", "text", "loss"])

    def run(batches):
        part, cut, held, size = TaskContext.get().partitionId() << 33, True, [], 0
        for batch in slices(batches, "text"):
            held.append(batch)
            size += int(offsets(batch.column("text"))[-1] - offsets(batch.column("text"))[0]) + 64 * batch.num_rows
            if size < SLICE_BYTES:
                continue
            rows = _one(held)
            last = int(_starts(rows.column("conv_id"))[-1])
            if last:  # all but the last conversation are complete
                out = parts(rows.slice(0, last), part, (not cut, True))
                held, cut = [rows.slice(last)], False
                size = int(offsets(held[0].column("text"))[-1] - offsets(held[0].column("text"))[0]) + 64 * held[0].num_rows
            elif size >= PART_BYTES:
                out = parts(rows, part, (False, False))
                held, cut, size = [], True, 0
            else:
                held = [rows]
                continue
            part += out.num_rows
            yield out
        if held and sum(b.num_rows for b in held):
            yield parts(_one(held), part, (not cut, False))

    return run


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, part, whole, n_turns, text, loss) of ``turns`` (conv_id, turn, role, text).

    ``text`` is the formatted conversation, ``loss`` its trained spans [start, stop) in code points.  A conversation
    longer than about ``PART_BYTES``, or one that lies across a border of two ranges, comes in several parts: joined
    by ascending ``part`` they are its text, and each part's spans count from its own start.  ``whole`` is true where
    a row is known to hold its conversation alone.  A null text or role is empty; null ids are one conversation; null
    turns come first; equal turns are ordered by role and digest of the text; repeated rows stay repeated.  Other
    columns are ignored; an empty table gives no rows.
    """
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # the last key only spreads rows that are equal in all others
    order = ["conv_id", "turn", "role", "tie", "row"]
    rows = rows.withColumn("tie", F.md5(F.coalesce("text", F.lit("")))).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    schema = f"conv_id {kind}, part long, whole boolean, n_turns long, text string, loss array<struct<start:long,stop:long>>"
    return dealt.mapInArrow(_format(template), schema)


def parse(text: str, template: Template = Template()) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    at = 0
    while at < len(text):
        if not text.startswith(template.start, at):
            raise ValueError(f"no turn starts at character {at}")
        line = text.index(template.after_role, at)
        stop = text.index(template.end, line + 1)
        yield template.role(text[at + len(template.start) : line]), template.unescape(text[line + 1 : stop])
        at = stop + len(template.end)


_DIGESTS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


class _Digest:
    """What the formatted text of one conversation holds, part by part."""

    def __init__(self, template: Template):
        self.template, self.turns, self.loss = template, hashlib.sha256(), hashlib.sha256()
        self.n, self.chars, self.formatted = 0, 0, 0

    def add(self, text: str, loss: list[dict]):
        for role, content in parse(text, self.template):
            self.turns.update(f"{role}\n{content}\n".encode())
            self.n += 1
        for span in loss:
            trained = self.template.unescape(text[span["start"] : span["stop"]])
            self.loss.update(trained.encode())
            self.chars += len(trained)
        self.formatted += len(text)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def _digest_whole(template: Template):
    """Digests of whole conversations; parts of others pass with their text and spans."""

    def run(batches):
        for batch in batches:
            whole = batch.column("whole")
            done = batch.filter(whole)
            rows = []
            for text, loss in zip(done.column("text"), done.column("loss"), strict=True):
                digest = _Digest(template)
                digest.add(text.as_py(), loss.as_py())
                rows.append(digest.row())
            names = ["conv_id", "part", *_DIGESTS, "text", "loss"]
            nothing = [pa.nulls(len(rows), batch.column(c).type) for c in ("text", "loss")]
            yield pa.RecordBatch.from_arrays([done.column("conv_id"), done.column("part"), *_arrays(rows), *nothing], names=names)
            rest = batch.filter(pc.invert(whole))
            if rest.num_rows:
                empty = _arrays([(None,) * len(_DIGESTS)] * rest.num_rows)
                yield pa.RecordBatch.from_arrays([rest.column("conv_id"), rest.column("part"), *empty, rest.column("text"), rest.column("loss")], names=names)

    return run


def _digest_parts(template: Template):
    """The digest of every conversation, its parts in order; a task holds one part at a time."""

    def run(batches):
        names = ["conv_id", *_DIGESTS]
        current, digest = None, None
        for batch in batches:
            ids, known = batch.column("conv_id"), pc.is_valid(batch.column("turns_sha256"))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(known) for c in names], names=names)
            for i in np.flatnonzero(~known.to_numpy(zero_copy_only=False)).tolist():
                if digest is None or ids[i].as_py() != current.as_py():
                    if digest:
                        yield pa.RecordBatch.from_arrays([pa.array([current.as_py()], ids.type), *_arrays([digest.row()])], names=names)
                    current, digest = ids[i], _Digest(template)
                digest.add(batch.column("text")[i].as_py(), batch.column("loss")[i].as_py())
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([current.as_py()], current.type), *_arrays([digest.row()])], names=names)

    return run


def read_back(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the formatted text and its spans alone.

    Whole conversations are read where they lie and only their digests move on; the parts of longer ones are brought
    together.  A digest runs over its conversation in order, so one conversation's parts go through one task, part
    by part.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    digests = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    first = parts.select("conv_id", "part", "whole", "text", "loss").mapInArrow(
        _digest_whole(template), f"conv_id {kind}, part long, {digests}, text string, loss array<struct<start:long,stop:long>>"
    )
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return first.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_digest_parts(template), f"conv_id {kind}, {digests}")
