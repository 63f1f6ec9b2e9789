"""SentencePiece encoding and decoding with a unigram model (operator 1).

The best segmentation of a text is the path of greatest total log score through the lattice of the pieces it
matches (Viterbi).  Pieces are found by a double-array trie over UTF-8 bytes; a character that no piece covers is
written as its byte pieces.  A space is the marker U+2581, and one marker is put before the text.

No piece holds a marker behind another character, so the best path of a text is made of the best paths of its
words; each task keeps the paths of the words it has met, and new words are solved together, position by position.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textwords import slices

MARK = "▁"
#: A character without a piece scores this much below the worst piece, as sentencepiece has it.
UNKNOWN_PENALTY = 10.0
#: A task's table of solved words starts anew beyond so many words or ids.
KEPT_WORDS, KEPT_IDS = 200_000, 2_000_000
#: New words are solved in batches of about so many bytes, texts in slices of so many.
SOLVED_BYTES, TEXT_BYTES = 1 << 16, 1 << 20
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class DoubleArrayTrie:
    """``check[base[s] + byte + 1] == s`` when state s has a child for the byte; ``value`` holds piece ids or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for key, value in keys.items():
            at = 0
            for byte in key:
                if byte not in children[at]:
                    children[at][byte] = len(children)
                    children.append({})
                    ids.append(-1)
                at = children[at][byte]
            ids[at] = value
        size = len(children) * 2 + 512
        base, check, value = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        used = bytearray(size)
        used[0] = 1
        # nodes with one child fill the lowest free place; for the others the search goes on where the last one ended
        low, tail = 1, 1
        todo = [(0, 0)]
        for node, state in todo:
            value[state] = ids[node]
            offspring = children[node]
            if not offspring:
                continue
            codes = sorted(offspring)
            at = max(low if len(codes) == 1 else tail, codes[0] + 1)
            while True:
                if at + codes[-1] + 2 >= size:
                    base, check, value = (np.concatenate([x, np.full(size, fill, dtype=np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                    used.extend(bytes(size))
                    size *= 2
                at = used.find(0, at)
                if at >= 0 and at + codes[-1] + 2 < size and not any(used[at - codes[0] + c] for c in codes):
                    break
                at = at + 1 if at >= 0 else size
            if len(codes) == 1:
                low = used.find(0, low)
            else:
                tail = at
            start = at - codes[0] - 1
            base[state] = start
            for c in codes:
                used[start + c + 1] = 1
                check[start + c + 1] = state
                todo.append((offspring[c], start + c + 1))
        self.base, self.check, self.value = base, check, value
        self.depth = max(map(len, keys), default=0)

    def matches(self, buf: np.ndarray, starts: np.ndarray, limits: np.ndarray):
        """(start, end, value) of every key that begins at one of ``starts`` and ends by its limit."""
        state = np.zeros(len(starts), dtype=np.int64)
        found = []
        for k in range(self.depth):
            live = starts + k < limits
            starts, limits, state = starts[live], limits[live], state[live]
            if not len(starts):
                break
            to = self.base[state].astype(np.int64) + buf[starts + k] + 1
            inside = to < len(self.check)
            hit = np.zeros(len(to), dtype=bool)
            hit[inside] = self.check[to[inside]] == state[inside]
            starts, limits, state = starts[hit], limits[hit], to[hit]
            value = self.value[state]
            full = value >= 0
            found.append((starts[full], starts[full] + k + 1, value[full]))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class UnigramModel:
    """Pieces with log scores. ``pieces``: (piece, score, type) by id."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.scores = np.array([s for _, s, _ in pieces], dtype=np.float64)
        normal = [i for i, (_, _, t) in enumerate(pieces) if t == NORMAL]
        self.unknown_score = float(min((self.scores[i] for i in normal), default=0.0)) - UNKNOWN_PENALTY
        self.trie = DoubleArrayTrie({p.encode(): i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER_DEFINED) and p})
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.byte_table = np.full(256, -1, dtype=np.int64)
        self.byte_table[list(self.byte_ids)] = list(self.byte_ids.values())
        self.unknown_id = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        if not self.byte_ids:
            self.byte_table[:] = self.unknown_id
        self.raw = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode()
            for p, _, t in pieces
        ]
        inner = [p for p, _, t in pieces if t in (NORMAL, USER_DEFINED) and MARK in p.lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces with a marker behind another character: {inner[:3]}")
        self.raw_size = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size
        self.raw_flat = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.firsts, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    @classmethod
    def load(cls, path: str) -> UnigramModel:
        """From a sentencepiece model file.

        A unigram file's scores are log probabilities.  Files of the BPE kind have merge ranks instead; their pieces
        get the log probabilities of Zipf's law, log(1 / (rank + 1)) less its norm, by the order of the file.
        """
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        if proto.trainer_spec.model_type != 1:
            order = [i for i, (_, _, t) in enumerate(pieces) if t == NORMAL]
            norm = float(np.log(np.sum(1.0 / np.arange(2, len(order) + 2))))
            zipf = {i: -float(np.log(r + 2)) - norm for r, i in enumerate(order)}
            pieces = [(p, zipf.get(i, s), t) for i, (p, s, t) in enumerate(pieces)]
        return cls(pieces)

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the best paths of all words, one after the other; number of ids of each word)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
        size = np.array([len(r) for r in raw], dtype=np.int64)
        stop = np.cumsum(size)
        begin = stop - size
        chars = np.flatnonzero((buf & 0xC0) != 0x80)
        word = np.searchsorted(stop, chars, side="right")
        start, end, piece = self.trie.matches(buf, chars, stop[word])
        after = np.append(chars[1:], len(buf))  # the end of each character
        # characters that no piece covers alone
        alone = np.zeros(len(buf) + 1, dtype=bool)
        next_char = np.zeros(len(buf) + 1, dtype=np.int64)
        next_char[chars] = after
        alone[start[end == next_char[start]]] = True
        bare = chars[~alone[chars]]
        start, end, piece = np.concatenate([start, bare]), np.concatenate([end, next_char[bare]]), np.concatenate([piece, np.full(len(bare), -1)])
        score = np.where(piece >= 0, self.scores[piece], self.unknown_score)
        # steps of equal distance from the start of their word don't touch each other
        step = start - begin[np.searchsorted(stop, start, side="right")]
        order = np.argsort(step, kind="stable")
        cuts = np.searchsorted(step[order], np.arange(int(size.max(initial=0)) + 1))
        best = np.full(len(buf) + len(raw) + 1, -np.inf)
        back = np.zeros(len(buf) + len(raw) + 1, dtype=np.int64)
        # word w has the places begin[w] + w ... stop[w] + w, so that ends and starts of neighbours differ
        owner = np.searchsorted(stop, start, side="right")
        best[begin + np.arange(len(raw))] = 0.0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            edge = order[a:b]
            to = end[edge] + owner[edge]
            value = best[start[edge] + owner[edge]] + score[edge]
            better = value > best[to]
            best[to[better]] = value[better]
            back[to[better]] = edge[better]
        # walk all words back together, from their ends to their starts
        active = np.flatnonzero(size)
        at, taken = stop[active], []
        while len(active):
            edge = back[at + active]
            taken.append(edge)
            at = start[edge]
            more = at > begin[active]
            active, at = active[more], at[more]
        edges = np.concatenate([*taken, np.zeros(0, dtype=np.int64)])
        edges = edges[np.argsort(start[edges], kind="stable")]  # words, and pieces in them, lie in order
        spelt = (piece[edges] < 0) & bool(self.byte_ids)
        count = np.where(spelt, end[edges] - start[edges], 1)
        each = np.repeat(edges, count)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        byte = self.byte_table[buf[np.minimum(start[each] + nth, len(buf) - 1)]] if len(each) else each
        ids = np.where(piece[each] >= 0, piece[each], byte).astype(np.int32)
        return ids, np.bincount(owner[edges], weights=count, minlength=len(words)).astype(np.int64)

    def _look_up(self, words: list[str]) -> np.ndarray:
        """Places of the words in the table of solved words, which takes up the new ones."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            sizes_of = np.cumsum([len(w) for w in new])
            cuts = [0, *np.unique(np.searchsorted(sizes_of, np.arange(SOLVED_BYTES, sizes_of[-1], SOLVED_BYTES))).tolist(), len(new)]
            parts = [self.solve(new[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
            ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.sizes = np.concatenate([self.sizes, sizes])
            self.firsts = np.concatenate([self.firsts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat = np.concatenate([self.flat, ids])
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their borders); an empty text has none."""
        if len(self.known) > KEPT_WORDS or len(self.flat) > KEPT_IDS:
            self._forget()
        split = [split_words(t) for t in texts]
        place = self._look_up(list(chain.from_iterable(split)))
        ids = gather(self.flat, self.firsts[place], self.sizes[place])
        per_word = np.concatenate([[0], np.cumsum(self.sizes[place])])
        return ids, per_word[np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)]

    def encode(self, text: str) -> list[int]:
        return self.encode_flat([text])[0].tolist()

    def decode_flat(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; the space that encoding put before it is taken off."""
        raw = gather(self.raw_flat, self.raw_first[ids], self.raw_size[ids]).tobytes()
        at = np.concatenate([[0], np.cumsum(self.raw_size[ids])])[offs].tolist()
        return [raw[a + (raw[a : a + 1] == b" " and a < b) : b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_flat(np.asarray(ids, dtype=np.int64), np.array([0, len(ids)]))[0].decode("utf-8", "replace")


def split_words(text: str) -> list[str]:
    """The text as words that each begin with their markers."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return _WORD.findall(MARK + text.replace(" ", MARK))
    return (MARK + text.replace(" ", " " + MARK)).split(" ")


def gather(flat: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[first : first + size], one after the other."""
    total = int(sizes.sum())
    return flat[np.repeat(firsts - np.cumsum(sizes) + sizes, sizes) + np.arange(total)] if total else flat[:0]


def encode(docs: DataFrame, model: UnigramModel, keep: tuple[str, ...] = ("doc_id",), verify: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` with n_tokens, n_byte_tokens and ids of ``text``; no shuffle.

    A null or empty text has no ids.  The model (bounded by its vocabulary) goes to the executors as a broadcast.
    ``verify`` adds round_trip: whether the decoded ids are the text (null as empty); a text that itself holds the
    marker U+2581 decodes with a space there.  Repeated rows all come back; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        byte = np.zeros(len(own.raw), dtype=bool)
        byte[list(own.byte_ids.values())] = True
        for part in slices(batches, "text", TEXT_BYTES):
            texts = [t or "" for t in part.column("text").to_pylist()]
            flat, offs = own.encode_flat(texts)
            in_byte = np.concatenate([[0], np.cumsum(byte[flat])])
            columns = [*(part.column(c) for c in keep), pa.array(np.diff(offs)), pa.array(in_byte[offs[1:]] - in_byte[offs[:-1]], pa.int64()), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat))]
            if verify:
                columns.append(pa.array([x == t.encode("utf-8", "surrogatepass") for x, t in zip(own.decode_flat(flat, offs), texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "n_byte_tokens", "ids", *["round_trip"] * verify])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{kinds}, n_tokens long, n_byte_tokens long, ids array<int>" + ", round_trip boolean" * verify)


def decode(tokens: DataFrame, model: UnigramModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``tokens`` with the text of ``ids``; null ids give an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for b in batches:
            texts = [own.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    kinds = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep)
    return tokens.select(*keep, "ids").mapInArrow(run, f"{kinds}, text string")
