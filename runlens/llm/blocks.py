"""Main text of web pages by a recurrent block labeller (operator 7).

A page is the sequence of its leaf blocks: the text between the borders of block-level elements.  Each block is a
vector of its hashed tag path (elements, classes, ids, roles), its hashed words and a few shape numbers.  A
bidirectional LSTM in numpy reads the whole sequence and labels every block, so a block is judged in the context of
the whole document.  The model is trained here, on pages drawn from a grammar of page layouts whose labels are known.
"""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textwords import slices

PATH, NEAR, WORDS = 256, 128, 64  # hashed dimensions: whole path, nearest two elements, words
SHAPE = 8
SIZE = PATH + NEAR + WORDS + SHAPE
HIDDEN = 24
#: Share of the features that training leaves out.
DROP = 0.15
#: Blocks of one batch of pages, padding included.
BATCH_BLOCKS = 1 << 14

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|style|type)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S | re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_RAW = frozenset("script style template".split())
_RAW_TEXT = frozenset("textarea title noscript iframe xmp".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table select body html article section div main aside nav header footer form td th blockquote".split())


def _names(attributes: str) -> list[str]:
    """Lower-case words of class, id, role and label."""
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            out.append("hidden")
        elif name not in ("style", "type"):
            out += [w.lower().rstrip("s") or "s" for w in _NAME_PART.findall(value)]
    return out


def blocks(page: str) -> list[tuple[tuple, str, int]]:
    """(path, text, characters in links) of each block with text, in page order.

    ``path`` is a tuple of (element, names) from the root.  Character references are decoded and white space is one
    space.  Scripts, styles and comments are no text; a line break is white space.
    """
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[tuple[tuple, str, int]] = []
    held: list[str] = []
    links = 0

    def flush():
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((tuple(stack), text, links))
            held.clear()
        links = 0

    def say(raw: str):
        nonlocal links
        if raw:
            text = html.unescape(raw)
            held.append(text)
            if any(t == "a" for t, _ in reversed(stack)):
                links += len(text)

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name == "br":
            held.append(" ")
            continue
        block = name not in _INLINE
        if m[1] or m[4]:  # an end tag closes what is open inside its element; an inline one doesn't cross a block
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if block:
                        flush()
                    del stack[k:]
                    break
                if not block and stack[k][0] not in _INLINE:
                    break
            else:
                if block:
                    flush()
            continue
        attributes = m[3] or m[6] or ""
        if block:
            flush()
            closing = _CLOSES.get(name, frozenset()) | {"p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closing:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPE:
                    break
        if name in _RAW or name in _RAW_TEXT:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name in _RAW_TEXT:
                stack.append((name, tuple(_names(attributes))))
                say(page[at : end.start() if end else len(page)])
                flush()
                stack.pop()
            at = end.end() if end else len(page)
        elif name not in _VOID and not attributes.endswith("/"):
            stack.append((name, tuple(_names(attributes))))
    say(page[at:])
    flush()
    return out


@lru_cache(maxsize=1 << 16)
def _slot(token: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "replace"))
    return h % size, 1.0 if h & 0x40000000 else -1.0


def vectors(page: list[tuple[tuple, str, int]]) -> np.ndarray:
    """(blocks, SIZE) features of one page."""
    out = np.zeros((len(page), SIZE), dtype=np.float32)
    for i, (path, text, links) in enumerate(page):
        x = out[i]
        block_path = [p for p in path if p[0] not in ("html", "body")]
        for k, (tag, names) in enumerate(reversed(block_path)):
            for token in (tag, *("." + n for n in names)):
                j, sign = _slot(token, PATH)
                x[j] += sign
                if k < 2:
                    j, sign = _slot(f"{k}{token}", NEAR)
                    x[PATH + j] += sign
        words = text.lower().split()
        for w in words:
            j, sign = _slot(w, WORDS)
            x[PATH + NEAR + j] += sign
        x[PATH + NEAR : PATH + NEAR + WORDS] /= max(1.0, len(words)) ** 0.5 * 2
        ends = text[-1] in ".!?:…\"”»"
        x[-SHAPE:] = (
            np.log1p(len(words)) / 4, links / len(text), float(ends), sum(map(text.count, ".,;")) / len(words) / 2,
            i / len(page), float(i == 0), np.log1p(len(page)) / 5, len(block_path) / 8,
        )
    return np.clip(out, -3, 3)


class BlockLSTM:
    """One forward and one backward LSTM over the blocks, and a logistic layer on both."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = (rng.standard_normal((SIZE, 4 * HIDDEN)) * 0.1).astype(np.float32)
            self.p["h" + d] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * HIDDEN**-0.5).astype(np.float32)
            self.p["b" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN).astype(np.float32)  # forget gates start open
        self.p["o"] = (rng.standard_normal((2 * HIDDEN, 1)) * 0.1).astype(np.float32)
        self.p["c"] = np.zeros(1, dtype=np.float32)

    @staticmethod
    def _flip(x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each sequence of x (time, batch, size) reversed within its length."""
        t = np.arange(len(x))[:, None]
        at = np.where(t < length[None, :], length[None, :] - 1 - t, t)
        return np.take_along_axis(x, at[:, :, None], axis=0)

    def _run(self, d: str, x: np.ndarray):
        steps, batch, _ = x.shape
        inner = x.reshape(-1, SIZE) @ self.p["x" + d] + self.p["b" + d]
        inner = inner.reshape(steps, batch, 4 * HIDDEN)
        h = np.zeros((batch, HIDDEN), dtype=np.float32)
        c = np.zeros_like(h)
        hs, cs, gates = np.empty((steps + 1, batch, HIDDEN), np.float32), np.empty((steps + 1, batch, HIDDEN), np.float32), np.empty((steps, batch, 4 * HIDDEN), np.float32)
        hs[0], cs[0] = h, c
        for t in range(steps):
            z = inner[t] + h @ self.p["h" + d]
            g = gates[t]
            g[:, : 3 * HIDDEN] = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            g[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o, n = np.split(g, 4, axis=1)
            c = f * c + i * n
            h = o * np.tanh(c)
            hs[t + 1], cs[t + 1] = h, c
        return hs, cs, gates

    def _logits(self, x: np.ndarray, length: np.ndarray):
        fwd, bwd = self._run("f", x), self._run("b", self._flip(x, length))
        both = np.concatenate([fwd[0][1:], self._flip(bwd[0][1:], length)], axis=2)
        return both @ self.p["o"] + self.p["c"], both, fwd, bwd

    def predict(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of each block of each page; pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            take = order[-max(1, BATCH_BLOCKS // longest) :]
            del order[-len(take) :]
            x, length = _padded([pages[i] for i in take])
            p = 1 / (1 + np.exp(-np.clip(self._logits(x, length)[0][:, :, 0], -30, 30)))
            for k, i in enumerate(take):
                out[i] = p[: length[k], k]
        return out

    def _back(self, d: str, x: np.ndarray, run, dh_out: np.ndarray) -> dict[str, np.ndarray]:
        hs, cs, gates = run
        steps, batch, _ = x.shape
        dz = np.empty_like(gates)
        dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, n = np.split(gates[t], 4, axis=1)
            tc = np.tanh(cs[t + 1])
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * n * i * (1 - i), dc * cs[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - n * n)], axis=1)
            dc = dc * f
            dh = dz[t] @ self.p["h" + d].T
        flat = dz.reshape(-1, 4 * HIDDEN)
        return {"x" + d: x.reshape(-1, SIZE).T @ flat, "h" + d: hs[:-1].reshape(-1, HIDDEN).T @ flat, "b" + d: flat.sum(axis=0)}

    def gradients(self, x: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean cross entropy, gradients) of a batch (time, pages, SIZE) with labels (time, pages)."""
        logits, both, fwd, bwd = self._logits(x, length)
        mask = (np.arange(len(x))[:, None] < length[None, :]).astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(logits[:, :, 0], -30, 30)))
        n = mask.sum()
        loss = -float(((y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)) * mask).sum() / n)
        dlogit = ((p - y) * mask / n)[:, :, None].astype(np.float32)
        dboth = dlogit @ self.p["o"].T
        grads = {"o": both.reshape(-1, 2 * HIDDEN).T @ dlogit.reshape(-1, 1), "c": dlogit.sum(axis=(0, 1))}
        grads |= self._back("f", x, fwd, dboth[:, :, :HIDDEN])
        flipped = self._flip(x, length)
        grads |= self._back("b", flipped, bwd, self._flip(dboth[:, :, HIDDEN:], length))
        return loss, grads

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 3) -> float:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        t, loss = 0, 0.0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), batch):
                take = order[a : a + batch]
                x, length = _padded([pages[i] for i in take])
                # features fall out at random, so that no single name decides
                x *= rng.random(x.shape, dtype=np.float32) > DROP
                y = np.zeros(x.shape[:2], dtype=np.float32)
                for k, i in enumerate(take):
                    y[: length[k], k] = labels[i]
                loss, grads = self.gradients(x, length, y)
                t += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return loss


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(p) for p in pages])
    x = np.zeros((int(length.max()), len(pages), SIZE), dtype=np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    return x, length


def extract(pages: DataFrame, model: BlockLSTM) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept), one row per row of ``pages`` (page_id, url, html); no shuffle.

    ``text`` is the blocks labelled main text, in page order, joined by one line feed; ``n_chars`` its code points.
    A null or empty html, or one without text, has an empty text.  Pages are read whole; repeated rows all come
    back; other columns are ignored.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches):
        for part in slices(batches, "html"):
            parsed = [blocks(h or "") for h in part.column("html").to_pylist()]
            scores = model.predict([vectors(p) for p in parsed])
            texts = ["\n".join(b[1] for b, s in zip(p, q, strict=True) if s >= 0.5) for p, q in zip(parsed, scores, strict=True)]
            numbers = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [len(p) for p in parsed], [int((q >= 0.5).sum()) for q in scores])]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), *numbers], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long, n_kept long"
    )
