"""Whole-text encoding with a public tokenizer file, remembering the pieces between single spaces.

Byte-level BPE applies its merges inside pre-tokens, and its pre-token pattern always breaks before a space that
stands between two characters that are not white space (only `` ?`` at the start of a pre-token can take it), and
before and after such a line feed. So the ids of a text are those of its pieces ``word``, `` word``, line feed and
word, ... one after another. Each distinct piece is
encoded once by the tokenizers library; a text with any other use of white space at a piece's edge, or with the
string of an added (special) token in it, is encoded by the library in one call, and so is every text if the file isn't
of the kind this holds for (see ``by_pieces``). Results equal ``Tokenizer.encode(text)`` (tests compare them).
"""

from __future__ import annotations

import gc
import json
import os
import string
from itertools import chain

import numpy as np

PIECES = 400_000  # remembered pieces per worker; beyond, those met in one call alone are forgotten


class _Index(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


class _Grow:
    def __init__(self, dtype) -> None:
        self.a, self.n = np.zeros(1 << 16, dtype), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.a):
            self.a = np.concatenate([self.a, np.zeros_like(self.a)])
        self.a[self.n : self.n + len(values)] = values
        self.n += len(values)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


LETTERS = _byte_letters()


def byte_level(word: str) -> str:
    if word.isascii():
        return "\u0120" + word[1:] if word[0] == " " else word
    return word.encode().decode("latin-1").translate(LETTERS)


def whole(piece: str) -> str:
    """The text that a piece stands for: the first of a text follows \\0, one after a line feed begins with it, any
    other follows a space."""
    return piece[1:] if piece[:1] == "\0" else piece if piece[:1] == "\n" else " " + piece


def strange(piece: str) -> bool:
    """Whether white space at the piece's edges makes it unsure that the pre-token pattern breaks there."""
    body = piece[1:] if piece[:1] in ("\0", "\n") else piece
    return not body or body[0].isspace() or body[-1].isspace() or "\0" in body


def by_pieces(tok) -> bool:
    """Whether the tokenizer is byte-level BPE with the usual pre-token pattern, no normalizer and no random merges."""
    d = json.loads(tok.to_str())
    pre, model = d.get("pre_tokenizer") or {}, d.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return d.get("normalizer") is None and plain and merges and all(c in (model.get("vocab") or {}) for c in LETTERS.values())


MARKS = string.punctuation  # a run of them after letters at the end of a piece is a pre-token of its own


class Encoder:
    """encode(texts) -> (ids uint32, ids per text[, character start of each id, end of each id])."""

    def __init__(self, path: str, spans: bool = False, limit: int | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.spans, self.limit = Tokenizer.from_file(path), spans, limit or PIECES
        self.pieces = by_pieces(self.tok)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.marks: dict[str, list[int]] = {"": []}
        self.line = self.tok.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.index, self.odd = _Index(), _Grow(bool)
        self.ids, self.start, self.size, self.chars = _Grow(np.uint32), _Grow(np.int64), _Grow(np.int32), _Grow(np.int32)
        self.lo, self.hi, self.hits = _Grow(np.int32), _Grow(np.int32), _Grow(np.int32)

    def _trim(self) -> None:
        """Forget the pieces that were met in one call alone, and the less frequent ones where that frees less than half."""
        hits = self.hits.a[: len(self.index)]
        keep = np.flatnonzero(hits > 1)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argsort(-hits[keep], kind="stable")[: self.limit // 2]])
        names, old = list(self.index), self.__dict__.copy()
        self.clear()
        size, start = old["size"].a[keep].astype(np.int64), old["start"].a[keep]
        ends = np.cumsum(size)
        pos = np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))
        self.index.update((names[k], i) for i, k in enumerate(keep.tolist()))
        self.start.add(ends - size)
        for k in ("size", "odd", "chars") if self.spans else ("size", "odd"):
            getattr(self, k).add(old[k].a[keep])
        self.hits.add(np.ones(len(keep), np.int32))
        for k in ("ids", "lo", "hi") if self.spans else ("ids",):
            getattr(self, k).add(old[k].a[pos])

    def _run(self, marks: str) -> list[int]:
        """Ids of a run of marks after letters."""
        found = self.marks.get(marks)
        if found is None:
            found = self.tok.encode(marks, add_special_tokens=False).ids
            if len(self.marks) < 10_000 and len(marks) < 16:
                self.marks[marks] = found
        return found

    def _lists(self, new: list[str]) -> tuple[list[list[int]], list[int]]:
        """Ids of new pieces, and which of these went through the library's own pre-tokens.

        A word of letters alone is one pre-token, which goes to the library's BPE model directly; so do the letters of a
        word with marks at its end, and those of either after a line feed, which is a pre-token of its own."""
        merge, index, line = self.tok.model.tokenize, self.index, self.line
        start, size, ids, learnt = self.start.a, self.size.a, self.ids.a, self.size.n
        out, other, known = [[]] * len(new), [], {}
        for k, p in enumerate(new):
            if p.isalpha():
                out[k] = known[p] = [t.id for t in merge("\u0120" + p if p.isascii() else byte_level(" " + p))]
            elif (core := p.rstrip(MARKS)).isalpha():
                found = known.get(core)
                if found is None:
                    at = index.get(core)
                    if at is not None and at < learnt:
                        found = ids[start[at] : start[at] + size[at]].tolist()
                    else:
                        found = known[core] = [t.id for t in merge("\u0120" + core if core.isascii() else byte_level(" " + core))]
                out[k] = found + self._run(p[len(core) :])
            elif p[:1] == "\n" and (body := core[1:]).isalpha():
                found = line + [t.id for t in merge(body if body.isascii() else byte_level(body))]
                out[k] = found + self._run(p[len(core) :])
            else:
                other.append(k)
        for k, e in zip(other, self.tok.encode_batch_fast([whole(new[k]) for k in other], add_special_tokens=False)):
            out[k] = e.ids
        return out, other

    def _learn(self) -> None:
        collects = gc.isenabled()
        gc.disable()  # many small lists, none in a cycle
        try:
            self._learn_new()
        finally:
            if collects:
                gc.enable()

    def _learn_new(self) -> None:
        for k in range(0, len(new := self.index.new), 5000):
            part = new[k : k + 5000]
            odd = np.zeros(len(part), bool)
            if self.spans:
                found = self.tok.encode_batch([whole(p) for p in part], add_special_tokens=False)
                lists, other = [e.ids for e in found], range(len(part))
                both = np.array([o for e in found for o in e.offsets], np.int32).reshape(-1, 2)
                self.lo.add(both[:, 0])
                self.hi.add(both[:, 1])
                self.chars.add(np.fromiter((len(p) + (p[:1] not in ("\n", "\0")) - (p[:1] == "\0") for p in part), np.int64, len(part)))
            else:
                lists, other = self._lists(part)
            odd[other] = [strange(part[i]) for i in other]  # the rest begins and ends with letters and marks
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.start.add(self.ids.n + np.cumsum(sizes) - sizes)
            self.size.add(sizes)
            self.ids.add(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())))
            self.odd.add(odd)
            self.hits.add(np.zeros(len(part), np.int32))
        self.index.new = []

    def encode(self, texts: list[str]):
        if len(self.index) > self.limit:
            self._trim()
        if not texts:
            return (np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * (3 if self.spans else 1))
        if not self.pieces:
            return self._library(texts)
        split = [("\0" + t.replace("\n", " \n")).split(" ") for t in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        first = np.concatenate([[0], np.cumsum(count)])
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(first[-1]))
        self._learn()
        self.hits.a[at] += 1  # once a call, however often the piece is in it
        size = self.size.a[at].astype(np.int64)
        ends = np.cumsum(size)
        pos = np.repeat(self.start.a[at] - (ends - size), size) + np.arange(int(size.sum()))
        ids, total, lo, hi = self.ids.a[pos], np.add.reduceat(size, first[:-1]), None, None
        if self.spans:
            chars = self.chars.a[at].astype(np.int64)
            begin = np.cumsum(chars) - chars
            begin -= np.repeat(begin[first[:-1]], count)
            shift = np.repeat(begin, size)
            lo, hi = self.lo.a[pos] + shift, self.hi.a[pos] + shift
        bad = np.logical_or.reduceat(self.odd.a[at], first[:-1])
        for mark in self.added:
            bad |= np.fromiter((mark in t for t in texts), bool, len(texts))
        if bad.any():
            bounds = np.concatenate([[0], np.cumsum(total)])
            parts, los, his = [], [], []
            done = 0
            for i in np.flatnonzero(bad):
                e = self.tok.encode(texts[i], add_special_tokens=False)
                parts += [ids[bounds[done] : bounds[i]], np.array(e.ids, np.uint32)]
                if self.spans:
                    both = np.array(e.offsets, np.int64).reshape(-1, 2)
                    los += [lo[bounds[done] : bounds[i]], both[:, 0]]
                    his += [hi[bounds[done] : bounds[i]], both[:, 1]]
                total[i] = len(e.ids)
                done = i + 1
            ids = np.concatenate([*parts, ids[bounds[done] :]])
            if self.spans:
                lo, hi = np.concatenate([*los, lo[bounds[done] :]]), np.concatenate([*his, hi[bounds[done] :]])
        return (ids, total, lo, hi) if self.spans else (ids, total)


    def _library(self, texts: list[str]):
        found = [self.tok.encode(t, add_special_tokens=False) for t in texts]
        total = np.array([len(e.ids) for e in found], np.int64)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32, int(total.sum()))
        if not self.spans:
            return ids, total
        both = np.array([o for e in found for o in e.offsets], np.int64).reshape(-1, 2)
        return ids, total, both[:, 0], both[:, 1]


_kept: dict[tuple[str, bool, int | None], Encoder] = {}


def encoder(path: str, spans: bool = False, limit: int | None = None) -> Encoder:
    """One encoder per worker and file, that remembers ``limit`` pieces; it outlives tasks where Spark reuses workers."""
    if (path, spans, limit) not in _kept:
        _kept[path, spans, limit] = Encoder(path, spans, limit)
    return _kept[path, spans, limit]


def release() -> None:
    """Forget all pieces and give their memory back to the system; for workers that go on to other work."""
    if not _kept:
        return
    import ctypes

    import pyarrow as pa

    _kept.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # freed strings lie scattered over the heap, which else stays as large as it was
    except (AttributeError, OSError):  # not the GNU library
        pass


def groups(texts: list[str | None], chars: int = 1_000_000):
    """Ranges of the list with about ``chars`` characters each."""
    i, n = 0, 0
    for j, t in enumerate(texts):
        n += len(t or "")
        if n >= chars:
            yield i, j + 1
            i, n = j + 1, 0
    if i < len(texts):
        yield i, len(texts)
