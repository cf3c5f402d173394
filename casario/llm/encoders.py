"""Encoding whole texts with a public tokenizer of the tokenizers library, with a memo of chunks.

A text is cut before a blank or line feed that follows a character other than white space and precedes another one.
Neither pre-tokenizer's pattern crosses such a cut, so the ids of the chunks, one after another, are the ids of the
text. Natural text repeats its chunks; a worker encodes each distinct one once and keeps its ids.

As the library does it, strings of special tokens in a text give their ids; with special=False they are ordinary text.
A text that may hold one goes to the library whole.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np

_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PUNCT = r"!-&(-/:-@\[-`{-~"
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_PLAIN = re.compile(rf"(\n?)( ?[{_LETTERS}]+)([{_PUNCT}]*)")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: The chunks that _CUT parts a text into, which has a character other than white space.
_CHUNK = re.compile(r"\s*\S+(?:(?![ \n]\S)\s+\S*)*")
#: Entries of a worker's memo; when full, it becomes the old one.
MEMO = 700_000


def pieces_of(text: str | None) -> tuple[str, list[str]]:
    """The first chunk of a text and the others, these without a leading blank (a leading line feed stays)."""
    if not text:
        return "", []
    first, *rest = text.replace("\n", " \n").split(" ")
    if all("!" < p < "\x7f" or _begins(p) for p in rest):
        return first, rest
    first, *rest = _CUT.split(text)  # runs of white space: cut with care
    return first, [p[1:] if p[0] == " " else p for p in rest]


def _begins(p: str) -> bool:
    """Whether a piece starts with a character other than white space, after at most one line feed."""
    head = p[1:] if p[:1] == "\n" else p
    return bool(head) and not head[0].isspace()


def _byte_letters() -> dict[int, str]:
    """The usual letters for bytes: printable ones stand for themselves, the others from U+0100 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Run(Exception):
    """A piece that is no chunk: the text has white space behind a blank or line feed."""


class Memo(dict):
    """Ids of chunks without their leading blank. A full memo becomes the old one, whose entries move back when they come again."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, p: str) -> bytes:
        if (x := self.old.get(p)) is None:
            if not ("!" < p < "\x7f" or _begins(p)):
                raise _Run
            x = self.make(p)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[p] = x
        return x


class Encoder:
    """encode(text) -> little-endian unsigned 32-bit ids as bytes. blanks: a chunk keeps its leading blank."""

    def __init__(self, path: str, blanks: bool, special: bool = True, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = not special
        added = [t.content for t in self.full.get_added_tokens_decoder().values()] if special else []
        self.marks = {a[:2].lower() for a in added} | {a[:2] for a in added}
        self.model = self.full.model
        self.blanks = blanks
        self.table = _byte_letters()
        self.memo = Memo(self._new, memo)
        self.parts: dict[str, list[int]] = {}

    def _part(self, s: str) -> list[int]:
        return [t.id for t in self.model.tokenize(s.encode().decode("latin-1").translate(self.table))]

    def _chunk(self, chunk: str) -> bytes:
        m = _PLAIN.fullmatch(chunk)
        if m is None:
            ids = self.full.encode(chunk, add_special_tokens=False).ids
        else:
            line, word, marks = m.groups()
            if self.blanks:
                ids = self._part(word)
                if line:
                    ids = self._known(line) + ids
            else:
                ids = self._part(word.lstrip(" ").lower())
            if marks:
                ids = ids + self._known(marks)
        return array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()

    def _known(self, marks: str) -> list[int]:
        if (ids := self.parts.get(marks)) is None:
            ids = self._part(marks)
            if len(self.parts) < 10_000:
                self.parts[marks] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(m in text for m in self.marks):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = iter(text.replace("\n", " \n").split(" "))
        first = next(parts)
        try:
            rest = b"".join(map(self.memo.__getitem__, parts))
        except _Run:  # cut with care
            first, *chunks = _CHUNK.findall(text) or [text]
            rest = b"".join([self.memo[c[1:] if c[0] == " " else c] for c in chunks])
        return self._chunk(first) + rest if first else rest

    def _new(self, p: str) -> bytes:
        word = p.rstrip(_MARKS)
        if not (word.isascii() and word.isalpha()):
            return self._chunk(p if p[0] == "\n" else " " + p)
        ids = [t.id for t in self.model.tokenize(self.table[32] + word if self.blanks else word.lower())]
        if len(word) < len(p):
            ids += self._known(p[len(word) :])
        return array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()


_OPEN: dict[tuple, Encoder] = {}


def opened(path: str, blanks: bool, special: bool = True, memo: int = MEMO) -> Encoder:
    """This worker's encoder of a vocabulary file; workers are reused, and with them their memo."""
    if (path, blanks, special) not in _OPEN:
        _OPEN[path, blanks, special] = Encoder(path, blanks, special, memo)
    return _OPEN[path, blanks, special]
