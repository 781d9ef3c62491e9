"""Cuts texts where byte-level tokenizers do: the matches of the public pattern, found for many texts at once.

The pattern reads letters, numbers, white space and the rest as runs of one class. A match begins where a run begins,
but for three things: a single space goes with the run behind it; of white space before anything else, the last
character stands for itself; an apostrophe that begins a match takes the letters of a contraction along. So whole
arrays of bytes are cut by comparing the classes of neighbours, and each distinct match has to be encoded once only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex

#: The public pattern, with white space as Unicode's property, as the tokenizers' own pattern engines have it.
WHITE_SPACE_PATTERN = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
_MATCH = regex.compile(WHITE_SPACE_PATTERN)
_KIND = regex.compile(r"(\p{L})|(\p{N})|(\p{White_Space})|(.)", regex.DOTALL)
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 1, 2, 3, 4, 0
#: Where a match begins whatever else the text holds: at white space behind what is not.
_SAFE = re.compile(rb"(?<=[!-~\x80-\xff])(?<!\xc2[\x85\xa0])(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80)[ \n]")


def matches(text: str) -> list[str]:
    """The definition: what the pattern finds."""
    return _MATCH.findall(text)


def bounded(text: bytes, size: int) -> Iterator[bytes]:
    """The text in blocks of about so many bytes, cut where a match begins; one block if nothing tells such a place."""
    at = 0
    while at < len(text):
        cut = _SAFE.search(text, at + size) if at + size < len(text) else None
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


class Cutter:
    """Holds the classes of the characters met so far."""

    def __init__(self):
        self.kinds = np.zeros(0x110000, np.uint8)
        self._learn(range(128))

    def _learn(self, points) -> None:
        for point in points:
            self.kinds[point] = _KIND.match(chr(point)).lastindex

    def _classes(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character; data is valid UTF-8."""
        kind = self.kinds[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        if not len(lead):
            return kind
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for k in (1, 2, 3):
            at = size > k
            point[at] = point[at] << 6 | data[lead[at] + k] & 0x3F
        of = self.kinds[point]
        if not of.all():
            self._learn(np.unique(point[of == UNKNOWN]).tolist())
            of = self.kinds[point]
        kind[lead] = of
        for k in (1, 2, 3):
            at = size > k
            kind[lead[at] + k] = of[at]
        return kind

    def starts(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where matches begin in the bytes of texts that lie one behind the other; texts are the places where each begins."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        first = np.zeros(n + 1, bool)
        first[texts] = True
        first[n] = True
        kind = self._classes(data)
        run = first.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        begins = run[:n].copy()
        begins[1:] &= first[1:n] | (data[:-1] != 0x20) | (kind[1:] == SPACE)
        last = np.flatnonzero((kind == SPACE) & run[1:] & ~first[1:])
        for _ in range(2):
            last -= (data[last] & 0xC0) == 0x80
        begins[last] = True
        ends = np.append(np.flatnonzero(first), n)
        marks = np.flatnonzero(begins & (data == 0x27))
        if len(marks):
            room = ends[np.searchsorted(ends, marks, side="right")] - marks
            one, two = (data[np.minimum(marks + k, n - 1)].astype(np.int32) for k in (1, 2))
            short = (room > 1) & np.isin(one, list(b"stmd"))
            long = (room > 2) & np.isin(one << 8 | two, [a << 8 | b for a, b in (b"re", b"ve", b"ll")])
            begins[marks[short | long] + 1] = False
            begins[np.minimum(marks[short] + 2, n - 1)[room[short] > 2]] = True
            begins[np.minimum(marks[long] + 3, n - 1)[room[long] > 3]] = True
        return np.flatnonzero(begins)
