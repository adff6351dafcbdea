"""Where the pieces of GPT-2's pattern start, in the bytes of many texts at once, vectorised with numpy.

Every character is of one kind: letter, number, white or other. A piece is a run of letters, of numbers or of others,
with the space before it, if there is one; or white characters but for the last of them, which stands alone where it
isn't such a space; or all of them at the end of a text. An apostrophe that begins a piece makes one with the endings
of the pattern's first part, whose rest, if any, is a run of its own.
"""

from __future__ import annotations

import numpy as np
import regex

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, OTHER, WHITE, CLOSED = range(5)
#: The byte that closes each text, and others that are closed pieces of their own; UTF-8 has no such bytes.
CLOSE, MARKS = b"\xff", bytes(range(0xF8, 0xFF))
_SPACE, _APOSTROPHE = ord(" "), ord("'")


class Runs:
    def __init__(self):
        #: Of each code point its kind, and of each byte that of an ASCII character.
        self.points = np.full(0x110000, OTHER, np.uint8)
        points = "".join(map(chr, range(0x110000)))
        for kind, members in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for m in regex.finditer(members, points):
                self.points[m.start() : m.end()] = kind
        self.ascii = np.full(256, OTHER, np.uint8)
        self.ascii[:128] = self.points[:128]
        self.ascii[list(MARKS + CLOSE)] = CLOSED

    def _kinds(self, data: np.ndarray) -> np.ndarray:
        """The kind of each byte: that of its character."""
        kinds = self.ascii[data]
        for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
            at = np.flatnonzero((data >= low) & (data < high))
            if len(at):
                point = (data[at] & (0xFF >> (size + 1))).astype(np.int32)
                for k in range(1, size):
                    point = point << 6 | (data[at + k] & 0x3F)
                kind = self.points[point]
                for k in range(size):
                    kinds[at + k] = kind
        return kinds

    def starts(self, data: np.ndarray) -> np.ndarray:
        """Where pieces start in the UTF-8 of texts, each of them closed by CLOSE, which is a piece too. One of MARKS ends a text as well."""
        if not len(data):
            return np.zeros(0, np.int64)
        kinds = self._kinds(data)
        space, inked = data[:-1] == _SPACE, kinds[1:] < WHITE
        alone = np.flatnonzero((kinds[:-1] == WHITE) & inked & ~space)
        joins = space & inked  # spaces that belong to what follows
        np.copyto(kinds[:-1], kinds[1:].copy(), where=joins)
        start = kinds == CLOSED
        start[0] = True
        start[1:] |= kinds[1:] != kinds[:-1]
        start[:-1] |= joins
        for _ in range(3):  # back to the first byte of the white character
            alone = alone - ((data[alone] & 0xC0) == 0x80)
        start[alone] = True

        at = np.flatnonzero(data == _APOSTROPHE)
        at = at[(kinds[at - 1] != OTHER) & (data[at - 1] != _SPACE)]  # before the first byte comes the last one, a CLOSE
        first, second = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
        size = np.where(np.isin(first, list(b"stmd")), 2, 0)
        for a, b in (b"re", b"ve", b"ll"):
            size[(first == a) & (second == b)] = 3
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        start[at + size] = True
        return np.flatnonzero(start)
