"""Token ids of whole texts for byte-level vocabularies, with a cache of pieces in each worker.

A text is cut at single spaces between two other characters. The splitting
pattern of the vocabulary has no match that crosses such a place, and the piece
after it begins with the space, so a piece's ids do not depend on its
neighbours. A piece is encoded when it is first met. The cache keeps the pieces
used last; its size bounds memory and changes nothing else.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from collections.abc import Callable

CACHE_PIECES = 250_000
LONGEST_KEPT = 64
_PLAIN_SPACE = re.compile(r"(?<=\S) (?=\S)")


def packed(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Uneven(Exception):
    """The text has white space next to a space."""


class PieceCache(dict):
    """Piece -> ids as little-endian unsigned 32-bit integers, for pieces that follow ``before`` ('' or a space).

    Two generations of at most ``CACHE_PIECES`` each: pieces used again move to the young one.
    """

    def __init__(self, encode: Callable[[str], list[int]], before: str):
        super().__init__()
        self.encode, self.before, self.old = encode, before, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.pop(piece, None)
        if ids is None:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                raise _Uneven
            ids = self.fresh(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= CACHE_PIECES:
                self.old = self.copy()
                self.clear()
            self[piece] = ids
        return ids

    def fresh(self, piece: str) -> bytes:
        return packed(self.encode(self.before + piece))


def text_encoder(encode: Callable[[str], list[int]], special: dict[str, int]) -> Callable[[str], bytes]:
    """text -> ids (bytes). Special strings inside a text become their ids, as the library does by default."""
    first, later = PieceCache(encode, ""), PieceCache(encode, " ")
    names = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def plain(text: str) -> bytes:
        if not text:
            return b""
        try:
            head, *rest = text.split(" ")
            return first[head] + b"".join(map(later.__getitem__, rest))
        except _Uneven:
            head, *rest = _PLAIN_SPACE.split(text)
            return first.fresh(head) + b"".join(map(later.fresh, rest))

    def run(text: str) -> bytes:
        if names is None or names.search(text) is None:
            return plain(text)
        out, at = [], 0
        for match in names.finditer(text):
            out += [plain(text[at : match.start()]), packed([special[match[0]]])]
            at = match.end()
        return b"".join([*out, plain(text[at:])])

    return run


def once_per_worker(key: tuple, make: Callable[[], object]) -> object:
    """An object made once in a Python worker and kept for its later tasks: vocabularies and their caches."""
    kept = sys.modules.setdefault("citespark_kept_objects", types.ModuleType("citespark_kept_objects")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
