"""Texts cut at single spaces, so that the ids of a word are found once and reused.

The pre-token pattern of the byte-level vocabularies never lets a pre-token run over a space that follows a
non-white character and is not followed by another space: the space begins the next pre-token. So a text may be
cut before each such space and the ids of the parts joined. Every other space stays inside its part.
"""

from __future__ import annotations

import re

CUT = re.compile(r"(?<!\s) (?! )")
ODD = re.compile(r"\s ")


def parts(text: str) -> list[str]:
    """Parts of a text; all but the first lost the space that begins them."""
    return CUT.split(text) if ODD.search(text) else text.split(" ")


class Memo(dict):
    """Ids of parts, computed when first asked for; at most ``limit`` parts are held.

    Parts are held in two halves. When the young half is full it becomes the old one and the old one is forgotten; a part that is
    asked for again moves to the young half, so words that come often are never computed anew.
    A comma or full stop after a letter at the end of a part is a pre-token of its own, so the ids of the part are those
    of the rest and of the mark.
    """

    def __init__(self, compute, limit: int = 800_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}
        self.marks = dict(zip(",.", compute([",", "."])))

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.asked(part)
        if len(self) >= self.limit // 2:
            self.old = dict(self)
            self.clear()
        self[part] = ids
        return ids

    def asked(self, part: str) -> bytes:
        if part[-1:] in self.marks and part[-2:-1].isalpha():
            return self[part[:-1]] + self.marks[part[-1]]
        return self.compute([" " + part])[0]

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = parts(text)
        head = self.compute([first])[0] if first else b""
        return head + b"".join(map(self.__getitem__, rest))
