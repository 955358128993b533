"""Encoding texts word by word, each distinct word once.

A sentencepiece model without pieces across a word's start never joins what stands before a space (after something other than white space)
with what follows it. So a text falls into units at those spaces, and a unit's ids are looked up in a cache of
bounded size, which every text of a task shares.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space between two characters that no tokenizer counts as white space.
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class UnitCache:
    """``encode(units) -> list of bytes``; a unit is a word with the space before it, or the first word of a text.

    When the cache is full it becomes the old one, from which words still in use move to the new.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 100_000):
        self.encode, self.limit = encode, limit
        self.inner: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Fills the cache for words that stand after a space."""
        inner, old = self.inner, self.old
        if old:
            rest = []
            for w in words:
                got = old.get(w)
                if got is None:
                    rest.append(w)
                else:
                    inner[w] = got
            words = rest
        inner.update(zip(words, self.encode([" " + w for w in words])))

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if len(self.inner) > self.limit:
            self.old, self.inner = self.inner, {}
        inner = self.inner
        split = []
        new: dict[str, None] = {}
        edges: dict[str, None] = {}
        for t in texts:
            parts = t.split(" ")
            middle = parts[1:-1]
            for w in middle:
                if w not in inner and w not in new:
                    if not w or w[0].isspace() or w[-1].isspace():
                        parts = SAFE_SPACE.split(t)
                        middle = parts[1:-1]
                        for v in middle:
                            if v not in inner:
                                new[v] = None
                        break
                    new[w] = None
            else:
                # the ends may hold white space on one side; what faces the middle must not
                if len(parts) > 1 and (parts[0][-1:].isspace() or parts[-1][:1].isspace() or (len(parts) == 2 and not parts[1])
                                       or (not parts[0] and parts[1][:1].isspace()) or (not parts[-1] and parts[-2][-1:].isspace())):
                    parts = SAFE_SPACE.split(t)
                    middle = parts[1:-1]
                    for v in middle:
                        if v not in inner:
                            new[v] = None
            edges[parts[0]] = None
            if len(parts) > 1:
                edges[" " + parts[-1]] = None
            split.append((parts, middle))
        self._learn(list(new))
        ends = list(edges)
        outer = dict(zip(ends, self.encode(ends)))
        out = []
        for parts, middle in split:
            got = [outer[parts[0]], *map(inner.__getitem__, middle)]
            if len(parts) > 1:
                got.append(outer[" " + parts[-1]])
            out.append(b"".join(got))
        return out
