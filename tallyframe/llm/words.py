"""What tokenizers make of the parts of texts, remembered: parts recur, so a library call for each new one is enough."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import chain, filterfalse

#: Parts that are remembered at once, and their characters.
ENTRIES, CHARS = 500_000, 16_000_000

#: A space between two characters that no definition of white space has: no token of a byte-level BPE or of word pieces covers the place before it and the space.
_EDGE = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_DOUBTFUL = re.compile(r"(?:^|[^!-~\w]) | (?:$|[^!-~\w])")


def parts(text: str) -> list[str]:
    """``text`` cut at its spaces, but at none beside white space, a mark or an end: those stay inside a part. Joined by spaces the parts are the text."""
    return _EDGE.split(text) if _DOUBTFUL.search(text) else text.split(" ")


class Memo(dict):
    """Part to what ``make`` returns for it; ``make`` takes a list of new parts and returns a list."""

    def __init__(self, make: Callable[[list[str]], Iterable], entries: int = ENTRIES):
        super().__init__()
        self.make, self.entries, self.chars = make, entries, 0

    def learn(self, split: list[list[str]]) -> None:
        """Everything that these texts' parts need is there afterwards; what was there before may go, when the memo is full."""
        wanted = set(chain.from_iterable(split))
        new = list(filterfalse(self.__contains__, wanted))
        if len(self) + len(new) > self.entries or self.chars > CHARS:
            self.clear()
            self.chars, new = 0, list(wanted)
        self.chars += sum(map(len, new))
        self.update(zip(new, self.make(new), strict=True))

    def all(self, parts: list[str]) -> list:
        """What there is for each of these parts, after new ones were made."""
        out = list(map(self.get, parts))
        places = [i for i, x in enumerate(out) if x is None]
        if places:
            new = list({parts[i] for i in places})
            made = dict(zip(new, self.make(new), strict=True))
            for i in places:
                out[i] = made[parts[i]]
            if len(self) + len(made) > self.entries or self.chars > CHARS:
                self.clear()
                self.chars = 0
            self.chars += sum(map(len, made))
            self.update(made)
        return out
