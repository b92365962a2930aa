"""Splitting texts ahead of byte-pair merges, with one lookup for each distinct word.

``WORDS`` cuts a text into an optional space with a run of non-space characters, or a run
of white space. A match of the tokenizers' own pattern never crosses such a cut, because
that pattern treats white space in the same way and joins at most one leading space to
what follows. A word's merges are therefore a function of the word alone, and the result of
each distinct word can be kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: The white space of Unicode, as the tokenizers' patterns understand it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: Distinct words that a worker keeps in each of its two generations.
KEPT_WORDS = 300_000


class WordTable:
    """Looks up what ``encode`` gives for each word of a text.

    Results are kept in two generations: when the younger is full it becomes the elder, and
    words that are met again move back, so that memory is bounded and frequent words stay.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = KEPT_WORDS):
        self.encode, self.limit, self.known, self.elder = encode, limit, {}, {}

    def look_up(self, texts: list[str | None]) -> list[list]:
        """For each text what its words encode to, in order; a null text has no words."""
        if len(self.known) > self.limit:
            self.known, self.elder = {}, self.known
        known, cut, found = self.known.get, [], []
        new: set[str] = set()
        for text in texts:
            words = WORDS.findall(text) if text else []
            values = list(map(known, words))
            gaps = [i for i, v in enumerate(values) if v is None] if None in values else []
            new.update(words[i] for i in gaps)
            cut.append([(i, words[i]) for i in gaps])
            found.append(values)
        self._learn(new)
        for values, gaps in zip(found, cut, strict=True):
            for i, word in gaps:
                values[i] = self.known[word]
        return found

    def _learn(self, words: set[str]) -> None:
        back = {w: self.elder[w] for w in words if w in self.elder}
        self.known.update(back)
        new = [w for w in words if w not in back]
        self.known.update(zip(new, self.encode(new), strict=True))
