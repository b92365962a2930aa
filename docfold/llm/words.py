"""Turning batches of texts into numbered words, each scored once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import Memo

#: Distinct words whose scores a worker keeps; beyond that it starts afresh.
KEPT_WORDS = 200_000


class ScoredWords:
    """Rows of ``score(words)`` for the white-space separated words of whole texts."""

    def __init__(self, score: Callable[[list[str]], np.ndarray], limit: int = KEPT_WORDS):
        self.score, self.limit = score, limit
        self.numbers, self.rows, self.used = Memo(), None, 0

    def look_up(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts in turn, length of each text in words).

        The numbers index ``rows`` until the next call.
        """
        if len(self.numbers) > self.limit:
            self.numbers, self.rows, self.used = Memo(), None, 0
        words = [t.split() if t else [] for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        number = self.numbers.__getitem__
        numbers = np.fromiter((n for ws in words for n in map(number, ws)), np.int64, int(lengths.sum()))
        if fresh := self.numbers.fresh:
            self.numbers.fresh = []
            self._add(self.score(fresh))
        return numbers, lengths

    def _add(self, new: np.ndarray) -> None:
        need = self.used + len(new)
        if self.rows is None or need > len(self.rows):
            grown = np.zeros((max(4096, 2 * need), *new.shape[1:]), new.dtype)
            if self.rows is not None:
                grown[: self.used] = self.rows[: self.used]
            self.rows = grown
        self.rows[self.used : need] = new
        self.used = need


def sum_by_text(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values``; an empty stretch gives 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]
