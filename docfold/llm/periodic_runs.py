"""Operator 12: periodic runs of words, by matching aligned blocks inside each text.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(LEAST, REPEATS * q), which no neighbouring word extends. Periods are searched scale by scale:
the scale of block length L, a power of two, has the periods from L to 2 * L - 1 (the first one all
periods below 2 * L). A run of such a period holds a whole aligned block, one that starts at a
multiple of L, and its copy one period later. An Aho-Corasick automaton of the aligned blocks, keyed
by sequences of word numbers, finds all their occurrences; those at a distance of the scale are
seeds, which are compared word by word in both directions, so that every run's ends are exact.

Before a scale is searched, stretches that cannot hold its runs are passed over: in a run every
word after the first period was seen at most one period before. Blocks inside a run of a small
period d occur everywhere in it. Two occurrences in one such run give no run of a larger primitive
period, and occurrences in two of them only if the runs' starts or ends are that distance apart, so
that seeds stay about linear in the length of a text.

Texts never leave their task: there is no shuffle, and a text's tables are dropped with it.

Defined results: a null or blank text has no words and no run; a null id counts as the empty text
where a checksum of the id is taken; repeated rows and ids are rows of their own; an empty table
gives no rows; very long texts are searched whole, with automata of bounded stretches. Only the id
and the text are read, so that columns of any other name do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Words that a run has at least, and periods.
LEAST, REPEATS = 24, 3
#: Words of the shortest block.
BLOCK = 8
#: Words, about, whose blocks one automaton holds; more only where a block itself is long.
STRETCH = 1 << 15
#: Words that an extension compares at first; each further comparison has twice as many.
STEP = 64


class Run(NamedTuple):
    start: int
    length: int
    period: int

    @property
    def end(self) -> int:
        return self.start + self.length


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    memo = common.Memo()
    return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def last_seen(w: np.ndarray) -> np.ndarray:
    """How many words back each word was seen last; a large number where it is new."""
    order = np.argsort(w, kind="stable")
    back = np.full(len(w), np.iinfo(np.int64).max)
    same = np.flatnonzero(w[order][1:] == w[order][:-1])
    back[order[same + 1]] = order[same + 1] - order[same]
    return back


def regions(back: np.ndarray, size: int, shorter: list[Run]) -> list[tuple[int, int]]:
    """Stretches (start, end), apart from each other, that hold all runs of the scale of ``size``.

    ``shorter`` are runs with at most a third of ``size`` as their period d. A run of this scale
    shares less than its own period and d with one of them, hence only words near its ends.
    """
    reach = 2 * size - 1
    least = 2 * size if size > BLOCK else min(max(LEAST, REPEATS * q) - q for q in range(1, reach + 1))
    kept = np.zeros(len(back), bool)
    for a, b in _stretches(back <= reach):
        if b - a >= least:
            kept[max(0, a - reach) : b] = True
    inside = np.zeros(len(back) if shorter else 0, np.int64)
    for run in shorter:
        shared = reach + run.period
        kept[run.start + shared : max(0, run.end - shared)] = False
        np.maximum(inside[run.start : run.end], run.end, out=inside[run.start : run.end])
    return [(a, b) for a, b in _stretches(kept) if b - a >= max(LEAST, REPEATS * size if size > BLOCK else 0) and not (shorter and inside[a] >= b)]


def _stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def occurrences(w: np.ndarray, lo: int, hi: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(p, q) of all aligned blocks p in [lo, hi) that occur again at p + q, for the scale's q."""
    stretch = max(4 * size, STRETCH)
    for left in range(-(-lo // size) * size, hi - size, stretch):
        right = min(hi, left + stretch)  # aligned blocks that start before it
        searched = tuple(w[left : min(hi, right + 3 * size)].tolist())
        starts = range(0, min(right - left, len(searched) - size + 1), size)
        trie = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        first = np.full(len(starts), -1)
        for k, p in enumerate(starts):
            block = searched[p : p + size]
            known = trie.get(block, -1)
            if known < 0:
                trie.add_word(block, p)
            first[k] = p if known < 0 else known
        if not len(starts):
            continue
        trie.make_automaton()
        found = np.array([x for hit in trie.iter(searched) for x in hit], np.int64).reshape(-1, 2)
        at, block = found[:, 0] - size + 1, found[:, 1]
        # Of a scale's distances each occurrence has one aligned block, in the first scale two.
        nearest = (at - size) // size if size > BLOCK else (at - 1) // size
        for back in (0,) if size > BLOCK else (0, 1):
            k = nearest - back
            some = (k >= 0) & (k < len(first))
            some[some] = first[k[some]] == block[some]
            p, q = k[some] * size, at[some] - k[some] * size
            inside = q < 2 * size
            yield p[inside] + left, q[inside]


def extended(w: np.ndarray, p: int, q: int, size: int) -> tuple[int, int]:
    """The longest stretch (start, end) around the block at ``p`` in which words q apart are equal."""
    n, step, right = len(w), STEP, p + size
    while right + q < n:
        stop = min(right + step, n - q)
        other = np.flatnonzero(w[right:stop] != w[right + q : stop + q])
        if len(other):
            right += int(other[0])
            break
        right, step = stop, 2 * step
    step, left = STEP, p
    while left > 0:
        stop = max(0, left - step)
        other = np.flatnonzero(w[stop:left] != w[stop + q : left + q])
        if len(other):
            left = stop + int(other[-1]) + 1
            break
        left, step = stop, 2 * step
    return left, right + q


def primitive(root: np.ndarray) -> bool:
    """Whether a period's words are not a shorter stretch several times over."""
    q = m = len(root)
    factor = 2
    while m > 1:
        if factor * factor > m:
            factor = m
        if m % factor == 0:
            d = q // factor
            if np.array_equal(root[d:], root[:-d]):
                return False
            while m % factor == 0:
                m //= factor
        factor += 1
    return True


class _Found:
    """The runs found so far, by period and start."""

    def __init__(self):
        self.runs: list[Run] = []
        self.by_period: dict[int, list[tuple[int, int]]] = {}

    def add(self, run: Run) -> None:
        self.runs.append(run)
        insort(self.by_period.setdefault(run.period, []), (run.start, run.end))

    def around(self, period: int, start: int, end: int) -> tuple[int, int] | None:
        """The run of a period that holds a stretch; runs of one period overlap in less than it."""
        own = self.by_period.get(period, [])
        k = bisect_right(own, (start, np.iinfo(np.int64).max)) - 1
        return own[k] if k >= 0 and own[k][1] >= end else None

    def covers(self, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each aligned block the smallest period, at most a third of ``size``, of a run that
        holds it whole, or 0, and that run's end."""
        period, end = np.zeros(n // size + 1, np.int64), np.zeros(n // size + 1, np.int64)
        for run in sorted(self.runs, key=lambda r: -r.period):
            if 3 * run.period <= size:
                part = slice(-(-run.start // size), max(0, run.end // size))
                period[part], end[part] = run.period, run.end
        return period, end


def runs_of(w: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers, by start and period."""
    n, found, size = len(w), _Found(), BLOCK
    if n < LEAST:
        return []
    back = last_seen(w)
    while REPEATS * size <= n or size == BLOCK:
        parts = regions(back, size, [r for r in found.runs if 3 * r.period <= size])
        if parts:
            period, end = found.covers(n, size)
            known: dict[int, int] = {}  # by period the end of the last stretch that was compared
            fresh: list[Run] = []
            for lo, hi in parts:
                seeds = [s for s in occurrences(w, lo, hi, size)]
                if not seeds:
                    continue
                p, q = np.concatenate([s[0] for s in seeds]), np.concatenate([s[1] for s in seeds])
                # An occurrence in the same run of a small period has that period as well.
                apart = (period[p // size] == 0) | (p + q + size > end[p // size])
                p, q = p[apart], q[apart]
                order = np.lexsort((p, q))
                for at, distance in zip(p[order].tolist(), q[order].tolist(), strict=True):
                    if at + size + distance <= known.get(distance, 0):
                        continue
                    d = int(period[at // size])
                    if d and not _matches(found, d, at, distance, size):
                        continue
                    start, stop = extended(w, at, distance, size)
                    known[distance] = stop
                    if stop - start >= max(LEAST, REPEATS * distance) and primitive(w[start : start + distance]):
                        fresh.append(Run(start, stop - start, distance))
            for run in sorted(set(fresh)):
                found.add(run)
        size *= 2
    return sorted(found.runs, key=lambda r: (r.start, r.period))


def _matches(found: _Found, d: int, p: int, q: int, size: int) -> bool:
    """Whether two runs of period ``d`` around a block and its copy have their starts or ends q apart."""
    one, other = found.around(d, p, p + size), found.around(d, p + q, p + q + size)
    return one is None or other is None or other[0] - one[0] == q or other[1] - one[1] == q


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of which one document in ten by a checksum of its id repeats a period up to its end."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the most periods, as exact fractions; ties by start, then period."""
    best: Run | None = None
    for r in runs:
        more = 1 if best is None else r.length * best.period - best.length * r.period
        if more > 0 or more == 0 and (r.start, r.period) < (best.start, best.period):
            best = r
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        change[r.start + r.period] += 1
        change[r.end] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_words, runs array<struct<start, length, period>>)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def made(doc_id, words: list[bytes]) -> tuple:
        return (len(words), [r._asdict() for r in runs_of(numbered(words))])

    types = [pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in Run._fields]))]
    fields = "n_words long, runs array<struct<start: long, length: long, period: long>>"
    return _mapped(docs, id_col, text_col, f"{id_col} {kind}, {fields}", [id_col, "n_words", "runs"], types, made)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the runs of each text after ``repeated_tail``, and of what is left without repeats."""
    kind = docs.schema[id_col].dataType.simpleString()

    def made(doc_id, words: list[bytes]) -> tuple:
        words = repeated_tail(words, doc_id)
        runs = runs_of(numbered(words))
        listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
        best = strongest(runs)
        head = (*best, 1000 * best.length // best.period) if best else (None,) * 4
        kept = b" ".join(collapsed(words, runs))
        return (len(runs), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())

    names = [id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    schema = f"{id_col} {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _mapped(docs, id_col, text_col, schema, names, [*[pa.int64()] * 5, *[pa.string()] * 2], made)


def _mapped(docs: DataFrame, id_col: str, text_col: str, schema: str, names: list[str], types: list, made) -> DataFrame:
    common.small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for batch in common.freed(batches):
            # On bytes, split() cuts at the six ASCII spaces alone.
            rows = [made(i, t.encode().split() if t else []) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(work, schema)
