"""Operator 9: language identification by interpolated Kneser-Ney character models.

Each language has a character model of order ORDER over words with their borders, smoothed
by interpolated Kneser-Ney. N-grams are 64-bit hashes in sorted arrays, one array an order for
PART languages at a time, so that memory follows the sample and not the number of languages. A
text takes the language of the lowest cross-entropy per
character. Calibration texts, held out of the counts, set the temperature that turns entropy
differences into a probability, and the entropy beyond which a text is rejected; a language with
too few texts to hold any out has the largest limit of the others.

Spark counts the sampled texts' words by language, one task a language smooths the model, and
tasks score what calibrates: the driver holds hashes of ids, the sorted arrays, and entropies.

The models are fitted on a bounded sample: at most ``per_language`` labelled texts of each
language and about ``max_chars`` characters of all languages, of which each gets its part;
they are chosen by a hash of id and text, whatever the order of the rows. Every label is
learned, from one text at least. Every text is scored whole, long ones in stretches.

Defined results: a null text or one without any letter is ``und``, with score 0, and counts
as rejected. If nothing is labelled all texts are ``und``, but none with a letter is rejected, as
no model speaks against it. Equal entropies go to the language that sorts first. Repeated rows
each get a result; an empty table gives none. Other columns are kept and not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import KEPT_WORDS, ScoredWords, sum_by_text

ORDER = 4
#: Labelled texts of each language in the sample at most, and characters of all of them, about.
PER_LANGUAGE, SAMPLE_CHARS = 1000, 24_000_000
#: Scores that are worked out at once, and characters of a text that are looked up at once.
CELLS, STRETCH = 8_000_000, 1 << 20
#: Languages whose values stand side by side in one table.
PART = 8
#: Of the sampled texts of a language, one in so many calibrates.
CALIBRATION = 5
UNKNOWN = "und"
#: Probability of a character that no training text has.
FLOOR = 1e-6
#: A text is rejected beyond the calibration texts' highest entropy by this many nats a character.
MARGIN = 1.0

SPACE = re.compile(r"\s+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters_of(word: str) -> str:
    """The word in lower case without what is not a letter; borders are added later."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word.lower()))


def grams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the 1- to ``order``-grams that end at each character after a word's start.

    Returns them by order, the number of each one's word, and how many characters of its
    word precede it. Shorter histories at the start of a word repeat the border.
    """
    joined = "".join("\x02" * (order - 1) + w + "\x03" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + order
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths - (order - 1))
    at = np.arange(len(points))
    keep = at - np.repeat(starts, lengths) >= order - 1
    at = at[keep]
    hashed, total = [], np.zeros(len(at), np.uint64)
    for back in range(order):
        # From the last character backwards, so that a longer gram extends a shorter one's hash.
        total = (total + points[at - back] + np.uint64(back + 1)) * MULTIPLIER
        total ^= total >> np.uint64(29)
        hashed.append(total.copy())
    return hashed, owner, at - starts[owner]


def contexts(words: list[str], order: int) -> list[np.ndarray]:
    """Hashes of the histories before each character, of 1 to ``order`` - 1 characters."""
    joined = "".join("\x02" * (order - 1) + w + "\x03" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + order
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.arange(len(points))
    at = at[at - starts >= order - 1]
    hashed, total = [], np.zeros(len(at), np.uint64)
    for back in range(1, order):
        total = (total + points[at - back] + np.uint64(back + 1)) * MULTIPLIER
        total ^= total >> np.uint64(29)
        hashed.append(total.copy())
    return hashed


@dataclass
class Table:
    """Sorted keys with a row of values each, one for every language of a part; others have ``absent``."""

    keys: np.ndarray
    values: np.ndarray
    absent: float

    def rows(self, wanted: np.ndarray) -> np.ndarray:
        at, found = lookup(self.keys, wanted)
        return np.where(found[:, None], self.values[at], self.absent)


@dataclass
class Part:
    """Up to PART languages: by order the n-grams with their smoothed probabilities, and by order
    the histories with their back-off weights."""

    probabilities: list[Table]
    weights: list[Table]

    def nats(self, hashed: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        p = FLOOR
        for k in range(ORDER):
            if k:
                p = p * self.weights[k - 1].rows(before[k - 1])
            p = p + self.probabilities[k].rows(hashed[k])
        return -np.log(p)


@dataclass
class Models:
    """The languages in their order, and their tables part by part."""

    languages: list[str]
    parts: list[Part]
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """For each word its nats in every language, and the number of its letters."""
        plain = [letters_of(w) for w in words]
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        out[:, -1] = lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        some = np.flatnonzero(lengths)
        if self.languages and len(some):
            group = np.cumsum((lengths[some] + ORDER) * PART) // CELLS
            for own in np.split(some, np.flatnonzero(np.diff(group)) + 1):
                out[own, :-1] = self._nats([plain[i] for i in own])
        return out

    def _nats(self, words: list[str]) -> np.ndarray:
        hashed, owner, _ = grams(words, ORDER)
        before = contexts(words, ORDER)
        columns = [nats[:, j] for nats in (part.nats(hashed, before) for part in self.parts) for j in range(nats.shape[1])]
        return np.stack([np.bincount(owner, c, len(words)) for c in columns], 1)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _one_language(words: list[str], often: np.ndarray) -> tuple[list, list]:
    """By order: (n-gram hashes, discounted share) and (history hashes, back-off weight).

    The highest order uses counts, the lower ones the number of distinct characters that
    precede an n-gram, as Kneser-Ney does; the discount of an order is n1 / (n1 + 2 n2).
    """
    hashed, owner, _ = grams(words, ORDER)
    before = contexts(words, ORDER)
    shares, backs = [], []
    for k in range(ORDER):
        if k == ORDER - 1:
            keys, first, inverse = np.unique(hashed[k], return_index=True, return_inverse=True)
            counts = np.bincount(inverse, often[owner])
        else:
            _, longer = np.unique(hashed[k + 1], return_index=True)
            keys, at, counts = np.unique(hashed[k][longer], return_index=True, return_counts=True)
            first, counts = longer[at], counts.astype(float)
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        if k == 0:
            total = counts.sum()
            shares.append((keys, (counts - discount) / total))
            base = discount * len(keys) / total / max(1, len(keys))
            shares[0] = (keys, shares[0][1] + base)
            continue
        held, group = np.unique(before[k - 1][first], return_inverse=True)
        total = np.bincount(group, counts)
        kinds = np.bincount(group)
        shares.append((keys, (counts - discount) / total[group]))
        backs.append((held, discount * kinds / total))
    return shares, backs


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], absent: float) -> Table:
    """The (keys, values) of each language of a part as one table."""
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    values = np.full((len(keys), len(parts)), absent)
    for j, (k, v) in enumerate(parts):
        values[np.searchsorted(keys, k), j] = v
    return Table(keys, values, absent)


def word_counts(texts: Iterable[str]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for text in texts:
        for w in map(letters_of, text.split()):
            if w:
                counts[w] = counts.get(w, 0) + 1
    return counts


def assembled(parts: dict[str, tuple[list, list]]) -> Models:
    """Models of what ``_one_language`` gave for each language, not calibrated yet."""
    languages = sorted(parts)
    held = []
    for at in range(0, len(languages), PART):
        own = [parts[x] for x in languages[at : at + PART]]
        shares = [_merged([shares[k] for shares, _ in own], 0.0) for k in range(ORDER)]
        held.append(Part(shares, [_merged([backs[k] for _, backs in own], 1.0) for k in range(ORDER - 1)]))
    return Models(languages, held, limits=np.full(len(languages), np.inf))


def calibrate(models: Models, entropy: np.ndarray, truth: np.ndarray) -> None:
    """Set temperature and limits by the entropies (rows of languages) of texts of known language."""
    if not len(truth):
        return
    known = np.unique(truth)
    for j in known:
        models.limits[j] = entropy[truth == j, j].max() + MARGIN
    models.limits[np.isinf(models.limits)] = models.limits[known].max()
    sizes = np.array([0.5, 1, 2, 4, 8, 16, 32, 64])
    loss = [-np.log(_shares(entropy, s)[np.arange(len(truth)), truth] + 1e-9).mean() for s in sizes]
    models.temperature = float(sizes[int(np.argmin(loss))])


def fit_models(texts: list[tuple[str, str]]) -> Models:
    """Models of a few (text, language) pairs, without calibration; ``fit`` is for tables."""
    by_language: dict[str, list[str]] = {}
    for text, language in texts:
        by_language.setdefault(language, []).append(text)
    counts = {language: word_counts(own) for language, own in by_language.items()}
    return assembled({x: _one_language(list(c), np.array(list(c.values()), float)) for x, c in counts.items() if c})


def _stretches(text: str) -> Iterator[str]:
    """A text, or if it is long stretches of it that end at white space, so that no word is cut."""
    start = 0
    while len(text) - start > STRETCH:
        border = SPACE.search(text, start + STRETCH)
        if border is None:
            break
        yield text[start : border.start()]
        start = border.end()
    yield text[start:]


def _entropies(words: ScoredWords, texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nats a character (each word's end counts as one) in each of ``width`` languages, and letters, by text."""
    sums, ends = np.zeros((len(texts), width + 1)), np.zeros(len(texts))
    parts = [(i, part) for i, text in enumerate(texts) if text for part in _stretches(text)]
    # As many stretches at once as keep the scores of their words within bounds.
    group = np.cumsum([(len(part) // 4 + 1) * (width + 1) for _, part in parts]) // (2 * CELLS)
    for own in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(group)) + 1):
        numbers, lengths = words.look_up([parts[k][1] for k in own])
        if words.rows is None:
            continue
        rows, at = words.rows[numbers], [parts[k][0] for k in own]
        np.add.at(sums, at, sum_by_text(rows, lengths))
        np.add.at(ends, at, sum_by_text((rows[:, -1:] > 0).astype(float), lengths)[:, 0])
    return sums[:, :-1] / np.maximum(1, sums[:, -1] + ends)[:, None], sums[:, -1]


def _shares(entropy: np.ndarray, sharpness: float) -> np.ndarray:
    weight = np.exp(-sharpness * (entropy - entropy.min(1, keepdims=True)))
    return weight / weight.sum(1, keepdims=True)


def labelled(docs: DataFrame, learn: Column | None, text_col: str, lang_col: str, id_col: str) -> DataFrame:
    """(label, h, text) of the rows to learn from; h is a hash of id and text."""
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].alias("text"), docs[lang_col].alias("label"), (F.lit(True) if learn is None else learn).alias("w"))
    return rows.where("w and label is not null and text is not null").select("label", F.xxhash64("i", "text").alias("h"), "text")


def sample(docs: DataFrame, learn: Column | None, text_col: str, lang_col: str, id_col: str, per_language: int, max_chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """(label, h) of at most ``per_language`` labelled texts of each language; see ``fit``."""
    rows = labelled(docs, learn, text_col, lang_col, id_col)
    sizes = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not sizes:
        return []
    top = 1 << 30
    shares = [(row["label"], int(min(1.0, common.share_for(per_language, row["n"])) * top)) for row in sizes]
    wanted = F.broadcast(rows.sparkSession.createDataFrame(shares, f"label {rows.schema['label'].dataType.simpleString()}, below long"))
    chosen = rows.join(wanted, "label").where(F.pmod(F.xxhash64("h", F.lit(0)), F.lit(top)) < F.col("below")).drop("below")
    return common.pick(chosen, {row["label"]: per_language for row in sizes}, max_chars)


def counted(texts: DataFrame) -> DataFrame:
    """(label, word, n): how often the words of (label, text) occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for batch in common.freed(batches):
            own: dict[str, list[str]] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own.setdefault(label, []).append(text)
            for label, some in own.items():
                counts = word_counts(some)
                columns = [pa.array([label] * len(counts), pa.string()), pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["label", "word", "n"])

    rows = texts.select(F.col("label").cast("string"), "text").mapInArrow(count, "label string, word string, n long")
    return rows.groupBy("label", "word").agg(F.sum("n").alias("n"))


def smoothed(counts: DataFrame) -> dict[str, tuple[list, list]]:
    """By language what ``_one_language`` gives for the words of (label, word, n).

    A language is one task's; its distinct words are bounded by the sample.
    """

    def learn(words: pa.Table) -> pa.Table:
        common.alone()
        shares, backs = _one_language(words["word"].to_pylist(), words["n"].to_numpy().astype(float))
        rows = [(words["label"][0].as_py(), at, keys.tobytes(), values.tobytes()) for at, (keys, values) in enumerate(shares + backs)]
        return pa.table(dict(zip(("label", "at", "keys", "values"), map(list, zip(*rows, strict=True)), strict=True)))

    found: dict[str, list] = {}
    for r in counts.groupBy("label").applyInArrow(learn, "label string, at long, keys binary, values binary").collect():
        found.setdefault(r["label"], []).append((r["at"], np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["values"], float)))
    parts = {x: [(keys, values) for _, keys, values in sorted(own, key=lambda o: o[0])] for x, own in found.items()}
    return {x: (own[:ORDER], own[ORDER:]) for x, own in parts.items()}


def fit(
    docs: DataFrame,
    learn: Column | None = None,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    per_language: int = PER_LANGUAGE,
    max_chars: int = SAMPLE_CHARS,
) -> Models:
    """Models of the rows where ``learn`` holds and the language is not null.

    They learn from at most ``per_language`` texts of each language and about ``max_chars``
    characters of all, which the languages share as ``common.within`` says.
    """
    common.small_batches(docs.sparkSession)
    picked = sample(docs, learn, text_col, lang_col, id_col, per_language, max_chars)
    if not picked:
        return assembled({})
    texts = common.picked_rows(labelled(docs, learn, text_col, lang_col, id_col), picked, CALIBRATION)
    models = assembled(smoothed(counted(texts.where("not held"))))
    if models.languages:
        held = texts.where("held").withColumn("label", F.col("label").cast("string"))
        shared = common.Shared(docs.sparkSession, models)
        told = [(r["label"], r["e"]) for r in held.select("label", _entropy_column(held["text"], shared).alias("e")).collect()]
        shared.destroy()
        told = [(models.languages.index(label), e[:-1]) for label, e in told if e[-1] and label in models.languages]
        calibrate(models, np.array([e for _, e in told]), np.array([j for j, _ in told], int))
    return models


def _kept_words(shared: common.Shared) -> ScoredWords:
    """The worker's table of scored words; the more languages, the fewer words it keeps."""
    width = len(shared.value.languages)
    return common.lasting("language", shared.id, lambda: ScoredWords(shared.value.word_scores, max(4096, 16 * KEPT_WORDS // max(16, width))))


def _entropy_column(text: Column, shared: common.Shared) -> Column:
    """A text's entropies in the languages' order, and its number of letters."""

    @F.arrow_udf("array<double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, width = _kept_words(shared), len(shared.value.languages)
        for batch in common.freed(batches):
            entropy, letters = _entropies(words, batch.to_pylist(), width)
            yield pa.array(list(np.column_stack([entropy, letters])), pa.list_(pa.float64()))

    return measure(text)


def predict(docs: DataFrame, models: Models, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct ``out_col`` of lang_pred, score, entropy and rejected.

    ``docs`` must not have a column of that name.
    """
    common.refuse_taken(docs, out_col)
    common.small_batches(docs.sparkSession)
    shared = common.Shared(docs.sparkSession, models)  # bounded by the sample it was fitted on

    @F.arrow_udf("lang_pred string, score double, entropy double, rejected boolean")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        words = _kept_words(shared)
        for batch in common.freed(batches):
            entropy, letters = _entropies(words, batch.to_pylist(), len(m.languages))
            n = len(batch)
            if not m.languages:
                names, score, least, bad = [UNKNOWN] * n, np.zeros(n), np.zeros(n), letters == 0
            else:
                best = entropy.argmin(1)
                some = letters > 0
                least = np.where(some, entropy.min(1), 0.0)
                score = np.where(some, _shares(entropy, m.temperature)[np.arange(n), best], 0.0)
                names = [m.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                bad = ~some | (least > m.limits[best])
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(score), pa.array(least), pa.array(bad)],
                ["lang_pred", "score", "entropy", "rejected"],
            )

    return docs.withColumn(out_col, judge(docs[text_col]))
