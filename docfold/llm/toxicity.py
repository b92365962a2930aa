"""Operator 1: toxic spans and document scores from a linear-chain conditional random field.

The field has two labels, clean (0) and toxic (1). A token's emission is the sum of hashed
features of its letters: the word, its beginnings and its ends. Document labels become token
labels first: in a toxic document a token is toxic if its word, or a beginning of it, occurs
almost only in toxic documents of the sample. The field is then fitted to these labelled
tokens by gradient steps on its conditional likelihood, and tags tokens by forward-backward
marginals. A document's score is a logistic function of its highest marginal and of how
many tokens it expects to be toxic, fitted to the sample's document labels.

Spark counts the evidence for words and their beginnings, tasks label the tokens and score
what calibrates, and one task takes the gradient steps over the bounded stretches; the driver
holds hashes of ids, sketches of eight numbers a sampled text, and the weights.

The sample is bounded: at most TOXIC_DOCS toxic and CLEAN_DOCS clean labelled documents, about
SAMPLE_CHARS characters, of which each label gets its part, and for the gradient about
CLEAN_TOKENS tokens of the clean documents beside those that look toxic; all four are parameters
of ``fit``. Documents and stretches are chosen by hashes, whatever the order of the rows; a
document that does not fit in its label's part is passed over. One document in CALIBRATION is
kept from the fit and calibrates. Every text is scored whole.

Defined results: a null or empty text, and one without letters, gets the score of a text
without any toxic token, and no spans; without any toxic label in the sample every score is
0; labels of null ids count for nothing, and an id with both labels is a document of each; repeated
rows each get a result; an empty table gives no rows; other columns are kept and not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import ScoredWords

TOXIC_DOCS, CLEAN_DOCS, SAMPLE_CHARS = 1500, 2500, 24_000_000
#: Hashed features, so many that other words seldom meet a toxic one's, and the lengths of the
#: beginnings and ends that are features.
BUCKETS, BEGINNINGS, ENDS = 1 << 22, (4, 5, 6), (3, 4)
#: A word or beginning is toxic if the share of toxic documents that have it is PURITY of both
#: shares, and chance would not make that of any of the words: the log-likelihood ratio must
#: exceed the logarithm of their number by MARGIN.
PURITY, MARGIN = 0.8, 1.0
#: Hashes by which copies of a text are known, and how many of them copies share.
SKETCH, COPY = 8, 3
#: Tokens beside a toxic one that are fitted to, tokens of a stretch of a clean document, and
#: tokens of all such stretches together, about.
AROUND, STRETCH, CLEAN_TOKENS = 12, 120, 300_000
#: Of the sampled texts of a label, one in so many calibrates.
CALIBRATION = 5
STEPS, RATE, RIDGE = 40, 0.25, 1e-4
#: A token with at least this marginal is part of a span.
SPAN = 0.5
#: Tokens that one block of the forward-backward pass covers.
BLOCK = 256

TOKEN = re.compile(r"\S+")


def plain(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word.lower()))


def parts(letters: str) -> list[str]:
    """Names of a word's features; the first is the word itself."""
    n = len(letters)
    return [f"w{letters}", *(f"b{letters[:k]}" for k in BEGINNINGS if n >= k), *(f"e{letters[-k:]}" for k in ENDS if n >= k)]


@dataclass
class Field:
    """Weights of the field's emissions for label 1 against label 0, and of its steps."""

    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # those with a weight
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -4.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # scores from one label to the next
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    #: Constant, slope of the highest marginal's log-odds, slope of log expected tokens.
    calibration: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0]))
    silent: bool = False  # nothing to learn from

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        """A function that gives the emission of each of some words."""
        dense = np.zeros(BUCKETS, np.float32)
        dense[self.buckets] = self.weights

        def scores(words: list[str]) -> np.ndarray:
            buckets, owners = hashed_parts(map(plain, words))
            return np.bincount(owners, dense[buckets], len(words)) + self.bias if len(owners) else np.full(len(words), self.bias)

        return scores

    def summaries(self, words: ScoredWords, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of the tokens of all texts, numbers of tokens, and ``summary`` by text."""
        numbers, lengths = words.look_up(texts)
        e = words.rows[numbers] if len(numbers) else np.zeros(0)
        p = marginals(e, lengths, self.steps, self.start)[0]
        return p, lengths, summary(p, lengths)

    def document_scores(self, summaries: np.ndarray) -> np.ndarray:
        if self.silent:
            return np.zeros(len(summaries))
        return 1 / (1 + np.exp(-np.clip(summaries @ self.calibration, -30, 30)))


def hashed_parts(letters: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of its word) of all features of some words."""
    buckets, owners = [], []
    for i, w in enumerate(letters):
        for p in parts(w) if w else ():
            buckets.append(zlib.crc32(p.encode()) % BUCKETS)
            owners.append(i)
    return np.array(buckets, np.int64), np.array(owners, np.int64)


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """By document: 1, log-odds of the highest marginal, log of 1 + expected toxic tokens."""
    ends = np.cumsum(lengths)
    highest, expected = np.full(len(lengths), 1e-6), np.zeros(len(lengths))
    some = np.flatnonzero(lengths)
    if len(some):
        highest[some] = np.maximum(1e-6, np.maximum.reduceat(p, (ends - lengths)[some]))
        expected[some] = np.add.reduceat(np.where(p >= 0.05, p, 0.0), (ends - lengths)[some])
    highest = np.minimum(highest, 1 - 1e-6)
    return np.stack([np.ones(len(lengths)), np.log(highest / (1 - highest)), np.log1p(expected)], 1)


def marginals(emissions: np.ndarray, lengths: np.ndarray, steps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of each token, and the expected number of each step between labels.

    All texts lie behind one another. A text's first token has the start's weights whatever
    precedes it, so texts don't touch. The pass runs over blocks side by side: first the
    product of each block's step matrices, then the messages at the blocks' borders, then
    inside all blocks at once; its steps in Python are thus few for any number of tokens.
    """
    n = len(emissions)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    first = np.zeros(n, bool)
    ends = np.cumsum(lengths)
    first[(ends - lengths)[lengths > 0]] = True
    blocks = -(-n // BLOCK)
    odds = np.ones(blocks * BLOCK)
    odds[:n] = np.exp(np.clip(emissions, -30, 30))
    lead = np.ones(blocks * BLOCK, bool)  # what pads the end starts texts of its own
    lead[:n] = first
    # One row a token of the blocks: m01 is the weight of the step from label 0 to label 1, and so on.
    odds, lead = (np.ascontiguousarray(x.reshape(blocks, BLOCK).T) for x in (odds, lead))
    step, begin = np.exp(steps), np.exp(start)
    m00, m10 = np.where(lead, begin[0], step[0, 0]), np.where(lead, begin[0], step[1, 0])
    m01, m11 = np.where(lead, begin[1], step[0, 1]) * odds, np.where(lead, begin[1], step[1, 1]) * odds

    a, b, c, d = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(BLOCK):
        a, b, c, d = a * m00[t] + b * m10[t], a * m01[t] + b * m11[t], c * m00[t] + d * m10[t], c * m01[t] + d * m11[t]
        if t % 4 == 3:  # four steps stay within the range of floats
            total = a + b + c + d
            a, b, c, d = a / total, b / total, c / total, d / total
    # Messages are ratios of label 1 to label 0, bounded because exponents are.
    whole = list(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True))
    enter, leave = np.ones(blocks), np.ones(blocks)
    for k in range(1, blocks):
        w, r = whole[k - 1], float(enter[k - 1])
        enter[k] = (w[1] + r * w[3]) / (w[0] + r * w[2])
    for k in range(blocks - 2, -1, -1):
        w, q = whole[k + 1], float(leave[k + 1])
        leave[k] = (w[2] + w[3] * q) / (w[0] + w[1] * q)

    ahead, behind = np.empty((BLOCK, blocks)), np.empty((BLOCK, blocks))
    r = enter
    for t in range(BLOCK):
        r = (m01[t] + r * m11[t]) / (m00[t] + r * m10[t])
        ahead[t] = r
    q = leave
    for t in range(BLOCK - 1, -1, -1):
        behind[t] = q
        q = (m10[t] + m11[t] * q) / (m00[t] + m01[t] * q)

    def flat(x: np.ndarray) -> np.ndarray:
        return x.T.reshape(-1)[:n]

    r, q = flat(ahead), flat(behind)
    p = r * q / (1 + r * q)
    inner = ~first[1:]
    before, after = r[:-1][inner], q[1:][inner]
    x00, x01, x10, x11 = (flat(m)[1:][inner] for m in (m00, m01, m10, m11))
    pair = np.stack([x00, x01 * after, before * x10, before * x11 * after])
    return p, (pair / pair.sum(0)).sum(1).reshape(2, 2)


def sketch_of(words: list[str]) -> list[int]:
    """The SKETCH smallest hashes of a text's shingles of three words."""
    return sorted({zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))})[:SKETCH]


def firsts(sketches: list[list[int]]) -> list[bool]:
    """Whether each text is the first of its copies: a later text that shares COPY of its SKETCH
    smallest shingle hashes with an earlier one is a copy."""
    holders: dict[int, list[int]] = {}
    out = []
    for number, own in enumerate(sketches):
        shared = Counter(h for x in own for h in holders.get(x, ()))
        out.append(max(shared.values(), default=0) < min(COPY, len(own)))
        if out[-1]:
            for x in own:
                holders.setdefault(x, []).append(number)
    return out


def tokenized(texts: DataFrame) -> DataFrame:
    """(label, h, held, sketch, words) of sampled texts; words are in lower case, letters alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for batch in common.freed(batches):
            words = [[plain(w) for w in t.split()] for t in batch.column(3).to_pylist()]
            columns = [*(batch.column(k) for k in range(3)), pa.array(map(sketch_of, words), pa.list_(pa.int64())), pa.array(words, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "h", "held", "sketch", "words"])

    return texts.select("label", "h", "held", "text").mapInArrow(work, "label int, h long, held boolean, sketch array<long>, words array<string>")


def strong_parts(told: DataFrame) -> list[str]:
    """The words and beginnings that occur almost only in toxic documents (rows of ``tokenized``)."""
    thin = sorted((r["h"], r["label"], r["sketch"]) for r in told.select("h", "label", "sketch").collect())
    new = [(h, label) for (h, label, _), is_first in zip(thin, firsts([s for _, _, s in thin]), strict=True) if is_first]
    n = [max(1, sum(label == y for _, label in new)) for y in (0, 1)]
    wanted = F.broadcast(told.sparkSession.createDataFrame(new, "h long, label int"))
    distinct = F.filter(F.array_distinct("words"), lambda w: w != "")
    names = F.transform(distinct, lambda w: F.array(F.concat(F.lit("w"), w), *[F.when(F.char_length(w) >= k, F.concat(F.lit("b"), F.left(w, F.lit(k)))) for k in BEGINNINGS]))
    seen = told.join(wanted, ["h", "label"]).select("label", F.explode(F.array_distinct(F.flatten(names))).alias("part")).where("part is not null")
    bad, good = F.col("bad"), F.col("good")
    counts = seen.groupBy("part").agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good")).where("bad > 0")
    counts = common.checkpoint(counts)
    gain = sum((F.when(k > 0, k * F.log(k * sum(n) / ((bad + good) * F.lit(of)))).otherwise(0.0) for k, of in ((good, n[0]), (bad, n[1]))), F.lit(0.0))
    pure = bad / n[1] >= PURITY * (bad / n[1] + good / n[0])
    # Each has so much evidence that the sample has room for few of them.
    return [r["part"] for r in counts.where(pure & (gain >= MARGIN + math.log(max(1, counts.count())))).select("part").collect()]


def stretches_to_fit(told: DataFrame, strong: list[str], clean_tokens: int) -> DataFrame:
    """(h, at, words, marks): the neighbourhoods of toxic tokens and of tokens in clean texts that
    look like them, and stretches of clean texts that a hash of text and place chooses."""
    known = frozenset(strong)
    total = told.where("label = 0").agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    share = clean_tokens / max(1, total)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for batch in common.freed(batches):
            rows: list[tuple] = []
            for y, h, ws in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                like = [int(bool(w) and not known.isdisjoint(parts(w))) for w in ws]
                marks = like if y else [0] * len(ws)
                ranges = stretches([i for i, m in enumerate(like) if m], len(ws))
                if not y:
                    chosen = (a for a in range(0, len(ws), STRETCH) if zlib.crc32(f"{h}:{a}".encode()) < share * (1 << 32))
                    ranges += [(a, min(len(ws), a + STRETCH)) for a in chosen]
                rows += [(h, i, ws[a:b], marks[a:b]) for i, (a, b) in enumerate(ranges)]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int8()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h", "at", "words", "marks"])

    return told.select("label", "h", "words").mapInArrow(work, "h long, at long, words array<string>, marks array<tinyint>")


def stretches(hits: list[int], n: int) -> list[tuple[int, int]]:
    """Ranges of AROUND tokens to either side of the hits, joined where they meet."""
    out: list[tuple[int, int]] = []
    for i in hits:
        a, b = max(0, i - AROUND), min(n, i + AROUND + 1)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def gradient_steps(rows: pa.Table) -> Field:
    """Fit emissions, steps and start to labelled stretches (rows of ``stretches_to_fit``)."""
    rows = rows.sort_by([("h", "ascending"), ("at", "ascending")])
    out = Field()
    lengths = np.diff(rows["words"].combine_chunks().offsets.to_numpy()) if len(rows) else np.zeros(0, int)
    labels = rows["marks"].combine_chunks().flatten().to_numpy().astype(float) if len(rows) else np.zeros(0)
    if not labels.sum():
        out.silent = True
        return out
    coded = rows["words"].combine_chunks().flatten().dictionary_encode()
    tokens, size = coded.indices.to_numpy(), len(coded.dictionary)
    buckets, owners = hashed_parts(coded.dictionary.to_pylist())
    first = np.zeros(len(labels), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    y = labels.astype(int)
    told = np.zeros((2, 2))
    np.add.at(told, (y[:-1][~first[1:]], y[1:][~first[1:]]), 1)
    n = len(labels)
    used, place = np.unique(buckets, return_inverse=True)
    weights, squares = np.zeros(len(used)), np.full(len(used), 1e-8)
    small = np.full(7, 1e-8)
    for _ in range(STEPS):
        by_word = np.bincount(owners, weights[place], size) + out.bias
        p, pair = marginals(by_word[tokens], lengths, out.steps, out.start)
        off = labels - p
        by_word = np.bincount(tokens, off, size)
        slope = np.bincount(place, by_word[owners], len(used)) - RIDGE * n * 0.01 * weights
        squares += slope**2
        weights += RATE * 2 * slope / np.sqrt(squares)
        start = np.array([-off[first].sum(), off[first].sum()]) / 2
        rest = np.concatenate([[off.sum()], (told - pair).ravel(), start])
        small += rest**2
        rest = RATE * rest / np.sqrt(small)
        out.bias += rest[0]
        out.steps = out.steps + rest[1:5].reshape(2, 2)
        out.start = out.start + rest[5:]
    out.buckets, out.weights = used, weights.astype(np.float32)
    return out


def fitted(sequences: DataFrame) -> Field:
    """``gradient_steps`` in one task, whose rows the sample's bounds limit."""

    def work(rows: pa.Table) -> pa.Table:
        common.alone()
        f = gradient_steps(rows)
        rest = [f.bias, *f.steps.ravel().tolist(), *f.start.tolist()]
        return pa.table({"silent": [f.silent], "buckets": [f.buckets.tobytes()], "weights": [f.weights.tobytes()], "rest": pa.array([rest], pa.list_(pa.float64()))})

    found = sequences.groupBy().applyInArrow(work, "silent boolean, buckets binary, weights binary, rest array<double>").first()
    if found is None or found["silent"]:
        return Field(silent=True)
    rest = np.array(found["rest"])
    return Field(np.frombuffer(found["buckets"], np.int64), np.frombuffer(found["weights"], np.float32), rest[0], rest[1:5].reshape(2, 2), rest[5:])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a ridge; both labels weigh as they occur."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (y - p) - 1e-1 * w)
    return w


def sample(
    docs: DataFrame, labels: DataFrame, learn: Column | None, id_col: str, text_col: str, label_col: str, toxic_docs: int, clean_docs: int, max_chars: int
) -> DataFrame | None:
    """(label, h, text, held) of a bounded number of labelled documents; see ``fit``. None without a toxic label."""
    known = labels.select(labels[id_col].alias("i"), labels[label_col].cast("int").alias("label"), (F.lit(True) if learn is None else learn).alias("w"))
    known = known.where(F.col("w") & F.col("i").isNotNull() & F.col("label").isin(0, 1)).select("i", "label")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.approx_count_distinct("i").alias("n")).collect()}
    if not counts.get(1):
        return None
    bounds = {1: toxic_docs, 0: clean_docs}
    chosen = F.lit(False)
    for y, bound in bounds.items():
        chosen = chosen | ((F.col("label") == y) & common.hashed_share(F.col("i"), common.share_for(bound, counts.get(y, 1))))
    # The share is of distinct ids, about twice the bounds, so it is safe to broadcast.
    few = F.broadcast(known.where(chosen).distinct())
    own = docs.select(docs[id_col].alias("i"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(few, "i")
    rows = common.checkpoint(own.select("label", F.xxhash64("i", "text").alias("h"), "text"))
    picked = common.pick(rows, bounds, max_chars)
    return common.picked_rows(rows, picked, CALIBRATION) if picked else None


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    toxic_docs: int = TOXIC_DOCS,
    clean_docs: int = CLEAN_DOCS,
    max_chars: int = SAMPLE_CHARS,
    clean_tokens: int = CLEAN_TOKENS,
) -> Field:
    """Fit on at most so many labelled documents and about ``max_chars`` characters.

    The two labels share the characters as ``common.within`` says; ``clean_tokens`` bounds, about,
    the tokens of chosen stretches of clean documents. ``learn`` is a condition on ``labels``' rows.
    """
    common.small_batches(docs.sparkSession)
    texts = sample(docs, labels, learn, id_col, text_col, label_col, toxic_docs, clean_docs, max_chars)
    if texts is None:
        return Field(silent=True)
    told = common.checkpoint(tokenized(texts.where("not held")))
    out = fitted(stretches_to_fit(told, strong_parts(told), clean_tokens))
    if not out.silent:
        shared = common.Shared(docs.sparkSession, out)
        both = [y for y, in texts.where("held").select("label").distinct().collect()]
        apart = texts.where("held") if len(both) == 2 else texts  # too few texts to hold some of each label out
        rows = [(r["s"], r["label"]) for r in apart.select("label", _summary_column(apart["text"], shared).alias("s")).collect()]
        shared.destroy()
        out.calibration = logistic(np.array([s for s, _ in rows]), np.array([y for _, y in rows], float))
    return out


def _scored_words(shared: common.Shared) -> ScoredWords:
    return common.lasting("toxicity", shared.id, lambda: ScoredWords(shared.value.scorer()))


def _summary_column(text: Column, shared: common.Shared) -> Column:
    @F.arrow_udf("array<double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _scored_words(shared)
        for batch in common.freed(batches):
            yield pa.array(list(shared.value.summaries(words, batch.to_pylist())[2]), pa.list_(pa.float64()))

    return measure(text)


def score(docs: DataFrame, field: Field, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``out_col``: score, and spans of first and last character (the
    latter exclusive) with their highest marginal. ``docs`` must not have a column of that name."""
    common.refuse_taken(docs, out_col)
    common.small_batches(docs.sparkSession)
    shared = common.Shared(docs.sparkSession, field)  # as bounded as the sample

    @F.arrow_udf("score double, spans array<struct<start:int,end:int,marginal:double>>")
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f, words = shared.value, _scored_words(shared)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in common.freed(batches):
            texts = batch.to_pylist()
            p, lengths, summaries = f.summaries(words, texts)
            scores = f.document_scores(summaries)
            spans = [[] for _ in texts]
            ends = np.cumsum(lengths)
            flagged = np.flatnonzero(p >= SPAN) if not f.silent else np.zeros(0, int)
            for d in np.unique(np.searchsorted(ends, flagged, side="right")):
                spans[d] = spans_of(texts[d], p[ends[d] - lengths[d] : ends[d]])
            yield pa.StructArray.from_arrays([pa.array(scores), pa.array(spans, kind)], ["score", "spans"])

    return docs.withColumn(out_col, tag(docs[text_col]))


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Runs of neighbouring tokens with a marginal of SPAN or more."""
    out: list[dict] = []
    last = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if p[i] >= SPAN:
            if last == i - 1:
                out[-1] = {"start": out[-1]["start"], "end": m.end(), "marginal": max(out[-1]["marginal"], float(p[i]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "marginal": float(p[i])})
            last = i
    return out
