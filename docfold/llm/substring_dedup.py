"""Operator 13: removal of passages that an earlier document has, by windows of doubling length.

A window is LENGTH consecutive words of one document. The search begins with short windows: of the
windows of the first level every full window has its least one by hash, so that documents which
share a full window share that short one. Only windows that some other document repeats go on to
twice the length, and only in the texts that have them, until the full length is reached or none
survives. At the full length the smallest id of each window decides which of its places go.

Documents with the same words are one node from the start: the smallest id of a node is judged, and
all windows of its copies repeat that one's. Windows are grouped by two 64-bit hashes of their
words; groupings sum up on the map side first, and where rows get their group's answer the at most
HOT groups that hold a HOT-th of all rows or more are broadcast, so that no key brings more than
that share of the rows to one task. Texts are read anew at each level and shuffled only where they
hold windows that survived.

Defined results: a null or blank text has no words; a text shorter than a window keeps all of
them; a null id sorts after all others and is no smaller than another null; rows that repeat an id
are not smaller than each other, whatever their texts; windows that a document repeats within itself
stay; an empty table gives no rows; long texts are taken whole. Only the id and the text are read, so
that columns of any other name do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a window; a first level has at least SHORTEST words.
LENGTH, SHORTEST = 50, 16
#: Groups of at least one HOT-th of all rows are hot; there are at most HOT of them.
HOT = 1024
#: Words whose hashes a worker keeps.
KEPT_WORDS = 200_000
#: Odd factors of the rolling hashes, and a third that mixes the words' own.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xD6E8FEB86659FD93)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def levels(length: int) -> list[int]:
    """Lengths of windows, each at most twice the one before, up to ``length``."""
    sizes = [length]
    while sizes[0] >= 2 * SHORTEST:
        sizes.insert(0, -(-sizes[0] // 2))
    return sizes


class Words:
    """Hashes of words, and of the windows of a text."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known = self.known
        known.update((w, xxhash.xxh64_intdigest(w)) for w in set(words).difference(known))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def _powers(self, factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n powers of a factor and of its inverse, modulo 2**64."""
        up, down = self.powers.get(factor, (np.empty(0, np.uint64),) * 2)
        if len(up) < n:
            most = max(4096, 2 * n)
            both = []
            for base in (factor, pow(factor, -1, 1 << 64)):
                steps = np.full(most, np.uint64(base))
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
            up, down = self.powers[factor] = both[0], both[1]
        return up[:n], down[:n]

    def windows(self, h: np.ndarray, size: int, factor: int) -> np.ndarray:
        """A hash of each window of ``size`` words, the same wherever the words are the same."""
        if len(h) < size:
            return np.empty(0, np.uint64)
        up, down = self._powers(factor, len(h))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
        rolled = (total[size:] - total[:-size]) * down[: len(h) - size + 1]
        return (rolled ^ (rolled >> np.uint64(32))) * MIX


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` consecutive values."""
    done = 1
    while 2 * done <= span:
        values, done = np.minimum(values[:-done], values[done:]), 2 * done
    return np.minimum(values[: len(values) - (span - done)], values[span - done :]) if span > done else values


def split(text: str | None) -> list[bytes]:
    # On bytes, split() cuts at the six ASCII spaces alone.
    return text.encode().split() if text else []


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col]
    return docs.select(docs[id_col].alias("id"), text.alias("text"), content_hash(text).alias("content"))


def _digests(docs: DataFrame, length: int) -> DataFrame:
    """(id, content, words, n_words, words_sha256, keys): ``words`` is a hash of all words in turn,
    ``keys`` has the distinct hashes of the first level's windows."""
    size = levels(length)[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        table = Words()
        for batch in common.freed(batches):
            counts, digests, shas, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = split(text)
                joined = b" ".join(words)
                counts.append(len(words))
                digests.append(hashlib.blake2b(joined, digest_size=16).digest())
                shas.append(hashlib.sha256(joined).hexdigest())
                keys.append(np.unique(_chosen(table, table.hashes(words), size, length)).view(np.int64) if len(words) >= length else np.empty(0, np.int64))
            columns = [pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["id", "content", "words", "n_words", "words_sha256", "keys"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(work, f"id {kind}, content binary, words binary, n_words long, words_sha256 string, keys array<long>")


def _chosen(table: Words, h: np.ndarray, size: int, length: int) -> np.ndarray:
    """For each full window the least hash of its windows of ``size`` words."""
    return least_of(table.windows(h, size, FACTORS[0]), length - size + 1)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, and the columns of ``wanted`` but id and content), of its documents (id, content).

    The thin ids are broadcast ahead if they are few, so that other texts are not shuffled.
    """
    thin = common.broadcast_if_small(wanted.select("id", "content"))
    some = docs.alias("d").join(thin.alias("w"), _same("d", "w"), "left_semi")
    more = [F.col(f"w.{c}") for c in wanted.columns if c not in ("id", "content")]
    return some.alias("d").join(wanted.hint("merge").alias("w"), _same("d", "w")).select("d.id", "d.text", *more)


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.content") == F.col(f"{b}.content"))


def answered(rows: DataFrame, groups: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has a row for each key and how many rows it has, ``n``.

    What holds a HOT-th of ``total`` rows or more is broadcast; there are at most HOT such keys.
    """
    hot = F.broadcast(groups.where(F.col("n") * HOT >= total).drop("n"))
    cold = rows.join(hot.select(*on), on, "left_anti").join(groups.drop("n"), on, how)
    return rows.join(hot, on).unionByName(cold)


def _survivors(nodes: DataFrame) -> DataFrame:
    """(node, kept): of each node's ``keys`` those that another node has too."""
    pairs = nodes.select("node", F.explode("keys").alias("key"))
    counted = pairs.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    repeated = common.checkpoint(counted.where("low <> high").select("key", "n"))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    found = answered(pairs, repeated, ["key"], total)
    return common.checkpoint(found.groupBy("node").agg(F.collect_set("key").alias("kept")))


def _next_keys(texts: DataFrame, size: int, larger: int, length: int) -> DataFrame:
    """(node, keys): hashes of windows of ``larger`` words in the full windows whose window of ``size`` words survived."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        table = Words()
        for batch in common.freed(batches):
            keys = []
            for text, kept in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = table.hashes(split(text))
                alive = np.isin(_chosen(table, h, size, length), np.array(kept, np.int64).view(np.uint64))
                keys.append(np.unique(_chosen(table, h, larger, length)[alive]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])

    return texts.select("node", "text", "kept").mapInArrow(work, "node long, keys array<long>")


def _full_windows(texts: DataFrame, size: int, length: int) -> DataFrame:
    """(a, b, node, first, start): both hashes of the full windows whose window of ``size`` words survived."""
    kind = texts.schema["first"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        table = Words()
        for batch in common.freed(batches):
            parts = []
            for i, (text, kept) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                h = table.hashes(split(text))
                if len(h) < length:
                    continue
                alive = np.isin(_chosen(table, h, size, length), np.array(kept, np.int64).view(np.uint64)) if size < length else np.ones(len(h) - length + 1, bool)
                start = np.flatnonzero(alive)
                a, b = (table.windows(x, length, f)[start] for x, f in zip((h, h * MIX ^ (h >> np.uint64(29))), FACTORS, strict=True))
                parts.append((np.full(len(start), i), a.view(np.int64), b.view(np.int64), start.astype(np.int32)))
            if parts:
                row, a, b, start = (np.concatenate(c) for c in zip(*parts, strict=True))
                own = [batch.column(k).take(pa.array(row)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *own, pa.array(start)], ["a", "b", "node", "first", "start"])

    return texts.select("node", "first", "text", "kept").mapInArrow(work, f"a long, b long, node long, first {kind}, start int")


def _joined_spans(found: DataFrame, length: int) -> DataFrame:
    """(node, spans) of (node, starts): the stretches of words that windows at these starts cover."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for starts in batch.column(1).to_pylist():
                s = np.sort(np.array(starts, np.int64))
                cut = np.flatnonzero(np.diff(s) > length)
                ends = np.concatenate([s[cut], s[-1:]]) + length
                spans.append([{"start": a, "end": b} for a, b in zip(np.concatenate([s[:1], s[cut + 1]]).tolist(), ends.tolist(), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["node", "spans"])

    return found.select("node", "starts").mapInArrow(work, "node long, spans array<struct<start: int, end: int>>")


def _repeats(docs: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """(node, spans) of the nodes that repeat windows of nodes with a smaller first id."""
    sizes = levels(length)
    named = nodes.select("node", F.col("first").alias("id"), "content", "first")
    alive = nodes.where(F.size("keys") > 0).select("node", "keys")
    for size, larger in zip(sizes, sizes[1:], strict=False):
        alive = _survivors(alive)
        texts = _texts(docs, common.checkpoint(named.join(alive, "node")))
        if larger < length:
            # Rows that repeat an id and a text give the same keys.
            alive = common.checkpoint(_next_keys(texts, size, larger, length)).dropDuplicates(["node"])
    if len(sizes) == 1:
        texts = _texts(docs, common.checkpoint(named.join(alive.select("node", F.col("keys").alias("kept")), "node")))
    windows = common.checkpoint(_full_windows(texts, sizes[-2] if len(sizes) > 1 else length, length))
    lowest = windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.min("first").alias("least"))
    lowest = common.checkpoint(lowest.where("low <> high and least is not null").select("a", "b", "n", "least"))
    total = lowest.agg(F.sum("n")).first()[0] or 0
    found = answered(windows, lowest, ["a", "b"], total).where("first is null or least < first")
    return _joined_spans(found.groupBy("node").agg(F.collect_set("start").alias("starts")), length)


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, content, n_words, words_sha256, spans).

    ``content`` is the MD5 of the text, ``words_sha256`` that of its words joined by a space, and
    ``spans`` lists the stretches of words (start, end) that go; it is empty where none does.
    """
    common.small_batches(docs.sparkSession)
    source = _source(docs, id_col, text_col)
    rows = common.checkpoint(_digests(source, length))
    grouped = rows.groupBy("words").agg(
        F.min("id").alias("first"), F.min_by("content", F.struct(F.col("id").isNull(), "id", "content")).alias("content"),
        F.first("keys").alias("keys"), F.count("*").alias("n"),
    )
    nodes = common.checkpoint(grouped.withColumn("node", F.monotonically_increasing_id()))
    spans = common.checkpoint(_repeats(source, nodes, length))
    groups = common.checkpoint(nodes.select("words", "first", "n", "node").join(spans, "node", "left").drop("node").where("n > 1 or spans is not null").withColumn("known", F.lit(True)))
    thin = rows.drop("keys")
    found = answered(thin, groups, ["words"], thin.count(), "left")
    nothing = F.array().cast("array<struct<start: int, end: int>>")
    whole = F.when(F.col("n_words") >= length, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))).otherwise(nothing)
    own = F.col("known").isNull() | F.col("id").eqNullSafe(F.col("first"))
    told = F.when(own, F.coalesce("spans", nothing)).otherwise(whole)
    return found.select(F.col("id").alias(id_col), "content", "n_words", "words_sha256", told.alias("spans"))


def _kept(words: list[bytes], spans: list[dict]) -> bytes:
    out, last = [], 0
    for s in spans:
        out += words[last : s["start"]]
        last = s["end"]
    return b" ".join(out + words[last:])


def _changed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, n_words, n_removed, kept) of the documents that lose some words."""
    wanted = common.checkpoint(found.select("id", "content", "spans").dropDuplicates(["id", "content"]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for batch in common.freed(batches):
            words = [split(t) for t in batch.column(1).to_pylist()]
            spans = batch.column(2).to_pylist()
            gone = [sum(s["end"] - s["start"] for s in own) for own in spans]
            kept = [_kept(ws, own) for ws, own in zip(words, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string())],
                ["id", "n_words", "n_removed", "kept"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return _texts(docs, wanted).select("id", "text", "spans").mapInArrow(work, f"id {kind}, n_words long, n_removed long, kept string")


def removal_digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row; only texts that lose a part are read for it."""
    spans = common.checkpoint(repeated_spans(docs, length, id_col, text_col).withColumnRenamed(id_col, "id"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    told = spans.withColumn("n_removed", gone)
    whole = told.where("n_removed = 0 or n_removed = n_words")
    sha = F.when(F.col("n_removed") > 0, F.lit(EMPTY_SHA)).otherwise(F.col("words_sha256"))
    part = _changed(_source(docs, id_col, text_col), told.where("n_removed > 0 and n_removed < n_words"))
    both = whole.select("id", "n_words", "n_removed", sha.alias("kept_sha256")).unionByName(
        part.select("id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    )
    return both.withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_removed, text) for each row: the words that stay, joined by one space."""
    spans = common.checkpoint(repeated_spans(docs, length, id_col, text_col).withColumnRenamed(id_col, "id"))
    part = _changed(_source(docs, id_col, text_col), spans)
    return part.select(F.col("id").alias(id_col), "n_removed", F.col("kept").alias("text"))
