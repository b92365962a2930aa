"""Operator 10: best-fit packing by exact complements.

Texts become token pieces of at most ``capacity`` tokens. How pieces combine depends on their
lengths alone, so the plan is made from the count of each length, at most ``capacity``
numbers. The lengths that occur are indexed by their sums: a sum leads to the single of that
length, to the pairs, and, by a single and the pairs of the rest, to the triples. For the
longest length left, the gap beside it is looked up there, and each combination found is
consumed as often as the counts allow; what no combination fills goes to the open sequence of
the smallest sufficient gap (best fit). The plan's size is bounded by the capacity, whatever the
input. Spark then numbers the pieces of each length and hands the numbers to the plan's slots.

Defined results: a null text counts as empty and is a piece of the end token alone; a text of any
length is encoded whole and cut only into pieces; special tokens that a text spells out are
encoded as the tokenizer's library does by default; ids of any type are carried as they are,
null ones too; repeated rows are packed once each, and equal pieces take places in any order; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .pretokens import WordTable

#: Pieces of one length that one task numbers at most, about.
NUMBERED = 200_000

PIECE_SCHEMA = "doc_id {id}, piece int, start long, length long, ids_crc32 long"
SLOT_SCHEMA = "_length long, _from long, _to long, _sequence long, offset long"


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers; each distinct word is encoded once."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens") or []]
        self.words = WordTable(self._encode)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        # A text that spells out an added token is the tokenizer's own; no word of another one can hold it.
        whole = [i for i, t in enumerate(texts) if t and any(a in t for a in self.added)]
        cut = [None if i in set(whole) else t for i, t in enumerate(texts)] if whole else texts
        out = [b"".join(parts) for parts in self.words.look_up(cut)]
        for i in whole:
            out[i] = self._encode([texts[i]])[0]
        return out


def token_pieces(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each text's ids followed by ``end_id``.

    A longer document is cut into pieces of ``capacity`` tokens; the first one takes the
    remainder and may be shorter.
    """
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = common.lasting("packing", shared.value, lambda: Encoder(shared.value))
        for batch in common.freed(batches):
            out: list[tuple] = []
            for row, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    out.append((row, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            rows, *columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(cut, PIECE_SCHEMA.format(id=kind))


class Complements:
    """The singles, pairs and triples of lengths, indexed by their sums.

    ``left`` has the count of each length and is the caller's to change: what the index finds is
    always left as often as the combination needs it.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        some = np.flatnonzero(left)
        high, low = (x.ravel() for x in np.meshgrid(some, some, indexing="ij"))
        fits = (high >= low) & (high + low < len(left))
        high, low = high[fits], low[fits]
        order = np.lexsort((-high, high + low))  # by sum, those with the longest length first
        self.high, self.low = high[order], low[order]
        self.at = np.searchsorted(self.high + self.low, np.arange(len(left) + 1))

    def pair(self, total: int, most: int, taken: int = 0) -> tuple[int, int] | None:
        """A pair of this sum with no length above ``most``, beside one piece of length ``taken``."""
        a, b = self.at[total], self.at[total + 1]
        a += np.searchsorted(-self.high[a:b], -most)
        high, low = self.high[a:b], self.low[a:b]
        twice = (high == low).astype(int)
        fits = (self.left[high] > twice + (high == taken)) & (self.left[low] > twice + (low == taken))
        k = int(fits.argmax()) if len(fits) else 0
        return (int(high[k]), int(low[k])) if len(fits) and fits[k] else None

    def of(self, gap: int) -> tuple[int, ...] | None:
        """A combination that sums to ``gap``: the single, else a pair, else a triple, long ones first."""
        if self.left[gap]:
            return (gap,)
        if two := self.pair(gap, gap):
            return two
        for first in np.flatnonzero(self.left[(gap + 2) // 3 : max(0, gap - 1)])[::-1] + (gap + 2) // 3:
            if two := self.pair(gap - int(first), int(first), int(first)):
                return (int(first), *two)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths of one sequence). Every step uses up a length or a kind of gap."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    index = Complements(left)
    made: list[tuple[int, list[int]]] = []
    rest = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        while left[length]:
            if length == capacity:
                made.append((int(left[length]), [length]))
                left[length] = 0
                break
            left[length] -= 1  # the one whose gap is to be filled
            fill = index.of(capacity - length)
            left[length] += 1
            if fill is None:
                rest[length], left[length] = left[length], 0
                break
            lengths = [length, *fill]
            often = min(int(left[x]) // lengths.count(x) for x in lengths)
            made.append((often, lengths))
            for x in lengths:
                left[x] -= often
    open_by_gap: dict[int, list[tuple[int, list[int]]]] = {}
    for length in range(capacity, 0, -1):
        n = int(rest[length])
        while n:
            gap = min((g for g, kinds in open_by_gap.items() if g >= length and kinds), default=None)
            if gap is None:
                each = capacity // length
                often = n // each or 1
                lengths = [length] * min(each, n)
            else:
                bins, before = open_by_gap[gap].pop()
                each = min(gap // length, n)
                often = min(bins, n // each)
                if bins > often:
                    open_by_gap[gap].append((bins - often, before))
                lengths = [*before, *[length] * each]
            n -= often * lengths.count(length)
            open_by_gap.setdefault(capacity - sum(lengths), []).append((often, lengths))
    return made + [kind for kinds in open_by_gap.values() for kind in kinds]


def slots(kinds: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Rows of SLOT_SCHEMA: the numbers of each length's pieces that a place of the plan takes."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for often, lengths in kinds:
        offset = 0
        for length in lengths:
            at = used.get(length, 0)
            out.append((length, at, at + often, sequence, offset))
            used[length] = at + often
            offset += length
        sequence += often
    return out


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces of PIECE_SCHEMA, whose length is 1 to ``capacity``.

    Pieces are numbered inside (length, part), where parts are as many as keep the rows of
    one task bounded even if most pieces have one length; the parts' counts give where each
    part's numbers start.
    """
    spark = pieces.sparkSession
    pieces = common.checkpoint(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row a length
    parts = max(16, -(-sum(counts.values()) // NUMBERED))
    slot_table = spark.createDataFrame(slots(plan(counts, capacity)), SLOT_SCHEMA)
    parted = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    starts = starts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = parted.withColumn("_own", F.row_number().over(order)).join(starts, ["length", "_part"])
    numbered = numbered.withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    # The plan has at most a few rows for each length up to the capacity, so it is safe to broadcast.
    inside = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return numbered.join(F.broadcast(slot_table), inside).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"),
        "offset",
    )
