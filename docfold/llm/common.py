"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, about: they bound a Python worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Rows of hashes and ids that a broadcast may have.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Limit the rows and bytes of the batches that go to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset and Spark runs in this process alone, as in tests, a temporary
    folder of this machine serves; on a cluster a missing name is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame, in_loop: bool = False) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    A checkpointed table keeps its plan's estimate of its size, and a join multiplies those of
    its sides: in a loop the number's digits double each round until planning fills the driver's
    memory. With ``in_loop`` the rows, thin ones, are a written table, whose size is known.
    """
    folder = checkpoint_dir(df.sparkSession)
    if not in_loop:
        return df.checkpoint(eager=True)
    path = f"{folder}/loop-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, in whatever store it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of an id's decimal text, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def hashed_share(key: Column, share: float, seed: int = 0) -> Column:
    """True for about ``share`` of the keys, the same ones at every run."""
    top = 1 << 30
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(top)) < F.lit(int(min(1.0, share) * top))


def share_for(bound: int, rows: int) -> float:
    """A share of ``rows`` that has ``bound`` of them and some to spare, but for a chance that does not matter."""
    return (2 * bound + 20) / max(1, rows)


def pick(rows: DataFrame, bounds: dict[Any, int], max_chars: int) -> list[tuple[Any, int]]:
    """The (label, h) of a sample of ``rows`` (label, h, text), where h is a hash of the row.

    Only hashes order it, never the rows' places in the table; equal rows count as one. See
    ``within`` for the bounds. Lengths alone are collected; ``picked_rows`` has the texts.
    """
    found = rows.select("label", "h", F.length("text").alias("n")).distinct().collect()
    return within([tuple(r) for r in found], bounds, max_chars)


def picked_rows(rows: DataFrame, picked: list[tuple[Any, int]], one_in: int) -> DataFrame:
    """(label, h, text, held) of the picked rows, checkpointed.

    Of a label's texts in the order of their hashes one in ``one_in`` is held out of the fit, if
    the label has twice as many; else none is. The list is as bounded as the sample.
    """
    own: dict[Any, list[int]] = {}
    for label, h in picked:
        own.setdefault(label, []).append(h)
    # A label without enough texts learns from all of them.
    marked = [(label, h, i % one_in == 0 and len(hs) >= 2 * one_in) for label, hs in own.items() for i, h in enumerate(sorted(hs))]
    kind = rows.schema["label"].dataType.simpleString()
    wanted = F.broadcast(rows.sparkSession.createDataFrame(marked, f"label {kind}, h long, held boolean"))
    return checkpoint(rows.join(wanted, ["label", "h"]).dropDuplicates(["label", "h"]).select("label", "h", "text", "held"))


def within(found: list[tuple[Any, int, int]], bounds: dict[Any, int], max_chars: int) -> list[tuple[Any, int]]:
    """The (label, h) among (label, h, length) that a sample takes in the order of their hashes.

    Each label gets at most its bound of texts and an equal part of the characters; what labels
    need less of goes to the others. A text is taken whole or passed over where it does not fit,
    and a label whose texts all are too long gets its shortest one nevertheless.
    """
    by_label: dict[Any, list[tuple[int, int]]] = {}
    for label, h, n in sorted(found, key=lambda r: r[1]):
        by_label.setdefault(label, []).append((n, h))
    need = {label: sum(n for n, _ in own[: bounds[label]]) for label, own in by_label.items()}
    picked, left = [], max_chars
    for k, label in enumerate(sorted(by_label, key=lambda label: (need[label], str(label)))):
        part, own = max(0, left) // (len(by_label) - k), []
        for n, h in by_label[label]:
            if len(own) < bounds[label] and n <= part:
                own.append((n, h))
                part -= n
        own = own or [min(by_label[label])]
        left -= sum(n for n, _ in own)
        picked += [(label, h) for _, h in own]
    return picked


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A checkpointed table of few short columns with a broadcast hint, if it has at most
    BROADCAST_ROWS rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def keep_rows(docs: DataFrame, content: Column, judged: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` that ``judged`` (id, content, kept) keeps, with all columns.

    ``content`` is a hash of a row of ``docs``; of rows that repeat both id and content one stays.
    Rows without id cannot be told apart and all stay. What goes and what repeats is broadcast if
    it is small; else both joins use one partitioning, so that texts are shuffled once.
    """
    key, content_name = free_name(docs, "_kept_id"), free_name(docs, "_kept_content")
    judged = judged.select(F.col("id").alias(key), F.col("content").alias(content_name), "kept")
    gone = checkpoint(judged.where("not kept").select(key, content_name).distinct())
    several = judged.where("kept").groupBy(key, content_name).agg(F.count("*").alias("n")).where("n > 1").select(key, content_name)
    several = checkpoint(several)
    rows = docs.withColumns({key: docs[id_col], content_name: content})
    left = rows.join(broadcast_if_small(gone), [key, content_name], "left_anti")
    once = left.join(broadcast_if_small(several), [key, content_name], "left_anti")
    if not several.isEmpty():
        once = once.unionByName(left.join(broadcast_if_small(several), [key, content_name], "left_semi").dropDuplicates([key, content_name]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it where ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def refuse_taken(df: DataFrame, name: str) -> None:
    if free_name(df, name) != name:
        raise ValueError(f"the table has a column {name} already; name another one for the result")


class Shared:
    """A broadcast value with an identity of its own, by which workers know it from others."""

    def __init__(self, spark: SparkSession, value: Any):
        self._broadcast, self.id = spark.sparkContext.broadcast(value), uuid.uuid4().hex

    @property
    def value(self) -> Any:
        return self._broadcast.value

    def destroy(self) -> None:
        """Free it everywhere, once no task needs it any more."""
        self._broadcast.destroy()


_LASTING: list[tuple[str, Any, Any]] = []


def lasting(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by this worker process from task to task while kind and key stay the same.

    It must be a function of both: it only saves computing the same again. A worker keeps one
    such value, so that operators that follow each other do not add up their memory.
    """
    if not _LASTING or _LASTING[0][:2] != (kind, key):
        _LASTING.clear()
        _LASTING.append((kind, key, make()))
    return _LASTING[0][2]


def freed(batches: Iterable) -> Iterator:
    """The same batches; what Arrow holds in reserve goes back to the system after each one."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


def alone() -> None:
    """Drop the table that an operator before left in this worker; for tasks that keep none themselves."""
    _LASTING.clear()
    pa.default_memory_pool().release_unused()


class Memo(dict):
    """Numbers that new keys get as they are first looked up; ``fresh`` lists those keys."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.fresh.append(key)
        return number
