"""Operator 5: exact deduplication by a 128-bit content hash with a byte comparison.

Rows are grouped by the MD5 of their normalised text; the smallest id of a group stays. Groups
of a single row need no more. The rows of larger groups are grouped once more by hash and the
text itself, which compares bytes, so that texts which share a hash stay apart. Groupings sum
up on the map side first, so a text that a third of all rows share arrives once for each map
task. Where rows get their group's answer, the at most HOT groups that hold a HOT-th of all
rows or more are broadcast, so no key brings more than that share of the rows to one task.

Each text is hashed once into a thin checkpointed table of ids and hashes, and a second time
where repeated texts are looked for.

Defined results: a null text counts as empty; empty texts form one group; rows that repeat
an id are counted as rows, and of the rows with the smallest id every one is kept; a null id
sorts after all others; an empty table gives an empty result. Only the id and the text are read.
``deduplicate`` returns one row for each id and text that is kept, and all rows without id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The white space that the normalisation folds.
SPACES = r"[\x20\x09-\x0D]+"
#: Groups of at least one HOT-th of all rows are hot; there are at most HOT of them.
HOT = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(normalised(text)))


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, _sha) of each row, computed once."""
    rows = docs.select(docs[id_col].alias("_id"), normalised(docs[text_col]).alias("_text"))
    return common.checkpoint(rows.select("_id", F.unhex(F.md5("_text")).alias("_hash"), F.unhex(F.sha2("_text", 256)).alias("_sha")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256)."""
    found = _answers(docs, id_col, text_col)
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def _answers(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, _sha, _keep, _size) for each row."""
    thin = hashed(docs, id_col, text_col)
    rows = thin.count()
    repeated = common.checkpoint(thin.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash"))
    texts = docs.select(docs[id_col].alias("_id"), normalised(docs[text_col]).alias("_text")).withColumn("_hash", F.unhex(F.md5("_text")))
    same_bytes = (
        texts.join(common.broadcast_if_small(repeated), "_hash", "left_semi")
        .groupBy("_hash", "_text")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .select("_hash", F.unhex(F.sha2("_text", 256)).alias("_sha"), "_first", "_n")
    )
    same_bytes = common.checkpoint(same_bytes.where("_n > 1"))
    hot = F.broadcast(same_bytes.where(F.col("_n") * HOT >= rows))
    cold = thin.join(hot, ["_hash", "_sha"], "left_anti").join(same_bytes, ["_hash", "_sha"], "left")
    both = thin.join(hot, ["_hash", "_sha"]).unionByName(cold)
    grouped = F.col("_n").isNotNull()
    keep = F.when(grouped, F.col("_first")).otherwise(F.col("_id"))
    return both.select("_id", "_hash", "_sha", keep.alias("_keep"), F.coalesce("_n", F.lit(1).cast("long")).alias("_size"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    found = common.checkpoint(_answers(docs, id_col, text_col).select("_id", "_hash", F.col("_id").eqNullSafe(F.col("_keep")).alias("_kept")))
    return common.keep_rows(docs, content_hash(docs[text_col]), found.where("_id is not null").select(F.col("_id").alias("id"), F.col("_hash").alias("content"), F.col("_kept").alias("kept")), id_col)
