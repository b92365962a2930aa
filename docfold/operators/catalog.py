"""The stored corpus: upserts, replacement, cascading deletion, rebuilds, counts and lists.

Tables are DataFrames in and out; ``publish`` writes a new version beside the old ones and then
adds one marker for it. Nothing is overwritten or deleted, so a reader at any moment, and after a
run that failed, finds the last version that was completed.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, key: str, created: str | None = None, updated: str | None = None, now: Column | None = None) -> DataFrame:
    """New rows replace those of the same key; ``created`` keeps its old value, and ``updated`` becomes
    ``now``, or the current time, in all new rows."""
    if updated:
        new = new.withColumn(updated, F.current_timestamp() if now is None else now)
    stay = existing.join(new.select(key), key, "left_anti")
    if created:
        old = existing.select(F.col(key).alias("_key"), F.col(created).alias("_created"))
        new = new.join(old, F.col(key) == F.col("_key"), "left").withColumn(created, F.coalesce("_created", created)).drop("_key", "_created")
    return stay.unionByName(new.select(*existing.columns))


def replace_children(existing: DataFrame, new: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """All rows of these documents go, the new ones come."""
    return existing.join(documents.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], deleted: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table, given with its column for the document, without the rows of deleted documents."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    return {name: df.join(gone, df[column] == F.col("_gone"), "left_anti") for name, (df, column) in tables.items()}


def paired(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Chunks with their vectors; rows of one side alone raise an error when the result is read."""
    both = chunks.withColumn("_c", F.lit(1)).join(vectors.withColumn("_v", F.lit(1)), key, "full_outer")
    checked = F.when(F.col("_c").isNull() | F.col("_v").isNull(), F.raise_error(F.lit("chunks and vectors do not match"))).otherwise(F.lit(True))
    return both.where(checked).drop("_c", "_v")


def identified(files: DataFrame) -> DataFrame:
    """Adds checksum, document_id and title to files (path, content); equal contents share an id."""
    from ..functions.text import title_of_path

    digest = F.sha2("content", 256)
    return files.withColumns({"checksum": digest, "document_id": F.left(digest, F.lit(32)), "title": title_of_path(F.col("path"))})


def file_digest(content: Column) -> Column:
    """The short checksum by which a file is known to have changed."""
    return F.sha1(content)


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """(name, n_rows) of each table, in one plan; a table that is None has 0 rows. One must be there."""
    known = next(df for df in tables.values() if df is not None)
    none = known.sparkSession.range(0)
    parts = [(none if df is None else df).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def counts_by_document(documents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Documents with the number of their rows in each child table; each is grouped before it is joined."""
    out = documents.select(key)
    for name, (df, column) in children.items():
        grouped = df.groupBy(F.col(column).alias(key)).agg(F.count("*").alias(name))
        out = out.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def create(spark: SparkSession, name: str, schema: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def publish(df: DataFrame, root: str, name: str) -> int:
    """Write a version of a table under ``root`` and then its marker; gives the version's number."""
    path = f"{root}/{name}/{uuid.uuid4()}"
    df.write.parquet(path)
    return mark(df.sparkSession, root, name, path)


def mark(spark: SparkSession, root: str, name: str, path: str) -> int:
    """Let readers see a version that was written whole: append its marker, one row in one file."""
    known = versions(spark, root, name)
    number = 1 if known is None else known.agg(F.max("version")).first()[0] + 1
    row = spark.createDataFrame([(number, path)], "version long, path string").withColumn("published_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{root}/{name}_versions")
    return number


def versions(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """(version, path, published_at) of all that were published, or None before the first."""
    try:
        return spark.read.schema("version long, path string, published_at timestamp").parquet(f"{root}/{name}_versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The highest version, or the given one; of two that took one number the later one."""
    known = versions(spark, root, name)
    if known is not None and version is not None:
        known = known.where(F.col("version") == version)
    last = known.orderBy(F.desc("version"), F.desc("published_at"), "path").first() if known is not None else None
    if last is None:
        raise LookupError(f"no version of {name} is published")
    return spark.read.parquet(last["path"])


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Append rows under a batch's name; a batch that is written again replaces its own rows alone.

    A run that is tried again after a failure, or a stream's micro-batch that comes twice, leaves
    its rows once.
    """
    rows = df.withColumn("batch_id", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
