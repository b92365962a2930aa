"""Images of documents: unique ones, those worth keeping, captions, and what happens to blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The least width, height and area; how often a small picture may repeat.
LEAST_WIDTH, LEAST_HEIGHT, LEAST_AREA, REPEATS, REPEATED_AREA = 120, 48, 12_000, 5, 90_000
#: Suffixes of raster images.
RASTER = ["png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff"]


def unique_images(images: DataFrame, doc: str, key: str, order: str) -> DataFrame:
    """The first image of each key of a document."""
    first = Window.partitionBy(doc, key).orderBy(order)
    return images.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def drop_reasons(images: DataFrame, doc: str, repeats: int = REPEATS) -> DataFrame:
    """Adds drop_reason: too_small, repeated_small_asset, or null for images that stay.

    Repeats are counted before rows meet, so that a logo on every page of a corpus costs no more
    than a count for each document.
    """
    area = F.col("width") * F.col("height")
    counts = images.groupBy(F.col(doc).alias("_doc"), F.col("digest").alias("_digest")).agg(F.count("*").alias("_repeats"))
    told = images.join(counts, (F.col(doc) == F.col("_doc")) & F.col("digest").eqNullSafe(F.col("_digest")), "left")
    small = (F.col("width") < LEAST_WIDTH) | (F.col("height") < LEAST_HEIGHT) | (area < LEAST_AREA)
    again = (F.col("_repeats") >= repeats) & (area <= REPEATED_AREA)
    return told.withColumn("drop_reason", F.when(small, "too_small").when(again, "repeated_small_asset")).drop("_doc", "_digest", "_repeats")


def prune(blocks: DataFrame, images: DataFrame, doc: str) -> DataFrame:
    """Blocks with the images that stay; figures without text or image left over go, headings stay.

    ``blocks`` has block_type, text and image_ids; ``images`` has image_id and drop_reason. Each list of ids
    meets only those of its own that go, so that a document may have any number of images.
    """
    gone = images.where("drop_reason is not null").select(doc, F.col("image_id").alias("_id")).distinct()
    lists = blocks.select(doc, "image_ids").distinct().select(doc, "image_ids", F.explode("image_ids").alias("_id"))
    lost = lists.join(gone, [doc, "_id"], "left_semi").groupBy(doc, "image_ids").agg(F.collect_set("_id").alias("_gone"))
    told = blocks.join(lost, [doc, "image_ids"], "left")
    left = told.withColumn("image_ids", F.when(F.col("_gone").isNull(), F.array_distinct("image_ids")).otherwise(F.array_except("image_ids", "_gone"))).drop("_gone")
    empty = (F.trim(F.coalesce("text", F.lit(""))) == "") & (F.size("image_ids") == 0)
    return left.where((F.col("block_type") == "heading") | ~empty)


def reasons_by_document(images: DataFrame, doc: str) -> DataFrame:
    return images.where("drop_reason is not null").groupBy(doc, "drop_reason").agg(F.count("*").alias("n_images"))


def captions(images: DataFrame, doc: str, order: str, most: int = 12, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds a caption where there is none: from ``model`` for the first ``most`` images of a
    document, else ``Image from`` its place, or ``Document image``."""
    place = F.coalesce(F.concat(F.lit("Image from "), F.col("location")), F.lit("Document image"))
    bare = F.trim(F.coalesce("caption_text", F.lit(""))) == ""
    number = F.row_number().over(Window.partitionBy(doc).orderBy(order))
    made = F.when(F.col("_n") <= most, model(F.col("image_path"))) if model else F.lit(None).cast("string")
    told = images.withColumn("_n", number)
    return told.withColumn("caption_text", F.when(bare, F.coalesce(made, place)).otherwise(F.col("caption_text"))).drop("_n")


def existing(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images whose path is a raster file of the listing."""
    suffix = F.lower(F.element_at(F.split("image_path", r"\."), -1))
    return images.where(suffix.isin(RASTER)).join(files.select(F.col("path").alias("image_path")).distinct(), "image_path", "left_semi")


def linked(images: DataFrame, block_images: DataFrame, chunks: DataFrame, doc: str) -> DataFrame:
    """Images of documents with related_chunk_id: the first chunk whose blocks show them, or null.

    ``block_images`` has block_id and image_path, ``chunks`` has chunk_id, chunk_index and block_ids.
    """
    spread = chunks.select(doc, "chunk_id", "chunk_index", F.explode("block_ids").alias("block_id"))
    shown = spread.join(block_images.select(doc, "block_id", "image_path"), [doc, "block_id"])
    first = shown.groupBy(doc, "image_path").agg(F.min_by("chunk_id", "chunk_index").alias("related_chunk_id"))
    return images.join(first, [doc, "image_path"], "left")
