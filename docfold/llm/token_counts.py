"""Operator 4: token counts from an exact length histogram.

Documents are counted by their encoded length; nothing else about them is kept. Suffix sums
over the lengths then answer, for every context limit, how many documents reach it, how many
tokens remain when longer ones are truncated there, and which share of documents fits.

Defined results: a null or empty text has length 0; repeated rows count once each; an empty
table has an empty histogram; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths that one window of the suffix sums covers.
BLOCK = 4096


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(length, n_docs), one row a distinct length, counted on the map side first."""
    return lengths.groupBy(lengths[length_col].cast("long").alias("length")).agg(F.count("*").alias("n_docs"))


def limit_answers(histogram: DataFrame) -> DataFrame:
    """For each distinct length taken as a context limit:

    n_docs of that length; docs_longer and tokens_longer beyond it; fitting_docs, the ones
    of at most that length; total_tokens of all documents; truncated_tokens when every
    document is cut to the limit; fitting_share, the share of documents that fit, so that
    the q-quantile is the least length with fitting_share >= q.

    Sums run inside blocks of BLOCK lengths and over the blocks' totals, so no task holds all
    lengths; there is one total for each block that occurs.
    """
    mass = F.col("length") * F.col("n_docs")
    blocks = histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("mass", mass)
    totals = blocks.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("mass").alias("block_mass"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    totals = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_mass").over(above), F.lit(0)).alias("mass_above"),
        F.sum("block_docs").over(everything).alias("all_docs"),
        F.sum("block_mass").over(everything).alias("all_mass"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)

    def longer(col: str, rest: str) -> Column:
        return F.coalesce(F.sum(col).over(inside), F.lit(0)) + F.col(rest)

    summed = blocks.join(totals, "block").withColumns(
        {"docs_longer": longer("n_docs", "docs_above"), "tokens_longer": longer("mass", "mass_above")}
    )
    fitting = F.col("all_docs") - F.col("docs_longer")
    return summed.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        "docs_longer",
        "tokens_longer",
        fitting.alias("fitting_docs"),
        F.col("all_mass").alias("total_tokens"),
        (F.col("all_mass") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        (fitting / F.col("all_docs")).alias("fitting_share"),
    )


def quantile(answers: DataFrame, q: float) -> DataFrame:
    """(q, length): the least length that at least the share ``q`` of documents does not exceed."""
    enough = answers.where(F.col("fitting_share") >= F.lit(q))
    return enough.agg(F.lit(q).alias("q"), F.min("context_limit").alias("length"))


def at_limit(answers: DataFrame, limit: int) -> DataFrame:
    """The totals at any limit, whether or not a document has that length.

    Between two occurring lengths the documents longer than the limit are the same ones, so
    the nearest length from below (or, below all of them, no document) decides.
    """
    below = answers.where(F.col("context_limit") <= limit)
    last = below.agg(F.max_by(F.struct("docs_longer", "tokens_longer", "total_tokens"), "context_limit").alias("s"))
    whole = answers.agg(F.sum("n_docs").alias("docs"), F.max("total_tokens").alias("tokens"))
    longer = F.coalesce(F.col("s.docs_longer"), F.col("docs"), F.lit(0))
    cut = F.coalesce(F.col("s.tokens_longer"), F.col("tokens"), F.lit(0))
    return last.crossJoin(whole).select(
        F.lit(limit).cast("long").alias("context_limit"),
        longer.alias("docs_longer"),
        (F.coalesce(F.col("tokens"), F.lit(0)) - cut + longer * F.lit(limit)).alias("truncated_tokens"),
    )
