"""Five operators in a row over ``documents``: from raw texts to packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. The
stages before the last return the columns of ``documents``. ``run`` writes each result as
Parquet in the shared checkpoint folder and reads it back as the next stage's input; a stage's
folder goes once the next one is written, and the last one stays.

Defined results: texts that are null or have no letter are rejected by the first stage. Where no
row has a language no text with a letter is rejected, and where no row is labelled toxic all go on.
Empty texts do not come further than that stage; repeated rows meet in the third one. An empty
table gives no rows. Columns of any other name are carried along, whatever the stages call their
own; long texts are taken whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docfold.llm import common, exact_dedup, language_id, near_dedup, packing, queries, toxicity


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: learn from the labelled rows, drop what the calibrated models reject."""
    name = common.free_name(docs, "_language")
    judged = language_id.predict(docs, language_id.fit(docs), out_col=name)
    return judged.where(~judged[name]["rejected"]).drop(name)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: learn from ``labels``, drop documents with a score of 0.5 or more."""
    field = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    name = common.free_name(docs, "_toxicity")
    scored = toxicity.score(docs, field, out_col=name)
    return scored.where(scored[name]["score"] < 0.5).drop(name)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of equal texts stays."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near-duplicates stays (five words, 0.8)."""
    return near_dedup.deduplicate(docs, width=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of the texts that are left, placed in sequences of 1024 tokens."""
    tokenizer = queries.tokenizer_file("byte_bpe_50k.json").decode()
    return packing.pack(packing.token_pieces(docs, tokenizer, end_id=2, capacity=1024), capacity=1024)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("minhash", near_stage),
    ("packing", packing_stage),
]

#: Language models, tagging and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder, before = f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.remove(spark, before)  # what is written from it does not read it again
        before = path
    return docs
