"""Results that several later steps read, written once to the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut, in the folder that spark.checkpoint.dir names.

    Only where Spark runs in this process alone and names none, a temporary folder serves.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return df.checkpoint(eager=True)


def parts(df: DataFrame, most: int) -> int:
    """Into how many parts ``df`` is dealt so that each holds about ``most`` rows, which are counted.

    Left to itself, Spark joins parts whose rows compress well, until one task sorts many millions of them; parts
    of a given number stay. All that is joined takes the same number.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most))
