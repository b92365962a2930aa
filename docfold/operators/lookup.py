"""Look-ups in small dimensions, and records as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_hop(asked: DataFrame, aliases: DataFrame, records: DataFrame, place: str) -> DataFrame:
    """Each asked name with its record: first as an alias of another name, else as it is.

    ``aliases`` has alias and name, ``records`` has name and further columns; names are compared
    trimmed and in lower case. Adds found, and supported, the sorted names, where nothing is found.
    """
    key = F.lower(F.trim(place))
    first = aliases.select(F.lower(F.trim("alias")).alias("_alias"), F.lower(F.trim("name")).alias("_via"))
    known = records.withColumn("_name", F.lower(F.trim("name")))
    hop = asked.withColumn("_key", key).join(first, F.col("_key") == F.col("_alias"), "left")
    hop = hop.withColumn("_target", F.coalesce("_via", "_key"))
    met = hop.join(known, F.col("_target") == F.col("_name"), "left").withColumn("found", F.col("_name").isNotNull())
    names = known.agg(F.array_join(F.array_sort(F.collect_set("_name")), ", ").alias("_names"))
    told = met.crossJoin(F.broadcast(names)).withColumn("supported", F.when(~F.col("found"), F.col("_names")))
    return told.drop("_key", "_alias", "_via", "_target", "_name", "_names")


def rendered(records: DataFrame, key: str, fields: list[str], group: list[str] | None = None) -> DataFrame:
    """Records as ``key: a=.., b=..`` joined with ``; `` in the order of the key."""
    pairs = [F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in fields]
    one = F.concat(F.col(key).cast("string"), F.lit(": "), F.concat_ws(", ", *pairs))
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), one.alias("t"))))
    return records.groupBy(*(group or [])).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "; ").alias("rendered"))


def by_priority(rows: DataFrame, *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows by the given order."""
    return rows.orderBy(*order).limit(n)


def latest_active(rows: DataFrame, keys: list[str], state: str, active: str, created: str, value: str) -> DataFrame:
    """The newest active value of each key."""
    return rows.where(F.col(state) == active).groupBy(*keys).agg(F.max_by(value, F.struct(created, value)).alias(value), F.max(created).alias(created))
