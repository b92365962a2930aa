"""Operator 3: document fingerprints as threshold-scaled sketches, in Spark SQL functions only.

A text's shingles are runs of WIDTH words (a shorter text is one shingle); each is a 64-bit
hash, and the sketch keeps every hash below THRESHOLD, one fixed fraction of the range for all
texts. Sketches of any two texts can so be compared and merged, however unequal the texts are.
A sketch also has one hash of all words, which tells texts apart that keep no shingle at all.

A sketch is struct<whole: long, hashes: array<long>>, with hashes ascending.

Defined results: a null text counts as empty, and an empty or blank text has no hashes; two
sketches without hashes are alike (1) if their words are the same, and else not (0); one
sketch without hashes is like no other (0). Rows with equal ids are ordered by their texts, and
rows without id come last. A single document is its own next one. An empty table gives no rows.
Ids are integers. Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of a shingle; one hash in SCALE is kept.
WIDTH, SCALE = 5, 4
#: Fixed value: the least long.
LOWEST = -(1 << 63)
THRESHOLD = LOWEST + (1 << 64) // SCALE - 1
#: Documents, about, that one window covers; quantiles of the ids that windows divide, at most.
NEIGHBOURS, QUANTILES = 256, 1024
#: Quantiles that are looked through at once.
STEP = 32


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column) -> Column:
    """The sketch of a whole text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)]),
        )
        return F.when(n == 0, F.array().cast("array<long>")).when(n < WIDTH, F.array(F.xxhash64(h))).otherwise(runs)

    def below(all_hashes: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(all_hashes, lambda x: x <= THRESHOLD)))

    def sketched(h: Column) -> Column:
        return F.struct(F.xxhash64(h).alias("whole"), below(shingles(h)).alias("hashes"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), sketched)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of shingles that two texts have in common (their Jaccard similarity)."""

    def of(pair: Column) -> Column:
        shared = F.size(F.array_intersect(pair["a"]["hashes"], pair["b"]["hashes"]))
        union = F.size(pair["a"]["hashes"]) + F.size(pair["b"]["hashes"]) - shared
        same = F.when(pair["a"]["whole"].eqNullSafe(pair["b"]["whole"]), 1.0).otherwise(0.0)
        return F.when(union == 0, same).otherwise(shared / union)

    return _let(F.struct(a.alias("a"), b.alias("b")), of)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 if the first keeps none."""

    def of(pair: Column) -> Column:
        size = F.size(pair["a"])
        return F.when(size == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(pair["a"], pair["b"])) / size)

    return _let(F.struct(a["hashes"].alias("a"), b["hashes"].alias("b")), of)


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together; its ``whole`` is null unless both have the same."""
    whole = F.when(a["whole"] == b["whole"], a["whole"])
    return F.struct(whole.alias("whole"), F.array_sort(F.array_union(a["hashes"], b["hashes"])).alias("hashes"))


def as_text(s: Column) -> Column:
    """The sketch as hexadecimal numbers: the hash of all words, a colon, the kept hashes."""
    hexes = F.transform(s["hashes"], lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.lower(F.concat(F.lpad(F.hex(F.coalesce(s["whole"], F.lit(0))), 16, "0"), F.lit(":"), F.array_join(hexes, "")))


def next_keys(keys: DataFrame, widths: list[int]) -> DataFrame:
    """(key, next_key): for distinct long keys the next lower one, and for the lowest the highest.

    Keys meet in windows of the first width; each window's lowest key gets the highest key of
    the next window, which this function finds among the windows with the remaining widths.
    """
    whole = Window.orderBy(F.col("key").desc())
    if not widths:
        top = F.max("key").over(Window.partitionBy(F.lit(1)))
        return keys.select("key", F.coalesce(F.lead("key").over(whole), top).alias("next_key"))
    parted = keys.withColumn("part", F.floor(F.col("key") / widths[0]))
    inside = parted.select("key", "part", F.lead("key").over(Window.partitionBy("part").orderBy(F.col("key").desc())).alias("below"))
    heads = parted.groupBy("part").agg(F.max("key").alias("head"))
    links = next_keys(heads.select(F.col("part").alias("key")), widths[1:])
    links = links.join(heads.select(F.col("part").alias("next_key"), "head"), "next_key").select(F.col("key").alias("part"), "head")
    return inside.join(links, "part").select("key", F.coalesce("below", "head").alias("next_key"))


def windows_of(ids: DataFrame) -> Column:
    """A column that numbers windows of about NEIGHBOURS rows by the order of ``id``.

    Quantiles of the ids divide the table, and equal widths divide what lies between two of
    them, so that ids far from all others widen one window's range alone. Nulls have a window of
    their own before all others.
    """
    n = ids.where("id is not null").count()
    parts = max(1, min(QUANTILES, n // NEIGHBOURS))
    shares = [k / parts for k in range(parts + 1)]
    found = ids.agg(F.percentile_approx("id", shares, 100 * QUANTILES).alias("q")).first()["q"] or [0]
    bounds = sorted(set(found))
    inside = max(1, n // parts // NEIGHBOURS)
    widths = [max(1, -(-(b - a) // inside)) for a, b in zip(bounds, [*bounds[1:], bounds[-1] + 1], strict=True)]
    tops = F.array(*[F.lit(b).cast("long") for b in bounds[::STEP]])
    nested = F.array(*[F.array(*[F.lit(b).cast("long") for b in bounds[k : k + STEP]]) for k in range(0, len(bounds), STEP)])
    lows, wide = (F.array(*[F.lit(x).cast("double") for x in xs]) for xs in (bounds, widths))

    def at(i: Column) -> Column:
        # As doubles keep the order, places do.
        sub = F.floor((F.col("id").cast("double") - F.get(lows, i)) / F.get(wide, i)).cast("long")
        return i.cast("long") * (1 << 32) + F.greatest(sub, F.lit(0).cast("long"))

    def quantile(top: Column) -> Column:
        return top * STEP + F.greatest(F.size(F.filter(F.get(nested, top), lambda b: b <= F.col("id"))) - 1, F.lit(0))

    top = F.greatest(F.size(F.filter(tops, lambda b: b <= F.col("id"))) - 1, F.lit(0))
    return F.when(F.col("id").isNull(), F.lit(-1).cast("long")).otherwise(_let(_let(top, quantile), at))


def with_next(docs: DataFrame, made: dict[str, Column]) -> DataFrame:
    """(id, text) with the columns ``made`` of it and ``next``, a struct of the text and those
    columns of the next row by descending id.

    The last row of a window gets the first row of the next one; those first rows are found by
    their ids and read apart, so that texts are shuffled once.
    """
    ids = docs.select("id")
    place = windows_of(ids)
    firsts = common.checkpoint(ids.withColumn("place", place).groupBy("place").agg(F.max("id").alias("id")))
    order = [F.col("id").desc_nulls_last(), F.col("text")]
    carried = F.struct("text", *made)
    rows = docs.withColumn("place", place).withColumns(made)
    ranked = rows.withColumn("next", F.lead(carried).over(Window.partitionBy("place").orderBy(*order)))
    wanted = common.broadcast_if_small(firsts.select(F.col("id").alias("first_id")))
    first_texts = docs.join(wanted, F.col("id").eqNullSafe(F.col("first_id")), "left_semi").withColumn("place", place)
    heads = first_texts.groupBy("place").agg(F.min("text").alias("text")).select(F.col("place").alias("next_key"), "text")
    heads = heads.withColumns(made).select("next_key", F.struct("text", *made).alias("head"))
    links = next_keys(firsts.select(F.col("place").alias("key")), [NEIGHBOURS, NEIGHBOURS])
    heads = heads.join(links, "next_key").select(F.col("key").alias("place"), "head")
    return ranked.join(heads, "place", "left").withColumn("next", F.coalesce("next", "head")).drop("place", "head")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its last third replaced by the start of the
    next document's, and the likeness of the first to the second and to the next document's."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    paired = with_next(rows, {"own": sketch(F.col("text"))})
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third))
    changed = paired.select("id", n.cast("long").alias("n_chars"), "own", F.col("next.own").alias("other"), edited.alias("edited"))
    changed = changed.withColumn("changed", sketch(F.col("edited")))
    return changed.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("other")).alias("near_next"),
    )
