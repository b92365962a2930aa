"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def nine_decimals(x: Column) -> Column:
    """A double with nine decimals, of which a tie gives the even one.

    ``format_string`` rounds ties up. Only odd multiples of 1/1024 end with a 5 at the tenth decimal;
    their decimals are worked out in whole numbers.
    """
    scaled = F.abs(x * 1024)
    whole = scaled.try_cast("long")
    kept = F.floor((whole % 1024) * 9765625 / 10)
    even = F.lpad((kept + kept % 2).cast("string"), 9, "0")
    tie = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(whole / 1024).cast("string"), F.lit("."), even)
    return F.when(scaled % 2 == 1, tie).otherwise(F.format_string("%.9f", x))


def literal(a: Column) -> Column:
    """``[v1, v2]`` with nine decimals each."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: nine_decimals(x.cast("double"))), ", "), F.lit("]"))


def from_literal(text: Column) -> Column:
    inner = F.regexp_replace(text, r"[\[\]\s]", "")
    return F.when(inner == "", F.array().cast("array<float>")).otherwise(F.split(inner, ",").cast("array<float>"))
