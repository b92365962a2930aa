"""Nested results of several models: leaves side by side, consensus, issues, scores and ranks."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.json import leaves
from .staging import parts

ISSUES = ["numeric_mismatch", "number_token_mismatch", "word_count_mismatch", "value_mismatch"]


def ratio(a: Column, b: Column) -> Column:
    """Share of two texts that matches in runs (Ratcliff and Obershelp), after folding spaces and case.

    There is no built-in function for it; whole batches go to one Arrow function.
    """

    @F.arrow_udf("double")
    def apply(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in pairs], pa.float64())

    return apply(T.folded(a), T.folded(b))


def leaf_rows(results: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """(keys, path, value) of each leaf; the last of equal paths counts."""
    spread = results.select(*keys, F.explode(leaves(F.col(json_col))).alias("leaf"))
    return spread.select(*keys, "leaf.path", "leaf.value")


def consensus(rows: DataFrame, group: list[str], model: str) -> DataFrame:
    """(group, path, consensus_norm, consensus_value, votes): the value that most models give,
    of equally frequent ones the greatest, as the first of its models writes it."""
    counted = rows.withColumn("norm", T.folded(F.col("value"))).groupBy(*group, "path", "norm").agg(
        F.count("*").alias("votes"), F.min_by("value", model).alias("value")
    )
    best = F.max(F.struct("votes", "norm", "value"))
    made = counted.groupBy(*group, "path").agg(best.alias("b"))
    return made.select(*group, "path", F.col("b.norm").alias("consensus_norm"), F.col("b.value").alias("consensus_value"), F.col("b.votes").alias("votes"))


#: Leaves of one task, when they are sorted by group and path.
LEAVES = 400_000


def _compared(told: DataFrame, keys: list[str], model: str) -> DataFrame:
    """(keys, path, n_given, issue) from rows with path, value and a model, null where a leaf does not count.

    Each model's leaves of a path are reduced first, so that models are counted without being gathered.
    """
    value = F.when(F.col(model).isNotNull(), F.coalesce("value", F.lit("")))
    c = F.col
    worked = told.withColumn("_value", value).select(
        *keys, "path", model, T.number_or_null(c("_value")).alias("number"), F.array_join(T.numbers(c("_value")), " ").alias("tokens"),
        F.size(T.words(c("_value"))).alias("n_words"), T.folded(c("_value")).alias("norm"),
    )
    names = ["number", "tokens", "n_words", "norm"]
    ends = [f(n).alias(f"{n}_{at}") for n in names for f, at in ((F.min, "from"), (F.max, "to"))]
    each = worked.groupBy(*keys, "path", model).agg(F.count(model).alias("n"), F.count("number").alias("n_numbers"), *ends)
    differ = lambda n: F.coalesce(F.min(f"{n}_from") != F.max(f"{n}_to"), F.lit(False)).alias(n)
    summed = each.groupBy(*keys, "path").agg(F.count(model).alias("n_given"), F.sum("n").alias("n"), F.sum("n_numbers").alias("n_numbers"), *[differ(n) for n in names])
    issue = (
        F.when((c("n_numbers") == c("n")) & c("number"), ISSUES[0])
        .when(c("tokens"), ISSUES[1])
        .when(c("norm") & c("n_words"), ISSUES[2])
        .when(c("norm"), ISSUES[3])
    )
    return summed.select(*keys, "path", "n_given", issue.alias("issue"))


def issues(rows: DataFrame, group: list[str], model: str, models: DataFrame | None = None) -> DataFrame:
    """(group, path, n_missing, issue): how the models' values of a path differ, if they do.

    The first that applies: all are numbers and differ; their numbers differ; their word counts
    differ; their values differ. ``models`` (group, model) lists the models that were asked, those whose
    answer had no leaf too; without it a group's models are those that gave leaves. A path is
    missing from those of them that gave no leaf for it; other models' leaves do not count.
    """
    n = parts(rows, LEAVES)
    leaves = rows.select(*group, "path", model, "value").repartition(n, *group)
    asked = (leaves if models is None else models.repartition(n, *group)).groupBy(*group).agg(F.collect_set(model).alias("_asked"))
    told = leaves.join(asked.hint("merge"), group).withColumn(model, F.when(F.array_contains("_asked", F.col(model)), F.col(model)))
    found = _compared(told.withColumn("_n", F.size("_asked").cast("long")), [*group, "_n"], model)
    return found.select(*group, "path", (F.col("_n") - F.col("n_given")).alias("n_missing"), "issue")


ANSWER = "struct<model:string,value:string,norm:string,number:double,tokens:string,n_words:int>"


def answers_by_path(rows: DataFrame, group: list[str], model: str, models: DataFrame | None = None) -> DataFrame:
    """(group, path, answers, asked, consensus_norm, consensus_value, issue): all that is known of a path in one row.

    A path's answers are gathered once, one for each of a few models, in the models' order; ``asked`` are
    the models of its group. The partitioning by group that the windows need serves the
    grouping by path as well, so that leaves are shuffled once.
    """
    text = F.coalesce("value", F.lit(""))
    answer = F.struct(
        F.col(model).cast("string").alias("model"), text.alias("value"), T.folded(text).alias("norm"), T.number_or_null(text).alias("number"),
        F.array_join(T.numbers(text), " ").alias("tokens"), F.size(T.words(text)).alias("n_words"),
    ).cast(ANSWER)
    paths = rows.repartition(*group).groupBy(*group, "path").agg(F.array_sort(F.collect_list(answer)).alias("answers"))
    if models is None:
        named = F.array_distinct(F.flatten(F.collect_set(F.transform("answers", lambda a: a["model"])).over(Window.partitionBy(*group))))
        paths = paths.withColumn("asked", named)
    else:
        paths = paths.join(models.groupBy(*group).agg(F.collect_set(F.col(model).cast("string")).alias("asked")), group)
    kinds = lambda f: F.array_distinct(F.transform("answers", lambda a: a[f]))
    having = lambda n: F.filter("answers", lambda a: a["norm"] == n)
    best = F.array_max(F.transform(kinds("norm"), lambda n: F.struct(F.size(having(n)).alias("votes"), n.alias("norm"), having(n)[0]["value"].alias("value"))))
    numbers = F.forall("answers", lambda a: a["number"].isNotNull()) & (F.size(kinds("number")) > 1)
    issue = (
        F.when(numbers, ISSUES[0])
        .when(F.size(kinds("tokens")) > 1, ISSUES[1])
        .when((F.size(kinds("norm")) > 1) & (F.size(kinds("n_words")) > 1), ISSUES[2])
        .when(F.size(kinds("norm")) > 1, ISSUES[3])
    )
    told = paths.withColumns({"best": best, "issue": issue})
    return told.select(*group, "path", "answers", "asked", F.col("best.norm").alias("consensus_norm"), F.col("best.value").alias("consensus_value"), "issue")


def model_summary(rows: DataFrame, group: list[str], model: str, models: DataFrame | None = None) -> DataFrame:
    """(model, counters, place): how often each model departs from the consensus, fewest first."""
    told = answers_by_path(rows, group, model, models)
    c = F.col
    given = F.transform("answers", lambda a: a["model"])
    missing = F.transform(F.array_except("asked", given), lambda m: F.struct(m.alias("model"), F.lit("missing").alias("kind")))
    off = (
        lambda a: F.when(c("issue") == ISSUES[0], ~a["number"].eqNullSafe(T.number_or_null(c("consensus_value"))))
        .when(c("issue") == ISSUES[1], a["tokens"] != F.array_join(T.numbers(c("consensus_value")), " "))
        .when(c("issue") == ISSUES[2], a["n_words"] != F.size(T.words(c("consensus_value"))))
        .when(c("issue") == ISSUES[3], a["norm"] != c("consensus_norm"))
        .otherwise(False)
    )
    wrong = F.transform("answers", lambda a: F.struct(a["model"].alias("model"), F.when(off(a), c("issue")).alias("kind")))
    spread = told.select(F.explode(F.concat(missing, wrong)).alias("m")).select(c("m.model").alias(model), "m.kind")
    count = lambda *kinds: F.sum(F.when(c("kind").isin(*kinds), 1).otherwise(0)).cast("long")
    made = spread.groupBy(model).agg(
        count("missing").alias("missing_fields"),
        count(*ISSUES).alias("value_mismatches"),
        count(ISSUES[0]).alias("numeric_mismatches"),
        count(ISSUES[1]).alias("number_token_mismatches"),
        count(ISSUES[2]).alias("word_count_mismatches"),
    )
    order = Window.orderBy("missing_fields", "value_mismatches", "numeric_mismatches", "number_token_mismatches", "word_count_mismatches", model)
    return made.withColumn("place", F.row_number().over(order))


def gated_issues(rows: DataFrame, models: DataFrame, group: list[str], model: str) -> DataFrame:
    """(group, available, path, n_missing, issue) of every group of asked models.

    A group can be compared if at least two models' answers were parsed, whether they had leaves or not;
    one that can't be has one row without path. In the others a model whose answer
    was not parsed is missing on every path, and leaves of such a model do not count.
    """
    counted = F.sum(F.when(F.col("parsed"), 1).otherwise(0)) >= 2
    n = parts(rows, LEAVES)
    gate = models.repartition(n, *group).groupBy(*group).agg(
        counted.alias("available"), F.size(F.collect_set(model)).cast("long").alias("_n"), F.collect_set(F.when(F.col("parsed"), F.col(model))).alias("_parsed")
    )
    leaves = rows.select(*group, "path", model, "value", F.lit(True).alias("_leaf")).repartition(n, *group)
    own, given = gate.alias("g"), leaves.alias("l")
    meets = [F.col(f"g.{k}") == F.col(f"l.{k}") for k in group] + [F.col("available"), F.array_contains("_parsed", F.col(model))]
    met = own.join(given.hint("merge"), meets, "left").select(*[f"g.{k}" for k in group], "available", "_n", "_leaf", "path", model, "value")
    found = _compared(met, [*group, "available", "_n", "_leaf"], model)
    missing = F.when(F.col("_leaf"), F.col("_n") - F.col("n_given"))
    return found.select(*group, "available", "path", missing.alias("n_missing"), F.when(F.col("_leaf"), F.col("issue")).alias("issue"))


def scores(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, coverage, similarity, missing, extra, score) of actual leaves against expected ones, in percent."""
    e = expected.select(*keys, "path", F.col("value").alias("want"), F.lit(True).alias("in_expected"))
    a = actual.select(*keys, "path", F.col("value").alias("got"), F.lit(True).alias("in_actual"))
    both = e.join(a, [*keys, "path"], "full_outer").withColumn("alike", ratio(F.col("want"), F.col("got")))
    common = F.col("in_expected") & F.col("in_actual")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    told = both.groupBy(*keys).agg(
        n(F.col("in_expected")).alias("wanted"),
        n(common).alias("both"),
        n(F.col("in_expected") & F.col("in_actual").isNull()).alias("missing"),
        n(F.col("in_actual") & F.col("in_expected").isNull()).alias("extra"),
        F.avg(F.when(common, F.col("alike"))).alias("alike"),
    )
    coverage = F.when(F.col("wanted") > 0, F.round(F.col("both") / F.col("wanted") * 100, 2)).otherwise(100.0)
    similarity = F.coalesce(F.round(F.col("alike") * 100, 2), F.lit(0.0))
    return told.select(*keys, coverage.alias("coverage"), similarity.alias("similarity"), "missing", "extra", F.round(0.6 * coverage + 0.4 * similarity, 2).alias("score"))


def overall(text_similarity: Column, json_score: Column) -> Column:
    """Both scores weighed .45 and .55, or the one that there is."""
    both = F.round(0.45 * text_similarity + 0.55 * json_score, 2)
    return F.coalesce(both, text_similarity, json_score)


def run_status(raw: Column, parsed: Column) -> Column:
    """ok, repaired or failed for a model's answer and what was read from it."""
    return F.when(parsed.isNull(), "failed").when(F.try_parse_json(raw).isNotNull(), "ok").otherwise("repaired")
