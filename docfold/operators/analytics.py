"""Usage of a chat service: summaries, top questions and sources, days, export, captured events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The columns of the event table and of its export, in their order.
EVENT_COLUMNS = (
    "asked_at session_id question_text question_normalized had_image top_k success latency_ms answer_model top_source_path top_section_path retrieved_count error_message"
).split()
# Widths of the event table's texts.
WIDTHS = {"question_text": 2000, "question_normalized": 2000, "session_id": 256, "answer_model": 256, "top_source_path": 1024, "top_section_path": 2000, "error_message": 1000}


def since(events: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """Events of the last ``days`` days before ``now``, or before the latest event."""
    if now is not None:
        return events.where(F.col("asked_at") >= now - F.make_dt_interval(F.lit(days)))
    latest = events.agg(F.max("asked_at").alias("_latest"))
    recent = events.join(F.broadcast(latest), F.col("asked_at") >= F.col("_latest") - F.make_dt_interval(F.lit(days)))
    return recent.drop("_latest")


def usage_summary(events: DataFrame) -> DataFrame:
    """One row of counts and the mean latency; 0 where there is nothing."""
    count_if = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return events.agg(
        F.count("*").alias("total_questions"),
        count_if(F.col("success")).alias("successful"),
        count_if(~F.col("success")).alias("failed"),
        count_if(F.col("had_image")).alias("with_image"),
        F.countDistinct("session_id").alias("unique_sessions"),
        F.coalesce(F.round(F.avg("latency_ms"), 2), F.lit(0.0)).alias("avg_latency_ms"),
    )


def top_questions(events: DataFrame, n: int) -> DataFrame:
    """The ``n`` most asked questions, each with the least text among its latest events."""
    asked = events.where("question_normalized is not null")
    named = asked.groupBy("question_normalized", "asked_at").agg(F.min("question_text").alias("text"), F.count("*").alias("n"))
    counted = named.groupBy("question_normalized").agg(
        F.max_by("text", "asked_at").alias("question_text"), F.sum("n").alias("times_asked"), F.max("asked_at").alias("last_asked")
    )
    return counted.orderBy(F.desc("times_asked"), F.desc("last_asked"), "question_normalized").limit(n)


def top_sources(events: DataFrame, n: int) -> DataFrame:
    """The ``n`` sources and sections that successful answers cite most."""
    unknown = F.lit("(unknown)")
    cited = events.where("success").groupBy("top_source_path", "top_section_path").agg(F.count("*").alias("hits"))
    named = cited.select(F.coalesce("top_source_path", unknown).alias("source_path"), F.coalesce("top_section_path", unknown).alias("section_path"), "hits")
    return named.orderBy(F.desc("hits"), "source_path", "section_path").limit(n)


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("asked_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("questions"))


def export(events: DataFrame) -> DataFrame:
    """Rows as texts for a CSV file: nulls empty, booleans yes or no, times in seconds."""

    def shown(name: str, kind: str) -> Column:
        value = F.col(name)
        if kind == "boolean":
            value = F.when(value, "yes").when(~value, "no")
        elif kind.startswith("timestamp"):
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        return F.coalesce(value.cast("string"), F.lit("")).alias(name)

    return events.select(*[shown(c, k) for c, k in events.dtypes])


def captured(events: DataFrame) -> DataFrame:
    """Event rows cut to the table's widths; empty texts become null."""
    return events.withColumns({c: F.nullif(F.left(F.col(c), F.lit(w)), F.lit("")) for c, w in WIDTHS.items() if c in events.columns})


def recent_questions(turns: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` latest distinct questions of each session, newest first."""
    last = turns.groupBy("session_id", "question").agg(F.max("at").alias("at"))
    order = Window.partitionBy("session_id").orderBy(F.desc("at"), "question")
    return last.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def answer_events(requests: DataFrame, matches: DataFrame) -> DataFrame:
    """One event for each request, answered or failed, with EVENT_COLUMNS and request_id.

    ``requests`` has request_id, session_id, question, had_image, top_k, asked_at, finished_at,
    answer_model and failures, an array of the errors of its stages in their order, null where a
    stage went well; the first of them is the event's error, and without any it is a success.
    ``matches`` has request_id, rank, source_path and section_path of what was retrieved before
    the end or the failure.
    """
    best = F.min_by(F.struct("source_path", "section_path"), "rank")
    told = matches.groupBy("request_id").agg(F.count("*").alias("n"), best.alias("best"))
    both = requests.join(told, "request_id", "left")
    error = F.get(F.array_compact("failures"), F.lit(0))
    latency = F.unix_millis("finished_at") - F.unix_millis("asked_at")
    made = both.select(
        "request_id", "asked_at", "session_id", F.col("question").alias("question_text"), T.normalize_question(F.col("question")).alias("question_normalized"), "had_image", "top_k",
        error.isNull().alias("success"), latency.alias("latency_ms"), "answer_model", F.col("best.source_path").alias("top_source_path"),
        F.col("best.section_path").alias("top_section_path"), F.coalesce("n", F.lit(0)).alias("retrieved_count"), error.alias("error_message"),
    )
    return captured(made).select("request_id", *EVENT_COLUMNS)


def export_rows(events: DataFrame) -> DataFrame:
    """EVENT_COLUMNS as texts, numbers 0 where there are none, newest first, over ranges of time."""
    numbers = {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("top_k", "latency_ms", "retrieved_count")}
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("had_image", "success")}
    ordered = events.withColumns(numbers | flags).orderBy(F.desc("asked_at"), "session_id", "question_text")
    return export(ordered.select(*EVENT_COLUMNS))


def write_export(events: DataFrame, path: str) -> None:
    """The export as CSV: the files in the order of their names are one text, with one byte order mark
    and one header at its start. Times are sorted by ranges, so that every file is written apart."""
    rows = export(events.withColumn("_at", F.col("asked_at")).select("_at", *EVENT_COLUMNS).drop("_at"))
    line = F.to_csv(F.struct(*EVENT_COLUMNS), {"emptyValue": "", "quoteEscapeFormat": "double", "escape": '"'})
    lines = rows.select(F.lit(1).alias("part"), F.col("asked_at").alias("at"), line.alias("value"))
    head = events.sparkSession.createDataFrame([(0, "", "\ufeff" + ",".join(EVENT_COLUMNS))], "part int, at string, value string")
    head.unionByName(lines).orderBy("part", F.desc("at"), "value").select("value").write.text(path)
