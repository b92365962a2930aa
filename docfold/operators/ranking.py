"""Scores beyond the vector's: words, structure, answer shapes, sections, images and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Weights of the ranking.
VECTOR, LEXICAL, SECTION, WITH_IMAGES, EACH_QUERY, MOST_QUERIES = 0.58, 0.12, 0.05, 0.03, 0.015, 0.04
MOST_STRUCTURE, AI = 0.18, 0.18
SIMPLE_VECTOR, SIMPLE_LEXICAL = 0.8, 0.2
IMAGE_VECTOR, IMAGE_LEXICAL, IMAGE_VISUAL = 0.76, 0.16, 0.08


def word_share(query: Column, text: Column) -> Column:
    """Share of the query's words that are words of the text."""
    asked = T.tokens(query)
    return F.size(F.array_intersect(asked, T.tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def best_share(variants: Column, text: Column) -> Column:
    """The highest share of a variant's words that the text has; its words are found once."""

    def share(variant: Column, hay: Column) -> Column:
        return T.once(T.tokens(variant), lambda asked: F.size(F.array_intersect(asked, hay)) / F.greatest(F.size(asked), F.lit(1)))

    return T.once(T.tokens(text), lambda hay: F.coalesce(F.array_max(F.transform(variants, lambda v: share(v, hay))), F.lit(0.0)))


def substring_share(query: Column, text: Column, least: int) -> Column:
    """Share of the query's words, of ``least`` characters or more, that the text holds anywhere."""
    asked, low = T.tokens(query, least), F.lower(text)
    return F.size(F.filter(asked, lambda t: F.contains(low, t))) / F.greatest(F.size(asked), F.lit(1))


def simple_score(vector: Column, query: Column, text: Column, least: int = 4) -> Column:
    return SIMPLE_VECTOR * vector + SIMPLE_LEXICAL * substring_share(query, text, least)


def structural_bonus(chunk_type: Column, title: Column, content: Column, image_refs: Column, shape: Column, evidence: Column) -> Column:
    """What a chunk's build adds for the answer's shape and the evidence asked for."""
    kind = F.lower(F.coalesce(chunk_type, F.lit("")))
    has = lambda *names: F.arrays_overlap(evidence, F.array(*[F.lit(n) for n in names]))
    steps = ((shape == "steps") | has("procedure")) & (F.contains(kind, F.lit("procedure")) | (T.step_density(content) >= 0.18))
    tables = (shape.isin("parameter_list", "comparison") | has("table", "configuration", "list")) & (
        F.contains(kind, F.lit("table")) | (T.reference_density(content) >= 0.2)
    )
    rules = (shape.isin("rule", "limit") | has("policy")) & (
        F.rlike(kind, F.lit("policy|clause")) | (T.list_density(content) >= 0.18)
    )
    defines = (shape == "definition") & (T.definition_density(title, content) >= 0.18)
    figures = has("figure") & ((F.size(image_refs) > 0) | F.contains(kind, F.lit("figure")))
    total = sum((F.when(c, v).otherwise(0.0) for c, v in ((steps, 0.08), (tables, 0.08), (rules, 0.06), (defines, 0.05), (figures, 0.04))), F.lit(0.0))
    return F.least(F.lit(MOST_STRUCTURE), total)


def shape_bonus(title: Column, content: Column, shape: Column) -> Column:
    """A bounded multiple of the density that the answer's shape asks for."""
    steps, lists = T.step_density(content), T.list_density(content)
    references, numbers = T.reference_density(content), T.numeric_density(content)
    rules = {
        "steps": (0.07, steps * 0.22),
        "parameter_list": (0.08, references * 0.24),
        "comparison": (0.07, (references + lists) * 0.16),
        "limit": (0.07, (numbers + lists) * 0.14),
        "rule": (0.06, lists * 0.16),
        "definition": (0.05, T.definition_density(title, content) * 0.18),
    }
    out = F.lit(0.0)
    for name, (most, value) in rules.items():
        out = F.when(shape == name, F.least(F.lit(most), value)).otherwise(out)
    return out


def heading_penalty(title: Column, content: Column) -> Column:
    """0.06 for a title that only numbers a page, 0.03 for a short title over at most two lines."""
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    rows = F.size(F.split(F.regexp_replace(content, r"(?:\r\n|\r|\n)\z", ""), r"\r\n|\r|\n"))
    few = (content == "") | (rows <= 2)
    return F.when(F.rlike(low, F.lit(r"^page\s+\d+$")), 0.06).when((F.size(T.words(low)) <= 3) & few, 0.03).otherwise(0.0)


def ai_bonus(position: Column, n: Column) -> Column:
    """What a given ranking adds: from ``n`` ids, more the earlier; 0 for those it leaves out."""
    return F.coalesce(AI * (n - position) / n, F.lit(0.0))


def ai_candidates(rows: DataFrame, limit: int, key: str, score: str = "score") -> DataFrame:
    """(key, position, n): the candidates that a ranking model is shown, max(2 * limit, 8) at most,
    in the order of their scores, which a model's answer replaces."""
    shown = rows.select(key, score).orderBy(F.col(score).desc_nulls_last(), key).limit(max(2 * limit, 8))
    place = F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), key)) - 1
    return shown.select(key, place.alias("position"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))


def with_ai_bonus(rows: DataFrame, ranking: DataFrame, key: str) -> DataFrame:
    """Rows with the bonus that a ranking (key, position, n) of a few candidates gives them."""
    told = rows.join(F.broadcast(ranking), key, "left")  # at most max(2 * limit, 8) rows
    return told.withColumn("ai_bonus", ai_bonus(F.col("position"), F.col("n"))).drop("position", "n")


def rich_score(rows: DataFrame, question: Column, shape: Column, evidence: Column, variants: Column | None = None) -> DataFrame:
    """Adds ``rank_score`` to candidates with score, title, section_path, content, chunk_type,
    image_refs, matched_queries, image_caption_support and ai_bonus.

    With ``variants``, an array of the question's wordings, the best of them counts for the words,
    and a candidate's source and title are among the words of text and section.
    """
    section = F.array_join("section_path", " ")
    if variants is None:
        words, of_section = word_share(question, F.concat_ws(" ", "title", section, "content")), word_share(question, section)
    else:
        words = best_share(variants, F.concat_ws(" ", "title", section, "content", "source_path"))
        of_section = best_share(variants, F.concat_ws(" ", "title", section))
    score = (
        VECTOR * F.col("score")
        + LEXICAL * words
        + SECTION * of_section
        + F.when(F.size("image_refs") > 0, WITH_IMAGES).otherwise(0.0)
        + F.least(F.lit(MOST_QUERIES), EACH_QUERY * (F.size("matched_queries") - 1))
        + structural_bonus(F.col("chunk_type"), F.col("title"), F.col("content"), F.col("image_refs"), shape, evidence)
        + shape_bonus(F.col("title"), F.col("content"), shape)
        + F.col("image_caption_support")
        + F.col("ai_bonus")
        - heading_penalty(F.col("title"), F.col("content"))
    )
    return rows.withColumn("rank_score", F.round(score, 6))


def consolidate_sections(
    rows: DataFrame, source: str, section: str | Column, content: str, images: str, key: str, score: str = "rank_score", within: tuple[str, ...] = ()
) -> DataFrame:
    """The richest row of each section of a source, with the section's highest score.

    Richer means more characters, then words, then images; of equally rich rows the one ranked
    higher stays. Rows without source or section stay as they are. Each section is summed up on
    the map side to the key of its richest row, so a section of any size costs no more than one
    row for each task; ``key`` names a row, among those with the same columns ``within``. With these,
    a few candidates of one question, sections are told apart by windows, and rows are made once.
    """
    label = F.array_join(F.transform(F.filter(section, lambda x: F.trim(x) != ""), lambda x: T.section_label(x)), "\x1f")
    has_source = F.trim(F.coalesce(F.col(source), F.lit(""))) != ""
    keyed = rows.withColumn("_section", F.when(has_source & (label != ""), label))
    poorness = F.struct(
        -F.char_length(content), -F.size(T.words(F.col(content))), -F.size(images), -F.col(score), F.col(key).alias("key")
    )
    if within:
        whole = Window.partitionBy(*within, source, "_section")
        placed = keyed.withColumns({"_most": F.max(score).over(whole), "_n": F.row_number().over(whole.orderBy(poorness))})
        kept = placed.where("_section is null or _n = 1")
        return kept.withColumn(score, F.when(F.col("_section").isNull(), F.col(score)).otherwise(F.col("_most"))).drop("_section", "_most", "_n")
    apart = keyed.where("_section is null").drop("_section")
    inside = keyed.where("_section is not null")
    best = inside.groupBy(source, "_section").agg(F.min_by(key, poorness).alias("_best"), F.max(score).alias("_most"))
    kept = inside.drop("_section").join(best.select("_best", "_most"), F.col(key) == F.col("_best"))
    return kept.withColumn(score, F.col("_most")).drop("_best", "_most").unionByName(apart)


def image_score(vector: Column, question: Column, text: Column, visual: Column) -> Column:
    return IMAGE_VECTOR * vector + IMAGE_LEXICAL * word_share(question, text) + F.when(visual, IMAGE_VISUAL).otherwise(0.0)


def fallback_images(chunks: DataFrame) -> DataFrame:
    """Images that chunks refer to: the first chunk by rank counts for each path, and later
    references of a chunk score a hundredth less each."""
    spread = chunks.select("*", F.posexplode("image_refs").alias("at", "ref")).withColumn("path", F.trim("ref")).where("path <> ''")
    first = Window.partitionBy("path").orderBy("rank", "at")
    return (
        spread.withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .select(
            F.concat(F.lit("ref::"), "path").alias("image_id"),
            "document_id",
            F.col("chunk_id").alias("related_chunk_id"),
            F.col("path").alias("image_path"),
            F.greatest(F.col("score") - 0.01 * F.col("at"), F.lit(0.0)).alias("score"),
        )
    )


def image_candidates(images: DataFrame, top_chunks: DataFrame, visual: bool) -> DataFrame:
    """Images for an answer: those linked to a top chunk if any is; else, for a visual question,
    those of the same documents if any is, or all; else the chunks' own references.

    Without chunks there are none. ``top_chunks`` are at most a handful, the top of one request.
    """
    ids = top_chunks.select(F.col("chunk_id").alias("related_chunk_id"), F.lit(True).alias("by_chunk")).distinct()
    refs = top_chunks.select(F.explode("image_refs").alias("image_path"), F.lit(True).alias("by_path")).distinct()
    own = top_chunks.select("document_id", F.lit(True).alias("by_document")).distinct()
    told = images.join(F.broadcast(ids), "related_chunk_id", "left").join(F.broadcast(refs), "image_path", "left").join(F.broadcast(own), "document_id", "left")
    tier = F.when(F.col("by_chunk") | F.col("by_path"), 1)
    if visual:
        tier = tier.when(F.col("by_document"), 2).otherwise(3)
    ranked = told.withColumn("tier", tier).where("tier is not null").drop("by_chunk", "by_path", "by_document")
    least = ranked.agg(F.min("tier").alias("least"))
    chosen = ranked.join(F.broadcast(least), F.col("tier") == F.col("least")).drop("least")
    spare = fallback_images(top_chunks).join(F.broadcast(least.where("least is null")), how="left_semi", on=F.lit(True)).withColumn("tier", F.lit(4))
    nothing = top_chunks.limit(1)
    return chosen.select(*spare.columns).unionByName(spare).join(F.broadcast(nothing.select(F.lit(1).alias("_any"))), how="left_semi", on=F.lit(True))


def prompt_blocks(rows: DataFrame, label: str, rank: str = "rank") -> DataFrame:
    """(prompt): the blocks of the ranked rows of one request, numbered behind ``label``."""
    head = F.concat(F.lit(f"[{label}"), F.col(rank).cast("string"), F.lit("] "), F.concat_ws(" | ", "title", "section", "source"), F.lit("\n"), F.col("content"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), head.alias("t")))), lambda x: x["t"]), "\n\n").alias("prompt"))


def follow_ups(titles: DataFrame, template: str, generic: list[str], most: int = 3) -> DataFrame:
    """Questions made from the top rows' titles by rank, then generic ones, first of equals."""
    made = titles.where("rank <= 3 and trim(title) <> ''").select(F.col("rank").alias("place"), F.format_string(template, "title").alias("question"))
    spare = titles.sparkSession.createDataFrame([(1000 + i, q) for i, q in enumerate(generic)], "place int, question string")
    first = made.unionByName(spare).groupBy("question").agg(F.min("place").alias("place"))
    return first.orderBy("place", "question").limit(most)


def evidence_count(matched: Column, shown: Column) -> Column:
    """How many images an answer rests on: those matched, or the distinct ones that its sources show
    (an array of arrays), whichever are more."""
    distinct = F.array_distinct(F.filter(F.flatten(shown), lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.greatest(F.coalesce(matched, F.lit(0)), F.size(distinct)).cast("long")


def prompts(questions: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """(question_id, prompt): each question with its numbered text blocks [S1].. and image blocks [I1]...

    ``chunks`` has question_id, rank, title, section_path, source_path and content, ``images`` has
    question_id, rank, source_path, section_path, image_path and caption_text: a few rows of each
    for a question, as ``answering.retrieve`` finds them.
    """
    path = F.array_join("section_path", " > ")
    head = lambda label, *parts: F.concat(F.lit(f"[{label}"), F.col("rank").cast("string"), F.lit("] "), F.concat_ws(" | ", *parts), F.lit("\n"))

    def joined(rows: DataFrame, block: Column, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("t"))))
        return rows.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias(name))

    texts = joined(chunks, F.concat(head("S", "title", path, "source_path"), F.col("content")), "_texts")
    pictures = joined(images, F.concat(head("I", "source_path", path, "image_path"), F.coalesce("caption_text", F.lit(""))), "_pictures")
    told = questions.join(texts, "question_id", "left").join(pictures, "question_id", "left")
    parts = ["User question:\n", F.col("question"), "\n\nRetrieved context:\n", F.coalesce("_texts", F.lit("No matching text context.")), "\n\nRelevant images:\n", F.coalesce("_pictures", F.lit("None"))]
    return told.select("question_id", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("prompt"))
