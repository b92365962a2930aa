"""What a table of questions finds: ranked chunks and images, in one plan keyed by question.

Questions come with their wordings, each with a vector. Chunks and images are searched by all
wordings, merged by question, helped by what images say, ranked by words, structure and a given
ranking, consolidated by section and cut to the best; images follow from the chunks that are left.
Everything after the search works on a bounded number of candidates for each question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranking, retrieval
from .staging import staged

#: Chunks whose images count, and images of an answer.
TOP_CHUNKS, MOST_IMAGES = 4, 4


def candidates(vectors: DataFrame, variants: DataFrame, k: int, key: str) -> DataFrame:
    """(question_id, key, score, matched_queries): what the wordings of each question find.

    ``variants`` has question_id, variant (0 for the question itself), variant_text and
    query_embedding. The wordings that found a row stand in their order.
    """
    asked = variants.withColumn("asked", F.struct("question_id", "variant"))
    found = retrieval.search_many(vectors, asked, k, key, "asked").select("asked.question_id", "asked.variant", key, "score")
    told = found.join(variants.select("question_id", "variant", "variant_text"), ["question_id", "variant"])
    matched = F.array_sort(F.collect_set(F.struct("variant", "variant_text")))
    return told.groupBy("question_id", key).agg(F.max("score").alias("score"), F.transform(matched, lambda x: x["variant_text"]).alias("matched_queries"))


def supported(chunks: DataFrame, images: DataFrame, questions: DataFrame) -> DataFrame:
    """Chunk candidates with image_caption_support; chunks that only images speak for join with score 0."""
    told = images.where("related_chunk_id is not null").join(questions.select("question_id", "question"), "question_id")
    caption = ranking.best_share(F.array("question"), F.concat_ws(" ", "caption_text", F.array_join("section_path", " "), "source_path"))
    support = F.least(F.lit(retrieval.MOST_SUPPORT), F.col("score") * retrieval.IMAGE_WEIGHT + caption * retrieval.CAPTION_WEIGHT)
    said = told.select("question_id", F.col("related_chunk_id").alias("chunk_id"), F.round(support, retrieval.DIGITS).alias("support")).where(F.col("support") > retrieval.LEAST_SUPPORT)
    most = said.groupBy("question_id", "chunk_id").agg(F.max("support").alias("support"))
    both = chunks.join(most, ["question_id", "chunk_id"], "full_outer").join(questions.select("question_id", "question"), "question_id")
    return both.select(
        "question_id", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("matched_queries", F.array("question")).alias("matched_queries"),
        F.coalesce("support", F.lit(0.0)).alias("image_caption_support"),
    )


def ranked_chunks(found: DataFrame, chunks: DataFrame, questions: DataFrame, k: int, given: DataFrame | None = None) -> DataFrame:
    """The ``k`` best chunks of each question, with rank and rank_score.

    ``given`` (question_id, chunk_id, position, n) is a model's order of the candidates that it was
    shown; without it they count in the order of their scores.
    """
    by_score = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "chunk_id")
    if given is None:
        shown = F.least(F.count("*").over(Window.partitionBy("question_id")), F.lit(max(2 * k, 8)))
        placed = found.withColumns({"position": F.row_number().over(by_score) - 1, "n": shown})
        bonus = F.when(F.col("position") < F.col("n"), ranking.ai_bonus(F.col("position"), F.col("n"))).otherwise(0.0)
    else:
        placed = found.join(given, ["question_id", "chunk_id"], "left")
        bonus = ranking.ai_bonus(F.col("position"), F.col("n"))
    # Texts are shuffled by question once; scores, sections and ranks keep that partitioning.
    rows = placed.withColumn("ai_bonus", bonus).drop("position", "n").join(chunks, "chunk_id").repartition("question_id").join(questions.select("question_id", "question", "shape", "evidence"), "question_id")
    variants = F.array_distinct(F.concat(F.array("question"), "matched_queries"))
    scored = ranking.rich_score(rows, F.col("question"), F.col("shape"), F.col("evidence"), variants)
    kept = ranking.consolidate_sections(scored, "source_path", "section_path", "content", "image_refs", "chunk_id", within=("question_id",))
    return retrieval.top_k_by_query(kept, k, "chunk_id", "question_id", "rank_score")


def chosen_images(images: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Images of each question's answer, with their tier.

    1: linked to a top chunk, by its id or a path that it refers to; where there is none, for a
    visual question, 2: of a top chunk's document or source, or else 3: all; 4: the top chunks' own
    references, where no other tier has an image. A question without chunks has no images.
    """
    top = chunks.where(F.col("rank") <= TOP_CHUNKS)
    tops = top.groupBy("question_id").agg(
        F.collect_set("chunk_id").alias("ids"), F.collect_set("document_id").alias("documents"), F.collect_set("source_path").alias("sources"), F.flatten(F.collect_list("image_refs")).alias("refs")
    )
    told = images.join(tops, "question_id").join(questions.select("question_id", "visual"), "question_id")
    holds = lambda array, c: F.coalesce(F.array_contains(array, F.col(c)), F.lit(False))
    near = holds("documents", "document_id") | holds("sources", "source_path")
    tier = F.when(holds("ids", "related_chunk_id") | holds("refs", "image_path"), 1).when(F.col("visual"), F.when(near, 2).otherwise(3))
    tiered = told.withColumn("tier", tier).where("tier is not null")
    least = tiered.withColumn("_least", F.min("tier").over(Window.partitionBy("question_id"))).where("tier = _least")
    fields = ["question_id", "image_id", "image_path", "document_id", "source_path", "section_path", "caption_text", "score", "matched_queries", "tier"]
    spread = top.select("*", F.posexplode("image_refs").alias("at", "ref")).withColumn("image_path", F.trim("ref")).where("image_path <> ''")
    row = F.struct(
        F.concat(F.lit("ref::"), "image_path").alias("image_id"), "document_id", "source_path", "section_path", F.col("title").alias("caption_text"),
        F.greatest(F.col("rank_score") - 0.01 * F.col("at"), F.lit(0.0)).alias("score"),
    )
    first = spread.groupBy("question_id", "image_path").agg(F.min_by(row, F.struct("rank", "at")).alias("r"))
    spare = first.join(least.select("question_id").distinct(), "question_id", "left_anti")
    spare = spare.select("question_id", "image_path", "r.*", F.array().cast("array<string>").alias("matched_queries"), F.lit(4).alias("tier"))
    return least.withColumn("image_id", F.col("image_id").cast("string")).select(*fields).unionByName(spare.select(*fields))


def ranked_images(images: DataFrame, questions: DataFrame, most: int) -> DataFrame:
    """The ``most`` best images of each question, with rank and rank_score."""
    told = images.join(questions.select("question_id", "question", "visual"), "question_id")
    text = F.concat_ws(" ", "caption_text", F.array_join("section_path", " "), "source_path")
    share = ranking.best_share(F.array_distinct(F.concat(F.array("question"), "matched_queries")), text)
    score = ranking.IMAGE_VECTOR * F.col("score") + ranking.IMAGE_LEXICAL * share + F.when(F.col("visual"), ranking.IMAGE_VISUAL).otherwise(0.0)
    return retrieval.top_k_by_query(told.withColumn("rank_score", F.round(score, retrieval.DIGITS)), most, "image_id", "question_id", "rank_score")


def retrieve(questions: DataFrame, variants: DataFrame, chunks: DataFrame, images: DataFrame, k: int, given: DataFrame | None = None) -> DataFrame:
    """(question_id, kind, rank, id, score, tier): chunks and images of each question's answer.

    ``questions`` has question_id, question, shape, evidence, visual and image_embedding, the vector of
    an uploaded image or null: the images nearest to it then take the place of all others, in
    the order of their scores. ``chunks`` has chunk_id, document_id, source_path, title,
    section_path, content, chunk_type, image_refs and embedding; ``images`` has image_id, image_path,
    document_id, source_path, section_path, caption_text, related_chunk_id and embedding.
    """
    # Candidates and the best chunks are read several times; they are a few rows a question.
    found = candidates(chunks, variants, retrieval.candidate_width(k), "chunk_id")
    most = min(MOST_IMAGES, k)
    about = images.drop("embedding")
    seen = staged(candidates(images, variants, retrieval.image_width(k, MOST_IMAGES), "image_id").join(about, "image_id"))
    best = staged(ranked_chunks(supported(found, seen, questions), chunks.drop("embedding"), questions, k, given))
    shown = ranked_images(chosen_images(seen, best, questions), questions, most)
    uploaded = questions.where("image_embedding is not null").select("question_id", F.col("image_embedding").alias("query_embedding"))
    own = retrieval.search_many(images, uploaded, most, "image_id", "question_id")
    shown = shown.join(uploaded.select("question_id"), "question_id", "left_anti")
    row = lambda df, kind, key, score, tier: df.select("question_id", F.lit(kind).alias("kind"), "rank", F.col(key).cast("string").alias("id"), F.col(score).alias("score"), tier.cast("int").alias("tier"))
    return (
        row(best, "chunk", "chunk_id", "rank_score", F.lit(None))
        .unionByName(row(shown, "image", "image_id", "rank_score", F.col("tier")))
        .unionByName(row(own, "image", "image_id", "score", F.lit(0)))
    )
