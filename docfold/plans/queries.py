"""Queries over the test tables, one for each operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arabic, models
from ..functions import json as J
from ..functions import text as T
from ..functions import vectors as V
from ..operators import analytics, answering, catalog, chunking, compare, formats, images, lookup, ranking, retrieval, structure
from . import views
from .views import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The question that the retrieval queries ask, and how many of its variants have vectors.
QUESTION, VARIANTS, K = "there are onerous things with the nature of tion", 4, 10
RECENT_DAYS = 14


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# -- retrieval ----------------------------------------------------------------------------


def _scored(spark: SparkSession, d: str, n: int = 1) -> DataFrame:
    return retrieval.scored(views.chunks(spark, d), views.query_vectors(spark, d, n))


@query
def hybrid_search(spark, d):
    """Vector candidates, ranked again by the words that they hold."""
    width = retrieval.candidate_width(K)
    best = retrieval.top_k(_scored(spark, d), width, "doc_id")
    score = F.round(ranking.simple_score(F.col("score"), F.lit(QUESTION), F.concat_ws(" ", "source", "text")), 6)
    ranked = best.withColumn("rank_score", score)
    return retrieval.top_k(ranked, K, "doc_id", "rank_score").select("doc_id", "score", "rank_score", T.excerpt(F.col("text")).alias("excerpt"))


@query
def vector_topk_chunks(spark, d):
    return retrieval.top_k_by_query(_scored(spark, d, VARIANTS), 12, "doc_id").select("query_id", "rank", "doc_id", "score")


@query
def vector_topk_filtered(spark, d):
    rows = retrieval.scored(views.chunks(spark, d).where(F.col("lang").isin("de", "fr")), views.query_vectors(spark, d, 1))
    return retrieval.top_k(rows, 12, "doc_id").select("doc_id", "lang", "score")


@query
def vector_topk_images(spark, d):
    """Images, their vectors and their documents; the labelled documents stand for documents."""
    labelled = table(spark, d, "labels").select("doc_id", "quality")
    rows = retrieval.scored(views.chunks(spark, d).join(labelled, "doc_id"), views.query_vectors(spark, d, 1))
    return retrieval.top_k(rows.where("quality = 1"), retrieval.image_width(K, 4), "doc_id").select("doc_id", "quality", "score")


@query
def multi_query_merge(spark, d):
    best = retrieval.top_k_by_query(_scored(spark, d, VARIANTS), 40, "doc_id")
    return retrieval.merge_queries(best, "doc_id")


@query
def vector_topk_many(spark, d):
    """Every fiftieth vector against all vectors, in blocks."""
    rows = table(spark, d, "embeddings")
    asked = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return retrieval.search_many(rows, asked, 12, "vec_id", "query_id")


@query
def multi_query_merge_many(spark, d):
    """What the two wordings of every question find, merged by question."""
    found = answering.candidates(views.stored_chunks(spark, d), views.wordings(spark, d), 20, "chunk_id")
    return found.select("question_id", "chunk_id", "score", F.size("matched_queries").alias("n_queries"))


@query
def image_search_filtered(spark, d):
    """Every fiftieth vector against the images of documents in two languages, which play kinds of files."""
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    pictures = docs.select(F.col("doc_id").alias("image_id"), (F.col("doc_id") * 7 % 1000).alias("document_id"))
    owners = docs.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("file_type"))
    rows = retrieval.image_vectors(pictures, vectors.select(F.col("vec_id").alias("image_id"), "embedding"), owners, ["de", "fr"])
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return retrieval.search_many(rows, asked, retrieval.image_width(K, 4), "image_id", "query_id").join(rows.select("image_id", "document_id", "file_type"), "image_id")


@query
def table_search(spark, d):
    """Every fiftieth vector against one table of texts and vectors, with the beginning of each text."""
    rows = views.chunks(spark, d).select("doc_id", "text", "embedding")
    asked = table(spark, d, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found = retrieval.matched_texts(retrieval.search_many(rows, asked, 12, "doc_id", "query_id"), rows, "doc_id", "text")
    return found.select("query_id", "rank", "doc_id", "score", F.sha2("text", 256).alias("shown"))


@query
def prompts_by_question(spark, d):
    """Prompts of every question, from the nearest chunks and images of its first wording."""
    asked = views.asked(spark, d).select("question_id", "question")
    first = views.wordings(spark, d).where("variant = 0").select("question_id", "query_embedding")
    chunks, pictures = views.stored_chunks(spark, d), views.stored_images(spark, d)
    best = retrieval.search_many(chunks, first, 3, "chunk_id", "question_id").join(chunks.drop("embedding"), "chunk_id")
    seen = retrieval.search_many(pictures, first.where(F.col("question_id") % 100 == 0), 2, "image_id", "question_id").join(pictures.drop("embedding"), "image_id")
    return ranking.prompts(asked, best, seen)


@query
def answers_by_question(spark, d):
    """Chunks and images for every question of a table, from search to consolidation and images."""
    return answering.retrieve(views.asked(spark, d), views.wordings(spark, d), views.stored_chunks(spark, d), views.stored_images(spark, d), K)


@query
def lookup_by_ids(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return retrieval.by_ids(table(spark, d, "documents").select("doc_id", "lang", "source"), ids, "doc_id")


@query
def query_list(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'")
    rewrites = F.array(F.lower("text"), F.col("text"), F.lit(None).cast("string"))
    return turns.select("conv_id", "turn", F.array_join(retrieval.query_list(F.col("text"), rewrites), "|").alias("queries"))


def _profiled(spark, d) -> DataFrame:
    """All chunks as candidates with what the rich score reads."""
    best = _scored(spark, d)
    best = ranking.with_ai_bonus(best, ranking.ai_candidates(best, K, "doc_id"), "doc_id")
    return best.select(
        "doc_id",
        "score",
        F.col("source").alias("title"),
        F.array("lang", "source").alias("section_path"),
        F.col("text").alias("content"),
        F.when(F.col("label") > 4, "table_chunk").otherwise("procedure_chunk").alias("chunk_type"),
        F.when(F.col("label") > 2, F.array(F.concat(F.lit("img/"), F.col("label").cast("string")))).otherwise(F.array().cast("array<string>")).alias("image_refs"),
        F.array(F.lit(0), F.lit(1)).alias("matched_queries"),
        F.lit(0.0).alias("image_caption_support"),
        "ai_bonus",
        "lang",
        "source",
    )


@query
def hybrid_rank_rich(spark, d):
    rows = ranking.rich_score(_profiled(spark, d), F.lit(QUESTION), F.lit("limit"), F.array(F.lit("procedure"), F.lit("figure")))
    return rows.select("doc_id", "score", F.round("ai_bonus", 6).alias("ai_bonus"), "rank_score")


@query
def rank_bonuses(spark, d):
    docs = table(spark, d, "documents")
    title, text = F.col("source"), F.col("text")
    shapes = {s: F.round(ranking.shape_bonus(title, text, F.lit(s)), 6).alias(f"{s}_bonus") for s in ("steps", "parameter_list", "comparison", "limit", "rule", "definition")}
    none = F.array().cast("array<string>")
    structural = ranking.structural_bonus(F.lit("table_chunk"), title, text, none, F.lit("comparison"), F.array(F.lit("policy")))
    return docs.select("doc_id", *shapes.values(), F.round(structural, 6).alias("structural"), ranking.heading_penalty(title, text).alias("penalty"))


@query
def line_densities(spark, d):
    text = F.col("text")
    kinds = {"step": T.step_density(text), "list": T.list_density(text), "reference": T.reference_density(text), "numeric": T.numeric_density(text), "definition": T.definition_density(F.col("source"), text)}
    return table(spark, d, "documents").select("doc_id", *[F.round(v, 6).alias(f"{k}_density") for k, v in kinds.items()])


@query
def section_consolidate(spark, d):
    rows = _profiled(spark, d).withColumn("rank_score", F.col("score"))
    kept = ranking.consolidate_sections(rows, "source", F.array("lang"), "content", "image_refs", "doc_id")
    return kept.select("doc_id", "source", "lang", "rank_score")


def _images(spark, d) -> DataFrame:
    """Vectors as images that belong to the document of their label."""
    rows = retrieval.scored(table(spark, d, "embeddings"), views.query_vectors(spark, d, 1))
    return rows.select(
        F.col("vec_id").alias("image_id"),
        F.col("label").cast("bigint").alias("related_chunk_id"),
        F.concat(F.lit("img/"), F.col("vec_id").cast("string")).alias("image_path"),
        F.col("label").cast("bigint").alias("document_id"),
        "score",
    )


@query
def image_chunk_support(spark, d):
    told = _images(spark, d).withColumn("caption_score", F.least(F.lit(1.0), F.col("related_chunk_id") / 10))
    return retrieval.image_support(told).withColumn("support", F.round("support", 6))


def _top_chunks(spark, d) -> DataFrame:
    best = retrieval.top_k_by_query(_scored(spark, d), 4, "doc_id")
    refs = F.array(F.concat(F.lit("img/"), F.col("doc_id").cast("string")), F.concat(F.lit("img/"), F.col("label").cast("string")))
    return best.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), refs.alias("image_refs"), "score", "rank")


@query
def image_candidate_tiers(spark, d):
    found = ranking.image_candidates(_images(spark, d), _top_chunks(spark, d), visual=True)
    return found.select(F.col("image_id").cast("string").alias("image_id"), "image_path", "score", "tier")


@query
def image_fallback(spark, d):
    return ranking.fallback_images(_top_chunks(spark, d)).withColumn("score", F.round("score", 6))


@query
def image_rerank(spark, d):
    rows = _scored(spark, d)
    score = F.round(ranking.image_score(F.col("score"), F.lit(QUESTION), F.col("text"), F.lit(True)), 6)
    return retrieval.top_k(rows.withColumn("image_score", score), 4, "doc_id", "image_score").select("doc_id", "score", "image_score")


@query
def prompt_blocks(spark, d):
    best = retrieval.top_k_by_query(_scored(spark, d), 5, "doc_id")
    rows = best.select("rank", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("section"), "source", F.col("text").alias("content"))
    return ranking.prompt_blocks(rows, "S")


@query
def lexical_overlap(spark, d):
    """Each document's share of the question's words, whole and as parts of words."""
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        F.round(ranking.word_share(F.lit(QUESTION), text), 6).alias("whole_words"),
        F.round(ranking.substring_share(F.lit(QUESTION), text, 4), 6).alias("parts"),
        F.round(retrieval.caption_score(F.array(F.lit(QUESTION), F.lit("the table")), text, F.col("lang"), F.col("source")), 6).alias("caption"),
    )


@query
def vector_literals(spark, d):
    rows = table(spark, d, "embeddings")
    back = V.from_literal(V.literal(F.col("embedding")))
    return rows.select("vec_id", V.literal(F.col("embedding")).alias("literal"), F.round(V.norm(back), 5).alias("norm"))


# -- text ---------------------------------------------------------------------------------


@query
def query_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"), F.size(T.tokens(F.col("text"), 4)).alias("n_long"))


@query
def question_normalize(spark, d):
    text = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.normalize_question(text).alias("question"), T.section_label(text).alias("label"), T.folded(text).alias("folded"))


@query
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", arabic.normalize_text(F.col("text")).alias("text"), T.contains_arabic(F.col("text")).alias("is_arabic"))


@query
def detect_languages(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.detect_languages(F.col("text")), ",").alias("tags"))


@query
def excerpts(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.excerpt(text).alias("fixed"), T.excerpt_at_border(text).alias("at_border"))


@query
def asset_urls(spark, d):
    return table(spark, d, "pages").select("page_id", T.asset_url(F.regexp_replace("url", "^https?://[^/]+", "/data")).alias("asset"), T.title_of_path(F.regexp_replace("url", "[?#].*$", "")).alias("title"))


@query
def text_numbers(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(T.numbers(text), " ").alias("numbers"), T.step_number(text).alias("step"), T.inline_math_count(text).cast("bigint").alias("formulas"))


@query
def embedding_text(spark, d):
    docs = table(spark, d, "documents")
    made = T.embedding_text(F.col("source"), F.array("lang", "source"), F.lit("narrative_chunk"), F.lit(""), F.col("text"), F.lit("knowledge"))
    return docs.select("doc_id", F.sha2(made, 256).alias("digest"))


@query
def format_texts(spark, d):
    """Digests of the texts that are embedded for pages, slides, markup, sheets, and in French and Arabic."""
    docs = views.markup(spark, d).join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    text, path, n = F.col("text"), F.array("source", F.coalesce("lang", F.lit("-"))), F.col("doc_id")
    head = (F.col("source"), F.lit("knowledge"), path, F.lit("section_chunk"))
    none, hints = F.array().cast("array<string>"), F.array(F.lit("heading"), F.lit("paragraph"))
    parts = structure.block_artifacts(text)
    made = {
        "paged": formats.page_text(*head, n % 9, F.when(n % 2 == 0, hints).otherwise(none), text),
        "slide": formats.slide_text(*head, n % 5 + 1, hints, text),
        "markup": formats.markup_text(*head, parts, (n, n + 7), text),
        "sheet": formats.sheet_text(*head, F.lit("s"), F.lit("table"), F.when(n % 3 > 0, hints), (n % 2, n % 2 + 4), text),
        "french": formats.french_text(F.col("source"), F.lit("D-1"), path, parts["anchors"], F.when(n % 2 == 0, hints), text),
        "arabic": formats.arabic_text(F.col("source"), F.lit("الفصل الأول"), F.when(n % 2 == 0, "المادة 3"), n % 4, text),
    }
    return docs.select("doc_id", *[F.sha2(v, 256).alias(k) for k, v in made.items()])


@query
def checksum_identity(spark, d):
    """Documents by the checksum of their bytes: equal bytes are one document."""
    files = table(spark, d, "documents").select(F.col("source").alias("path"), F.col("text").cast("binary").alias("content"), "doc_id")
    return catalog.identified(files).groupBy("document_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


@query
def cleaned_lists(spark, d):
    text = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.cleaned_list(text, 3, question=True), "\n").alias("questions"))


@query
def rewrites(spark, d):
    """A turn's lines as rewrites of its first line, which is not among them."""
    text = F.col("text")
    asked = F.get(T.lines(text), F.lit(0))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.cleaned_list(text, 3, asked=asked), "\n").alias("rewrites"))


@query
def closed_labels(spark, d):
    """Labels of a closed set among the comma separated parts of a turn."""
    found = T.closed_labels(F.col("text"), ["the", "of", "de la", "und", "que", "in"])
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("labels"))


@query
def query_profiles(spark, d):
    """Profiles of turns: known labels, a known shape, and rewrites that differ by more than case."""
    known = {"intents": ["en", "de", "xx"], "evidence": ["src1", "src2", "src3"], "shapes": ["limit", "rule"]}
    text = F.col("text")
    rows = table(spark, d, "documents")
    made = retrieval.query_profile(F.array("lang", F.lit("zz")), F.array("source", F.lit("src3")), F.when(F.col("doc_id") % 2 == 0, "rule").otherwise("odd"), F.array(F.lower(text), text, F.upper("lang"), "lang", "source", F.lit("x")), known)
    return rows.select("doc_id", made.alias("p")).select("doc_id", F.array_join("p.intents", ",").alias("intents"), F.array_join("p.evidence_types", ",").alias("evidence"), F.col("p.answer_shape").alias("shape"), F.sha2(F.array_join("p.rewrites", "|"), 256).alias("rewrites"))


@query
def location_hints(spark, d):
    """Where a block stands, by the first of its places that is known."""
    rows = views.shown_blocks(spark, d).withColumn("anchor", F.col("anchor").withField("line_start", F.when(F.col("order_index") % 3 == 0, F.col("order_index").cast("int"))).withField("source_label", F.col("document_title")))
    return rows.select("doc_id", "order_index", T.location_hint(F.col("anchor")).alias("place"))


@query
def evidence_counts(spark, d):
    """Images that rest on each document: found ones, or those that its chunks show."""
    shown = views.stored_chunks(spark, d).groupBy("document_id").agg(F.collect_list("image_refs").alias("shown"))
    found = views.stored_images(spark, d).groupBy("document_id").agg(F.count("*").alias("matched"))
    return shown.join(found, "document_id", "left").select("document_id", ranking.evidence_count(F.col("matched"), F.col("shown")).alias("images"))


@query
def parse_stats(spark, d):
    """What a corpus of markup holds: documents, blocks, formulas and images."""
    rows = views.markup(spark, d)
    blocks = structure.blank_line_blocks(structure.split_lines(rows, "doc_id", "text"), ["doc_id"])
    return structure.parse_stats(blocks, "doc_id")


@query
def block_artifacts(spark, d):
    """Anchors, images, directives, labels and formulas of documents of markup."""
    parts = structure.block_artifacts(F.col("text"))
    rows = views.markup(spark, d).select("doc_id", parts.alias("p"))
    return rows.select("doc_id", *[F.array_join(f"p.{f}", ",").alias(f) for f in ("anchors", "image_refs", "directives", "equation_labels")], F.col("p.inline_math").cast("bigint").alias("inline_math"))


@query
def arabic_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", arabic.normalized(F.col("text")).alias("text"))


# -- structure and chunks -----------------------------------------------------------------


@query
def blank_line_blocks(spark, d):
    return structure.blank_line_blocks(views.lines(spark, d), ["doc_id"])


@query
def typed_blocks(spark, d):
    found = structure.typed_blocks(views.lines(spark, d), "doc_id")
    return found.withColumn("section_path", F.array_join("section_path", " > "))


@query
def sections(spark, d):
    marked = structure.underlined(views.lines(spark, d), "doc_id")
    placed = structure.sections(marked, "doc_id")
    return placed.groupBy("doc_id", "heading_line").agg(F.count("*").alias("n_lines"), F.max(F.array_join("section_path", " > ")).alias("path"))


@query
def page_units(spark, d):
    """Headings, steps, captions, tables and paragraphs of pages, with their paths across pages."""
    units = structure.page_units(views.pages(spark, d), "doc_id")
    return units.withColumn("section_path", F.array_join("section_path", " > "))


@query
def window_chunks(spark, d):
    return chunking.window_chunks(table(spark, d, "documents"), "doc_id", "text", 30, 8, "\n")


@query
def window_chunks_min_words(spark, d):
    return chunking.window_chunks(table(spark, d, "documents"), "doc_id", "text", 60, 12, "\n", least=20)


@query
def document_archetype(spark, d):
    return chunking.archetypes(views.blocks(spark, d), "doc_id")


@query
def group_blocks(spark, d):
    blocks = views.blocks(spark, d)
    grouped = chunking.group_blocks(blocks.join(chunking.archetypes(blocks, "doc_id"), "doc_id"), "doc_id")
    return grouped.select("doc_id", "order_index", "group")


@query
def build_chunks(spark, d):
    made = chunking.build_chunks(views.blocks(spark, d), "doc_id", "document_title")
    return made.select("doc_id", "chunk_index", "chunk_id", "chunk_type", F.array_join("block_ids", ",").alias("block_ids"), "content")


@query
def image_blocks(spark, d):
    """Blocks of images from what a model told of them."""
    made = structure.image_blocks(views.image_analyses(spark, d), "doc_id")
    return made.withColumn("section_path", F.array_join("section_path", " > "))


@query
def segment_blocks(spark, d):
    """Blocks of even documents, and segments of the others as blocks."""
    own = views.blocks(spark, d).where(F.col("doc_id") % 2 == 0).select("doc_id", "block_id", "block_type", "order_index", "text")
    return chunking.materialized(own, views.segments(spark, d), "doc_id")


@query
def strategy_chunks(spark, d):
    """Chunks of files of all kinds, each by the strategy that its hint or kind asks for."""
    made = formats.dispatched_chunks(views.filed_blocks(spark, d), "doc_id")
    return made.withColumn("block_ids", F.array_join("block_ids", ","))


def _chunk_rows(spark, d) -> DataFrame:
    return chunking.chunk_rows(views.shown_blocks(spark, d), views.shown_documents(spark, d), "doc_id")


@query
def chunk_attributes(spark, d):
    """Chunk rows with the merged attributes of their groups of blocks."""
    made = _chunk_rows(spark, d)
    listed = lambda c: F.array_join(c, ",")
    metadata = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return made.select(
        "doc_id", "chunk_index", "chunk_type", "title", listed("section_path").alias("path"), F.col("anchor.page_number").alias("page_number"), listed("language_tags").alias("languages"),
        metadata.alias("metadata"), listed("image_refs").alias("image_refs"), F.sha2("embedding_text", 256).alias("embedded"),
    )


@query
def chunk_image_rows(spark, d):
    """Images of documents with the first chunk that shows them, and those that none shows."""
    chunks = _chunk_rows(spark, d)
    rows = chunking.image_rows(chunks, views.shown_documents(spark, d), "doc_id")
    listed = {c: F.array_join(c, ",") for c in ("related_section_path", "related_block_ids", "language_tags")}
    return rows.withColumns(listed)


@query
def block_window_overlap(spark, d):
    """Blocks between empty lines against windows of fifty lines."""
    blocks = structure.blank_line_blocks(views.lines(spark, d), ["doc_id"])
    windows = views.lines(spark, d).groupBy("doc_id", F.floor(F.col("line_no") / 50).alias("window")).agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    return chunking.overlapping_blocks(blocks.select("doc_id", "block", "first_line", "last_line"), windows, ["doc_id"]).select("doc_id", "block", "window")


def _pictures(spark, d) -> DataFrame:
    """Parts as images of their brand's document."""
    p = table(spark, d, "part")
    path = F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, ".png").when(F.col("p_size") % 3 == 1, ".JPG").otherwise(".txt"))
    return p.select(
        "p_brand", "p_partkey", F.col("p_partkey").cast("string").alias("image_id"), F.col("p_type").alias("digest"), (F.col("p_size") * 10).alias("width"), F.floor("p_retailprice").cast("int").alias("height"),
        path.alias("image_path"), F.when(F.col("p_size") % 4 == 0, F.col("p_name")).when(F.col("p_size") % 4 == 1, "  ").alias("caption_text"), F.when(F.col("p_size") % 5 > 0, F.col("p_type")).alias("location"),
    )


@query
def unique_images(spark, d):
    """The first picture of each type of a brand."""
    return images.unique_images(_pictures(spark, d), "p_brand", "digest", "p_partkey").select("p_brand", "digest", "p_partkey")


@query
def image_captions(spark, d):
    """Captions of pictures: their own, or made from their place, or by a model for the first of a brand."""
    told = images.captions(_pictures(spark, d), "p_brand", "p_partkey", 4, lambda path: F.concat(F.lit("seen "), path))
    return told.select("p_partkey", "caption_text")


@query
def existing_images(spark, d):
    """Pictures whose raster files are listed."""
    files = _pictures(spark, d).where(F.col("p_partkey") % 2 == 0).select(F.col("image_path").alias("path"))
    return images.existing(_pictures(spark, d), files).select("p_partkey", "image_path")


@query
def drop_counts(spark, d):
    return images.reasons_by_document(images.drop_reasons(_pictures(spark, d), "p_brand"), "p_brand")


@query
def pruned_blocks(spark, d):
    """Blocks of brands with the pictures that stay; figures that are left with nothing go."""
    told = images.drop_reasons(_pictures(spark, d), "p_brand")
    kind = F.when(F.col("p_partkey") % 10 == 0, "heading").otherwise("figure")
    blocks = told.select("p_brand", "p_partkey", kind.alias("block_type"), F.when(F.col("p_partkey") % 4 == 0, F.lit("told")).otherwise(" ").alias("text"), F.array("image_id", F.lit("other")).alias("image_ids"))
    blocks = blocks.withColumn("image_ids", F.when(F.col("p_partkey") % 3 == 0, F.slice("image_ids", 1, 1)).otherwise(F.col("image_ids")))
    return images.prune(blocks, told, "p_brand").select("p_partkey", "block_type", F.array_join("image_ids", ",").alias("image_ids"))


@query
def linked_images(spark, d):
    """Pictures of documents with the first chunk whose blocks show them."""
    blocks = views.shown_blocks(spark, d)
    shown = blocks.select("doc_id", "block_id", F.explode("images").alias("i")).select("doc_id", "block_id", F.col("i.image_path").alias("image_path"))
    chunks = chunking.build_chunks(views.blocks(spark, d), "doc_id", "document_title").select("doc_id", "chunk_id", "chunk_index", "block_ids")
    own = views.shown_documents(spark, d).select("doc_id", F.explode("images").alias("i")).select("doc_id", F.col("i.image_path").alias("image_path"))
    return images.linked(own, shown, chunks, "doc_id")


@query
def image_anchors(spark, d):
    """The block of each page that its images belong to."""
    units = structure.page_units(views.pages(spark, d), "doc_id").withColumn("block_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("order_index").cast("string")))
    return structure.image_anchor(units, ["doc_id", "page_number"])


@query
def pages_to_render(spark, d):
    """Pages without images that hold many drawings or speak of figures, three of each document."""
    pages = views.pages(spark, d).withColumns({
        "embedded_images": F.char_length("text") % 2, "drawings": F.char_length("text") % 50, "has_keyword": F.contains("text", F.lit("Note 7")),
    })
    return structure.pages_to_render(pages, "doc_id", 3).select("doc_id", "page_number")


@query
def chapter_lines(spark, d):
    """Lines of rules with their chapters and articles."""
    n = F.col("line_no")
    line = F.when(n % 15 == 2, F.concat(F.lit("الفصل "), n.cast("string"))).when(n % 6 == 4, F.concat(F.lit("المادة ("), n.cast("string"), F.lit(")"))).when(n % 17 == 5, F.lit("المادة 3. نص")).otherwise(F.col("line"))
    rows = views.lines(spark, d).withColumns({"page_number": F.floor(n / 20), "is_contents": n % 40 == 7, "line": line})
    found = structure.chapter_machine(rows, "doc_id")
    return found.select("doc_id", "line_no", "chapter", "article")


@query
def page_lines(spark, d):
    """Lines without blank ones, the running header and page numbers."""
    n = F.col("line_no")
    line = F.when(n % 5 == 0, F.lit(" Header ")).when(n % 5 == 1, n.cast("string")).when(n % 5 == 2, F.lit("٣٤")).otherwise(F.col("line"))
    return structure.clean_page_lines(views.lines(spark, d).withColumn("line", line), "Header").select("doc_id", "line_no")


@query
def slide_chunks(spark, d):
    """Windows over slides of eight blocks."""
    blocks = views.blocks(spark, d).withColumn("slide_number", F.floor(F.col("order_index") / 8).cast("int"))
    made = formats.slide_chunks(blocks, "doc_id", 60, 12)
    return made.select("doc_id", "slide_number", "chunk_index", "chunk_type", F.array_join("block_types", ",").alias("block_types"), "content")


@query
def line_windows(spark, d):
    """Windows over blocks that carry back lines."""
    docs = table(spark, d, "documents")
    blocks = F.filter(F.split("text", r"\. "), lambda x: x != "")
    made = docs.select("doc_id", F.posexplode(chunking.line_overlap_windows(blocks, 40, 8)).alias("place", "content"))
    return made


@query
def section_places(spark, d):
    """The sections of each page, in the order in which they begin, with their blocks."""
    blocks = views.filed_blocks(spark, d)
    hints = formats.structure_hints(blocks, "doc_id", "page_number")
    return hints.select("doc_id", "page_number", "place", F.array_join("section_path", " > ").alias("path"), F.array_join("block_ids", ",").alias("block_ids"))


@query
def paired_rows(spark, d):
    """Chunks with their vectors, of those ids that both have."""
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    both = docs.join(vectors, "doc_id", "left_semi").select("doc_id", "lang")
    return catalog.paired(both, vectors.join(docs, "doc_id", "left_semi"), "doc_id")


@query
def run_statuses(spark, d):
    """What became of a model's answer, and both scores of it as one."""
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Sure: "), F.col("props"))).when(k == 2, "no object").otherwise("")
    status = compare.run_status(raw, F.to_json(J.object_in(raw)))
    text, json_score = F.when(k < 3, F.col("value")), F.when(k > 1, F.col("value"))
    return e.select("event_id", status.alias("status"), F.round(compare.overall(text, json_score), 2).alias("overall"))


@query
def image_prune(spark, d):
    """Parts as images of their brand's document, sized by price and size."""
    p = table(spark, d, "part")
    sized = p.select("p_partkey", "p_brand", F.col("p_type").alias("digest"), (F.col("p_size") * 10).alias("width"), F.floor("p_retailprice").cast("int").alias("height"))
    return images.drop_reasons(sized, "p_brand").select("p_partkey", "drop_reason")


def _sheet_rows(spark, d) -> DataFrame:
    """Line items as rows of a sheet for each order; a returned item's row is empty."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("row_no")).agg(F.max("l_returnflag").alias("flag"), F.max("l_quantity").alias("quantity"), F.max("l_tax").alias("tax"))
    full = F.array("flag", F.when(F.col("quantity") > 25, F.col("quantity").cast("int").cast("string")).otherwise("few"), F.when(F.col("tax") > 0.04, "taxed").otherwise(" "))
    return items.select("l_orderkey", "row_no", F.when(F.col("flag") == "R", F.array(F.lit(""), F.lit(" "))).otherwise(full).alias("cells"))


@query
def regions(spark, d):
    return structure.region_types(structure.regions(_sheet_rows(spark, d), ["l_orderkey"]), ["l_orderkey"])


@query
def region_titles(spark, d):
    placed = structure.regions(_sheet_rows(spark, d), ["l_orderkey"])
    return structure.region_titles(placed, structure.region_types(placed, ["l_orderkey"]), ["l_orderkey"], "l_orderkey")


@query
def page_chunks(spark, d):
    """Blocks with a page for every hundred lines."""
    blocks = views.blocks(spark, d).withColumn("page_number", F.floor(F.col("order_index") / 100).cast("int"))
    # Texts are shuffled here, by document, and not again.
    told = blocks.repartition("doc_id").join(chunking.archetypes(views.blocks(spark, d), "doc_id"), "doc_id")
    made = formats.page_chunks(told, "doc_id")
    return made.select("doc_id", "page_number", "chunk_index", "chunk_type", F.size("block_ids").alias("n_blocks"), "content")


@query
def markup_chunks(spark, d):
    made = formats.markup_chunks(views.lines(spark, d), "doc_id", chunking.archetypes(views.blocks(spark, d), "doc_id"))
    return made.select("doc_id", "chunk_index", "chunk_type", F.array_join("section_path", " > ").alias("path"), "content")


@query
def sheet_chunks(spark, d):
    """Each customer's orders as the rows of a sheet."""
    o = table(spark, d, "orders")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = o.select(F.col("o_custkey").alias("doc_id"), F.lit("orders").alias("sheet_name"), number.alias("row_no"), F.array("o_orderpriority", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("cells"))
    return formats.sheet_chunks(rows, "doc_id")


@query
def answer_shapes(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'")
    intents = F.when(F.contains("text", F.lit("que")), F.array(F.lit("reference"))).when(F.contains("text", F.lit("the")), F.array(F.lit("regulatory"))).otherwise(F.array(F.lit("technical")))
    return turns.select("conv_id", "turn", retrieval.default_shape(intents, F.col("text")).alias("shape"))


@query
def follow_ups(spark, d):
    best = retrieval.top_k_by_query(_scored(spark, d), 3, "doc_id").select("rank", F.col("source").alias("title"))
    return ranking.follow_ups(best, "What else does %s say?", ["Where does it apply?", "Who is concerned?", "What changed?"])


@query
def embedded_texts(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.round(V.norm(models.embedded(F.col("text"), models.hashed_vectors)), 4).alias("norm"))


@query
def document_list(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id")


@query
def priority_pick(spark, d):
    s = table(spark, d, "supplier")
    return lookup.by_priority(s, F.when(F.col("s_acctbal") > 0, 0).otherwise(1), F.col("s_nationkey"), F.col("s_suppkey"), n=1).select("s_suppkey", "s_nationkey")


# -- store --------------------------------------------------------------------------------


@query
def doc_upsert(spark, d):
    old = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    new = table(spark, d, "labels").select("doc_id", F.lit("xx").alias("lang"), F.col("quality").cast("bigint").alias("n_chars"))
    return catalog.upsert(old, new, "doc_id")


@query
def doc_upsert_times(spark, d):
    """Rows that are replaced keep the time of their making and get that of the change."""
    at = lambda s: F.timestamp_seconds(s)
    old = table(spark, d, "documents").select("doc_id", "lang", at(F.col("doc_id")).alias("created_at"), at(F.col("doc_id")).alias("updated_at"))
    new = table(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id"), F.lit("xx").alias("lang"), at(F.lit(5_000)).alias("created_at"))
    return catalog.upsert(old, new, "doc_id", "created_at", "updated_at", at(F.lit(1_000_000)))


@query
def file_digests(spark, d):
    content = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, d, "documents").select("doc_id", catalog.file_digest(content).alias("digest"), F.sha2(content, 256).alias("checksum"))


@query
def counts_of_any(spark, d):
    """Rows of tables, also of one that is not there."""
    return catalog.counts({n: catalog.table_or_none(spark, f"{d}/{n}.parquet") for n in ("documents", "no_such_table", "labels")})


@query
def doc_replace(spark, d):
    old = table(spark, d, "conversations").select("conv_id", "turn", "role")
    gone = old.where("role = 'system'").select("conv_id")
    new = gone.distinct().select("conv_id", F.lit(0).cast("bigint").alias("turn"), F.lit("replaced").alias("role"))
    return catalog.replace_children(old, new, gone, "conv_id")


@query
def doc_cascade_delete(spark, d):
    deleted = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    tables = {"documents": (table(spark, d, "documents"), "doc_id"), "embeddings": (table(spark, d, "embeddings"), "vec_id"), "labels": (table(spark, d, "labels"), "doc_id")}
    return catalog.counts(catalog.cascade_delete(tables, deleted, "doc_id"))


@query
def corpus_counts(spark, d):
    return catalog.counts({n: table(spark, d, n) for n in ("documents", "embeddings", "labels", "pages")})


@query
def document_counts(spark, d):
    children = {"n_vectors": (table(spark, d, "embeddings"), "vec_id"), "n_labels": (table(spark, d, "labels"), "doc_id")}
    return catalog.counts_by_document(table(spark, d, "documents"), "doc_id", children)


# -- analytics ----------------------------------------------------------------------------


@query
def usage_summary(spark, d):
    return analytics.usage_summary(analytics.since(views.chat_events(spark, d), RECENT_DAYS))


@query
def top_questions(spark, d):
    return analytics.top_questions(views.chat_events(spark, d), 10).withColumn("last_asked", T.iso_seconds(F.col("last_asked")))


@query
def top_sources(spark, d):
    return analytics.top_sources(views.chat_events(spark, d), 10)


@query
def daily_counts(spark, d):
    return analytics.daily_counts(views.chat_events(spark, d))


@query
def analytics_export(spark, d):
    rows = views.chat_events(spark, d).select("asked_at", "session_id", "question_text", "had_image", "success", "top_source_path")
    return analytics.export(rows)


@query
def event_capture(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("question_text"), F.col("text").alias("error_message"), F.col("role").alias("session_id"))
    return analytics.captured(rows)


@query
def answer_events(spark, d):
    """Events of answered and failed requests, with latency, best match, count and error."""
    return analytics.answer_events(views.requests(spark, d), views.request_matches(spark, d))


@query
def analytics_export_rows(spark, d):
    """All columns of the events as the export shows them, newest first."""
    return analytics.export_rows(analytics.answer_events(views.requests(spark, d), views.request_matches(spark, d)))


@query
def recent_queries(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'")
    asked = turns.select(F.col("conv_id").alias("session_id"), F.col("text").alias("question"), F.col("turn").alias("at"))
    return analytics.recent_questions(asked)


# -- JSON ---------------------------------------------------------------------------------


@query
def json_columns(spark, d):
    e = table(spark, d, "events")
    listed = F.concat(F.lit("['"), F.col("event_type"), F.lit("','x']"))
    answer = F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))
    return e.select("event_id", F.array_join(J.string_list(listed), ",").alias("listed"), F.size(J.string_list(F.col("props"))).alias("none"), F.to_json(J.object_in(answer)).alias("object"), J.repaired(answer)["status"].alias("status"))


@query
def json_leaves(spark, d):
    nested = F.to_json(F.struct("doc_id", F.struct("lang", F.array("source", "lang").alias("list")).alias("inner")))
    rows = table(spark, d, "documents").select("doc_id", nested.alias("j"))
    return compare.leaf_rows(rows, ["doc_id"], "j")


@query
def json_consensus(spark, d):
    return compare.consensus(views.model_leaves(spark, d), ["o_orderkey"], "model")


@query
def json_issues(spark, d):
    return compare.issues(views.model_leaves(spark, d), ["o_orderkey"], "model").where("issue is not null or n_missing > 0")


@query
def json_issues_gated(spark, d):
    """Issues where at least two models' answers were parsed; asked models that gave nothing are missing."""
    found = compare.gated_issues(views.model_leaves(spark, d), views.asked_models(spark, d), ["o_orderkey"], "model")
    return found.where("issue is not null or n_missing > 1 or not available")


@query
def json_model_summary(spark, d):
    return compare.model_summary(views.model_leaves(spark, d), ["o_orderkey"], "model")


@query
def json_score(spark, d):
    rows = views.model_leaves(spark, d)
    keys = ["o_orderkey"]
    return compare.scores(rows.where("model = 'a'").select(*keys, "path", "value"), rows.where("model = 'c'").select(*keys, "path", "value"), keys)


# -- look-ups -----------------------------------------------------------------------------


@query
def two_hop_lookup(spark, d):
    """Customers' segments and nations to regions: a nation's name is an alias of its region's."""
    asked = table(spark, d, "nation").select(F.concat(F.lit(" "), F.upper("n_name")).alias("place")).unionByName(table(spark, d, "customer").select(F.col("c_mktsegment").alias("place")).distinct())
    aliases = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("alias"), F.col("r_name").alias("name"))
    records = table(spark, d, "region").select(F.col("r_name").alias("name"), "r_regionkey")
    return lookup.two_hop(asked, aliases, records, "place")


@query
def record_rendering(spark, d):
    return lookup.rendered(table(spark, d, "nation"), "n_name", ["n_nationkey", "n_regionkey"], ["n_regionkey"])


@query
def latest_active(spark, d):
    return lookup.latest_active(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "F", "o_orderdate", "o_orderkey")
