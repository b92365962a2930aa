"""Blocks to chunks: groups, overlapping windows, types and the rows that are stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words by which documents are told apart, and kinds of blocks.
REGULATORY = "policy standard governance compliance control shall must".split()
PROCEDURAL = "procedure step runbook rollback prerequisite verify".split()
TECHNICAL = "architecture design component interface topology diagram".split()
REFERENCE = "faq reference parameter command field".split()
MERGING = "regulatory knowledge technical reference mixed_multimodal".split()
STEPS, TABLES, PICTURES = ["step", "list_item"], ["table", "table_row"], ["figure", "caption"]
PROSE = ["paragraph", "note", "warning", "caption", "figure"]

#: Numbers of groups that are gathered before they are put aside.
PART = 256
ITEM = "struct<text:string,n:int,id:string>"


def fold_windows(items: Column, most: int, overlap: int) -> Column:
    """Windows of items (struct text, n words, id), each an array of items.

    Items are added while the words stay within ``most``; then the window is given out, and its
    last items, until they hold ``overlap`` words, open the next one. An item is never cut, and
    what is carried over does not count against the limit.
    """
    none = F.array().cast(f"array<{ITEM}>")
    state = F.struct(F.array().cast(f"array<array<{ITEM}>>").alias("out"), none.alias("cur"), F.lit(0).alias("n"))

    def carried(current: Column) -> Column:
        start = F.struct(none.alias("keep"), F.lit(0).alias("n"))

        def back(acc: Column, item: Column) -> Column:
            longer = F.struct(F.concat(F.array(item), acc["keep"]).alias("keep"), (acc["n"] + item["n"]).alias("n"))
            return F.when(acc["n"] >= overlap, acc).otherwise(longer)

        return F.aggregate(F.reverse(current), start, back) if overlap > 0 else start

    def add(s: Column, item: Column) -> Column:
        kept = carried(s["cur"])
        onward = F.struct(
            F.concat(s["out"], F.array(s["cur"])).alias("out"),
            F.concat(kept["keep"], F.array(item)).alias("cur"),
            (kept["n"] + item["n"]).alias("n"),
        )
        within = F.struct(s["out"].alias("out"), F.concat(s["cur"], F.array(item)).alias("cur"), (s["n"] + item["n"]).alias("n"))
        return F.when((F.size(s["cur"]) > 0) & (s["n"] + item["n"] > most), onward).otherwise(within)

    return F.aggregate(items, state, add, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))


def paragraphs(text: Column, border: str = r"\n\n") -> Column:
    """The trimmed paragraphs of a text as items; their ids are their numbers from 0."""
    parts = F.filter(F.transform(F.split(text, border), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p, i: F.struct(p.alias("text"), F.size(T.words(p)).alias("n"), i.cast("string").alias("id")))


def window_chunks(docs: DataFrame, doc: str, text: str, most: int = 220, overlap: int = 40, border: str = r"\n\n", least: int = 0) -> DataFrame:
    """(doc, chunk_index, n_words, content): windows over each text's paragraphs.

    Windows of fewer than ``least`` words are dropped before chunks are numbered. A document is
    folded inside its own row, so nothing is shuffled.
    """
    made = docs.select(doc, fold_windows(paragraphs(F.col(text), border), most, overlap).alias("windows"))
    shaped = F.transform(
        "windows",
        lambda w: F.struct(
            F.aggregate(w, F.lit(0), lambda total, x: total + x["n"]).alias("n_words"),
            F.array_join(F.transform(w, lambda x: x["text"]), "\n\n" if border == r"\n\n" else "\n").alias("content"),
        ),
    )
    kept = F.filter(shaped, lambda w: w["n_words"] >= least)
    return made.select(doc, F.posexplode(kept).alias("chunk_index", "w")).select(doc, "chunk_index", "w.n_words", "w.content")


def block_windows(blocks: DataFrame, keys: list[str], order: str, most: int, overlap: int) -> DataFrame:
    """(keys, window, block_ids, content) over the ordered blocks (block_id, text) of each key,
    which is one section or page of a document."""
    item = F.struct(F.col("text"), F.size(T.words(F.col("text"))).alias("n"), F.col("block_id").alias("id"))
    ordered = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("item")))).alias("rows"))
    windows = fold_windows(F.transform("rows", lambda r: r["item"]), most, overlap)
    spread = ordered.select(*keys, F.posexplode(windows).alias("window", "w"))
    ids = F.transform("w", lambda x: x["id"]).alias("block_ids")
    return spread.select(*keys, "window", ids, F.array_join(F.transform("w", lambda x: x["text"]), "\n\n").alias("content"))


def window_row(order: str) -> Column:
    """A block as ``typed_windows`` reads it."""
    return F.struct(F.col(order).alias("o"), F.col("text"), F.size(T.words(F.col("text"))).alias("n"), F.col("block_id").alias("id"), F.col("block_type").alias("kind"))


def typed_windows(gathered: DataFrame, kept: list[str], most: int, overlap: int) -> DataFrame:
    """(kept, window, block_ids, content, block_types) over the gathered blocks of each row, in order.

    ``rows`` holds what ``window_row`` gives. Items carry their places, so that windows find their
    blocks' ids and types in their own row and nothing is joined.
    """
    ordered = gathered.select(*kept, F.array_sort("rows").alias("rows"))
    items = F.transform("rows", lambda r, i: F.struct(r["text"].alias("text"), r["n"].alias("n"), i.cast("string").alias("id")))
    own = lambda w, name: F.transform(w, lambda x: F.get(F.col("rows"), x["id"].cast("int"))[name])
    shaped = F.transform(
        fold_windows(items, most, overlap),
        lambda w: F.struct(
            own(w, "id").alias("block_ids"),
            F.array_join(F.transform(w, lambda x: x["text"]), "\n\n").alias("content"),
            F.array_sort(F.array_distinct(F.array_compact(own(w, "kind")))).alias("block_types"),
        ),
    )
    return ordered.select(*kept, F.posexplode(shaped).alias("window", "w")).select(*kept, "window", "w.*")


def line_overlap_windows(blocks: Column, most: int, overlap: int) -> Column:
    """Windows that carry back lines, not blocks: each block is one item of several lines, and
    the lines of the last window that hold ``overlap`` words open the next. Gives texts."""
    none = F.array().cast("array<string>")
    state = F.struct(none.alias("out"), none.alias("cur"), F.lit(0).alias("n"))
    count = lambda lines: F.aggregate(lines, F.lit(0), lambda t, x: t + F.size(T.words(x)))

    def carried(lines: Column) -> Column:
        start = F.struct(none.alias("keep"), F.lit(0).alias("n"))
        step = lambda a, x: F.when(a["n"] >= overlap, a).otherwise(
            F.struct(F.concat(F.array(x), a["keep"]).alias("keep"), (a["n"] + F.size(T.words(x))).alias("n"))
        )
        return F.aggregate(F.reverse(lines), start, step)["keep"]

    def add(s: Column, block: Column) -> Column:
        own = F.split(block, "\n")
        whole = F.array_join(s["cur"], "\n")
        kept = F.concat(carried(s["cur"]), F.array(F.lit("")), own)
        onward = F.struct(F.concat(s["out"], F.array(whole)).alias("out"), kept.alias("cur"), count(kept).alias("n"))
        more = F.when(F.size(s["cur"]) > 0, F.concat(s["cur"], F.array(F.lit("")), own)).otherwise(own)
        within = F.struct(s["out"].alias("out"), more.alias("cur"), (s["n"] + count(own)).alias("n"))
        return F.when((F.size(s["cur"]) > 0) & (s["n"] + count(own) > most), onward).otherwise(within)

    return F.aggregate(
        blocks, state, add, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(F.array_join(s["cur"], "\n")))).otherwise(s["out"])
    )


def _any_word(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def archetypes(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, archetype) from blocks (block_type, text, sheet_name, slide_number, n_images)."""
    low = F.col("_low")
    ever = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    kind = F.col("block_type")
    told = blocks.withColumn("_low", F.lower(F.coalesce("text", F.lit("")))).groupBy(doc).agg(
        ever(F.col("sheet_name").isNotNull() | kind.isin(TABLES)).alias("tabular"),
        ever(F.col("slide_number").isNotNull()).alias("slides"),
        ever(kind.isin(PICTURES) | (F.col("n_images") > 0)).alias("pictures"),
        ever(_any_word(low, REGULATORY)).alias("regulatory"),
        (ever(_any_word(low, PROCEDURAL)) | (F.sum((kind == "step").cast("int")) >= 2)).alias("procedural"),
        ever(_any_word(low, TECHNICAL)).alias("technical"),
        ever(_any_word(low, REFERENCE)).alias("reference"),
    )
    c = F.col
    return told.select(
        doc,
        F.when(c("tabular"), "tabular")
        .when(c("slides"), "presentation")
        .when(c("pictures") & (c("regulatory") | c("procedural") | c("technical")), "mixed_multimodal")
        .when(c("procedural"), "procedural")
        .when(c("regulatory"), "regulatory")
        .when(c("technical"), "technical")
        .when(c("reference"), "reference")
        .otherwise("knowledge")
        .alias("archetype"),
    )


def group_blocks(blocks: DataFrame, doc: str) -> DataFrame:
    """Adds group: a number for the blocks of a document that form one chunk, in order.

    ``blocks`` has archetype, order_index, block_type and section_path. Headings go with the block
    after them. A step or list item takes what follows in its section up to the next one; prose
    of merging kinds of documents takes what follows up to a step or table; elsewhere a figure or
    caption takes the next block. What a block may take depends on the block that leads its group
    alone, so one fold over a document's blocks carries that leader along. A document's blocks are
    gathered once and leave with their numbers, partitioned by document, so that what follows shuffles nothing.
    """
    leader = "struct<kind:string,path:string,mode:string>"
    # Numbers are gathered in parts, so that a step copies no more than one part.
    part = "array<int>"
    path = F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), "\x1f")
    row = F.struct(F.col("order_index").alias("o"), F.col("block_type").alias("kind"), path.alias("path"), F.col("archetype").alias("archetype"))
    # Both lists are in the same order; the places of the sorted ones lead from one to the other.
    kept = F.struct(*[c for c in blocks.columns if c != doc])
    whole = blocks.groupBy(doc).agg(F.collect_list(kept).alias("kept"), F.collect_list(row).alias("told"))
    places = F.transform(F.array_sort(F.transform("told", lambda r, i: F.struct(r["o"].alias("o"), i.alias("i")))), lambda x: x["i"])
    whole = whole.withColumn("places", places).withColumn("rows", F.transform("places", lambda i: F.get("told", i)))
    state = F.struct(
        F.array().cast(f"array<{part}>").alias("out"), F.array().cast(part).alias("now"), F.lit(-1).alias("g"), F.lit(None).cast(leader).alias("lead"), F.lit(False).alias("pending")
    )

    def takes(lead: Column, b: Column) -> Column:
        same = lead["path"] == b["path"]
        steps = (lead["mode"] == "step") & b["kind"].isin(PROSE)
        prose = (lead["mode"] == "prose") & ~b["kind"].isin([*STEPS, *TABLES])
        return lead.isNotNull() & same & (steps | prose | (lead["mode"] == "next"))

    def mode(b: Column) -> Column:
        return (
            F.when(b["kind"].isin(STEPS), "step")
            .when(b["archetype"].isin(MERGING) & b["kind"].isin(PROSE), "prose")
            .when(b["kind"].isin(PICTURES), "next")
            .otherwise("alone")
        )

    def add(s: Column, b: Column) -> Column:
        heading = b["kind"] == "heading"
        joins = ~heading & ~s["pending"] & F.coalesce(takes(s["lead"], b), F.lit(False))
        # A heading opens a group if none is pending; a block then completes it or opens its own.
        new = ~joins & ~s["pending"]
        g = F.when(new, s["g"] + 1).otherwise(s["g"])
        spent = F.struct(s["lead"]["kind"].alias("kind"), s["lead"]["path"].alias("path"), F.when(s["lead"]["mode"] == "next", "alone").otherwise(s["lead"]["mode"]).alias("mode"))
        own = F.struct(b["kind"].alias("kind"), b["path"].alias("path"), mode(b).alias("mode"))
        lead = F.when(heading, F.lit(None).cast(leader)).when(joins, spent).otherwise(own)
        full = F.size(s["now"]) >= PART
        out = F.when(full, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"])
        now = F.when(full, F.array(g)).otherwise(F.concat(s["now"], F.array(g)))
        return F.struct(out.alias("out"), now.alias("now"), g.alias("g"), lead.cast(leader).alias("lead"), heading.alias("pending"))

    gathered = F.aggregate("rows", state, add, lambda s: F.flatten(F.concat(s["out"], F.array(s["now"]))))
    numbered = F.zip_with("places", "groups", lambda i, g: F.struct(F.get("kept", i).alias("row"), g.alias("group")))
    spread = whole.withColumn("groups", gathered).select(doc, F.explode(numbered).alias("b"))
    return spread.select(doc, "b.row.*", "b.group")


def chunk_type(kinds: Column, archetype: Column, has_slide: Column) -> Column:
    """The type of a group from the set of its blocks' types."""
    has = lambda *names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    several = F.size(F.array_distinct(kinds)) > 1
    return (
        F.when(has_slide, "slide_chunk")
        .when(has("table_row"), "row_chunk")
        .when(has("table"), "table_chunk")
        .when(has("code"), "code_chunk")
        .when(has(*PICTURES), F.when(several, "figure_explainer_chunk").otherwise("image_caption_chunk"))
        .when((archetype == "procedural") & has(*STEPS), "procedure_chunk")
        .when((archetype == "mixed_multimodal") & has(*STEPS), "mixed_context_chunk")
        .when(archetype == "regulatory", "policy_clause_chunk")
        .when(archetype == "reference", "reference_entry_chunk")
        .when(~several & has("heading"), "section_chunk")
        .when(has("list_item"), "list_chunk")
        .when(has("note", "warning"), "note_chunk")
        .when(has("heading"), "section_chunk")
        .otherwise("narrative_chunk")
    )


def group_rows(blocks: DataFrame, doc: str, title: str, attributes: bool = False) -> DataFrame:
    """One row for each group: its blocks' ids and types, first path, last title, text and type, and
    with ``attributes`` what ``group_attributes`` gives, gathered in the same grouping."""
    row = F.struct("order_index", "block_id", "block_type", "text", "title", "section_path", "slide_number")
    whole = blocks.groupBy(doc, "group").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.first("archetype").alias("archetype"), F.first(title).alias("_document_title"), *([_attribute_rows()] if attributes else [])
    )
    path = F.coalesce(F.filter("rows", lambda r: F.size(r["section_path"]) > 0)[0]["section_path"], F.array("_document_title"))
    named = F.filter("rows", lambda r: F.coalesce(r["title"], F.lit("")) != "")
    own = F.coalesce(F.try_element_at(named, F.lit(-1))["title"], F.element_at(path, -1))
    kinds = F.transform("rows", lambda r: r["block_type"])
    texts = F.filter(F.transform("rows", lambda r: F.trim(r["text"])), lambda t: t != "")
    return whole.select(
        doc,
        "group",
        "archetype",
        F.transform("rows", lambda r: r["block_id"]).alias("block_ids"),
        kinds.alias("block_types"),
        path.alias("section_path"),
        own.alias("chunk_title"),
        F.array_join(texts, "\n\n").alias("content"),
        chunk_type(kinds, F.col("archetype"), F.exists("rows", lambda r: r["slide_number"].isNotNull())).alias("chunk_type"),
        *(_merged_attributes() if attributes else []),
    )


def build_chunks(blocks: DataFrame, doc: str, title: str, most: int = 220, overlap: int = 40) -> DataFrame:
    """Blocks of any documents to chunk rows with a dense chunk_index and a stable chunk_id."""
    kinds = archetypes(blocks, doc)
    grouped = group_blocks(blocks.join(kinds, doc), doc)
    rows = group_rows(grouped, doc, title).withColumn("content", T.normalize_spaces(F.col("content")))
    spread = rows.select("*", F.posexplode(fold_windows(paragraphs(F.col("content")), most, overlap)).alias("_w", "_items"))
    spread = spread.withColumn("content", F.array_join(F.transform("_items", lambda x: x["text"]), "\n\n"))
    index = F.row_number().over(Window.partitionBy(doc).orderBy("group", "_w")) - 1
    numbered = spread.withColumn("chunk_index", index).drop("_w", "_items")
    identity = F.sha2(F.concat_ws("|", F.col(doc).cast("string"), F.col("chunk_index").cast("string")), 256)
    rendered = T.embedding_text(
        F.col("chunk_title"), F.col("section_path"), F.col("chunk_type"), F.lit(""), F.col("content"), F.col("archetype")
    )
    tags = T.detect_languages(F.col("content"))
    return numbered.withColumns({"chunk_id": identity, "language_tags": tags, "embedding_text": rendered})


def overlapping_blocks(blocks: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks and windows of the same section whose ranges of lines meet."""
    w = windows.select(*keys, "window", F.col("first_line").alias("_from"), F.col("last_line").alias("_to"))
    met = blocks.join(w, keys)
    return met.where((F.col("first_line") <= F.col("_to")) & (F.col("last_line") >= F.col("_from"))).drop("_from", "_to")


IMAGE = "struct<image_id:string,image_path:string,caption:string,alt_text:string,ocr_text:string>"


def last_wins(maps: Column) -> Column:
    """One map of an array of maps; of equal keys the last one's value stays."""
    none = F.create_map().cast("map<string,string>")
    return F.aggregate(maps, none, lambda held, new: F.map_concat(F.map_filter(held, lambda k, v: ~F.map_contains_key(new, k)), new))


def first_of(items: Column, key) -> Column:
    """The items of an array without those whose ``key`` an earlier one has."""
    return T.once(F.transform(items, key), lambda keys: F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1))


def _attribute_rows() -> Column:
    row = F.struct("order_index", "anchor", "language_tags", "metadata", "images")
    return F.array_sort(F.collect_list(row), lambda a, b: (a["order_index"] - b["order_index"]).cast("int")).alias("_attributes")


def _merged_attributes() -> list[Column]:
    every = lambda name: F.filter(F.transform("_attributes", lambda r: r[name]), lambda x: x.isNotNull())
    said = F.filter(every("anchor"), lambda a: F.coalesce(T.location_hint(a), F.lit("")) != "")
    images = first_of(F.flatten(every("images")), lambda x: F.coalesce(F.nullif(x["image_id"], F.lit("")), x["image_path"]))
    return [
        F.get(said, F.lit(0)).alias("anchor"),
        F.array_distinct(F.flatten(every("language_tags"))).alias("own_languages"),
        last_wins(every("metadata")).alias("own_metadata"),
        images.alias("images"),
    ]


def group_attributes(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, group, anchor, own_languages, own_metadata, images) of groups of blocks.

    ``blocks`` has group, order_index, anchor (a struct with the places that ``location_hint``
    knows), language_tags, metadata (a map) and images (an array of IMAGE). The anchor is the first
    that says anything, languages are distinct in their order, later metadata replaces earlier,
    and of images with one id, or one path where there is no id, the first stays.
    """
    whole = blocks.groupBy(doc, "group").agg(_attribute_rows())
    return whole.select(doc, "group", *_merged_attributes())


def chunk_rows(blocks: DataFrame, documents: DataFrame, doc: str, title: str = "document_title", most: int = 220, overlap: int = 40) -> DataFrame:
    """Chunk rows of any documents with all that is stored of them.

    ``blocks`` is what ``build_chunks`` and ``group_attributes`` read, ``documents`` has language_tags
    and metadata of each document. A group's languages are the document's where it has none;
    its metadata stands over the document's, and the archetype and the blocks over both.
    """
    kinds = archetypes(blocks, doc)
    grouped = group_blocks(blocks.join(kinds, doc), doc)
    texts = group_rows(grouped, doc, title, attributes=True).withColumn("content", T.normalize_spaces(F.col("content")))
    spread = texts.select("*", F.posexplode(fold_windows(paragraphs(F.col("content")), most, overlap)).alias("_w", "_items"))
    spread = spread.withColumn("content", F.array_join(F.transform("_items", lambda x: x["text"]), "\n\n"))
    index = F.row_number().over(Window.partitionBy(doc).orderBy("group", "_w")) - 1
    numbered = spread.withColumn("chunk_index", index).drop("_w", "_items")
    own = documents.select(doc, F.col("language_tags").alias("_languages"), F.col("metadata").alias("_metadata"))
    told = numbered.join(own, doc, "left")
    languages = F.when(F.size("own_languages") > 0, F.col("own_languages")).otherwise(F.col("_languages"))
    fixed = F.create_map(
        F.lit("document_archetype"), F.col("archetype"), F.lit("block_ids"), F.to_json("block_ids"), F.lit("block_types"), F.to_json("block_types")
    )
    metadata = last_wins(F.array(F.coalesce("_metadata", F.create_map().cast("map<string,string>")), F.col("own_metadata"), fixed))
    place = F.coalesce(T.location_hint(F.col("anchor")), F.lit(""))
    return told.select(
        doc, "chunk_index",
        F.sha2(F.concat_ws("|", F.col(doc).cast("string"), F.col("chunk_index").cast("string")), 256).alias("chunk_id"),
        "chunk_type", F.col("chunk_title").alias("title"), "section_path", "content", "block_ids", "block_types", languages.alias("language_tags"), "anchor",
        metadata.alias("metadata"), F.array_distinct(F.transform("images", lambda x: x["image_path"])).alias("image_refs"), "images",
        T.embedding_text(F.col("chunk_title"), F.col("section_path"), F.col("chunk_type"), place, F.col("content"), F.col("archetype")).alias("embedding_text"),
    )


def image_rows(chunks: DataFrame, documents: DataFrame, doc: str, title: str = "document_title") -> DataFrame:
    """Image rows of documents: one for each path that a chunk shows, with the first chunk that
    does, and the documents' own images that no chunk shows, without chunk.

    Each path's first chunk is found by a minimum, so a picture on every page of a document
    comes to a task once for each task before it.
    """
    shown = chunks.select(doc, "chunk_index", "chunk_id", "title", "section_path", "block_ids", "language_tags", F.posexplode("images").alias("_n", "image"))
    caption = lambda x: F.coalesce(*[F.nullif(x[c], F.lit("")) for c in ("caption", "alt_text", "ocr_text")], F.lit(""))
    fields = F.struct(
        F.col("image.image_id").alias("image_id"), "title", caption(F.col("image")).alias("caption_text"), F.col("section_path").alias("related_section_path"),
        F.col("chunk_id").alias("related_chunk_id"), F.col("block_ids").alias("related_block_ids"), "language_tags",
    )
    names = ["image_id", "title", "caption_text", "related_section_path", "related_chunk_id", "related_block_ids", "language_tags"]
    linked = shown.select(doc, F.col("image.image_path").alias("image_path"), fields.alias("f"), F.struct("chunk_index", "_n").alias("place"))
    own = documents.select(doc, F.col(title).alias("title"), "language_tags", F.explode("images").alias("image"))
    rest = own.select(
        doc, F.col("image.image_path").alias("image_path"), F.struct(
            F.col("image.image_id").alias("image_id"), "title", caption(F.col("image")).alias("caption_text"), F.array("title").alias("related_section_path"),
            F.lit(None).cast("string").alias("related_chunk_id"), F.array().cast("array<string>").alias("related_block_ids"), "language_tags").alias("f"),
        F.lit(None).cast("struct<chunk_index:int,_n:int>").alias("place"),
    )
    # Chunks are worked out once: a path's first one and the document's own images meet in one group.
    is_own = F.col("place").isNull()
    met = linked.unionByName(rest).groupBy(doc, "image_path").agg(F.min_by("f", "place").alias("first"), F.collect_list(F.when(is_own, F.col("f"))).alias("own"))
    kept = F.when(F.col("first").isNull(), F.col("own")).when(F.col("image_path").isNull(), F.concat(F.array("first"), F.col("own"))).otherwise(F.array("first"))
    return met.select(doc, "image_path", F.explode(kept).alias("f")).select(doc, "image_path", *[f"f.{name}" for name in names])


# The kinds of blocks that kinds of segments become; all others are paragraphs.
SEGMENT_BLOCKS = {"table": "table", "table_row": "table_row", "code_block": "code", "image_caption": "caption", "list_item": "list_item", "note": "note"}


def segment_block_type(segment_type: Column, text: Column) -> Column:
    """A segment's kind of block; a paragraph that begins as a step is one."""
    out = F.when((segment_type == "paragraph") & F.rlike(F.trim(text), F.lit(T.STEP_START)), "step")
    for name, kind in SEGMENT_BLOCKS.items():
        out = out.when(segment_type == name, kind)
    return out.otherwise("paragraph")


def materialized(blocks: DataFrame, segments: DataFrame, doc: str) -> DataFrame:
    """Blocks of all documents: their own, or, where a document has none, its segments as blocks.

    ``segments`` has segment_id, segment_type, segment_index and text, and may have more columns of
    the blocks. Blocks get step_number, empty where they begin no step.
    """
    bare = segments.join(blocks.select(doc).distinct(), doc, "left_anti")
    order = Window.partitionBy(doc).orderBy("segment_index")
    made = bare.withColumns({"block_type": segment_block_type(F.col("segment_type"), F.col("text")), "order_index": (F.row_number().over(order) - 1).cast("long")})
    made = made.withColumnRenamed("segment_id", "block_id").drop("segment_type", "segment_index")
    both = blocks.unionByName(made, allowMissingColumns=True)
    return both.withColumn("step_number", F.coalesce(T.step_number(F.col("text")), F.lit("")))
