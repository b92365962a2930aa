"""Chunks of paged, slide, reStructuredText and sheet documents.

Each kind windows its own unit (a section of a page, a slide, a section, the rows of a region);
the windows themselves and the numbering of chunks are the ones that all kinds share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking, structure
from .staging import parts


# The labels of the texts that are embedded, by kind of document, and what stands for nothing.
HEAD = ["Document title", "Archetype", "Section path", "Content type"]
PAGED = [*HEAD, "Page number", "Layout hints"]
SLIDES = [*HEAD, "Slide number", "Layout hints"]
MARKUP = [*HEAD, "RST anchors", "RST images", "RST equation labels", "RST directives", "Inline math count", "Location"]
SHEETS = [*HEAD, "Sheet name", "Region type", "Headers", "Row range"]
FRENCH = ["Titre", "Document", "Section", "Ancres", "Images"]
ARABIC = ["عنوان الوثيقة", "القسم", "المادة", "الصفحة"]


def labelled(labels: list[str], values: list[Column], content: Column, intro: str = "Content:\n", nothing: str = "none") -> Column:
    """``label: value`` lines, an empty line, and the content behind ``intro``; empty values are ``nothing``."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(nothing)), F.lit("\n")) for label, value in zip(labels, values, strict=True)]
    return F.concat(*lines, F.lit(f"\n{intro}"), content)


def _head(title: Column, archetype: Column, section_path: Column, kind: Column) -> list[Column]:
    return [title, archetype, F.array_join(section_path, " > "), kind]


def _listed(items: Column) -> Column:
    return F.array_join(F.coalesce(items, F.array().cast("array<string>")), ", ")


def page_text(title: Column, archetype: Column, section_path: Column, kind: Column, page: Column, hints: Column, content: Column) -> Column:
    return labelled(PAGED, [*_head(title, archetype, section_path, kind), page, _listed(hints)], content)


def slide_text(title: Column, archetype: Column, section_path: Column, kind: Column, slide: Column, hints: Column, content: Column) -> Column:
    return labelled(SLIDES, [*_head(title, archetype, section_path, kind), slide, _listed(hints)], content)


def markup_text(title: Column, archetype: Column, section_path: Column, kind: Column, parts: Column, lines: tuple[Column, Column], content: Column) -> Column:
    """``parts`` is what ``structure.block_artifacts`` gives, ``lines`` the first and last line."""
    place = F.concat(F.lit("lines "), lines[0].cast("string"), F.lit("-"), lines[1].cast("string"))
    listed = [_listed(parts[f]) for f in ("anchors", "image_refs", "equation_labels", "directives")]
    return labelled(MARKUP, [*_head(title, archetype, section_path, kind), *listed, parts["inline_math"], place], content)


def sheet_text(title: Column, archetype: Column, section_path: Column, kind: Column, sheet: Column, region: Column, headers: Column, rows: tuple[Column, Column], content: Column) -> Column:
    both = (F.coalesce(rows[0], F.lit(0)) != 0) & (F.coalesce(rows[1], F.lit(0)) != 0)
    span = F.when(both, F.concat(rows[0].cast("string"), F.lit("-"), rows[1].cast("string"))).otherwise("n/a")
    return labelled(SHEETS, [*_head(title, archetype, section_path, kind), sheet, region, _listed(headers), span], content)


def french_text(title: Column, code: Column, section_path: Column, anchors: Column, images: Column, content: Column) -> Column:
    return labelled(FRENCH, [title, code, F.array_join(section_path, " > "), _listed(anchors), _listed(images)], content, "", "aucune")


def arabic_text(title: Column, chapter: Column, article: Column, page: Column, content: Column) -> Column:
    return labelled(ARABIC, [title, chapter, article, page], content, "", "")


def numbered(chunks: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """Adds chunk_index, dense for each document in the given order."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1)


def page_type(kinds: Column, archetype: Column) -> Column:
    has = lambda *names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(has(*chunking.PICTURES), F.when(F.size(kinds) > 1, "figure_explainer_chunk").otherwise("image_caption_chunk"))
        .when(has("table"), "table_chunk")
        .when((archetype == "procedural") & has(*chunking.STEPS), "procedure_chunk")
        .when(archetype == "regulatory", "policy_clause_chunk")
        .otherwise("section_chunk")
    )


def markup_type(kinds: Column, archetype: Column, image_refs: Column, labels: Column, directives: Column) -> Column:
    has = lambda array, *names: F.arrays_overlap(array, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(F.size(image_refs) > 0, "figure_explainer_chunk")
        .when(has(kinds, "code") | has(directives, "code-block"), "code_chunk")
        .when((archetype == "procedural") & has(kinds, *chunking.STEPS), "procedure_chunk")
        .when((F.size(labels) > 0) | has(directives, "math"), "reference_entry_chunk")
        .when(archetype == "regulatory", "policy_clause_chunk")
        .when(archetype == "reference", "reference_entry_chunk")
        .otherwise("section_chunk")
    )


def page_chunks(blocks: DataFrame, doc: str, most: int = 220, overlap: int = 40) -> DataFrame:
    """Windows over each section of each page (page_number, section_path, archetype on the blocks).

    Headings of a section's path are part of it on every page that has the section. Nothing is
    joined: blocks that come partitioned by document are not shuffled again.
    """
    keys = [doc, "page_number", "section"]
    told = blocks.withColumn("section", F.array_join("section_path", " > "))
    row, heading = chunking.window_row("order_index"), F.col("block_type") == "heading"
    pages = told.groupBy(*keys).agg(
        F.first("archetype").alias("archetype"), F.collect_list(F.when(F.coalesce(~heading, F.lit(False)), row)).alias("_here"), F.collect_list(F.when(heading, row)).alias("_heads")
    )
    heads = F.flatten(F.collect_list("_heads").over(Window.partitionBy(doc, "section")))
    whole = pages.withColumn("_all", heads).withColumn("rows", F.concat("_here", "_all"))
    windows = chunking.typed_windows(whole, [*keys, "archetype"], most, overlap)
    return numbered(windows.withColumn("chunk_type", page_type(F.col("block_types"), F.col("archetype"))), doc, ["page_number", "section", "window"])


def slide_chunks(blocks: DataFrame, doc: str, most: int = 220, overlap: int = 40) -> DataFrame:
    """Windows over each slide; all are slide chunks."""
    keys = [doc, "slide_number"]
    slides = blocks.groupBy(*keys).agg(F.collect_list(chunking.window_row("order_index")).alias("rows"))
    windows = chunking.typed_windows(slides, keys, most, overlap)
    return numbered(windows.withColumn("chunk_type", F.lit("slide_chunk")), doc, ["slide_number", "window"])


def markup_chunks(lines: DataFrame, doc: str, archetypes: DataFrame, most: int = 220, overlap: int = 40) -> DataFrame:
    """Windows over the blocks of each section of reStructuredText lines (doc, line_no, line)."""
    marked = structure.sections(structure.underlined(lines, doc), doc)
    paths = marked.select(doc, "heading_line", "section_path").distinct()
    keys = [doc, "heading_line"]
    blocks = structure.blank_line_blocks(marked, keys).withColumn("block_id", F.concat_ws("-", "heading_line", "block"))
    parts = structure.block_artifacts(F.col("text"))
    blocks = blocks.withColumns({"parts": parts, "raw": F.col("text")})
    shown = F.array_join(F.filter(F.transform(F.split("text", "\n"), structure.marked_line), lambda x: x != ""), "\n")
    windows = chunking.block_windows(blocks.withColumn("text", shown), keys, "first_line", most, overlap)
    spread = windows.select(*keys, "window", F.explode("block_ids").alias("block_id")).join(blocks, [*keys, "block_id"])
    in_order = F.array_sort(F.collect_list(F.struct("first_line", "parts")))
    gather = lambda f: F.array_distinct(F.flatten(F.transform(in_order, lambda x: x["parts"][f]))).alias(f)
    told = spread.groupBy(*keys, "window").agg(
        *[gather(f) for f in ("anchors", "image_refs", "directives", "equation_labels")],
        F.sum("parts.inline_math").alias("inline_math"),
        F.min("first_line").alias("first_line"),
        F.max("last_line").alias("last_line"),
    )
    made = windows.join(told, [*keys, "window"]).join(paths, keys).join(archetypes, doc)
    kind = markup_type(F.array(F.lit("paragraph")), F.col("archetype"), F.col("image_refs"), F.col("equation_labels"), F.col("directives"))
    return numbered(made.withColumn("chunk_type", kind), doc, ["heading_line", "window"])


#: Rows of sheets of one task.
SHEET_ROWS = 200_000


def sheet_chunks(rows: DataFrame, doc: str, most: int = 220, overlap: int = 40, samples: int = 5, pairs: int = 8) -> DataFrame:
    """A summary of each region, and windows over the rows of tables.

    ``rows`` has sheet_name, row_no and cells. A table's first row names its columns; its summary
    lists them and the first ``samples`` rows. A key_value region is its first ``pairs`` pairs.
    """
    keys = [doc, "sheet_name", "region"]
    n = parts(rows, SHEET_ROWS)
    placed = structure.with_region_types(structure.regions(rows.repartition(n, doc), keys[:2]), keys[:2])
    values = F.filter("cells", lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    first = Window.partitionBy(*keys).orderBy("row_no")
    told = placed.withColumns({"headers": F.first("cells").over(first), "n": F.row_number().over(first)})
    pair = F.concat_ws(": ", F.get(values, F.lit(0)), F.get(values, F.lit(1)))
    table = F.col("region_type") == "table"
    told = told.withColumn("shown", F.when(table, structure.row_text(F.col("headers"), F.col("cells"))).otherwise(pair))
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("n", "shown")))), lambda x: x["shown"]), "\n")
    names = F.transform(F.first("headers"), lambda h, i: F.coalesce(F.nullif(F.trim(h), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))
    summed = told.groupBy(*keys, "region_type").agg(
        F.array_join(names, ", ").alias("names"), lines((F.col("n") > 1) & (F.col("n") <= samples + 1)).alias("sample"), lines(F.col("n") <= pairs).alias("pairs")
    )
    sample = F.when(F.col("sample") != "", F.concat(F.lit("\n\nSample rows:\n"), F.col("sample"))).otherwise("")
    summary = F.when(table, F.concat(F.lit("Headers: "), F.col("names"), sample)).otherwise(F.col("pairs"))
    kind = F.when(table, "table_chunk").otherwise("reference_entry_chunk")
    heads = summed.select(*keys, F.lit(-1).alias("window"), kind.alias("chunk_type"), summary.alias("content"), F.lit(None).cast("bigint").alias("row_start"))
    data = told.where(table & ((F.col("n") > 1) | (F.col("n_rows") == 1)) & (F.col("shown") != ""))
    items = data.select(*keys, F.col("row_no").cast("string").alias("block_id"), F.col("row_no").alias("order_index"), F.col("shown").alias("text"))
    windows = chunking.block_windows(items, keys, "order_index", most, overlap)
    start = F.array_min(F.transform("block_ids", lambda b: b.cast("bigint")))
    body = windows.select(*keys, "window", F.lit("row_chunk").alias("chunk_type"), F.replace("content", F.lit("\n\n"), F.lit("\n")).alias("content"), start.alias("row_start"))
    return numbered(heads.unionByName(body).repartition(n, doc), doc, ["sheet_name", "region", "window"])


# Strategies in the order in which they are tried, and the files that they are for.
STRATEGIES = [("pdf_section_window", ["pdf"]), ("slide_window", ["ppt", "pptx"]), ("rst_section_window", ["rst"]), ("xlsx_sheet_window", ["xls", "xlsx"])]
GENERIC = "generic_blocks"


def strategy(file_type: Column, hint: Column) -> Column:
    """The strategy that a document's hint names, if there is one of that name, else the first for its kind of file."""
    names = [name for name, _ in STRATEGIES] + [GENERIC]
    out = F.when(hint.isin(names), hint)
    for name, files in STRATEGIES:
        out = out.when(file_type.isin(files), name)
    return out.otherwise(GENERIC)


def dispatched_chunks(blocks: DataFrame, doc: str, most: int = 220, overlap: int = 40) -> DataFrame:
    """(doc, chunk_index, strategy, chunk_type, block_ids, content): documents of all kinds in one plan.

    Each strategy names the unit that its windows stay in, a section of a page, a slide, a
    section, a sheet or a group of blocks; one grouping by document and unit then serves all.
    ``blocks`` has what ``group_blocks`` reads, and file_type, preferred_strategy, page_number,
    slide_number and sheet_name.
    """
    chosen = strategy(F.col("file_type"), F.col("preferred_strategy"))
    kinds = chunking.archetypes(blocks, doc)
    grouped = chunking.group_blocks(blocks.join(kinds, doc), doc).withColumn("strategy", chosen)
    section = F.array_join("section_path", " > ")
    said = lambda *parts: F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    unit = (
        F.when(F.col("strategy") == "pdf_section_window", said(F.col("page_number"), section))
        .when(F.col("strategy") == "slide_window", said(F.col("slide_number")))
        .when(F.col("strategy") == "rst_section_window", section)
        .when(F.col("strategy") == "xlsx_sheet_window", said(F.col("sheet_name")))
        .otherwise(said(F.col("group")))
    )
    told = grouped.withColumns({"unit": unit, "n": F.size(T.words(F.col("text")))}).where(F.trim("text") != "")
    item = F.struct(F.col("text"), "n", F.col("block_id").alias("id"))
    units = told.groupBy(doc, "strategy", "unit").agg(
        F.array_sort(F.collect_list(F.struct("order_index", item.alias("item")))).alias("rows"),
        F.array_sort(F.collect_set("block_type")).alias("kinds"), F.first("archetype").alias("archetype"), F.bool_or(F.col("slide_number").isNotNull()).alias("slides"),
    )
    windows = chunking.fold_windows(F.transform("rows", lambda r: r["item"]), most, overlap)
    spread = units.select(doc, "strategy", "kinds", "archetype", "slides", F.element_at("rows", 1)["order_index"].alias("first"), F.posexplode(windows).alias("window", "w"))
    content = F.array_join(F.transform("w", lambda x: x["text"]), "\n\n")
    parts = structure.block_artifacts(F.col("content"))
    kind = (
        F.when(F.col("strategy") == "pdf_section_window", page_type(F.col("kinds"), F.col("archetype")))
        .when(F.col("strategy") == "slide_window", "slide_chunk")
        .when(F.col("strategy") == "rst_section_window", T.once(parts, lambda p: markup_type(F.col("kinds"), F.col("archetype"), p["image_refs"], p["equation_labels"], p["directives"])))
        .when(F.col("strategy") == "xlsx_sheet_window", "row_chunk")
        .otherwise(chunking.chunk_type(F.col("kinds"), F.col("archetype"), F.col("slides")))
    )
    made = spread.withColumns({"content": content, "block_ids": F.transform("w", lambda x: x["id"])}).withColumn("chunk_type", kind)
    return numbered(made, doc, ["first", "window"]).select(doc, "chunk_index", "strategy", "chunk_type", "block_ids", "content")


def structure_hints(blocks: DataFrame, doc: str, unit: str) -> DataFrame:
    """(doc, unit, section_path, block_ids) in the order in which sections first occur."""
    row = F.struct("order_index", "block_id")
    made = blocks.groupBy(doc, unit, "section_path").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    first = F.element_at("rows", 1)["order_index"]
    place = F.row_number().over(Window.partitionBy(doc, unit).orderBy(first)) - 1
    return made.select(doc, unit, place.alias("place"), "section_path", F.transform("rows", lambda r: r["block_id"]).alias("block_ids"))

