"""From lines to headings, sections, blocks and regions.

Rows are lines, pages or cells with a document key and a position; what belongs together is found
with windows over one document, so documents are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T

# Characters that underline headings, by level, in the full and the short form.
LEVELS = "=-~^\"`:#*+"
SHORT_LEVELS = "=-~^\""
LOOSE = r"^[=~^#*+-]+$"


def split_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no from 0, line) of each line of each text."""
    return docs.select(doc, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "line"))


def underlined(lines: DataFrame, doc: str, chars: str = LEVELS, least: int = 1, loose: bool = False) -> DataFrame:
    """Adds heading_level, null for lines that are no heading.

    A heading stands above a line of one repeated character of ``chars``, at least as long as it
    and at least ``least`` long; with ``loose`` any mix of the loose characters will do.
    """
    after = F.lead("line").over(Window.partitionBy(doc).orderBy("line_no"))
    title, rule = F.trim("line"), F.trim(after)
    level = F.instr(F.lit(chars), F.left(rule, F.lit(1)))
    if loose:
        fits = F.rlike(rule, F.lit(LOOSE))
    else:
        fits = F.rlike(rule, F.lit(r"^(.)\1*$")) & (F.char_length(rule) >= F.greatest(F.char_length(title), F.lit(least)))
    return lines.withColumn("heading_level", F.when((title != "") & fits & (level > 0), level))


def heading_stack(level: Column, at: Column, title: Column, so_far: WindowSpec, deepest: int) -> Column:
    """The titles of the headings that are open at a row, outermost first.

    ``so_far`` is a window of the rows up to this one in the order of ``at``. The last heading of
    each level is open if it stands behind the last ones of all lower levels, as those close it.
    The window keeps one heading for each level, so the work is linear in the rows.
    """
    named = F.struct(at.cast("long").alias("at"), title.alias("title"))
    latest = [F.last(F.when(level == k, named), ignorenulls=True).over(so_far) for k in range(1, deepest + 1)]
    none = F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast("array<string>").alias("path"))

    def take(held: Column, head: Column) -> Column:
        longer = F.struct(head["at"].alias("at"), F.concat(held["path"], F.array(head["title"])).alias("path"))
        return F.when(head["at"] > held["at"], longer).otherwise(held)

    return F.aggregate(F.array(*latest), none, take, lambda held: held["path"])


def with_paths(lines: DataFrame, doc: str) -> DataFrame:
    """Adds section_path, the titles of the open headings at each line, itself included, and
    heading_line, the line of the innermost; both are null before the first heading."""
    so_far = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("heading_level").isNotNull()
    stack = heading_stack(F.col("heading_level"), F.col("line_no"), F.trim("line"), so_far, len(LEVELS))
    own = lines.withColumn("_path", F.when(is_head, stack))
    return own.withColumns({
        "section_path": F.last("_path", ignorenulls=True).over(so_far),
        "heading_line": F.max(F.when(is_head, F.col("line_no"))).over(so_far),
    }).drop("_path")


def sections(lines: DataFrame, doc: str) -> DataFrame:
    """Adds heading_line, the line of the nearest heading above, and section_path.

    Lines before the first heading, headings and their rules are dropped. A heading closes those
    of its own or a deeper level.
    """
    return with_paths(lines, doc).where("heading_level is null and line_no > heading_line + 1")


def blank_line_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, first_line, last_line, text): runs of lines that are not blank."""
    blank = (F.trim("line") == "").cast("int")
    so_far = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    islands = lines.withColumn("_island", F.sum(blank).over(so_far)).where(F.trim("line") != "")
    made = islands.groupBy(*keys, "_island").agg(
        F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("first_line")) - 1
    return made.withColumn("block", number).drop("_island")


def typed_blocks(lines: DataFrame, doc: str) -> DataFrame:
    """Blocks (doc, order_index, block_type, text, heading_level, section_path) of plain text.

    Headings are underlined in any of the loose characters, or look like headings between empty
    lines; a line that starts as a step or list item is a block; other lines that follow each
    other form paragraphs. Paths hold the headings that are open at a block, itself included.
    """
    order = Window.partitionBy(doc).orderBy("line_no")
    own, before, after = F.trim("line"), F.trim(F.lag("line").over(order)), F.trim(F.lead("line").over(order))
    rule = F.rlike(own, F.lit(LOOSE)) & (F.char_length(own) >= 3)
    alone = (F.coalesce(before, F.lit("")) == "") & (F.coalesce(after, F.lit("")) == "")
    told = underlined(lines, doc, loose=True).withColumns({"_before": before, "_alone": alone, "_rule": rule})
    told = told.where(~F.col("_rule"))
    level = F.coalesce("heading_level", F.when(F.col("_alone") & heuristic_heading(own), F.lit(2)))
    kind = (
        F.when(own == "", "blank")
        .when(level.isNotNull(), "heading")
        .when(F.rlike(own, F.lit(T.STEP_START)), "step")
        .when(F.rlike(own, F.lit(r"^[-*•]\s+")), "list_item")
        .otherwise("paragraph")
    )
    typed = told.withColumns({"heading_level": level, "block_type": kind}).drop("_before", "_alone", "_rule")
    goes_on = (F.col("block_type") == "paragraph") & (F.lag("block_type").over(order) == "paragraph")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = with_paths(typed, doc).withColumn("_start", F.when(goes_on, 0).otherwise(1)).withColumn("_block", F.sum("_start").over(so_far))
    row = F.struct("line_no", own.alias("text"))
    made = marked.where("block_type <> 'blank'").groupBy(doc, "_block", "block_type").agg(
        F.max("heading_level").alias("heading_level"),
        F.first("section_path").alias("section_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["text"]), " ").alias("text"),
    )
    index = F.row_number().over(Window.partitionBy(doc).orderBy("_block")) - 1
    none = F.array().cast("array<string>")
    return made.select(doc, index.alias("order_index"), "block_type", "text", "heading_level", F.coalesce("section_path", none).alias("section_path"))


def block_artifacts(text: Column) -> Column:
    """Anchors, image references, directives, equation labels and inline formulas of a block; LF ends its lines."""
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.struct(
        every(r"(?md)^\s*\.\. _([^:]+):\s*$").alias("anchors"),
        every(r"(?md)^\s*\.\. (?:image|figure)::\s*(\S+)").alias("image_refs"),
        F.array_distinct(every(r"(?md)^\s*\.\. ([a-z-]+)::")).alias("directives"),
        every(r"(?md)^\s*:label:\s*(\S+)").alias("equation_labels"),
        T.inline_math_count(text).alias("inline_math"),
    )


def marked_line(line: Column) -> Column:
    """A line of markup as the marker that stands for it in a chunk's text; other lines as they are."""
    out = F.trim(line)
    rules = [
        (r"^\.\. _([^:]+):$", "[Anchor: %s]"),
        (r"^\.\. (?:image|figure)::\s*(.*)$", "[Image: %s]"),
        (r"^\.\. code-block::\s*(.*)$", "[Code: %s]"),
        (r"^:label:\s*(.*)$", "[Label: %s]"),
    ]
    marked = F.when(F.rlike(out, F.lit(r"^\.\. math::")), F.lit("[Math]"))
    for pattern, shown in rules:
        marked = marked.when(F.rlike(out, F.lit(pattern)), F.format_string(shown, F.trim(F.regexp_extract(out, pattern, 1))))
    return marked.otherwise(out)


def heuristic_heading(line: Column) -> Column:
    """A short line that does not end a sentence, is no step, and is in capitals or title case."""
    own = F.trim(line)
    letters = F.regexp_replace(own, r"[^\p{L}]+", "")
    upper = F.char_length(F.regexp_replace(letters, r"[^\p{Lu}]+", ""))
    capitals = (F.char_length(letters) > 0) & (upper > 0.75 * F.char_length(letters))
    titled = T.at_most_words(own, 6) & (F.initcap(own) == own)
    return (own != "") & T.at_most_words(own, 8) & ~F.rlike(own, F.lit("[.;?!]$")) & (T.step_number(own) == "") & (capitals | titled)


# How captions begin, and what separates the cells of a table in plain text.
CAPTION = r"(?i)^(?:figure|fig\.?|diagram|workflow|architecture|table|chart|image|screenshot|screen)\s*[\dA-Za-z.-]*[:\-]?\s+"
CELL_BORDER = r"\s{2,}|\t|\|"


def looks_like_table(text: Column) -> Column:
    """Lines that all hold a cell border (of the first four), or one line with two borders and three words."""

    def holds(own: Column) -> Column:
        several = (F.size(own) >= 2) & F.forall(F.slice(own, 1, 4), lambda x: F.rlike(x, F.lit(CELL_BORDER)))
        single = (F.size(own) == 1) & (F.regexp_count(F.get(own, F.lit(0)), F.lit(CELL_BORDER)) >= 2) & ~T.at_most_words(text, 2)
        return several | single

    # Most texts have no border at all.
    return F.rlike(text, F.lit(CELL_BORDER)) & T.once(T.lines(text), holds)


def page_heading(own: Column) -> Column:
    """A few words before a colon, or a short line in capitals or title case with few digits."""
    colon = F.endswith(own, F.lit(":"))
    few_digits = F.char_length(F.regexp_replace(own, r"\D+", "")) <= 4
    return F.rlike(own, F.lit(r"\S")) & ((colon & T.at_most_words(own, 6)) | (heuristic_heading(own) & few_digits & ~colon))


def unit_type(text: Column) -> Column:
    """table, step, caption, heading or paragraph for a unit of a page."""
    own = F.trim(text)
    return (
        F.when(looks_like_table(text), "table")
        .when(F.rlike(own, F.lit(T.STEP_START)), "step")
        .when(F.rlike(own, F.lit(CAPTION)), "caption")
        .when(page_heading(own), "heading")
        .otherwise("paragraph")
    )


# How numbered headings begin, and digits that count as a number in one.
ENUMERATED = r"^(?:[\(\[]?[\d٠-٩IVXivxA-Za-z]+[\)\].:-]\s*).+"
NUMERIC = r"[\d٠-٩]"


def _compact(line: Column) -> Column:
    return T.at_most_words(line, 10) & ~F.rlike(line, F.lit("[,،;؛]"))


def heading_line(line: Column) -> Column:
    """Whether a line of a page is a heading on its own.

    It has at most fourteen words, ends no sentence, and is no table, step or caption. A numbered
    line must be compact; else a colon at its end, or within twelve words, makes it one, or its
    looks do.
    """
    other = F.rlike(line, F.lit("[.;?!]$")) | F.rlike(line, F.lit(CAPTION)) | F.rlike(line, F.lit(T.STEP_START)) | looks_like_table(line)
    colon = F.endswith(line, F.lit(":")) | (F.contains(line, F.lit(":")) & T.at_most_words(line, 12))
    return F.rlike(line, F.lit(r"\S")) & T.at_most_words(line, 14) & ~other & F.when(F.rlike(line, F.lit(ENUMERATED)), _compact(line)).otherwise(colon | page_heading(line))


def heading_line_level(line: Column) -> Column:
    """1 or 2: compact numbered lines and those with a colon and a digit are 2, others with a colon
    or of at most four words 1."""
    colon, digit = F.contains(line, F.lit(":")), F.rlike(line, F.lit(NUMERIC))
    return (
        F.when((F.rlike(line, F.lit(ENUMERATED)) & _compact(line)) | (colon & digit), 2)
        .when(colon | T.at_most_words(line, 4), 1)
        .otherwise(2)
    )


def page_units(pages: DataFrame, doc: str, page: str = "page_number", text: str = "text", title: str = "document_title") -> DataFrame:
    """Units (doc, page, order_index, block_type, text, heading_level, heading_style, section_path) of pages of text.

    Paragraphs stand between empty lines. A heading line breaks its paragraph's run of other lines,
    and each such run is a unit with a type of its own. Paths begin with the document's title and
    hold the headings that are open, on earlier pages too; without any, the page stands there.
    Texts are shuffled once, by document, and all windows and groups keep that partitioning.
    """
    folded = lambda parts, fold: F.filter(F.transform(parts, fold), lambda x: x != "")
    by_doc = pages.select(doc, page, title, F.col(text).alias("_text")).repartition(doc)
    parts = by_doc.select(doc, page, title, F.posexplode(folded(F.split("_text", "\n\n"), T.normalize_spaces)).alias("_part", "_paragraph"))
    # A normalised paragraph's lines have nothing left to fold but their ends.
    lines = parts.select(doc, page, title, "_part", F.posexplode(folded(F.split("_paragraph", "\n"), T.trimmed)).alias("_line", "line"))
    told = lines.withColumn("_head", heading_line(F.col("line")))
    in_part = Window.partitionBy(doc, page, "_part").orderBy("_line").rowsBetween(Window.unboundedPreceding, 0)
    runs = told.withColumn("_run", F.sum(F.col("_head").cast("int")).over(in_part))
    row = F.array_sort(F.collect_list(F.struct("_line", "line")))
    units = runs.groupBy(doc, page, title, "_part", "_run", "_head").agg(F.min("_line").alias("_line"), F.array_join(F.transform(row, lambda r: r["line"]), "\n").alias("text"))
    kind = F.when(F.col("_head"), "heading").otherwise(unit_type(F.col("text")))
    units = units.withColumn("block_type", kind)
    is_head = F.col("block_type") == "heading"
    level = F.when(F.col("_head"), heading_line_level(F.col("text"))).when(is_head, 1)
    style = F.when(F.col("_head"), "line_heuristic").when(is_head, "heuristic")
    order = Window.partitionBy(doc).orderBy(page, "_part", "_line")
    placed = units.withColumns({"order_index": (F.row_number().over(order) - 1).cast("long"), "heading_level": level, "heading_style": style})
    so_far = Window.partitionBy(doc).orderBy("order_index").rowsBetween(Window.unboundedPreceding, 0)
    stack = heading_stack(F.col("heading_level"), F.col("order_index"), F.col("text"), so_far, 2)
    bare = F.array(F.concat(F.lit("Page "), F.col(page).cast("string")))
    path = F.concat(F.array(title), F.when(F.size("_stack") > 0, F.col("_stack")).otherwise(bare))
    return placed.withColumn("_stack", stack).select(doc, page, "order_index", "block_type", "text", "heading_level", "heading_style", path.alias("section_path"))


def image_anchor(blocks: DataFrame, page: list[str]) -> DataFrame:
    """The block of each page that its images belong to: the first caption, else the first that
    speaks of a figure, else the first step, else the first that is neither heading nor table."""
    spoken = F.rlike(F.col("text"), F.lit(r"(?i)\b(?:figure|diagram|image|screenshot|chart)\b"))
    kind = F.col("block_type")
    rank = (
        F.when(kind == "caption", 1)
        .when((kind == "paragraph") & spoken, 2)
        .when(kind == "step", 3)
        .when(~kind.isin("heading", "table"), 4)
    )
    ranked = blocks.withColumn("_rank", rank).where("_rank is not null")
    return ranked.groupBy(*page).agg(F.min_by("block_id", F.struct("_rank", "order_index")).alias("anchor_block"))


def pages_to_render(pages: DataFrame, doc: str, most: int = 8, drawings: int = 25) -> DataFrame:
    """Pages without embedded images that hold many drawings or speak of figures; the first ``most``."""
    wanted = pages.where((F.col("embedded_images") == 0) & ((F.col("drawings") >= drawings) | F.col("has_keyword")))
    number = F.row_number().over(Window.partitionBy(doc).orderBy("page_number"))
    return wanted.withColumn("_n", number).where(F.col("_n") <= most).drop("_n")


def regions(rows: DataFrame, sheet: list[str], row: str = "row_no", cells: str = "cells") -> DataFrame:
    """Adds region: runs of neighbouring rows of a sheet that hold anything."""
    filled = rows.withColumn("populated", F.size(F.filter(cells, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))).where("populated > 0")
    order = Window.partitionBy(*sheet).orderBy(row)
    starts = F.when(F.col(row) - F.lag(row).over(order) <= 1, 0).otherwise(1)
    return filled.withColumn("_start", starts).withColumn("region", F.sum("_start").over(order) - 1).drop("_start")


def _told_regions(rows: DataFrame, sheet: list[str], row: str, cells: str) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with what tells regions apart, and the sums over a region that its type follows from."""
    values = F.filter(F.transform(cells, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    number = F.exists(F.slice(values, 2, 10_000), lambda x: F.rlike(F.replace(x, F.lit(","), F.lit("")), F.lit(r"^[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?$")))
    first = Window.partitionBy(*sheet, "region").orderBy(row)
    told = rows.withColumns({
        "_number": number,
        "_named": (F.size(values) > 0) & ~F.rlike(F.get(values, F.lit(0)), F.lit(r"^\d+$")),
        "_head": F.first("populated").over(first),
        "_n": F.row_number().over(first),
    })
    data = F.col("_n") > 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = {
        "first_row": F.min(row),
        "last_row": F.max(row),
        "n_rows": F.count("*"),
        "_head": F.max("_head"),
        "_wide": count(data & (F.col("populated") > 2)),
        "_numbers": count(data & F.col("_number")),
        "_same": count(data & (F.col("populated") == F.col("_head"))),
        "_narrow": count(F.col("populated") <= 2),
        "_named": count(F.col("_named")),
    }
    return told, sums


def _region_type() -> Column:
    c = F.col
    n_data, most = c("n_rows") - 1, F.greatest(F.lit(1), c("n_rows") - 1)
    pairs = (c("_head") == 2) & (n_data > 0) & (c("_wide") == 0) & (c("_numbers") == 0)
    table = (c("_head") >= 2) & (n_data > 0) & (c("_same") >= F.greatest(F.lit(1), F.floor(n_data / 2)))
    narrow = (c("_narrow") >= most) & (c("_named") >= most)
    return F.when(pairs, "key_value").when(table, "table").when(narrow, "key_value").otherwise("table")


def region_types(rows: DataFrame, sheet: list[str], row: str = "row_no", cells: str = "cells") -> DataFrame:
    """table or key_value for each region, from its first row and the counts of filled cells.

    Pairs without numbers behind a first row of two cells are key_value. Else rows as wide as a
    first row of two cells or more, at least half of them, make a table. Else rows of one or two
    cells that begin with a text, but for one row at most, are key_value. All else is a table.
    """
    told, sums = _told_regions(rows, sheet, row, cells)
    kinds = told.groupBy(*sheet, "region").agg(*[c.alias(name) for name, c in sums.items()])
    return kinds.select(*sheet, "region", "first_row", "last_row", "n_rows", _region_type().alias("region_type"))


def with_region_types(rows: DataFrame, sheet: list[str], row: str = "row_no", cells: str = "cells") -> DataFrame:
    """Rows with the region_type and n_rows of their region, found in windows, without a join."""
    told, sums = _told_regions(rows, sheet, row, cells)
    whole = Window.partitionBy(*sheet, "region").orderBy(row).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = told.select("*", *[c.over(whole).alias(f"_r{name}") for name, c in sums.items()])
    kept = named.select(*rows.columns, *[F.col(f"_r{name}").alias(name) for name in sums])
    return kept.withColumn("region_type", _region_type()).select(*rows.columns, "region_type", "n_rows")


# Words of a title of pairs, headers that a table's title shows, and characters of them.
TITLE_WORDS, TITLE_HEADERS, TITLE_LENGTH = 6, 3, 48


def region_titles(rows: DataFrame, types: DataFrame, sheet: list[str], name: str, row: str = "row_no", cells: str = "cells") -> DataFrame:
    """(sheet, region, title) of the regions of sheets called ``name``: a short first entry or the sheet's
    details for pairs, the number and, if they are short, the first headers for a table."""
    values = F.filter(F.transform(F.min_by(cells, row), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    first = rows.groupBy(*sheet, "region").agg(values.alias("_first"))
    told = types.select(*sheet, name, "region", "region_type") if name not in sheet else types.select(*sheet, "region", "region_type")
    number = (F.col("region") + 1).cast("string")
    entry, shown = F.get("_first", F.lit(0)), F.array_join(F.slice("_first", 1, TITLE_HEADERS), ", ")
    pairs = F.when(F.size(T.words(entry)) <= TITLE_WORDS, entry).otherwise(F.concat(F.col(name).cast("string"), F.lit(" Details "), number))
    table = F.concat(F.lit("Table "), number, F.when((shown != "") & (F.char_length(shown) <= TITLE_LENGTH), F.concat(F.lit(": "), shown)).otherwise(""))
    return told.join(first, [*sheet, "region"]).select(*sheet, "region", F.when(F.col("region_type") == "key_value", pairs).otherwise(table).alias("title"))


def row_text(headers: Column, cells: Column) -> Column:
    """``header: value | header: value``; a missing header is ``column_i``, blank cells are left out."""
    named = F.transform(
        cells,
        lambda v, i: F.when(
            F.trim(F.coalesce(v, F.lit(""))) != "",
            F.concat(
                F.coalesce(F.nullif(F.trim(F.get(headers, i)), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))), F.lit(": "), F.trim(v)
            ),
        ),
    )
    return F.array_join(F.filter(named, lambda x: x.isNotNull()), " | ")


def chapter_machine(lines: DataFrame, doc: str) -> DataFrame:
    """Chapter and article of each line of Arabic rules; pages of contents, lines before the first
    section and the headings themselves are left out."""
    own = F.trim("line")
    chapter = F.rlike(own, F.lit("^الفصل"))
    article = F.rlike(own, F.lit(r"^المادة\s*\(?\d+")) & ~F.contains(own, F.lit(".")) & (F.char_length(own) <= 120)
    order = Window.partitionBy(doc).orderBy("page_number", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    told = lines.where(~F.coalesce(F.col("is_contents"), F.lit(False)))
    told = told.withColumns({
        "chapter": F.last(F.when(chapter, own), ignorenulls=True).over(order),
        "article": F.last(F.when(chapter, F.lit("")).when(article, own), ignorenulls=True).over(order),
    })
    body = told.where(~chapter & ~article & (F.col("chapter").isNotNull() | (F.coalesce("article", F.lit("")) != "")))
    return body.withColumn("article", F.nullif("article", F.lit("")))


def clean_page_lines(lines: DataFrame, header: str) -> DataFrame:
    """Without blank lines, the running header, and lines of digits alone."""
    own = F.trim("line")
    return lines.where((own != "") & (own != header) & ~F.rlike(own, F.lit(r"^[\d٠-٩]+$")))


# Texts and sections of an image that become blocks, and the kinds that a section may have.
MOST_TEXTS, MOST_SECTIONS = 8, 6
SECTION_KINDS = ["paragraph", "list_item", "table", "note", "warning", "code", "quote"]


def image_blocks(images: DataFrame, doc: str, analysis: str = "analysis", title: str = "document_title", file_name: str = "file_name") -> DataFrame:
    """Blocks (doc, order_index, block_type, text, heading_level, section_path, layout_hint, image_type)
    of what a model told of an image, a JSON text with title, summary, visible_text and sections.

    The title is a heading if it differs from the document's; the summary, else the first visible
    text, else the file's name, is a figure; the first visible texts are one note, and of the first
    sections those with content follow, each behind its heading. JSON that cannot be read, and
    parts of another shape, count as absent. Each document is worked out in its own row.
    """
    v = F.try_parse_json(F.col(analysis))
    text = lambda x: T.normalize_spaces(F.coalesce(x, F.lit("")))
    said = lambda path: text(F.try_variant_get(v, path, "string"))
    shown = F.coalesce(F.try_variant_get(v, "$.visible_text", "array<string>"), F.array().cast("array<string>"))
    parts = F.coalesce(F.try_variant_get(v, "$.sections", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(parts, lambda x: F.coalesce(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.lit(False)))
    told = images.select(
        doc, F.col(title).alias("_document"), F.col(file_name).alias("_file"),
        F.coalesce(F.nullif(said("$.title"), F.lit("")), F.col(title)).alias("_title"), said("$.summary").alias("_summary"),
        F.coalesce(F.nullif(said("$.image_type"), F.lit("")), F.lit("unknown")).alias("image_type"),
        F.filter(F.transform(shown, text), lambda x: x != "").alias("_texts"),
        F.transform(F.slice(objects, 1, MOST_SECTIONS), lambda x: F.struct(
            text(F.try_variant_get(x, "$.heading", "string")).alias("heading"), text(F.try_variant_get(x, "$.content", "string")).alias("content"),
            F.lower(F.trim(F.coalesce(F.try_variant_get(x, "$.block_type", "string"), F.lit("")))).alias("kind"))).alias("_sections"),
    )
    c = F.col
    named = c("_title") != c("_document")
    root = F.when(named, F.array("_document", "_title")).otherwise(F.array("_document"))

    def block(kind: Column, body: Column, level: Column, path: Column, hint: str) -> Column:
        return F.struct(kind.alias("block_type"), body.alias("text"), level.cast("int").alias("heading_level"), path.alias("section_path"), F.lit(hint).alias("layout_hint"))

    none = F.lit(None)
    summary = F.coalesce(F.nullif(c("_summary"), F.lit("")), F.get("_texts", F.lit(0)), F.concat(F.lit("Image file: "), c("_file")))
    head = F.array(
        F.when(named, block(F.lit("heading"), c("_title"), F.lit(1), root, "image_title")),
        block(F.lit("figure"), summary, none, root, "image_summary"),
        F.when(F.size("_texts") > 0, block(F.lit("note"), T.normalize_spaces(F.array_join(F.slice("_texts", 1, MOST_TEXTS), "\n")), none, F.concat(root, F.array(F.lit("Visible Text"))), "visible_text")),
    )

    def section(x: Column) -> Column:
        path = F.when(x["heading"] != "", F.concat(root, F.array(x["heading"]))).otherwise(root)
        kind = F.when(x["kind"].isin(SECTION_KINDS), x["kind"]).otherwise("paragraph")
        heading = F.when((x["content"] != "") & (x["heading"] != ""), block(F.lit("heading"), x["heading"], F.lit(2), path, "image_section_heading"))
        return F.array(heading, F.when(x["content"] != "", block(kind, x["content"], none, path, "image_section")))

    every = F.array_compact(F.concat(head, F.flatten(F.transform("_sections", section))))
    spread = told.select(doc, "image_type", F.posexplode(every).alias("order_index", "b"))
    return spread.select(doc, "order_index", "b.*", "image_type")


def parse_stats(blocks: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """One row of what was read: documents, blocks, formulas in lines and of their own, and images,
    each as often as it is referred to."""
    parts = block_artifacts(F.col(text))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return blocks.select(doc, parts.alias("p"), F.regexp_count(text, F.lit(r"(?md)^[ \t]*\.\. math::[ \t]*$")).alias("math")).agg(
        F.countDistinct(doc).alias("documents"), F.count("*").alias("blocks"), total(F.col("p.inline_math"), "math_inline"), total(F.col("math"), "math_block"),
        total(F.size("p.image_refs"), "images"),
    )
