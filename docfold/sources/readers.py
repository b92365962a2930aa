"""Files to lines, blocks and rows.

A scan lists files with Spark's own readers, so any store that Spark reads will do; files of
one kind are then parsed in parallel, a file at a time inside its task. Containers are read with
the standard library alone.
"""

from __future__ import annotations

import io
import posixpath
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, structure

# Suffixes by the kind of file that they stand for.
KINDS = {
    "text": ["txt"],
    "json": ["json"],
    "rst": ["rst"],
    "docx": ["docx"],
    "pptx": ["pptx"],
    "xlsx": ["xlsx"],
    "pdf": ["pdf"],
    "image": ["png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff"],
}
BLOCK_SCHEMA = "block_type string, text string, heading_level int, section_path array<string>, json_path string, slide_number int, sheet_name string"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_kind(path: Column) -> Column:
    """The kind of a file by its suffix; null for files that no parser takes."""
    out = F.lit(None).cast("string")
    for kind, names in KINDS.items():
        out = F.when(suffix(path).isin(names), kind).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, recurse: bool = True, pattern: str | None = None) -> DataFrame:
    """Files below ``root`` with path, content, kind, checksum, document_id and title."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recurse).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(root).select("path", "content", "length")
    return catalog.identified(files).withColumn("kind", file_kind(F.col("path")))


def routed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that some parser takes, and the others."""
    return files.where("kind is not null"), files.where("kind is null").select("path", suffix(F.col("path")).alias("suffix"))


def decoded(files: DataFrame) -> DataFrame:
    """Text files with their text; bytes that are no UTF-8 are left out."""

    @F.arrow_udf("string")
    def without_errors(batch: pa.Array) -> pa.Array:
        return pa.array([None if b is None else b.decode("utf-8", "ignore") for b in batch.to_pylist()], pa.string())

    return files.withColumn("text", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(without_errors(F.col("content"))))


def text_lines(files: DataFrame) -> DataFrame:
    return structure.split_lines(decoded(files), "document_id", "text")


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def static_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object of records as rows (name, record); ``schema`` is that of one record."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"map<string,{schema}>").alias("m"))
    return parsed.select(F.explode("m").alias("name", "record"))


def _parsed(files: DataFrame, parse: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """(document_id, title, order_index, block_id, fields of BLOCK_SCHEMA) of each file's blocks.

    A file that does not parse gives one block of type ``error``.
    """
    fields = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]

    @F.arrow_udf(f"array<struct<{BLOCK_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    def run(contents: pa.Array) -> pa.Array:
        kind = pa.struct([
            ("block_type", pa.string()), ("text", pa.string()), ("heading_level", pa.int32()), ("section_path", pa.list_(pa.string())),
            ("json_path", pa.string()), ("slide_number", pa.int32()), ("sheet_name", pa.string()),
        ])
        out = []
        for raw in contents.to_pylist():
            try:
                out.append([{f: b.get(f) for f in fields} for b in parse(raw or b"")])
            except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                out.append([{f: {"block_type": "error", "text": str(e)}.get(f) for f in fields}])
        return pa.array(out, pa.list_(kind))

    spread = files.select("document_id", "title", F.posexplode(run("content")).alias("order_index", "b"))
    rows = spread.select("document_id", "title", F.col("order_index").cast("bigint").alias("order_index"), "b.*")
    titled = F.concat(F.array("title"), F.coalesce("section_path", F.array().cast("array<string>")))
    block_id = F.concat_ws("-block-", "document_id", F.col("order_index").cast("string"))
    return rows.withColumns({"section_path": titled, "block_id": block_id})


def _shown(value) -> str:
    return value if isinstance(value, str) else str(value)


def _json_parts(value, path: str = "$") -> Iterator[tuple[str, str]]:
    """Scalar members of an object as lines, scalar lists in one line, and every leaf."""
    if isinstance(value, dict):
        own = [f"{k}: {_shown(v)}" for k, v in value.items() if not isinstance(v, (dict, list))]
        if own:
            yield path, "\n".join(own)
        inner = [(f"{path}.{k}", v) for k, v in value.items()]
    elif isinstance(value, list):
        if value and not any(isinstance(v, (dict, list)) for v in value):
            yield path, ", ".join(map(_shown, value))
        inner = [(f"{path}[{i}]", v) for i, v in enumerate(value)]
    else:
        yield path, _shown(value)
        inner = []
    for below, v in inner:
        yield from _json_parts(v, below)


def json_blocks(files: DataFrame) -> DataFrame:
    def parse(raw: bytes) -> Iterator[dict]:
        for path, text in _json_parts(json.loads(raw.decode("utf-8", "ignore"))):
            if text.strip():
                yield {"block_type": "paragraph", "text": text.strip(), "section_path": [path], "json_path": path}

    return _parsed(files, parse)


def _headed(paragraphs: Iterator[tuple[str, int | None, str]]) -> Iterator[dict]:
    """Blocks with the path of the headings that are open at each."""
    stack: list[tuple[int, str]] = []
    for kind, level, text in paragraphs:
        if level is not None:
            stack = [h for h in stack if h[0] < level] + [(level, text)]
        yield {"block_type": kind, "text": text, "heading_level": level, "section_path": [t for _, t in stack]}


# Directives that show images, and how far their options are indented.
IMAGE_DIRECTIVES = {"image", "figure"}
INDENTED = ("   ", "\t")
MARKUP = "struct<block_type:string,text:string,heading_level:int,section_path:array<string>,line_start:int,line_end:int,directive:string,image_target:string,alt_text:string>"


class _Markup:
    """The blocks of one reStructuredText file, line by line; numbers of lines begin at 1.

    An open block ends at an empty line, a heading, a directive, or where a list begins. Its kind
    is told by the directive before it, and lasts over empty lines until the block holds a text.
    A path begins with None, which stands for the document's title.
    """

    def __init__(self, lines: list[str]):
        self.lines, self.path, self.out = lines, [None], []
        self.kind, self.rows, self.start = "paragraph", [], 1

    def give(self, kind: str, text: str, first: int, last: int, **rest) -> None:
        self.out.append({"block_type": kind, "text": text, "section_path": list(self.path), "line_start": first, "line_end": last, **rest})

    def close(self, last: int) -> None:
        text, self.rows = "\n".join(self.rows), []
        if text.strip():
            directive = None if self.kind == "paragraph" else {"code": "code_block"}.get(self.kind, self.kind)
            self.give(self.kind, text, self.start, last, directive=directive)
            self.kind = "paragraph"

    def heading(self, at: int) -> bool:
        title, rule = self.lines[at].strip(), (self.lines[at + 1] if at + 1 < len(self.lines) else "")
        if not title or not rule.strip() or len(rule) < len(title) or set(rule.strip()) - set(structure.LEVELS):
            return False
        self.close(at)
        level = structure.LEVELS.index(rule.strip()[0]) + 1
        self.path = [*self.path[: level - 1], title]
        self.give("heading", title, at + 1, at + 2, heading_level=level)
        return True

    def image(self, at: int, directive: str, target: str) -> int:
        """Gives a caption block and returns the number of the first line after its options."""
        end = at + 1
        while end < len(self.lines) and (not self.lines[end].strip() or self.lines[end].startswith(INDENTED)):
            end += 1
        own = [x.strip() for x in self.lines[at + 1 : end] if x.strip()]
        alt = [x.removeprefix(":alt:").strip() for x in own if x.startswith(":alt:")]
        said = "\n".join(x for x in own if not x.startswith(":"))
        alt_text = alt[-1] if alt else ""
        self.give("caption", said or alt_text or target, at + 1, end, directive=directive, image_target=target, alt_text=alt_text)
        return end

    def blocks(self) -> list[dict]:
        at = 0
        while at < len(self.lines):
            line = self.lines[at]
            if self.heading(at):
                at += 2
                continue
            if named := re.match(r"\.\.\s+([a-zA-Z0-9_-]+)::\s*(.*)$", line):
                self.close(at)
                name, said = named[1], named[2].strip()
                if name in IMAGE_DIRECTIVES:
                    at = self.image(at, name, said)
                    continue
                self.kind, self.start, self.rows = "code" if name == "code-block" else "note", at + 1, [said] if said else []
            elif self.kind == "code" and line.startswith("    "):
                self.add(at, line[4:])
            elif not line.strip():
                self.close(at + 1)
            else:
                if line.lstrip().startswith(("- ", "* ")):
                    if self.rows and self.kind != "list_item":
                        self.close(at)
                    self.kind = "list_item"
                self.add(at, line)
            at += 1
        self.close(len(self.lines))
        return self.out

    def add(self, at: int, row: str) -> None:
        if not self.rows:
            self.start = at + 1
        self.rows.append(row)


def resolved(path: Column) -> Column:
    """A path without ``.`` parts and, up to eight levels deep, without ``..`` parts."""
    out = F.regexp_replace(path, r"/(?:\./)+", "/")
    for _ in range(8):
        out = F.regexp_replace(out, r"/(?!\.\./)[^/]+/\.\./", "/")
    return out


def rst_blocks(files: DataFrame, images: DataFrame) -> DataFrame:
    """(document_id, title, order_index, block_id, fields of MARKUP, image_path) of reStructuredText files.

    ``images`` has the path of each file that may be shown; an image directive whose file is not
    among them gives no block. Texts have their spaces normalised, code too.
    """

    @F.arrow_udf(f"array<{MARKUP}>")
    def run(texts: pa.Array) -> pa.Array:
        names = ["block_type", "text", "heading_level", "section_path", "line_start", "line_end", "directive", "image_target", "alt_text"]
        whole = {"heading_level": pa.int32(), "line_start": pa.int32(), "line_end": pa.int32(), "section_path": pa.list_(pa.string())}
        kind = pa.struct([(n, whole.get(n, pa.string())) for n in names])
        return pa.array([[{n: b.get(n) for n in names} for b in _Markup((t or "").splitlines()).blocks()] for t in texts.to_pylist()], pa.list_(kind))

    rows = decoded(files).select("path", "document_id", "title", F.posexplode(run("text")).alias("_at", "b")).select("path", "document_id", "title", "_at", "b.*")
    shown = F.when(F.col("image_target").isNotNull(), resolved(T.sibling_path(F.col("path"), F.col("image_target"))))
    found = images.select(F.col("path").alias("image_path"), F.lit(True).alias("_found")).distinct()
    kept = rows.withColumn("image_path", shown).join(found, "image_path", "left").where("image_target is null or _found")
    kept = kept.withColumn("order_index", (F.row_number().over(Window.partitionBy("document_id").orderBy("_at")) - 1).cast("bigint"))
    return kept.withColumns({
        "section_path": F.transform("section_path", lambda p: F.coalesce(p, F.col("title"))),
        "text": T.normalize_spaces(F.col("text")),
        "block_id": F.concat_ws("-block-", "document_id", F.col("order_index").cast("string")),
    }).drop("_at", "_found", "path")


def docx_blocks(files: DataFrame) -> DataFrame:
    """Paragraphs of Word files; styles named Heading and a number are headings."""

    def parse(raw: bytes) -> Iterator[dict]:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))

        def paragraphs() -> Iterator[tuple[str, int | None, str]]:
            for p in root.iter(f"{W}p"):
                text = "".join(t.text or "" for t in p.iter(f"{W}t")).strip()
                style = p.find(f"{W}pPr/{W}pStyle")
                name = "" if style is None else style.get(f"{W}val", "")
                level = re.fullmatch(r"(?i)heading\s*(\d+)", name)
                listed = p.find(f"{W}pPr/{W}numPr") is not None or "list" in name.lower()
                if not text:
                    continue
                if level:
                    yield "heading", int(level[1]), text
                elif "caption" in name.lower():
                    yield "caption", None, text
                elif re.match(r"(?:step\s+)?(?:\d+|[a-zA-Z])[).:-]\s+", text):
                    yield "step", None, text
                else:
                    yield ("list_item" if listed else "paragraph"), None, text

        return _headed(paragraphs())

    return _parsed(files, parse)


def pptx_blocks(files: DataFrame) -> DataFrame:
    """Title and body of each slide, then its notes."""

    def parse(raw: bytes) -> Iterator[dict]:
        archive = zipfile.ZipFile(io.BytesIO(raw))
        names = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
        for number, name in sorted(names):
            texts = _paragraph_texts(archive.read(name))
            title = texts[0] if texts else f"Slide {number}"
            place = {"section_path": [title], "slide_number": number}
            if texts:
                yield {"block_type": "heading", "text": title, "heading_level": 1, **place}
            if texts[1:]:
                yield {"block_type": "paragraph", "text": "\n".join(texts[1:]), **place}
            notes = f"ppt/notesSlides/notesSlide{number}.xml"
            if notes in archive.namelist() and (said := _paragraph_texts(archive.read(notes))):
                yield {"block_type": "note", "text": "\n".join(said), **place}

    return _parsed(files, parse)


def _paragraph_texts(raw: bytes) -> list[str]:
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{A}t")).strip() for p in ElementTree.fromstring(raw).iter(f"{A}p"))
    return [p for p in paragraphs if p]


# Fixed value: the attribute by which a workbook names a sheet's file.
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def xlsx_rows(files: DataFrame) -> DataFrame:
    """(document_id, title, sheet_name, row_no, cells, error) of each row of each sheet, for the regions' operators.

    A workbook that does not parse gives one row with its error and nothing else.
    """

    @F.arrow_udf("array<struct<sheet_name:string,row_no:int,cells:array<string>,error:string>>")
    def run(contents: pa.Array) -> pa.Array:
        kind = pa.struct([("sheet_name", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
        out = []
        for raw in contents.to_pylist():
            try:
                out.append(list(_sheet_rows(raw or b"")))
            except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                out.append([{"error": str(e)}])
        return pa.array(out, pa.list_(kind))

    return files.select("document_id", "title", F.explode(run("content")).alias("r")).select("document_id", "title", "r.*")


def _sheet_rows(raw: bytes) -> Iterator[dict]:
    archive = zipfile.ZipFile(io.BytesIO(raw))
    names = archive.namelist()
    strings = []
    if "xl/sharedStrings.xml" in names:
        strings = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{S}si")]
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    for i, sheet in enumerate(book.iter(f"{S}sheet"), 1):
        title = sheet.get("name")
        target = targets.get(sheet.get(RELATION), f"worksheets/sheet{i}.xml")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        for row in ElementTree.fromstring(archive.read(path)).iter(f"{S}row"):
            cells: list[str] = []
            for c in row.iter(f"{S}c"):
                column = 0
                for letter in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                    column = column * 26 + ord(letter) - 64
                cells += [""] * (column - len(cells))
                value = c.find(f"{S}v")
                text = "".join(t.text or "" for t in c.iter(f"{S}t")) if value is None else value.text or ""
                cells[column - 1] = strings[int(text)] if c.get("t") == "s" else text
            yield {"sheet_name": title, "row_no": int(row.get("r", "0")), "cells": cells}


def image_blocks(files: DataFrame, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """One block for each image: what ``model`` says of it (a struct of image_type and text), or that it is one."""
    said = model(F.col("content")) if model else F.struct(F.lit("unknown").alias("image_type"), F.concat(F.lit("Image file: "), F.col("title")).alias("text"))
    told = files.select("document_id", "title", F.lit(0).cast("bigint").alias("order_index"), said.alias("s"))
    return told.select("document_id", "title", "order_index", F.lit("figure").alias("block_type"), "s.image_type", "s.text", F.array("title").alias("section_path"))
