"""Small cases with known results for functions and operators."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docfold.functions import arabic
from docfold.functions import json as J
from docfold.functions import text as T
from docfold.operators import catalog, chunking, compare, images, lookup, ranking, retrieval, structure
from docfold.sources import readers
from docfold.streaming import usage


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("٪05", "50٪"), (".03", "30."), (".10 x", "10. x"), (".41 x", "14. x"), ("‏١٢", "12"), ("a ، b", "a، b")])
def test_arabic_numbers(raw, want):
    assert arabic.normalize(raw) == want


def test_arabic_column_and_page_variant(spark):
    rows = spark.createDataFrame([("٪05",), (None,)], "t string")
    assert [r["x"] for r in rows.select(arabic.normalized(F.col("t")).alias("x")).collect()] == ["50٪", None]
    assert arabic.normalize(".03", at_end=False) == ".03"


@pytest.mark.parametrize(("raw", "want"), [('["en","ar"]', ["en", "ar"]), ("['en','ar']", ["en", "ar"]), ("not-json", []), ('{"a": 1}', []), (None, [])])
def test_string_lists(spark, raw, want):
    assert one(spark, J.string_list(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [('```json\n{"a": 1}\n```', ("ok", '{"a":1}')), ('Sure: {"a": {"b": 2}} ok', ("repaired", '{"a":{"b":2}}')), ("none", ("failed", None)), ("", ("failed", None))],
)
def test_repaired_json(spark, raw, want):
    assert tuple(one(spark, J.repaired(F.col("t")), t=raw)) == want


def test_leaves(spark):
    raw = json.dumps({"a": {"b": [1, None, {}]}, "c": [], "d": True})
    got = {r["path"]: r["value"] for r in one(spark, J.leaves(F.col("t")), t=raw)}
    assert got == {"a.b[0]": "1", "a.b[1]": "", "a.b[2]": "{}", "c": "[]", "d": "True"}
    assert one(spark, J.leaves(F.col("t")), t="{") is None


def test_text_functions(spark):
    assert one(spark, T.tokens(F.col("t")), t="Élan élan a_b x 12") == ["élan", "a_b", "12"]
    assert one(spark, T.normalize_spaces(F.col("t")), t=" a  b\r\n\r\n\r\n\r\nc ") == "a b\n\nc"
    assert one(spark, T.detect_languages(F.col("t")), t="مرحبا abc") == ["ar", "en"]
    assert one(spark, T.detect_languages(F.col("t")), t="123") == ["unknown"]
    assert one(spark, T.step_number(F.col("t")), t="step 2: go") == "step 2:"
    assert one(spark, T.step_number(F.col("t")), t="Step 1. go") == ""
    long = "x" * 600 + "\n\n" + "y " * 300
    assert one(spark, T.excerpt_at_border(F.col("t")), t=long) == "x" * 600 + " ..."
    assert one(spark, T.excerpt_at_border(F.col("t")), t="word " * 300).endswith("word ...")
    assert one(spark, T.excerpt_at_border(F.col("t")), t="z" * 1000) == "z" * 900 + " ..."
    assert one(spark, T.asset_url(F.col("t")), t="/data/a/b.png") == "/assets/a/b.png"
    assert one(spark, T.title_of_path(F.col("t")), t="/x/my_run-book.txt") == "my run book"
    assert one(spark, T.cleaned_list(F.col("t"), 2, True), t='1. "How"\n- how?\n* Why?\nWhat') == ["How?", "Why?"]
    assert one(spark, T.closed_labels(F.col("t"), ["visual", "policy"]), t="Policy, x\nvisual") == ["policy", "visual"]


def test_embedding_text(spark):
    made = T.embedding_text(F.lit("Runbook"), F.array(F.lit("Runbook"), F.lit("Recovery")), F.lit("procedure_chunk"), F.lit("page 3"), F.lit("body"), F.lit("procedural"))
    assert one(spark, made).split("\n") == ["Document title: Runbook", "Archetype: procedural", "Section path: Runbook > Recovery", "Content type: procedure_chunk", "Location: page 3", "", "Content:", "body"]


def test_windows(spark):
    text = "a b c d\n\ne f g h\n\ni j k l"
    rows = chunking.window_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "d int, t string"), "d", "t", 6, 2)
    got = [(r["d"], r["chunk_index"], r["content"]) for r in rows.orderBy("d", "chunk_index").collect()]
    assert got == [(1, 0, "a b c d"), (1, 1, "a b c d\n\ne f g h"), (1, 2, "e f g h\n\ni j k l")]
    no_overlap = chunking.window_chunks(spark.createDataFrame([(1, text)], "d int, t string"), "d", "t", 6, 0)
    assert no_overlap.count() == 3
    kept = chunking.window_chunks(spark.createDataFrame([(1, text + "\n\nm")], "d int, t string"), "d", "t", 4, 0, least=2)
    assert [r["chunk_index"] for r in kept.orderBy("chunk_index").collect()] == [0, 1, 2]


def test_line_overlap(spark):
    blocks = F.array(F.lit("a b\nc d"), F.lit("e f g"), F.lit("h i"))
    assert one(spark, chunking.line_overlap_windows(blocks, 5, 2)) == ["a b\nc d", "c d\n\ne f g", "e f g\n\nh i"]


def blocks_frame(spark, rows):
    full = [("d", "Doc", i, b, k, t, None, p.split("/"), None, s, n) for i, (b, k, t, p, s, n) in enumerate(rows)]
    schema = "doc string, document_title string, order_index bigint, block_id string, block_type string, text string, title string, section_path array<string>, sheet_name string, slide_number int, n_images int"
    return spark.createDataFrame(full, schema)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("h1", "heading", "H", "S", None, 0), ("s1", "step", "1. do", "S", None, 0), ("p1", "paragraph", "x", "S", None, 0), ("s2", "step", "2. do", "S", None, 0), ("p2", "paragraph", "y", "S", None, 0)],
         [(["h1", "s1", "p1"], "procedure_chunk"), (["s2", "p2"], "procedure_chunk")]),
        ([("h1", "heading", "H", "S", None, 0), ("p1", "paragraph", "see", "S", None, 0), ("f1", "figure", "pic", "S", None, 1), ("c1", "caption", "cap", "S", None, 0)],
         [(["h1", "p1", "f1", "c1"], "figure_explainer_chunk")]),
        ([("b0", "heading", "H", "S", None, 0), ("b1", "step", "1. design it", "S", None, 1), ("b2", "paragraph", "verify", "S", None, 0)], [(["b0", "b1", "b2"], "mixed_context_chunk")]),
        ([("b0", "heading", "H", "S", None, 0), ("b1", "paragraph", "shall record exceptions", "S", None, 0), ("b2", "paragraph", "more", "S", None, 0)], [(["b0", "b1", "b2"], "policy_clause_chunk")]),
        ([("b0", "paragraph", "on a slide", "S", 4, 0)], [(["b0"], "slide_chunk")]),
        ([("h1", "heading", "A", "S", None, 0), ("h2", "heading", "B", "S", None, 0)], [(["h1", "h2"], "section_chunk")]),
        ([("p1", "paragraph", "x", "S", None, 0), ("p2", "paragraph", "y", "T", None, 0), ("t", "table", "a|b", "T", None, 0)], [(["p1"], "narrative_chunk"), (["p2"], "narrative_chunk"), (["t"], "table_chunk")]),
    ],
)
def test_chunks_of_blocks(spark, rows, want):
    made = chunking.build_chunks(blocks_frame(spark, rows), "doc", "document_title").orderBy("chunk_index").collect()
    assert [(r["block_ids"], r["chunk_type"]) for r in made] == want


def test_sections_and_blocks(spark):
    text = "lost\n\nGuide\n=====\nintro\n\nPart\n----\nbody\nmore\n\nlast\nNext\n====\nend"
    lines = structure.split_lines(spark.createDataFrame([(1, text)], "d int, t string"), "d", "t")
    placed = structure.sections(structure.underlined(lines, "d"), "d")
    got = {(r["line"], "/".join(r["section_path"])) for r in placed.collect() if r["line"]}
    assert got == {("intro", "Guide"), ("body", "Guide/Part"), ("more", "Guide/Part"), ("last", "Guide/Part"), ("end", "Next")}
    blocks = structure.blank_line_blocks(lines, ["d"]).orderBy("block").collect()
    assert [(b["first_line"], b["last_line"]) for b in blocks] == [(0, 0), (2, 4), (6, 9), (11, 14)]


def test_typed_blocks(spark):
    text = "Guide\n=====\nfirst line\nsecond line\n\n1. do it\n- item\n\nPart Two\n--------\nbody"
    lines = structure.split_lines(spark.createDataFrame([(1, text), (2, "no heading here.")], "d int, t string"), "d", "t")
    got = [(r["block_type"], r["text"], r["section_path"]) for r in structure.typed_blocks(lines, "d").orderBy("d", "order_index").collect()]
    assert got == [
        ("heading", "Guide", ["Guide"]), ("paragraph", "first line second line", ["Guide"]), ("step", "1. do it", ["Guide"]), ("list_item", "- item", ["Guide"]),
        ("heading", "Part Two", ["Guide", "Part Two"]), ("paragraph", "body", ["Guide", "Part Two"]), ("paragraph", "no heading here.", []),
    ]


def test_images_belong_to_the_first_chunk_that_shows_them(spark):
    found = spark.createDataFrame([("d", "a.png"), ("d", "b.png")], "doc string, image_path string")
    shown = spark.createDataFrame([("d", "b1", "a.png"), ("d", "b2", "a.png")], "doc string, block_id string, image_path string")
    chunks = spark.createDataFrame([("d", "c1", 0, ["b1"]), ("d", "c2", 1, ["b1", "b2"])], "doc string, chunk_id string, chunk_index int, block_ids array<string>")
    got = {r["image_path"]: r["related_chunk_id"] for r in images.linked(found, shown, chunks, "doc").collect()}
    assert got == {"a.png": "c1", "b.png": None}


@pytest.mark.parametrize(("text", "want"), [("Figure 2: Recovery workflow", "caption"), ("Region   Status   Lag", "table"), ("1. go on", "step"), ("RECOVERY PLAN", "heading"), ("It is done.", "paragraph")])
def test_unit_types(spark, text, want):
    assert one(spark, structure.unit_type(F.col("t")), t=text) == want


def test_regions(spark):
    cells = [["Month", "Value"], ["Jan", "1"], ["Feb", "2"], ["", " "], ["Owner", "Finance"], ["Currency", "USD"]]
    rows = spark.createDataFrame([("s", i, c) for i, c in enumerate(cells)], "sheet string, row_no int, cells array<string>")
    got = structure.region_types(structure.regions(rows, ["sheet"]), ["sheet"]).orderBy("region").collect()
    assert [r["region_type"] for r in got] == ["table", "key_value"]
    assert one(spark, structure.row_text(F.array(F.lit("a"), F.lit("")), F.array(F.lit("1"), F.lit("2"), F.lit("")))) == "a: 1 | column_2: 2"


def test_arabic_chapters(spark):
    lines = ["قبل", "الفصل الأول", "المادة (1) نطاق", "نص", "الفصل الثاني", "نص آخر"]
    rows = spark.createDataFrame([("d", 1, i, l, False) for i, l in enumerate(lines)], "d string, page_number int, line_no int, line string, is_contents boolean")
    got = structure.chapter_machine(rows, "d").orderBy("line_no").collect()
    assert [(r["line"], r["chapter"], r["article"]) for r in got] == [("نص", "الفصل الأول", "المادة (1) نطاق"), ("نص آخر", "الفصل الثاني", None)]


def test_images(spark):
    rows = [("d", f"i{k}", k, "same", 518, 144) for k in range(3)] + [("d", "big", 3, "other", 1200, 800), ("d", "tiny", 4, "t", 105, 23)]
    frame = spark.createDataFrame(rows, "doc string, image_id string, n int, digest string, width int, height int")
    told = images.drop_reasons(frame, "doc", repeats=3)
    assert {r["drop_reason"]: r["n_images"] for r in images.reasons_by_document(told, "doc").collect()} == {"repeated_small_asset": 3, "too_small": 1}
    blocks = spark.createDataFrame([("d", "heading", "H", []), ("d", "figure", "", ["tiny"]), ("d", "figure", "", ["big", "i0"])], "doc string, block_type string, text string, image_ids array<string>")
    left = images.prune(blocks, told, "doc").collect()
    assert sorted((r["block_type"], tuple(r["image_ids"])) for r in left) == [("figure", ("big",)), ("heading", ())]
    shown = frame.select("doc", "image_id", "n", F.lit(None).cast("string").alias("caption_text"), F.lit("p").alias("image_path"), F.concat(F.lit("Page "), F.col("n").cast("string")).alias("location"))
    made = {r["n"]: r["caption_text"] for r in images.captions(shown, "doc", "n", 2, lambda p: F.lit("seen")).collect()}
    assert (made[0], made[1], made[2]) == ("seen", "seen", "Image from Page 2")


def test_ranking_cases(spark):
    schema = "id string, title string, section_path array<string>, content string, chunk_type string, image_refs array<string>, score double, matched_queries array<int>, image_caption_support double, ai_bonus double"
    text = "Parameters of the service and how they are set in long lines of prose"
    rows = spark.createDataFrame(
        [("narrative", "About the whole service here", ["a"], text, "narrative_chunk", [], 0.84, [0], 0.0, 0.0), ("table", "About the whole service here", ["b"], "port: 80\nhost: x\nmode: y", "table_chunk", [], 0.79, [0], 0.0, 0.0)], schema
    )
    ranked = ranking.rich_score(rows, F.lit("which parameters"), F.lit("parameter_list"), F.array(F.lit("table")))
    assert ranked.orderBy(F.desc("rank_score")).first()["id"] == "table"
    other = rows.select(*[F.col(c) for c in rows.columns if c not in ("matched_queries",)], F.array(F.lit(0), F.lit(1)).alias("matched_queries"))
    higher = ranking.rich_score(other, F.lit("q"), F.lit(""), F.array(F.lit("none"))).collect()
    assert all(r["rank_score"] > 0 for r in higher)
    bonus = spark.createDataFrame([(0,), (None,)], "p int").select(F.round(ranking.ai_bonus(F.col("p"), F.lit(2)), 4).alias("b")).collect()
    assert [r["b"] for r in bonus] == [0.18, 0.0]


def test_sections_consolidate_to_the_richest(spark):
    rows = spark.createDataFrame(
        [("thin", "s", ["A "], "x", [], 0.57), ("rich", "s", ["a"], "x y z", [], 0.52), ("other", "s", ["b"], "x", [], 0.50), ("free", None, ["a"], "x", [], 0.4)],
        "id string, src string, path array<string>, content string, imgs array<string>, rank_score double",
    )
    kept = ranking.consolidate_sections(rows, "src", F.col("path"), "content", "imgs", "id").orderBy(F.desc("rank_score")).collect()
    assert [(r["id"], r["rank_score"]) for r in kept] == [("rich", 0.57), ("other", 0.5), ("free", 0.4)]


@pytest.mark.parametrize(("linked", "visual", "want"), [("c1", False, ["i1"]), ("zz", True, ["i1", "i2"]), ("zz", False, ["ref::r.png"])])
def test_image_candidates(spark, linked, visual, want):
    found = spark.createDataFrame([("i1", linked, "a.png", "d1", 0.3), ("i2", "yy", "b.png", "d1", 0.6), ("i3", "yy", "c.png", "d9", 0.9)], "image_id string, related_chunk_id string, image_path string, document_id string, score double")
    top = spark.createDataFrame([("c1", "d1", ["r.png"], 0.8, 1)], "chunk_id string, document_id string, image_refs array<string>, score double, rank int")
    assert sorted(r["image_id"] for r in ranking.image_candidates(found, top, visual).collect()) == want
    assert ranking.image_candidates(found, top.limit(0), visual).count() == 0


def test_image_support_lifts_chunks(spark):
    pictures = spark.createDataFrame([("c1", 0.9, 0.5), ("c2", 0.8, 0.9), ("c3", 0.1, 0.1), (None, 1.0, 1.0)], "related_chunk_id string, score double, caption_score double")
    known = spark.createDataFrame([("c1", 0.5)], "chunk_id string, score double")
    chunks = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "chunk_id string")
    got = {r["chunk_id"]: (r["score"], round(r["image_caption_support"], 3)) for r in retrieval.with_image_support(known, pictures, chunks).collect()}
    assert got == {"c1": (0.5, 0.24), "c2": (0.0, 0.24)}


def test_catalog(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, v string, created int")
    new = spark.createDataFrame([(2, "c", 99), (3, "d", 30)], "id int, v string, created int")
    assert sorted(map(tuple, catalog.upsert(old, new, "id", "created").collect())) == [(1, "a", 10), (2, "c", 20), (3, "d", 30)]
    catalog.publish(old, str(tmp_path), "t")
    catalog.publish(new, str(tmp_path), "t")
    assert catalog.current(spark, str(tmp_path), "t").count() == 2
    with pytest.raises(Exception, match="do not match"):
        catalog.paired(old, new, "id").collect()


def test_comparison(spark):
    rows = spark.createDataFrame([(1, "p", "a", "10"), (1, "p", "b", "12"), (1, "q", "a", "x"), (1, "q", "b", "y"), (1, "r", "a", "same")], "g int, path string, model string, value string")
    got = {r["path"]: (r["n_missing"], r["issue"]) for r in compare.issues(rows, ["g"], "model").collect()}
    assert got == {"p": (0, "numeric_mismatch"), "q": (0, "value_mismatch"), "r": (1, None)}
    best = {r["path"]: r["consensus_value"] for r in compare.consensus(rows, ["g"], "model").collect()}
    assert best == {"p": "12", "q": "y", "r": "same"}
    assert one(spark, compare.ratio(F.col("a"), F.col("b")), a="abcd", b="bcde") == pytest.approx(0.75)


def test_lookup(spark):
    asked = spark.createDataFrame([(" Rome ",), ("italy",), ("mars",)], "place string")
    aliases = spark.createDataFrame([("rome", "Italy")], "alias string, name string")
    records = spark.createDataFrame([("Italy", 20), ("Egypt", 30)], "name string, t int")
    got = {r["place"]: (r["t"], r["found"], r["supported"]) for r in lookup.two_hop(asked, aliases, records, "place").collect()}
    assert got == {" Rome ": (20, True, None), "italy": (20, True, None), "mars": (None, False, "egypt, italy")}


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_files_to_blocks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"policy": {"owner": "security", "required": True}}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "sub" / "n.txt").write_text("x\ny")
    (tmp_path / "z.bin").write_text("?")
    p = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p("Heading1", "Remote Work") + p("Heading2", "Eligibility") + p("Normal", "All staff.")
    (tmp_path / "m.docx").write_bytes(zipped(**{"word/document.xml": f'<w:document xmlns:w="{readers.W[1:-1]}">{body}</w:document>'}))
    slide = f'<p xmlns:a="{readers.A[1:-1]}"><a:p><a:r><a:t>Title</a:t></a:r></a:p><a:p><a:r><a:t>Body</a:t></a:r></a:p></p>'
    (tmp_path / "s.pptx").write_bytes(zipped(**{"ppt/slides/slide1.xml": slide}))
    sheet = f'<worksheet xmlns="{readers.S[1:-1]}"><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></worksheet>'
    book = f'<workbook xmlns="{readers.S[1:-1]}" xmlns:r="{readers.RELATION[1:-3]}"><sheets><sheet name="One" r:id="r7"/><sheet name="Two"/></sheets></workbook>'
    relations = '<Relationships xmlns="x"><Relationship Id="r7" Target="worksheets/first.xml"/></Relationships>'
    other = sheet.replace("<v>7</v>", "<v>8</v>")
    shared = f'<sst xmlns="{readers.S[1:-1]}"><si><t>Month</t></si></sst>'
    files = {"xl/worksheets/first.xml": sheet, "xl/worksheets/sheet2.xml": other, "xl/workbook.xml": book, "xl/sharedStrings.xml": shared, "xl/_rels/workbook.xml.rels": relations}
    (tmp_path / "x.xlsx").write_bytes(zipped(**files))
    (tmp_path / "y.xlsx").write_bytes(b"no workbook")
    known, unknown = readers.routed(readers.scan(spark, str(tmp_path)))
    assert [r["suffix"] for r in unknown.collect()] == ["bin"]
    of = lambda kind: known.where(F.col("kind") == kind)
    blocks = readers.json_blocks(of("json")).collect()
    assert {(b["block_type"], b["json_path"]) for b in blocks} >= {("paragraph", "$.policy"), ("paragraph", "$.policy.owner"), ("error", None)}
    words = readers.docx_blocks(of("docx")).orderBy("order_index").collect()
    assert words[-1]["section_path"] == ["m", "Remote Work", "Eligibility"] and words[-1]["block_type"] == "paragraph"
    assert [b["block_type"] for b in readers.pptx_blocks(of("pptx")).orderBy("order_index").collect()] == ["heading", "paragraph"]
    sheets = readers.xlsx_rows(of("xlsx")).collect()
    assert {r["sheet_name"]: r["cells"] for r in sheets if r["error"] is None} == {"One": ["Month", "", "7"], "Two": ["Month", "", "8"]}
    assert [r["title"] for r in sheets if r["error"]] == ["y"]
    assert readers.text_lines(of("text")).count() == 2


def test_markup_files_to_blocks(spark, tmp_path):
    text = """lost
Guide
=====
intro  text
goes on
- one
- two

Part
----
.. code-block:: bash

    ls
    cd

.. note:: Mind this

.. figure:: img/../a.png
   :alt: An image
   :width: 3

   Shown here
.. image:: gone.png
   :alt: not there

after"""
    (tmp_path / "my_doc.rst").write_text(text)
    (tmp_path / "a.png").write_bytes(b"x")
    files = readers.scan(spark, str(tmp_path))
    rows = readers.rst_blocks(files.where("kind = 'rst'"), files.where("kind = 'image'")).orderBy("order_index").collect()
    # A heading of the first level takes the place of the document's title; a rule is as long as its title.
    assert [(r["block_type"], r["text"], "/".join(r["section_path"])) for r in rows] == [
        ("paragraph", "lost", "my doc"), ("heading", "Guide", "Guide"), ("paragraph", "intro text\ngoes on", "Guide"), ("list_item", "- one\n- two", "Guide"),
        ("heading", "Part", "Guide/Part"), ("code", "bash", "Guide/Part"), ("paragraph", "ls\n cd", "Guide/Part"),
        ("note", "Mind this", "Guide/Part"), ("caption", "Shown here", "Guide/Part"), ("paragraph", "after", "Guide/Part"),
    ]
    figure = rows[-2]
    assert (figure["alt_text"], figure["directive"], figure["image_path"].endswith("/a.png")) == ("An image", "figure", True)
    assert [(r["line_start"], r["line_end"]) for r in rows[:4]] == [(1, 1), (2, 3), (4, 5), (6, 8)]
    assert [r["order_index"] for r in rows] == list(range(len(rows)))


def test_streaming_days(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 10:00:00' + make_dt_interval(0, id * 6) AS asked_at, 'u' AS session_id FROM range(20)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    usage.run_once(usage.daily(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    closed = {str(r["day"])[:10]: r["questions"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert closed == {"2024-01-01": 3, "2024-01-02": 4, "2024-01-03": 4, "2024-01-04": 4}


def test_quotes_inside_a_line_stay(spark):
    answer = "1) What's new in \"v2\"?\n- 'Quoted'\n• dot"
    assert one(spark, T.cleaned_list(F.col("t"), 5), t=answer) == ['What\'s new in "v2"?', "Quoted", "• dot"]


def test_only_arabic_indic_digits_are_rewritten():
    assert arabic.normalize("٣ ۴") == "3 ۴"


def test_bytes_that_are_no_text_are_left_out(spark):
    files = spark.createDataFrame([(bytearray(b"ab\xffc"),), (bytearray("é".encode()),), (None,)], "content binary")
    assert [r["text"] for r in readers.decoded(files).collect()] == ["abc", "é", None]


def test_a_model_without_leaves_is_missing(spark):
    rows = spark.createDataFrame([(1, "p", "a", "x"), (1, "p", "b", "x")], "g int, path string, model string, value string")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "g int, model string")
    assert compare.issues(rows, ["g"], "model", asked).first()["n_missing"] == 1
    assert compare.issues(rows, ["g"], "model").first()["n_missing"] == 0
