"""Paths, units, chunk rows, search in blocks, answers, versions and events against small brute force."""

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from docfold.operators import analytics, answering, catalog, chunking, compare, formats, retrieval, structure


def stack_paths(heads):
    """The open titles after each (level, title), by a stack."""
    open_heads, out = [], []
    for level, title in heads:
        while open_heads and open_heads[-1][0] >= level:
            open_heads.pop()
        open_heads.append((level, title))
        out.append([t for _, t in open_heads])
    return out


def test_paths_equal_a_stack(spark):
    rng = random.Random(1)
    docs = {d: [(rng.randrange(1, 8), f"t{i}") for i in range(rng.randrange(1, 40))] for d in range(40)}
    rows = []
    for d, heads in docs.items():
        for i, (level, title) in enumerate(heads):
            rows += [(d, 3 * i + 1, title, level), (d, 3 * i + 2, "----", None), (d, 3 * i + 3, "body", None)]
    rows += [(0, 0, "before the first", None)]
    lines = spark.createDataFrame(rows, "d int, line_no int, line string, heading_level int").repartition(3)
    got = {(r["d"], r["heading_line"]): r["section_path"] for r in structure.sections(lines, "d").collect()}
    want = {(d, 3 * i + 1): path for d, heads in docs.items() for i, path in enumerate(stack_paths(heads))}
    assert got == want


def test_nested_rules_give_nested_sections(spark):
    text = "Intro\nA\n===\na\nB\n---\nb\nC\n~~~\nc\nD\n---\nd\nE\n===\ne"
    lines = structure.split_lines(spark.createDataFrame([(1, text)], "d int, t string"), "d", "t")
    placed = structure.sections(structure.underlined(lines, "d", structure.LEVELS), "d")
    assert {r["line"]: r["section_path"] for r in placed.collect()} == {"a": ["A"], "b": ["A", "B"], "c": ["A", "B", "C"], "d": ["A", "D"], "e": ["E"]}


@pytest.mark.parametrize(
    ("line", "heading", "level"),
    [
        ("Scope:", True, 1),
        ("Step 2: open the valve", True, 2),
        ("II. Duties of the board", True, 2),
        ("(3) One, two", False, None),
        ("one two three four five six seven eight nine ten eleven: twelve", True, 1),
        ("one two three four five six seven eight nine ten eleven twelve: thirteen", False, None),
        ("This is a sentence.", False, None),
        ("Figure 3: the plan", False, None),
        ("1. Open it", False, None),
        ("THE WHOLE PLAN OF IT", True, 2),
        ("Safety Rules", True, 1),
        ("a | b | c", False, None),
    ],
)
def test_heading_lines(spark, line, heading, level):
    row = spark.createDataFrame([(line,)], "t string").select(structure.heading_line(F.col("t")).alias("h"), structure.heading_line_level(F.col("t")).alias("l")).first()
    assert row["h"] is heading and (not heading or row["l"] == level)


def test_page_units(spark):
    pages = [
        (1, 1, "Doc", "before any heading here it goes\n\nScope:\nfirst line of text goes here\nsecond line of text.\nRules 2: more\nlast line of it"),
        (1, 2, "Doc", "1. open it\n\nstill under the rules, as it was before"),
        (2, 1, "Other", ""), (3, 1, "Null", None),
    ]
    got = structure.page_units(spark.createDataFrame(pages, "d int, page_number int, document_title string, text string"), "d").orderBy("d", "order_index").collect()
    assert [(r["page_number"], r["block_type"], r["text"], r["heading_level"], r["section_path"]) for r in got] == [
        (1, "paragraph", "before any heading here it goes", None, ["Doc", "Page 1"]),
        (1, "heading", "Scope:", 1, ["Doc", "Scope:"]),
        (1, "paragraph", "first line of text goes here\nsecond line of text.", None, ["Doc", "Scope:"]),
        (1, "heading", "Rules 2: more", 2, ["Doc", "Scope:", "Rules 2: more"]),
        (1, "paragraph", "last line of it", None, ["Doc", "Scope:", "Rules 2: more"]),
        (2, "step", "1. open it", None, ["Doc", "Scope:", "Rules 2: more"]),
        (2, "paragraph", "still under the rules, as it was before", None, ["Doc", "Scope:", "Rules 2: more"]),
    ]


ANCHOR = "anchor struct<page_number:int,slide_number:int,sheet_name:string,json_path:string,rst_path:string,line_start:int,source_label:string>"
BLOCKS = (
    "d int, document_title string, order_index bigint, block_id string, block_type string, text string, title string, section_path array<string>, sheet_name string, "
    f"slide_number int, n_images int, {ANCHOR}, language_tags array<string>, metadata map<string,string>, images array<{chunking.IMAGE}>"
)


def block(n, kind, text, place=None, tags=(), metadata=None, images=(), path=("S",)):
    anchor = (place, None, None, None, None, None, None)
    return (1, "Doc", n, f"b{n}", kind, text, None, list(path), None, None, 0, anchor, list(tags), metadata or {}, [(*i, "", "", "") for i in images])


def test_groups_merge_their_attributes_and_show_images(spark):
    rows = [
        block(0, "heading", "Head", metadata={"a": "0", "h": "x"}),
        block(1, "step", "1. do this", None, ["en"], {"a": "1"}, [("i1", "p1"), ("", "p2")]),
        block(2, "paragraph", "and more", 7, ["fr", "en"], {"a": "2", "b": "y"}, [("i1", "p9"), ("", "p2"), ("i3", "p3")]),
        block(3, "step", "2. do that", 8, [], {"c": "z"}, [("i1", "p1")]),
        block(4, "table", "  ", 9),
    ]
    documents = spark.createDataFrame(
        [(1, "Doc", ["de"], {"a": "doc", "s": "src"}, [("own", "p3", "", "alt", ""), ("own", "p8", "", "", "seen")])],
        f"d int, document_title string, language_tags array<string>, metadata map<string,string>, images array<{chunking.IMAGE}>",
    )
    chunks = chunking.chunk_rows(spark.createDataFrame(rows, BLOCKS), documents, "d").orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["content"], r["language_tags"], r["image_refs"]) for r in chunks] == [
        (0, "Head\n\n1. do this\n\nand more", ["en", "fr"], ["p1", "p2", "p3"]), (1, "2. do that", ["de"], ["p1"]),
    ]
    first = chunks[0]["metadata"]
    assert {k: first[k] for k in "abhs"} == {"a": "2", "b": "y", "h": "x", "s": "src"} and "c" not in first and first["block_ids"] == '["b0","b1","b2"]'
    assert chunks[0]["anchor"]["page_number"] == 7 and chunks[1]["metadata"]["a"] == "doc" and "Location: page 7" in chunks[0]["embedding_text"]
    made = spark.createDataFrame(chunks, chunking.chunk_rows(spark.createDataFrame(rows, BLOCKS), documents, "d").schema)
    images = {r["image_path"]: (r["image_id"], r["related_chunk_id"], r["caption_text"], r["related_section_path"]) for r in chunking.image_rows(made, documents, "d").collect()}
    assert images == {
        "p1": ("i1", chunks[0]["chunk_id"], "", ["S"]), "p2": ("", chunks[0]["chunk_id"], "", ["S"]), "p3": ("i3", chunks[0]["chunk_id"], "", ["S"]), "p8": ("own", None, "seen", ["Doc"]),
    }


@pytest.mark.parametrize(("vectors", "asked"), [(8192, 512), (7, 3)])
def test_search_in_blocks_equals_brute_force(spark, monkeypatch, vectors, asked):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", vectors)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", asked)
    rng = random.Random(6)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(60)]
    rows += [(60 + i, rows[i][1]) for i in range(10)] + [(100, None), (101, [0.0] * 4)]
    questions = [(f"q{i}", rows[i * 3][1]) for i in range(9)] + [("none", None), ("zero", [0.0] * 4)]
    v = spark.createDataFrame(rows, "k bigint, embedding array<float>")
    q = spark.createDataFrame(questions, "query string, query_embedding array<float>")
    want = set()
    for name, x in questions:
        if x and any(x):
            scored = [(round(sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y)), 6), -k) for k, y in rows if y and any(y)]
            want |= {(name, n + 1, -k, s) for n, (s, k) in enumerate(sorted(scored, reverse=True)[:5])}
    got = retrieval.search_many(v, q, 5, "k", "query").collect()
    assert {(r["query"], r["rank"], r["k"], r["score"]) for r in got} == want and len(got) == len(want)
    assert retrieval.search_many(v.limit(0), q, 5, "k", "query").count() == 0 == retrieval.search_many(v, q.limit(0), 5, "k", "query").count()


def test_scores_are_the_same_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(12)], "k int, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(7)], "query_id int, query_embedding array<float>")
    whole = sorted(map(tuple, retrieval.scored(v, q).collect()))
    monkeypatch.setattr(retrieval, "SENT_QUERIES", 2)
    assert sorted(map(tuple, retrieval.scored(v, q).collect())) == whole and len(whole) == 84


def answered(spark, questions, links):
    """Three chunks and three images on a line of vectors, asked at their ends."""
    at = lambda x: [math.cos(x), math.sin(x)]
    chunks = [(1, 10, "s1", "T", ["A"], "alpha text", "x", ["img/ref"], at(0.0)), (2, 20, "s2", "T", ["B"], "beta", "x", [], at(0.3)), (3, 20, "s2", "T", ["B"], "beta beta beta", "x", [], at(1.5))]
    images = [(7, "img/7", 99, "z", ["B"], "nothing", links, at(0.1)), (8, "img/8", 20, "z", ["B"], "alpha", None, at(0.2)), (9, "img/9", 99, "z", ["C"], "other", None, at(1.5))]
    asked = spark.createDataFrame(questions, "question_id int, question string, shape string, evidence array<string>, visual boolean, image_embedding array<double>")
    variants = asked.select("question_id", F.lit(0).alias("variant"), F.col("question").alias("variant_text"), F.array(F.lit(1.0), F.lit(0.0)).alias("query_embedding"))
    c = spark.createDataFrame(chunks, "chunk_id int, document_id int, source_path string, title string, section_path array<string>, content string, chunk_type string, image_refs array<string>, embedding array<double>")
    i = spark.createDataFrame(images, "image_id int, image_path string, document_id int, source_path string, section_path array<string>, caption_text string, related_chunk_id int, embedding array<double>")
    found = answering.retrieve(asked, variants, c, i, 3).collect()
    return {(r["question_id"], r["kind"], r["rank"]): (r["id"], r["tier"]) for r in found}


def test_answers_follow_the_chunks(spark):
    none = [(1, "alpha", "rule", [], False, None), (2, "alpha", "rule", [], True, None), (3, "alpha", "rule", [], False, [0.0, 1.0])]
    got = answered(spark, none, None)
    # Chunks 2 and 3 are one section, of which the richer stays with the higher score.
    assert [got[q, "chunk", r][0] for q in (1, 2) for r in (1, 2)] == ["1", "3", "1", "3"] and (1, "chunk", 3) not in got
    assert {k: v for k, v in got.items() if k[:2] == (1, "image")} == {(1, "image", 1): ("ref::img/ref", 4)}
    assert got[2, "image", 1] == ("8", 2) and (2, "image", 2) not in got
    assert got[3, "image", 1] == ("9", 0) and got[3, "image", 3] == ("7", 0)
    linked = answered(spark, none[:2], 1)
    assert {v for k, v in linked.items() if k[1] == "image"} == {("7", 1)}


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    with pytest.raises(LookupError):
        catalog.current(spark, root, "t")
    assert catalog.publish(spark.range(1), root, "t") == 1
    seen = []

    def failing(*args):
        seen.append(catalog.current(spark, root, "t").count())
        raise RuntimeError("the run ends between both writes")

    with monkeypatch.context() as m:
        m.setattr(catalog, "mark", failing)
        with pytest.raises(RuntimeError):
            catalog.publish(spark.range(5), root, "t")
    assert seen == [1] and catalog.current(spark, root, "t").count() == 1
    assert catalog.publish(spark.range(3), root, "t") == 2
    assert catalog.current(spark, root, "t").count() == 3 and catalog.current(spark, root, "t", version=1).count() == 1
    assert catalog.versions(spark, root, "t").count() == 2


def test_batches_come_once(spark, tmp_path):
    path = str(tmp_path / "events")
    catalog.append_batch(spark.range(3), path, "one")
    catalog.append_batch(spark.range(2), path, "two")
    catalog.append_batch(spark.range(4), path, "one")
    assert {r["batch_id"]: r["n"] for r in spark.read.parquet(path).groupBy("batch_id").agg(F.count("*").alias("n")).collect()} == {"one": 4, "two": 2}


@pytest.fixture
def events(spark):
    t = lambda s, ms=0: dt.datetime(2024, 5, 1, 12, 0, s, ms * 1000)
    requests = spark.createDataFrame(
        [
            ("r1", "s1", "How, many?", False, 8, t(1), t(2, 250), "m", [None, None]), ("r2", None, 'say "x"\nor y', True, 4, t(3), t(3, 40), None, [None, "no index"]),
            ("r3", "s3", "q" * 3000, False, 8, t(2), t(2), "", ["first", "second"]),
        ],
        "request_id string, session_id string, question string, had_image boolean, top_k int, asked_at timestamp, finished_at timestamp, answer_model string, failures array<string>",
    )
    matches = spark.createDataFrame([("r1", 2, "b", "B"), ("r1", 1, "a", "A"), ("r3", 1, "", None)], "request_id string, rank int, source_path string, section_path string")
    return analytics.answer_events(requests, matches)


def test_events_of_failed_requests(events):
    got = {r["request_id"]: r for r in events.collect()}
    assert (got["r1"]["success"], got["r1"]["latency_ms"], got["r1"]["top_source_path"], got["r1"]["retrieved_count"], got["r1"]["question_normalized"]) == (True, 1250, "a", 2, "how many")
    assert (got["r2"]["success"], got["r2"]["error_message"], got["r2"]["retrieved_count"], got["r2"]["top_source_path"]) == (False, "no index", 0, None)
    assert (got["r3"]["error_message"], got["r3"]["answer_model"], got["r3"]["top_source_path"], len(got["r3"]["question_text"])) == ("first", None, None, 2000)


def test_exports_are_ordered_files(events, tmp_path):
    import csv
    import io

    path = str(tmp_path / "export")
    analytics.write_export(events.repartition(3), path)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    text = "".join(open(f"{path}/{f}", encoding="utf-8", newline="").read() for f in files)
    assert text.startswith("﻿asked_at,session_id") and text.count("﻿") == 1
    rows = list(csv.DictReader(io.StringIO(text.removeprefix("﻿"))))
    assert [r["asked_at"][-2:] for r in rows] == ["03", "02", "01"] and list(rows[0]) == analytics.EVENT_COLUMNS
    assert rows[0]["question_text"] == 'say "x"\nor y' and rows[0]["had_image"] == "yes" and rows[0]["session_id"] == "" and rows[2]["question_text"] == "How, many?"


def test_groups_of_too_few_parsed_models_are_not_compared(spark):
    models = spark.createDataFrame([(g, m, ok) for g, oks in ((1, "yyn"), (2, "ynn"), (3, "yyy")) for m, ok in zip("abc", (x == "y" for x in oks))], "g int, model string, parsed boolean")
    rows = spark.createDataFrame([(1, "p", "a", "1"), (1, "p", "b", "2"), (1, "q", "c", "lost"), (2, "p", "a", "1")], "g int, path string, model string, value string")
    got = {(r["g"], r["path"]): (r["available"], r["n_missing"], r["issue"]) for r in compare.gated_issues(rows, models, ["g"], "model").collect()}
    assert got == {(1, "p"): (True, 1, "numeric_mismatch"), (2, None): (False, None, None), (3, None): (True, None, None)}


def test_blocks_of_images(spark):
    told = '{"title": "Plan", "summary": "", "visible_text": ["  a ", "", "b", 3], "sections": [{"heading": "H", "content": "c", "block_type": "Table "}, "odd", {"content": ""}, {"content": "d", "block_type": "x"}]}'
    rows = [(1, "Doc", "f.png", told), (2, "Doc", "f.png", "{broken"), (3, "Doc", "f.png", None), (4, "Doc", "f.png", '{"title": "Doc", "sections": {"a": 1}, "visible_text": "no list", "image_type": "map"}')]
    got = structure.image_blocks(spark.createDataFrame(rows, "d int, document_title string, file_name string, analysis string"), "d").orderBy("d", "order_index").collect()
    assert [(r["block_type"], r["text"], r["heading_level"], r["section_path"]) for r in got if r["d"] == 1] == [
        ("heading", "Plan", 1, ["Doc", "Plan"]), ("figure", "a", None, ["Doc", "Plan"]), ("note", "a\nb\n3", None, ["Doc", "Plan", "Visible Text"]),
        ("heading", "H", 2, ["Doc", "Plan", "H"]), ("table", "c", None, ["Doc", "Plan", "H"]), ("paragraph", "d", None, ["Doc", "Plan"]),
    ]
    assert [(r["d"], r["text"], r["image_type"]) for r in got if r["d"] > 1] == [(2, "Image file: f.png", "unknown"), (3, "Image file: f.png", "unknown"), (4, "Image file: f.png", "map")]


@pytest.mark.parametrize(
    ("file_type", "hint", "want"),
    [("pdf", None, "pdf_section_window"), ("pdf", "slide_window", "slide_window"), ("xls", "unknown", "xlsx_sheet_window"), ("md", None, "generic_blocks"), (None, None, "generic_blocks"), ("ppt", "generic_blocks", "generic_blocks")],
)
def test_strategies(spark, file_type, hint, want):
    row = spark.createDataFrame([(file_type, hint)], "f string, h string")
    assert row.select(formats.strategy(F.col("f"), F.col("h")).alias("s")).first()["s"] == want


def test_segments_become_blocks_where_there_are_none(spark):
    blocks = spark.createDataFrame([(1, "b", "paragraph", 0, "2) own")], "d int, block_id string, block_type string, order_index bigint, text string")
    segments = spark.createDataFrame(
        [(1, "s", "table", 0, "x"), (2, "s1", "paragraph", 5, " 1. go"), (2, "s0", "code_block", 2, "y"), (2, "s2", "slide", 9, "z")], "d int, segment_id string, segment_type string, segment_index int, text string"
    )
    got = [tuple(r) for r in chunking.materialized(blocks, segments, "d").orderBy("d", "order_index").collect()]
    assert got == [(1, "b", "paragraph", 0, "2) own", "2)"), (2, "s0", "code", 0, "y", ""), (2, "s1", "step", 1, " 1. go", "1."), (2, "s2", "paragraph", 2, "z", "")]


def test_titles_of_regions(spark):
    rows = [(1, "S", 1, ["Owner", "x"]), (1, "S", 2, ["City", "y"]), (1, "S", 4, ["one two three four five six seven", "z"]), (1, "S", 5, ["a", "b"]), (1, "S", 7, ["Month", "", "Sum"]), (1, "S", 8, ["May", "", "3"]),
            (1, "S", 10, ["h" * 30, "h" * 30]), (1, "S", 11, ["1", "2"])]
    placed = structure.regions(spark.createDataFrame(rows, "d int, sheet string, row_no int, cells array<string>"), ["d", "sheet"])
    types = structure.region_types(placed, ["d", "sheet"])
    got = {r["region"]: r["title"] for r in structure.region_titles(placed, types, ["d", "sheet"], "sheet").collect()}
    assert got == {0: "Owner", 1: "S Details 2", 2: "Table 3: Month, Sum", 3: "Table 4"}


def test_prompts_name_what_is_missing(spark):
    from docfold.operators import ranking

    asked = spark.createDataFrame([(1, "Why?"), (2, "How?")], "question_id int, question string")
    chunks = spark.createDataFrame([(1, 2, "T", ["A", "B"], "p", "two"), (1, 1, "U", ["C"], "q", "one")], "question_id int, rank int, title string, section_path array<string>, source_path string, content string")
    images = spark.createDataFrame([(1, 1, "p", ["A"], "i.png", None)], "question_id int, rank int, source_path string, section_path array<string>, image_path string, caption_text string")
    got = {r["question_id"]: r["prompt"] for r in ranking.prompts(asked, chunks, images).collect()}
    assert got[1] == "User question:\nWhy?\n\nRetrieved context:\n[S1] U | C | q\none\n\n[S2] T | A > B | p\ntwo\n\nRelevant images:\n[I1] p | A | i.png\n"
    assert got[2] == "User question:\nHow?\n\nRetrieved context:\nNo matching text context.\n\nRelevant images:\nNone"


def test_rewrites_leave_out_the_question(spark):
    from docfold.functions import arabic
    from docfold.functions import text as T

    rows = [("1. Straße?\n- STRASSE?\n* \"Other one\"\nother ONE\nlast", "strasse?", "a b\r\n\r\n\r\nالنسبة ٪05  (x )")]
    row = spark.createDataFrame(rows, "t string, q string, a string")
    got = row.select(T.cleaned_list(F.col("t"), 3, asked=F.col("q")).alias("l"), arabic.normalize_text(F.col("q")).alias("plain"), arabic.normalize_text(F.col("a")).alias("arabic")).first()
    assert got["l"] == ["Other one", "last"] and got["plain"] == "strasse?" and got["arabic"] == "a b\n\nالنسبة 50٪ (x)"
