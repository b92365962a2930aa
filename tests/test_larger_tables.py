"""What differed, or grew too fast, on tables larger than the smallest ones."""

import pytest
from pyspark.sql import functions as F

from docfold.functions import vectors as V
from docfold.operators import chunking, compare, formats, images, ranking, retrieval, structure
from docfold.plans import views
from docfold.plans.queries import QUERIES


@pytest.fixture(scope="module")
def markup_dir(spark, tmp_path_factory):
    """Words behind letters that are not ASCII, and lines that do not end with LF."""
    d = str(tmp_path_factory.mktemp("markup"))
    texts = ["a\u00dfof \u00e9de der\u00fc x of\nEnd", "a\u0085E b\u2028L c\rT d\nA e\n.. image:: x.png\u0085.. image:: y.png"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["block_artifacts", "format_texts", "parse_stats"])
def test_borders_of_words_and_lines(spark, markup_dir, name):
    import duckdb

    from docfold.plans.oracle import ORACLE

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{markup_dir}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, markup_dir)
    want = con.sql(ORACLE[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_artifacts_of_lines_that_end_with_lf(spark):
    row = spark.createDataFrame([("x\u0085.. image:: a.png\n.. image:: b.png",)], "t string").select(structure.block_artifacts(F.col("t")).alias("p")).first()
    assert row.p.image_refs == ["b.png"]


def test_ties_of_nine_decimals(spark):
    values = [k / 1024 for k in (1, 3, 5, 153, 313, 1023, 1025, -1, -153, 2049)] + [0.0, -0.0, 0.25, 0.1, -1.5, 1e-12, 123456.789, 16383 + 1 / 1024]
    got = spark.createDataFrame([(values,)], "v array<double>").select(V.literal(F.col("v"))).first()[0]
    assert got == "[" + ", ".join(f"{x:.9f}" for x in values) + "]"


def test_pruning_gathers_ids_by_list_not_by_document(spark):
    pictures = spark.createDataFrame([("d", "a", "small"), ("d", "b", None), ("e", "b", "small"), ("e", "b", "small")], "doc string, image_id string, drop_reason string")
    rows = [("d", 1, "figure", "", ["a"]), ("d", 2, "figure", " ", ["a", "b", "b"]), ("d", 3, "heading", "", ["a"]), ("d", 4, "figure", "x", ["a"]), ("e", 5, "figure", "", ["b"]), ("e", 6, "figure", "", None), ("f", 7, "figure", None, ["b"])]
    blocks = spark.createDataFrame(rows, "doc string, n int, block_type string, text string, image_ids array<string>")
    made = images.prune(blocks, pictures, "doc")
    assert {r.n: r.image_ids for r in made.collect()} == {2: ["b"], 3: [], 4: [], 7: ["b"]}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert all("image_ids" in line.split("],")[0] for line in plan.splitlines() if "collect_set" in line)


def test_parts_of_issues_follow_the_number_of_leaves(spark, monkeypatch):
    monkeypatch.setattr(compare, "LEAVES", 5, raising=False)
    rows = spark.createDataFrame([(g, p, m, f"{g % (3 if m == 'a' else 2)} x") for g in range(8) for p in "pq" for m in "aab"], "g int, path string, model string, value string")
    models = spark.createDataFrame([(g, m, g != 3 or m == "a") for g in range(9) for m in "abc"], "g int, model string, parsed boolean")
    found = compare.gated_issues(rows, models, ["g"], "model")
    assert found.rdd.getNumPartitions() == 10 and compare.issues(rows, ["g"], "model").rdd.getNumPartitions() == 10
    got = {(r.g, r.path): (r.available, r.n_missing, r.issue) for r in found.collect()}
    assert got[3, None] == (False, None, None) and got[8, None] == (True, None, None)
    assert got[2, "p"] == (True, 1, "number_token_mismatch") and got[0, "q"] == (True, 1, None) and len(got) == 16


def test_sheets_are_shuffled_by_document_in_counted_parts(spark, monkeypatch):
    monkeypatch.setattr(formats, "SHEET_ROWS", 10, raising=False)
    rows = spark.createDataFrame([(d, s, r, [f"h{r}", str(r), "x"]) for d in range(10) for s in "st" for r in (1, 2, 3, 5, 6)], "doc int, sheet_name string, row_no int, cells array<string>")
    made = formats.sheet_chunks(rows, "doc")
    assert made.rdd.getNumPartitions() == 10
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    got = [(r.sheet_name, r.region, r.window, r.chunk_index) for r in made.where("doc = 3").orderBy("chunk_index").collect()]
    assert got == [(s, g, w, i) for i, (s, g, w) in enumerate((s, g, w) for s in "st" for g in (0, 1) for w in (-1, 0))]


def test_chunks_are_made_from_one_shuffle_of_texts(spark, markup_dir):
    docs, blocks = views.shown_documents(spark, markup_dir), views.shown_blocks(spark, markup_dir)
    rows = chunking.chunk_rows(blocks, docs, "doc_id")
    plan = chunking.image_rows(rows, docs, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and plan.count("Relation [") == 4
    grouped = chunking.group_blocks(blocks.join(chunking.archetypes(blocks, "doc_id"), "doc_id"), "doc_id")
    assert grouped._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert [r.order_index for r in grouped.where("doc_id = 1").collect()] == sorted(r.order_index for r in grouped.where("doc_id = 1").collect())


def test_search_deals_vectors_once_and_gives_out_k_rows_a_range(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 10)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    monkeypatch.setattr(retrieval, "RANGE", 4, raising=False)
    copies = spark.range(400).selectExpr("id AS k", "array(1f, CAST(id DIV 200 AS float)) AS embedding")
    asked = spark.range(80).selectExpr("id AS query", "array(1f, CAST(id % 2 AS float)) AS query_embedding")
    found = retrieval.search_many(copies, asked, 5, "k", "query")
    got = {(r["query"], r["rank"]): (r["k"], r["score"]) for r in found.collect()}
    assert got == {(q, i + 1): (q % 2 * 200 + i, 1.0) for q in range(80) for i in range(5)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Neither side is repeated for each block of the other before it is shuffled.
    assert "explode(" not in plan
    best = retrieval._Best(retrieval.pa.array([{"key": 1, "v": [1.0, 0.0]}]), 5)
    for start in (300, 0, 100):
        keys = retrieval.pa.array(range(start, start + 100))
        best.add(keys, retrieval.np.ones((100, 2)), retrieval.np.full(100, 2**0.5))
    assert best.prune()["key"].to_pylist() == [0, 1, 2, 3, 4]


def test_scores_next_to_a_border_of_rounding_stay(spark):
    # 0.5e-6 above a multiple of 1e-6: both may round either way, so the smaller key does not decide yet.
    scores = [0.7000005, 0.70000049999, 0.7000001, 0.7]
    best = retrieval._Best(retrieval.pa.array([{"key": 1, "v": [1.0, 0.0]}]), 1)
    v = retrieval.np.array([[x, (1 - x * x) ** 0.5] for x in scores])
    best.add(retrieval.pa.array([9, 8, 7, 6]), v, retrieval.np.ones(4))
    assert set(best.prune()["key"].to_pylist()) >= {9, 8}


def test_sections_of_a_question_are_told_apart_without_a_second_pass(spark):
    rows = spark.createDataFrame([(1, 1, "s", "a bc", 0.2), (1, 2, "s", "abcd e", 0.1), (2, 1, "s", "x", 0.3), (1, 3, "", "y", 0.4)], "q int, k int, src string, content string, rank_score double")
    rows = rows.selectExpr("*", "array('p') AS path", "CAST(array() AS array<string>) AS refs")
    kept = ranking.consolidate_sections(rows, "src", "path", "content", "refs", "k", within=("q",))
    assert {(r.q, r.k, r.rank_score) for r in kept.collect()} == {(1, 2, 0.2), (2, 1, 0.3), (1, 3, 0.4)}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def paged(spark):
    rows = [(1, 0, 0, "heading", "Top", "A"), (1, 1, 0, "paragraph", "one two", "A"), (1, 2, 0, "step", "three", "A"), (1, 3, 1, "figure", "four", "A"), (1, 4, 1, "heading", "Low", "B"), (1, 5, 2, "table", "five", "B"), (2, 0, 0, "paragraph", None, "A")]
    return spark.createDataFrame(rows, "d int, order_index long, page_number int, block_type string, text string, p string").selectExpr("*", "concat('b', order_index) AS block_id", "array(p) AS section_path", "'regulatory' AS archetype", "page_number AS slide_number")


def test_pages_are_windowed_without_joins(spark):
    made = formats.page_chunks(paged(spark).repartition("d"), "d", 3, 0)
    got = [(r.page_number, r.section, r.chunk_index, r.block_ids, r.content, r.block_types, r.chunk_type) for r in made.where("d = 1").orderBy("chunk_index").collect()]
    assert got == [
        (0, "A", 0, ["b0", "b1"], "Top\n\none two", ["heading", "paragraph"], "policy_clause_chunk"),
        (0, "A", 1, ["b2"], "three", ["step"], "policy_clause_chunk"),
        (1, "A", 2, ["b0", "b3"], "Top\n\nfour", ["figure", "heading"], "figure_explainer_chunk"),
        (1, "B", 3, ["b4"], "Low", ["heading"], "policy_clause_chunk"),
        (2, "B", 4, ["b4", "b5"], "Low\n\nfive", ["heading", "table"], "table_chunk"),
    ]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    slides = formats.slide_chunks(paged(spark), "d", 3, 0)
    assert [(r.slide_number, r.block_ids, r.block_types) for r in slides.where("d = 1").orderBy("chunk_index").collect()] == [(0, ["b0", "b1"], ["heading", "paragraph"]), (0, ["b2"], ["step"]), (1, ["b3", "b4"], ["figure", "heading"]), (2, ["b5"], ["table"])]
    assert "Join" not in slides._jdf.queryExecution().optimizedPlan().toString()


def test_units_of_pages_fold_and_count_in_one_pass(spark):
    from docfold.functions import text as T

    texts = ["", " ", "a", " a  b ", "a\tb\n\n\n\nc\r\n\r\n\r\nd\re", "one two three four five six seven eight nine", " a  b\x0b", "a \u0085", "a b c", "\n\n\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    counts = rows.select(F.size(T.words(F.col("t"))).alias("n"), *[T.at_most_words(F.col("t"), k).alias(f"k{k}") for k in (0, 1, 2, 8, 9)], "t").collect()
    assert all(r[f"k{k}"] is (None if r.t is None else r.n <= k) for r in counts for k in (0, 1, 2, 8, 9))
    folded = [r[0] for r in rows.select(T.normalize_spaces(F.col("t"))).collect()]
    # A blank before a line end that is not ASCII is inside the text, as in the SQL.
    assert folded == ["", "", "a", "a b", "a b\n\nc\n\nd\ne", texts[5], "a b", "a \u0085", "a b c", "", None]
    pages = rows.selectExpr("1 AS d", "1 AS page_number", "'x' AS document_title", "t AS text")
    plan = structure.page_units(pages, "d")._jdf.queryExecution().optimizedPlan().toString()
    assert r"^\s+|\s+$" not in plan and r"split(line" not in plan
