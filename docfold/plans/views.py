"""The test tables seen as the engine's own: chunks, chat events, lines, blocks, models' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    """Documents that have a vector, as chunks; the source plays the path and the language the section.

    With ``most``, only so many characters of a text meet the vectors.
    """
    docs = table(spark, d, "documents").select("doc_id", "text" if most is None else F.left("text", F.lit(most)).alias("text"), "lang", "source")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return docs.join(vectors, "doc_id")


def query_vectors(spark: SparkSession, d: str, n: int) -> DataFrame:
    """The first ``n`` vectors, as the vectors of ``n`` variants of a question."""
    rows = table(spark, d, "embeddings").where(F.col("vec_id") < n)
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def chat_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("ts").cast("timestamp").alias("asked_at"),
        F.col("user_id").cast("string").alias("session_id"),
        F.concat_ws(" ", "event_type", k.cast("string")).alias("question_text"),
        F.col("event_type").alias("question_normalized"),
        (F.col("value") > 50).alias("had_image"),
        k.alias("top_k"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("latency_ms"),
        F.when(k > 20, F.col("event_type")).alias("top_source_path"),
        F.when(k > 40, F.concat(F.lit("s"), k.cast("string"))).alias("top_section_path"),
    )


#: The same for DuckDB.
CHAT_EVENTS = """
    SELECT ts AS asked_at, user_id::VARCHAR AS session_id,
           event_type || ' ' || (props::JSON->>'$.k') AS question_text, event_type AS question_normalized,
           value > 50 AS had_image, (props::JSON->>'$.k')::INT AS top_k, event_type <> 'error' AS success, value AS latency_ms,
           CASE WHEN (props::JSON->>'$.k')::INT > 20 THEN event_type END AS top_source_path,
           CASE WHEN (props::JSON->>'$.k')::INT > 40 THEN 's' || (props::JSON->>'$.k') END AS top_section_path
    FROM events
"""


#: Every twelfth line, and some between, become a heading of their first words: (place, words, rule).
TITLES = [(1, 3, "="), (4, 2, "-"), (6, 3, "~"), (9, 2, "-"), (10, 4, "^")]


def opening(line: str, k: int) -> str:
    """SQL of both engines: a line's first ``k`` words, empty if it has none."""
    return rf"regexp_extract({line}, '^\s*((?:\S+\s+){{0,{k - 1}}}\S+)', 1)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents, with an empty line after each that ends a sentence, and with headings
    of several levels and the rules below them, so that sections nest."""
    made = "".join(rf" WHEN i % 12 = {n} AND x rlike '\\S' THEN concat({opening('x', k)}, '\n', repeat('{rule}', 60))".replace(r"\s", r"\\s").replace(r"\S+", r"\\S+") for n, k, rule in TITLES)
    parts = F.expr(rf"transform(split(text, '\n'), (x, i) -> CASE{made} WHEN endswith(x, '.') THEN concat(x, '\n') ELSE x END)")
    docs = table(spark, d, "documents").select("doc_id", F.array_join(parts, "\n").alias("text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = rf"""
    SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM (
        SELECT doc_id, string_split(array_to_string(list_transform(string_split(text, E'\n'), lambda x, i: CASE
            {" ".join(rf"WHEN (i - 1) % 12 = {n} AND regexp_matches(x, '\S') THEN {opening('x', k)} || E'\n{60 * rule}'" for n, k, rule in TITLES)}
            WHEN ends_with(x, '.') THEN x || E'\n' ELSE x END), E'\n'), E'\n') AS parts FROM documents)
"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of thirty lines; some lines become labels and numbered titles."""
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", F.col("source").alias("document_title"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    first = lambda k: F.regexp_extract("line", rf"^\s*((?:\S+\s+){{0,{k - 1}}}\S+)", 1)
    made = (
        F.when((F.col("n") % 9 == 2) & (first(3) != ""), F.concat(first(3), F.lit(":")))
        .when(F.col("n") % 9 == 5, F.concat(F.lit("("), F.col("n").cast("string"), F.lit(") "), first(5)))
        .when(F.col("n") % 9 == 7, F.concat(F.lit("Note "), F.col("n").cast("string"), F.lit(": "), first(2)))
        .when(F.endswith("line", F.lit(".")), F.concat("line", F.lit("\n")))
        .otherwise(F.col("line"))
    )
    row = F.array_sort(F.collect_list(F.struct("n", made.alias("line"))))
    return rows.groupBy("doc_id", "document_title", (F.floor(F.col("n") / 30) + 1).cast("int").alias("page_number")).agg(
        F.array_join(F.transform(row, lambda r: r["line"]), "\n").alias("text")
    )


PAGES = r"""
    SELECT doc_id, document_title, n // 30 + 1 AS page_number, string_agg(
        CASE WHEN n % 9 = 2 AND regexp_extract(line, '^\s*((?:\S+\s+){0,2}\S+)', 1) <> '' THEN regexp_extract(line, '^\s*((?:\S+\s+){0,2}\S+)', 1) || ':'
             WHEN n % 9 = 5 THEN '(' || n || ') ' || regexp_extract(line, '^\s*((?:\S+\s+){0,4}\S+)', 1)
             WHEN n % 9 = 7 THEN 'Note ' || n || ': ' || regexp_extract(line, '^\s*((?:\S+\s+){0,1}\S+)', 1)
             WHEN ends_with(line, '.') THEN line || E'\n' ELSE line END, E'\n' ORDER BY n) AS text
    FROM (SELECT doc_id, source AS document_title, unnest(range(len(parts))) AS n, unnest(parts) AS line FROM (SELECT *, string_split(text, E'\n') AS parts FROM documents))
    GROUP BY ALL
"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a document as a block; its type follows from its length and first letter."""
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", F.col("source").alias("document_title"), "lang", F.posexplode(F.split("text", "\n")).alias("order_index", "text"))
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    kind = F.when(n <= 3, "heading").when(F.rlike("text", F.lit("^[AS]")), "step").when(F.rlike("text", F.lit("^E")), "figure").otherwise("paragraph")
    return rows.select(
        "doc_id",
        "document_title",
        F.col("order_index").cast("bigint").alias("order_index"),
        F.concat_ws("-block-", F.col("doc_id").cast("string"), F.col("order_index").cast("string")).alias("block_id"),
        kind.alias("block_type"),
        "text",
        F.lit(None).cast("string").alias("title"),
        F.array("lang").alias("section_path"),
        F.lit(None).cast("string").alias("sheet_name"),
        F.lit(None).cast("int").alias("slide_number"),
        F.lit(0).alias("n_images"),
    )


def shown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks with places, languages, metadata and the images that some of them show."""
    n, doc = F.col("order_index"), F.col("doc_id").cast("string")
    image = lambda path, id_: F.struct(
        id_.alias("image_id"), path.alias("image_path"), F.when(n % 2 == 0, F.concat(F.lit("Figure "), n.cast("string"))).alias("caption"), F.lit("").alias("alt_text"), F.lit("seen").alias("ocr_text")
    )
    own = image(F.concat(F.lit("img/"), doc, F.lit("/"), (n % 4).cast("string")), F.concat(F.lit("i"), (n % 4).cast("string")))
    logo = image(F.lit("img/logo"), F.lit(""))
    images = F.when(n % 6 == 3, F.array(own, logo, own)).when(F.col("block_type") == "figure", F.array(own))
    page = F.when(n % 4 == 1, (F.floor(n / 20) + 1).cast("int"))
    return blocks(spark, d).withColumns({
        "anchor": F.struct(
            page.alias("page_number"), F.lit(None).cast("int").alias("slide_number"), F.lit(None).cast("string").alias("sheet_name"), F.lit(None).cast("string").alias("json_path"),
            F.lit(None).cast("string").alias("rst_path"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("string").alias("source_label"),
        ),
        "language_tags": F.when(n % 5 == 2, F.array_compact(F.array(F.get("section_path", F.lit(0)), F.lit("xx")))).when(n % 5 == 3, F.array(F.lit("yy"))).otherwise(F.array().cast("array<string>")),
        "metadata": F.create_map(F.lit("last"), n.cast("string"), F.concat(F.lit("k"), (n % 3).cast("string")), F.col("block_type")),
        "images": images,
    })


def shown_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with languages, metadata, and four images of their own, which chunks may show."""
    docs = table(spark, d, "documents")
    image = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda k: F.struct(
            F.concat(F.lit("i"), k.cast("string")).alias("image_id"), F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit("/"), k.cast("string")).alias("image_path"),
            F.lit("").alias("caption"), F.when(k == 1, "plan").alias("alt_text"), F.lit(None).cast("string").alias("ocr_text"),
        ),
    )
    return docs.select(
        "doc_id", F.col("source").alias("document_title"), F.array(F.coalesce("lang", F.lit("none"))).alias("language_tags"),
        F.create_map(F.lit("source"), F.col("source"), F.lit("last"), F.lit("document")).alias("metadata"), image.alias("images"),
    )


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth chunk as a question: its opening is the text, its vector the first wording's."""
    rows = chunks(spark, d, 90).where(F.col("doc_id") % 50 == 0)
    return rows.select(
        F.col("doc_id").alias("question_id"), F.col("text").alias("question"), F.lit("limit").alias("shape"), F.array(F.lit("procedure"), F.lit("figure")).alias("evidence"),
        (F.col("doc_id") % 100 == 0).alias("visual"), F.when(F.col("doc_id") % 200 == 150, F.col("embedding")).alias("image_embedding"),
    )


def wordings(spark: SparkSession, d: str) -> DataFrame:
    """Two wordings of each question: its own, and the chunk after it."""
    rows = chunks(spark, d, 90).where(F.col("doc_id") % 50 < 2)
    n = F.col("doc_id") % 50
    return rows.select((F.col("doc_id") - n).alias("question_id"), n.alias("variant"), F.col("text").alias("variant_text"), F.col("embedding").alias("query_embedding"))


def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    refs = F.when(F.col("label") > 2, F.array(F.concat(F.lit("img/"), F.col("doc_id").cast("string")), F.concat(F.lit("img/x"), F.col("label").cast("string"))))
    return chunks(spark, d).select(
        F.col("doc_id").alias("chunk_id"), F.col("label").cast("bigint").alias("document_id"), F.concat("source", F.lit("/"), (F.col("doc_id") % 7).cast("string")).alias("source_path"), F.col("source").alias("title"),
        F.array("lang", "source").alias("section_path"), F.col("text").alias("content"), F.when(F.col("label") > 4, "table_chunk").otherwise("procedure_chunk").alias("chunk_type"),
        F.coalesce(refs, F.array().cast("array<string>")).alias("image_refs"), "embedding",
    )


def stored_images(spark: SparkSession, d: str) -> DataFrame:
    """The vectors once more, as images; every third is linked to a chunk."""
    return chunks(spark, d, 40).select(
        (F.col("doc_id") + 1_000_000).alias("image_id"), F.concat(F.lit("img/"), (F.col("doc_id") + 3).cast("string")).alias("image_path"), (F.col("doc_id") % 10).alias("document_id"),
        F.concat(F.lit("scan"), (F.col("doc_id") % 4).cast("string")).alias("source_path"), F.array("lang").alias("section_path"), F.col("text").alias("caption_text"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("related_chunk_id"), "embedding",
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Users' turns as requests; one fails where no answer follows, or where its text is short."""
    turns = table(spark, d, "conversations")
    answers = turns.where("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.max(F.length("text")).alias("answer"))
    asked = turns.where("role = 'user'").join(answers, ["conv_id", "turn"], "left")
    began = F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return asked.select(
        F.concat_ws(":", "conv_id", "turn").alias("request_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("question"), (F.col("turn") == 0).alias("had_image"),
        F.lit(8).alias("top_k"), began.alias("asked_at"), F.timestamp_millis(F.unix_millis(began) + F.coalesce("answer", F.lit(7))).alias("finished_at"),
        F.when(F.col("answer") > 0, F.concat(F.lit("m"), (F.col("answer") % 3).cast("string"))).alias("answer_model"),
        F.array(F.when(F.length("text") < 30, "the question is too short"), F.when(F.col("answer").isNull(), "no answer")).alias("failures"),
    )


def request_matches(spark: SparkSession, d: str) -> DataFrame:
    """Up to three documents that each request found: those that its numbers lead to."""
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"))
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_path"), F.col("lang").alias("section_path"))
    led = asked.withColumn("doc_id", F.col("conv_id") * 11 + F.col("turn") * 5 + F.col("rank") * 400)
    return led.join(docs, "doc_id").select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), "rank", "source_path", "section_path")


def image_analyses(spark: SparkSession, d: str) -> DataFrame:
    """Documents as what a model told of an image: titles, texts and sections made of their lines."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("l"))
    line = lambda i: F.get("l", F.lit(i))
    kinds = ["table", "Note", "odd", "code", "quote", "list_item", "warning"]
    sections = F.array(*[
        F.struct(F.when((F.col("doc_id") + i) % 3 > 0, F.left(line(i), F.lit(20))).alias("heading"), line(i + 1).alias("content"), F.lit(k).alias("block_type")) for i, k in enumerate(kinds)
    ])
    title = F.when(F.col("doc_id") % 4 == 0, F.col("source")).when(F.col("doc_id") % 4 == 1, F.left(line(0), F.lit(30)))
    told = F.to_json(F.struct(
        title.alias("title"), F.when(F.col("doc_id") % 5 > 1, line(1)).alias("summary"), F.when(F.col("doc_id") % 2 == 0, F.slice("l", 1, 10)).alias("visible_text"), sections.alias("sections"),
        F.when(F.col("doc_id") % 6 == 0, "chart").alias("image_type"),
    ))
    return docs.select("doc_id", F.col("source").alias("document_title"), F.concat("source", F.lit(".png")).alias("file_name"), F.when(F.col("doc_id") % 7 == 6, F.lit("{broken")).otherwise(told).alias("analysis"))


def filed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks as those of files of several kinds, some with a hint."""
    n = F.col("order_index")
    kinds = F.array(*[F.lit(k) for k in ("pdf", "pptx", "rst", "xlsx", "md", "xls", "ppt")])
    hints = F.array(*[F.lit(k) for k in ("slide_window", "generic_blocks", "unknown", "pdf_section_window", "xlsx_sheet_window")])
    return blocks(spark, d).withColumns({
        "file_type": F.get(kinds, (F.col("doc_id") % 7).cast("int")),
        "preferred_strategy": F.when(F.col("doc_id") % 3 == 1, F.get(hints, (F.col("doc_id") % 5).cast("int"))),
        "page_number": (F.floor(n / 6) + 1).cast("int"),
        "slide_number": F.when(F.col("doc_id") % 7 == 1, F.floor(n / 4).cast("int")),
        "sheet_name": F.concat(F.lit("s"), (n % 2).cast("string")),
        "section_path": F.array("document_title", F.concat(F.lit("part "), F.floor(n / 5).cast("string"))),
    })


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as segments of several kinds."""
    kinds = F.array(*[F.lit(k) for k in ("paragraph", "table", "table_row", "json_object", "code_block", "image_caption", "slide", "list_item", "note")])
    n = F.col("segment_index")
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("segment_index", "line"))
    return rows.select(
        "doc_id", F.concat_ws("-seg-", F.col("doc_id").cast("string"), n.cast("string")).alias("segment_id"), n.alias("segment_index"), F.get(kinds, (n * n % 9).cast("int")).alias("segment_type"),
        F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit(". "), F.col("line"))).otherwise(F.col("line")).alias("text"),
    )


def asked_models(spark: SparkSession, d: str) -> DataFrame:
    """The models that were asked about each order, and whether their answers were parsed; the
    fourth one's were, but for some, and were empty."""
    k = F.col("o_orderkey")
    models = F.array(*[F.struct(F.lit(m).alias("model"), ok.alias("parsed")) for m, ok in (("a", k % 7 != 0), ("b", k % 3 != 0), ("c", k % 2 != 0), ("d", k % 5 != 0))])
    return table(spark, d, "orders").select("o_orderkey", F.explode(models).alias("m")).select("o_orderkey", "m.*")


def markup(spark: SparkSession, d: str) -> DataFrame:
    """Documents with formulas, images, anchors, labels and code put into their lines."""
    docs = table(spark, d, "documents")
    # Borders of words and lines are those of the SQL: words are ASCII, and only LF ends a line.
    text = F.regexp_replace("text", r"(?<![A-Za-z0-9_])(of|de|der)(?![A-Za-z0-9_])", ":math:`$1`")
    for start, put in (("A", ".. math::"), ("E", ".. image:: img/e.png"), ("D", ".. _here:"), ("T", ".. code-block:: sql"), ("L", "   :label: eq")):
        text = F.regexp_replace(text, rf"(?md)^({start})", f"{put}\n$1")
    return docs.select("doc_id", text.alias("text"))


MARKUP = "SELECT doc_id, {} AS text FROM documents"
for _start, _put in (("L", "   :label: eq"), ("T", ".. code-block:: sql"), ("D", ".. _here:"), ("E", ".. image:: img/e.png"), ("A", ".. math::")):
    MARKUP = MARKUP.format(f"regexp_replace({{}}, '(?m)^({_start})', E'{_put}\\n\\\\1', 'g')")
MARKUP = MARKUP.format(r"regexp_replace(text, '\b(of|de|der)\b', ':math:`\1`', 'g')")


def model_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Orders as what three models read of each order: (o_orderkey, path, model, value).

    One model rounds prices and one leaves out what is open, so that they disagree.
    """
    o = table(spark, d, "orders")

    def leaf(model: str, path: str, value) -> F.Column:
        return F.struct(F.lit(path).alias("path"), F.lit(model).alias("model"), value.cast("string").alias("value"))

    price = F.format_string("%.2f", "o_totalprice")
    status = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    rows = [
        leaf("a", "status", F.col("o_orderstatus")),
        leaf("b", "status", F.lower("o_orderstatus")),
        leaf("c", "status", status),
        leaf("a", "price", price),
        leaf("b", "price", price),
        leaf("c", "price", F.round("o_totalprice", 0).cast("bigint")),
        leaf("a", "priority", F.col("o_orderpriority")),
        leaf("b", "priority", F.regexp_replace("o_orderpriority", "^[0-9]-", "")),
        leaf("c", "priority", F.regexp_replace("o_orderpriority", "-", " - ")),
    ]
    return o.select("o_orderkey", F.explode(F.array(*rows)).alias("l")).select("o_orderkey", "l.*").where("value is not null")


MODEL_LEAVES = """
    SELECT * FROM (
        SELECT o_orderkey, unnest(['status','status','status','price','price','price','priority','priority','priority']) AS path,
               unnest(['a','b','c','a','b','c','a','b','c']) AS model,
               unnest([o_orderstatus, lower(o_orderstatus), CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END,
                       printf('%.2f', o_totalprice), printf('%.2f', o_totalprice), round(o_totalprice, 0)::BIGINT::VARCHAR,
                       o_orderpriority, regexp_replace(o_orderpriority, '^[0-9]-', ''), replace(o_orderpriority, '-', ' - ')]) AS value
        FROM orders) WHERE value IS NOT NULL
"""
