"""The operators against brute force on small tables, with the odd rows that each must bear."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfold.llm import (
    bpe,
    chat_tools,
    common,
    exact_dedup,
    fingerprints,
    html_extract,
    language_id,
    near_dedup,
    packing,
    queries,
    token_counts,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string, node string, key string"
LONG = "wort " * 30_000 + "x" * 20_000


def table(spark, rows):
    """Documents with more columns, named as the operators name their own."""
    return spark.createDataFrame([(i, t, l, "s", 1, "k", "i", "n", "y") for i, t, l in rows], SCHEMA)


ROWS = [
    (5, "The quick brown fox jumps over the lazy dog", "en"),
    (3, "The  quick\tbrown fox jumps\nover the lazy dog", "en"),
    (3, "The quick brown fox jumps over the lazy dog", "en"),
    (7, None, None),
    (8, "", "en"),
    (9, "   ", "de"),
    (10, LONG, "de"),
    (None, "no id at all", "en"),
    (11, "1234 !!!", "en"),
    (12, "naïve ÉTÉ  漢字 😀  x y 's", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


# -- 1 toxicity ---------------------------------------------------------------------------


def toxic_corpus(n=1000, seed=1):
    rnd = random.Random(seed)
    plain = [f"{a}{b}" for a in "ba de ki lo mu na".split() for b in "r s t len ven ton".split()]
    slurs = ["snarg", "blorft", "queplo"]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(slurs) + rnd.choice(["", "a", "en", "ing", "ismo", "ly", "ous", "ten"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_finds_unseen_forms_and_leaves_clean_texts(spark):
    rows, labels = toxic_corpus()
    labels += [(None, 1, 1), (3, None, None)]
    docs = table(spark, rows + [(5900, None, None), (5901, "", "en"), (5902, "!!! 12", "en"), (5903, "ba SNARGENLY!", "en"), (5904, LONG, "en")])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    field = toxicity.fit(docs, marks, common.remainder(marks["doc_id"], 5) != 0)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, field).collect()}
    truth = {i: bool(t) for i, _, t in labels if i is not None and t is not None}
    assert all((got[i]["score"] >= 0.5) == t for i, t in truth.items())
    assert got[5903]["score"] >= 0.5 and [(s["start"], s["end"]) for s in got[5903]["spans"]] == [(3, 13)]
    assert all(got[i]["score"] < 0.5 and got[i]["spans"] == [] for i in (5900, 5901, 5902, 5904))


def test_toxicity_learns_from_rows_after_long_texts(spark):
    rows, labels = toxic_corpus()
    rows.sort(key=lambda r: r[0] % 4 == 0)  # toxic rows last
    docs = table(spark, [(5000, "ba kis lor " * 2_300_000, "en"), *rows]).coalesce(1)
    marks = spark.createDataFrame([(5000, 1, 0), *labels], "doc_id long, quality int, toxic int")
    field = toxicity.fit(docs, marks)
    got = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.score(docs.where("doc_id <> 5000"), field).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, _, t in labels)


def test_toxicity_without_labels(spark, docs, none):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = toxicity.fit(docs, marks)
    assert {r["toxicity"]["score"] for r in toxicity.score(docs, field).collect()} == {0.0}
    assert toxicity.score(none, field).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    steps, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths = np.array([0, 1, 5, 0, 7])
    e = rng.normal(size=13)
    p, pair = toxicity.marginals(e, lengths, steps, start)
    want, want_pair, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        if not n:
            continue
        weights, own = {}, e[at : at + n]
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            s = start[y[0]] + sum(own[k] * (y[k] - 0.5) for k in range(n)) + sum(steps[y[k], y[k + 1]] for k in range(n - 1))
            weights[tuple(y)] = np.exp(s)
        total = sum(weights.values())
        want += [sum(w for y, w in weights.items() if y[k]) / total for k in range(n)]
        for y, w in weights.items():
            for k in range(n - 1):
                want_pair[y[k], y[k + 1]] += w / total
        at += n
    assert np.allclose(p, want) and np.allclose(pair, want_pair)


def test_forward_backward_over_many_blocks():
    rng = np.random.default_rng(4)
    lengths = rng.integers(0, 900, 40)
    e = rng.normal(size=lengths.sum()) * 3
    steps, start = np.array([[0.3, -0.5], [-0.2, 0.8]]), np.array([0.4, -1.0])
    together, _ = toxicity.marginals(e, lengths, steps, start)
    ends = np.cumsum(lengths)
    alone = [toxicity.marginals(e[b - n : b], np.array([n]), steps, start)[0] for n, b in zip(lengths, ends)]
    assert np.allclose(together, np.concatenate(alone))


# -- 2 and 4 encoding ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")


def reference_encoding(raw):
    import tiktoken

    own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=queries.pattern(), mergeable_ranks=own, special_tokens={})


def test_encoding_is_the_reference_encoders(ranks):
    codec, known = bpe.ByteBpe(ranks, queries.pattern()), reference_encoding(ranks)
    from docfold.llm.pretokens import WordTable

    words = WordTable(codec.encode_words, limit=50)
    rnd = random.Random(5)
    letters = " \t\n\r\x0b\x0c\x1c\x85  　'sdrevml.,1²½٣éßあ漢😀a_-̀​"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    texts += [t for _, t, _ in ROWS if t]
    for t in texts:
        ids = [i for part in words.look_up([t])[0] for i in part]
        assert ids == known.encode_ordinary(t), t
        assert codec.decode(ids) == t.encode()


def test_round_trip_digests(docs, none, ranks):
    known = reference_encoding(ranks)
    got = sorted(map(tuple, bpe.round_trip_digests(docs, ranks, queries.pattern()).collect()), key=str)
    want = []
    for i, t, _ in ROWS:
        ids = known.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip_digests(none, ranks, queries.pattern()).count() == 0
    encoded = bpe.encode_documents(docs, ranks, queries.pattern())
    decoded = bpe.decode_documents(encoded, ranks, queries.pattern()).collect()
    assert sorted(bytes(r["decoded"]) for r in decoded) == sorted((t or "").encode() for _, t, _ in ROWS)


def test_token_counts_answer_every_limit(spark, docs, none, ranks):
    known = reference_encoding(ranks)
    lengths = [len(known.encode_ordinary(t or "")) for _, t, _ in ROWS]
    counted = bpe.count_tokens(docs, ranks, queries.pattern())
    answers = token_counts.limit_answers(token_counts.length_histogram(counted)).cache()
    got = {r["context_limit"]: r for r in answers.collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r["n_docs"] == lengths.count(limit) and r["total_tokens"] == sum(lengths)
        assert r["docs_longer"] == sum(n > limit for n in lengths)
        assert r["tokens_longer"] == sum(n for n in lengths if n > limit)
        assert r["truncated_tokens"] == sum(min(n, limit) for n in lengths)
        assert r["fitting_docs"] == sum(n <= limit for n in lengths)
        assert r["fitting_share"] == pytest.approx(r["fitting_docs"] / len(lengths))
    for limit in (0, 1, 5, 13, 10**6):
        r = token_counts.at_limit(answers, limit).first()
        assert (r["docs_longer"], r["truncated_tokens"]) == (sum(n > limit for n in lengths), sum(min(n, limit) for n in lengths))
    assert token_counts.quantile(answers, 0.5).first()["length"] == sorted(lengths)[4]
    assert token_counts.limit_answers(token_counts.length_histogram(bpe.count_tokens(none, ranks, queries.pattern()))).count() == 0


# -- 3 fingerprints -----------------------------------------------------------------------


def test_fingerprints_of_edited_texts(spark, none):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    rows = [(i * 3 if i < 500 else i * 70_000, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 4, 5, 30, 900]))), "en") for i in range(600)]
    rows[17] = (rows[17][0], None, None)
    rows[18] = (rows[18][0], "é漢😀" * 40, None)
    rows[20] = (rows[20][0], rows[21][1], None)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(table(spark, rows)).collect()}
    order = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, follower) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        edited = t[: len(t) - k] + follower[:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(t), shingles(edited)
        if len(a | b) > 500:
            assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 0.35
        if len(a | b) < 16:
            assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert 0 <= r["near_next"] <= 1
    assert got[rows[20][0]]["fingerprint"] == got[rows[21][0]]["fingerprint"]
    assert fingerprints.edited_fingerprints(none).count() == 0


def shingles(text, width=5):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_fingerprints_of_odd_rows_and_merging(spark, docs):
    assert fingerprints.edited_fingerprints(docs).count() == len(ROWS)
    assert fingerprints.edited_fingerprints(docs.where("doc_id = 5")).first()["near_next"] == 1.0
    rnd = random.Random(8)
    a = " ".join(str(rnd.randrange(10**6)) for _ in range(4000))
    b = " ".join(str(rnd.randrange(10**6)) for _ in range(400))
    pair = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, ab string")
    s = pair.select(*[fingerprints.sketch(F.col(c)).alias(c) for c in ("a", "b", "ab")])
    r = s.select(
        fingerprints.containment(F.col("b"), F.col("ab")).alias("inside"),
        fingerprints.containment(F.col("ab"), F.col("b")).alias("outside"),
        fingerprints.likeness(fingerprints.merge(F.col("a"), F.col("b")), F.col("ab")).alias("merged"),
    ).first()
    assert r["inside"] > 0.9 and r["outside"] < 0.2 and r["merged"] > 0.95


# -- 5 exact dedup ------------------------------------------------------------------------


def test_exact_groups(docs, none):
    def key(t):
        return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")

    members = {}
    for i, t, _ in ROWS:
        members.setdefault(key(t), []).append(i)
    want = []
    for i, t, _ in ROWS:
        ids = [x for x in members[key(t)] if x is not None]
        keep = min(ids, default=None)
        want.append((i, keep, len(members[key(t)]), i == keep, hashlib.sha256(key(t).encode()).hexdigest()))
    assert sorted(map(tuple, exact_dedup.groups(docs).collect()), key=str) == sorted(want, key=str)
    assert exact_dedup.groups(none).count() == 0
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({w[0] for w in want if w[3]}, key=str)


def test_exact_groups_survive_hash_collisions(docs, monkeypatch):
    honest = sorted(map(tuple, exact_dedup.groups(docs).collect()), key=str)
    monkeypatch.setattr(exact_dedup.F, "md5", lambda text: F.hex(F.length(text) % 2))
    assert sorted(map(tuple, exact_dedup.groups(docs).collect()), key=str) == honest


# -- 6 HTML -------------------------------------------------------------------------------

LINES = "The river was high in the spring and the old bridge had to be closed for a week after the flood. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>Short&nbsp;one.<br>x<p>" + LINES + "</article><footer>&copy; z</footer>",
         ["A & B", "Short one. x", LINES.strip()]),
        ("<body><div class='cookie-notice'>We use cookies</div><div id=sidebar><p>" + LINES + "</p></div><main><p>" + LINES
         + "</p><aside>More</aside><p>End.</p><section class='comments'><p>" + LINES + "</p></section></main></body>", [LINES.strip(), "End."]),
        ("<div><p>" + LINES + "</p><p>Few words.</p><p>" + LINES + "</p></div><div><a href=a>One link</a> <a href=b>and another</a></div>",
         [LINES.strip(), "Few words.", LINES.strip()]),
        ("<article><script>var t='</p>';</script><style>p{}</style><!-- no --><form><p>Sign up</p></form><p>" + LINES + "</p></article>", [LINES.strip()]),
        ("<nav>Home</nav><div id='page' class='has-sidebar'><h1>Title</h1><p>" + LINES + "</p><ins class='adsbygoogle'>Buy</ins><p>" + LINES + "</p></div>", ["Title", LINES.strip(), LINES.strip()]),
        ("<header class='site-header'><h1>Site</h1></header><article class='post'><header class='post-header'><h1>Head</h1></header><p>" + LINES
         + "</p><table><tr><td>a</td><td>b</td></tr></table><div class='share-buttons'>Share this</div></article>", ["Head", LINES.strip(), "a b"]),
        ("<article><h2>Only</h2><p>short.</p></article>", ["Only", "short."]),
        ("<article><p>1 &lt; 2 &#233; <b>bold<p>" + LINES, ["1 < 2 é bold", LINES.strip()]),
        ("<body><nav>Home</nav><form id=aspnet method=post><h1>Head</h1><p>" + LINES + "</p><div class=sidebar><p>" + LINES[:99] + "</p></div></form></body>", ["Head", LINES.strip()]),
        ("<main id='main' class='ad-free'><p>" + LINES + "</p></main>", [LINES.strip()]),
        ("<div class='post social'><div id=tags-story><p>" + LINES + "</p><p>End.</p></div></div><footer>F</footer>", [LINES.strip(), "End."]),
        ("<p title=it's>" + LINES + "</p><p title=\"a>b\" data-x='c>d'>" + LINES + "</p>", [LINES.strip(), LINES.strip()]),
        ("<article><p>" + LINES + "</p></article><div class=newsletter><form><p>" + LINES + "</p></form></div>", [LINES.strip()]),
        ("<article><p>Short one.</p></article><section class=comments><p>" + LINES * 9 + "</p></section>", ["Short one."]),
        ("<body><p>" + "река была высока весной " * 12 + "</p><p><a href=x>" + "ещё одна ссылка " * 20 + "</a></p></body>", [("река была высока весной " * 12).strip()]),
    ],
)
def test_main_text(page, want):
    assert html_extract.extract(page) == (want if isinstance(want, str) else "\n\n".join(want))


def test_main_text_of_a_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>é " + LINES + "</article>", "z"), (1, None, None, "z")], "page_id long, url string, html string, text string")
    got = html_extract.main_text(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, len(LINES) + 1]
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_unclosed_tags_and_nested_names_end():
    assert html_extract.extract("<a b='1' c=\"2\" " * 5000) is not None
    assert html_extract.extract("<div class=ad>" * 5000 + "<p>" + LINES) == LINES.strip()


def test_long_pages_of_open_blocks_end():
    page = "<p>x</p>" * 20_000
    assert html_extract.extract(page) == ""


# -- 7 chat -------------------------------------------------------------------------------


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            ("a", None, "add", '{"y": 2, "x": 1}', "?"),
            ("a", None, "add", '{"y": 2, "x": 1}', "?"),
            ("b", "a", "add", '{"x": "no", "z": {"k": [1, {"b": 1, "a": 2}]}}', "?"),
            ("c", "b", "none", "{}", "?"),
            ("d", "gone", "add", "not json", "?"),
            ("e", "f", "add", "[1]", "?"),
            ("f", "e", "add", None, "?"),
            (None, "a", "add", "{}", "?"),
        ],
        "call_id string, parent_id string, tool string, arguments string, content string",
    )
    results = spark.createDataFrame([("a", "3"), ("a", "4"), ("z", "lost"), (None, "x"), ("c", None)], "call_id string, content string")
    whole = {"type": "integer"}
    schemas = {"add": {"type": "object", "properties": {"x": whole, "y": whole}, "required": ["x", "y"]}}
    got = {r["call_id"]: r for r in chat_tools.link(calls, results, schemas).collect()}
    assert {k: (r["status"], r["level"], r["valid"], r["faults"]) for k, r in got.items()} == {
        "a": ("linked", 0, True, []),
        "b": ("unanswered", 1, False, ["missing:y", "type:x", "unknown:z"]),
        "c": ("linked", 2, False, ["schema"]),
        "d": ("unanswered", 0, False, ["object"]),
        "e": ("unanswered", None, False, ["object"]),
        "f": ("unanswered", None, False, ["object"]),
        "z": ("orphan", None, None, None),
    }
    assert got["a"]["message"] == '{"arguments":{"x":1,"y":2},"id":"a","level":0,"result":"3","status":"linked","tool":"add"}'
    assert chat_tools.link(calls.limit(0), results.limit(0), schemas).count() == 0


BOOKING = {
    "type": "object",
    "properties": {
        "seats": {"type": "integer", "minimum": 1, "maximum": 9},
        "price": {"type": ["number", "null"], "minimum": 0},
        "class": {"enum": ["first", "second", 3]},
        "name": {"type": "string", "minLength": 2, "maxLength": 5},
        "stops": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "properties": {"at": {"type": "string"}, "wait": {"type": "integer"}}, "required": ["at"]}},
        "options": {"type": "object", "properties": {"quiet": {"type": "boolean"}}, "additionalProperties": True},
    },
    "required": ["seats"],
}


@pytest.mark.parametrize(
    ("arguments", "want"),
    [
        ('{"seats": 2}', []),
        ('{"seats": 2.0, "price": 3, "class": 3, "name": "Ann", "stops": [{"at": "x"}], "options": {"z": 1, "quiet": true}}', []),
        ('{"seats": 2, "price": null, "class": "first"}', []),
        ('{"seats": 0, "price": -1.5, "class": "third", "name": "A"}', ["enum:class", "length:name", "range:price", "range:seats"]),
        ('{"seats": "2", "stops": [], "options": {"quiet": 1}}', ["length:stops", "type:options.quiet", "type:seats"]),
        ('{"stops": [{"at": 1}, {"wait": 1.5}, {"at": "x", "odd": 1}], "more": 1}', ["missing:seats", "missing:stops[].at", "type:stops[].at", "type:stops[].wait", "unknown:more", "unknown:stops[].odd"]),
        ('{"seats": 1.5, "options": [], "name": "much too long"}', ["length:name", "type:options", "type:seats"]),
        ("[]", ["object"]),
        ("{", ["object"]),
    ],
)
def test_arguments_against_schemas(spark, arguments, want):
    row = spark.createDataFrame([(arguments,)], "a string").select(chat_tools.checked(F.lit("book"), F.try_parse_json("a"), {"book": BOOKING}).alias("f")).first()
    assert row["f"] == want


def test_other_turns_are_context(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Yes?"), (1, 3, None, None), (1, 0, "system", "B"), (None, 1, "tool", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results, others = chat_tools.conversation_calls(turns)
    got = {(r["call_id"], r["status"]): r for r in chat_tools.link(calls, results, chat_tools.TOOLS, others).collect()}
    assert set(got) == {("1:0", "context"), ("1:1", "linked"), ("1:3", "context")}
    assert got["1:0", "context"]["message"] == '{"context":"B","id":"1:0","role":"system","status":"context"}'
    assert got["1:3", "context"]["message"] == '{"id":"1:3","status":"context"}' and got["1:1", "linked"]["faults"] == []


def test_long_chain_of_calls(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", None) for i in range(600)], "conv_id long, turn long, role string, text string")
    calls, results, _ = chat_tools.conversation_calls(turns)
    got = chat_tools.link(calls, results, chat_tools.TOOLS).collect()
    assert sorted(r["level"] for r in got) == list(range(300)) and {r["status"] for r in got} == {"linked"}
    assert {tuple(r["faults"]) for r in got} == {("missing:text",)}


# -- 8 near-duplicates --------------------------------------------------------------------


def brute_components(rows, width, percent):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, width):
    rnd = random.Random(9)
    rows = []
    for g in range(25):
        base = [f"t{rnd.randrange(3000)}" for _ in range(rnd.choice([1, 2, 6, 80, 300]))]
        for _ in range(rnd.choice([1, 2, 9, 25])):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 8))):
                words[rnd.randrange(len(words))] = f"t{rnd.randrange(3000)}"
            rows.append((len(rows) * 7 % 1000 + 1, " ".join(words).upper(), "en"))
    rows += [(2001, None, None), (2002, "", None), (2003, " \t", None), (2004, "One", None), (2005, "oNE", None), (2006, "É é", None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(table(spark, rows), width=width).collect()}
    assert got == brute_components(rows, width, 80)


def test_chain_of_links_is_one_component(spark):
    words = [f"t{i}" for i in range(240)]
    rows = [(100 - i, " ".join(words[4 * i : 4 * i + 60]), "en") for i in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(table(spark, rows), width=2).collect()}
    assert got == brute_components(rows, 2, 80)


def test_near_duplicates_of_odd_rows(docs, none):
    got = near_dedup.groups(docs).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"]: r["component_id"] for r in got}[5] == 3
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert near_dedup.groups(none).count() == 0
    assert near_dedup.deduplicate(docs).columns == docs.columns


def test_components_of_random_links(spark):
    rnd = random.Random(10)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    pairs = [(a, b) for a, b in pairs if a != b] + [(i, i + 1) for i in range(1000, 1100)]
    up = {x: x for p in pairs for x in p}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: top(i) for i in up}


def test_every_pair_in_reach_shares_a_key():
    rng = np.random.default_rng(11)
    a = rng.integers(0, 1 << 16, (300, near_dedup.PLACES), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.PLACES, near_dedup.DISTANCE, replace=False)] ^= 1
    assert (near_dedup.index_keys(a) == near_dedup.index_keys(b)).any(1).all()


def test_links_whose_signatures_differ_in_many_places(spark):
    rng = np.random.default_rng(13)
    pairs = [(words[:90], words[10:]) for words in (rng.choice(100_000, 100, replace=False) for _ in range(6000))]
    texts = [[" ".join(f"t{w}" for w in ws) for ws in pair] for pair in pairs]
    shingler = near_dedup.Shingler(1)
    a, b = (near_dedup.signatures(shingler.sets([t[k] for t in texts])) for k in (0, 1))
    far = (a != b).sum(1) > near_dedup.DISTANCE
    found = np.flatnonzero(far & (near_dedup.index_keys(a) == near_dedup.index_keys(b)).any(1))
    assert len(found)
    rows = [(2 * int(i) + k, texts[i][k], "en") for i in found for k in (0, 1)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(table(spark, rows), width=1).collect()}
    assert got == brute_components(rows, 1, 80)
    assert sum(kept for _, _, kept in got.values()) == len(found)


LINE = "This is the story of the town and of the people who were there for a long time, as it was told by them all."
MORE = "And so it was that they came to the river, where the boats were, and all of them went on to the other side of it."
NOTICE = "We and our partners use what is on your device so that we can show you what you like, and you can change it all at any time."


@pytest.mark.parametrize("name", ["newsletter", "cookie-consent", "gdpr popup", "advert", "subscribe-box"])
def test_long_notices_beside_a_short_article_go(name):
    page = f"<body><article><h1>Town</h1><p>{LINE}</p></article><div class='{name}'><h2>Your choice</h2>" + f"<p>{NOTICE}</p>" * 20 + "</div></body>"
    assert html_extract.extract(page) == f"Town\n\n{LINE}"


@pytest.mark.parametrize("name", ["reviews", "customer-reviews", "comments", "testimonials"])
def test_what_readers_write_goes(name):
    page = f"<body><div class=post><h1>Town</h1><p>{LINE}</p><p>{MORE}</p></div><section class='{name}'><h2>What readers say</h2>" + f"<p>{LINE}</p>" * 9 + "</section></body>"
    assert html_extract.extract(page) == f"Town\n\n{LINE}\n\n{MORE}"
    alone = f"<body><section class='{name}'><h2>What readers say</h2>" + f"<p>{LINE}</p>" * 9 + "</section></body>"
    assert html_extract.extract(alone) == ""


@pytest.mark.parametrize(("opening", "closing"), [("<aside>", "</aside>"), ("<div class=related>", "</div>"), ("<aside><article>", "</article></aside>"), ("<div class='share promo'>", "</div>"), ("<footer>", "</footer>")])
def test_an_article_in_an_odd_place_stays(opening, closing):
    page = f"<body><nav><a href=a>Home</a> <a href=b>News</a></nav>{opening}<h1>Town</h1><p>{LINE}</p><p>{MORE}</p>{closing}<div class=comments><p>{LINE}</p></div></body>"
    assert html_extract.extract(page) == f"Town\n\n{LINE}\n\n{MORE}"
    # Beside an article it is what its name says.
    both = page.replace("<nav>", f"<article><h1>River</h1><p>{MORE}</p><p>{LINE}</p></article><nav>")
    assert html_extract.extract(both) == f"River\n\n{MORE}\n\n{LINE}"


def test_pages_without_an_article_are_empty():
    assert html_extract.extract(f"<body><nav><a href=a>Home</a></nav><div class=cookie><p>{NOTICE}</p></div><footer><p>{LINE}</p></footer></body>") == ""
    assert html_extract.extract(f"<body><div style='display: none'><h1>Town</h1><p>{LINE}</p><p>{MORE}</p></div></body>") == ""


# -- 9 languages --------------------------------------------------------------------------

SPEECH = {
    "en": "the of and to in is was that with from this they have which would there their about other into".split(),
    "de": "der die und das nicht ein eine mit für auf dem sich von werden auch nach wird bei einer über".split(),
    "fr": "le la les des et une est pas que dans pour qui sur avec sont par elle nous vous être".split(),
}


def test_languages(spark, none):
    rnd = random.Random(12)
    rows = []
    for i in range(300):
        lang = sorted(SPEECH)[i % 3]
        rows.append((i, " ".join(rnd.choice(SPEECH[lang]) for _ in range(rnd.randint(3, 40))), lang))
    rows += [(900, None, "en"), (901, "", None), (902, "12 !! ...", "fr"), (903, "漢字漢字 漢字", None), (904, LONG, None), (0, rows[0][1], None)]
    docs = table(spark, rows)
    models = language_id.fit(docs, common.remainder(docs["doc_id"], 3) != 1)
    got = [(r["doc_id"], r["language"]) for r in language_id.predict(docs, models).collect()]
    assert len(got) == len(rows)
    truth = {i: l for i, _, l in rows[:300]}
    assert sum(p["lang_pred"] == truth[i] for i, p in got if i in truth) >= 298
    odd = dict(got)
    assert all((odd[i]["lang_pred"], odd[i]["score"], odd[i]["rejected"]) == ("und", 0.0, True) for i in (900, 901, 902))
    assert odd[903]["rejected"] and odd[903]["lang_pred"] in SPEECH
    assert not any(p["rejected"] for i, p in got if i in truth)
    assert language_id.predict(none, models).count() == 0


def test_languages_of_later_rows_are_learned_beside_long_texts(spark):
    rows = [(i, " ".join(SPEECH["en"]) + " " + " ".join(SPEECH["en"][i % 20 :]), "en") for i in range(40)] + [(500, "the of and " * 2_300_000, "en")]
    rows += [(1000 + i, " ".join(SPEECH["de"][i % 20 :] + SPEECH["de"]), "de") for i in range(40)]
    docs = table(spark, rows).coalesce(1)
    models = language_id.fit(docs)
    assert models.languages == ["de", "en"]
    got = {r["doc_id"]: r["language"]["lang_pred"] for r in language_id.predict(docs.where("doc_id <> 500"), models).collect()}
    assert all(lang == ("en" if i < 1000 else "de") for i, lang in got.items())
    assert language_id.sample(docs, None, "text", "lang", "doc_id", 30) == language_id.sample(docs.orderBy(F.desc("doc_id")), None, "text", "lang", "doc_id", 30)


def test_every_label_is_learned(spark):
    word = lambda i, k: "".join(chr(0x4E00 + 40 * i + (k * m) % 40) for m in (1, 3, 7))
    rows = [(j, " ".join(word(j % 70, k) for k in range(1 + j // 70, 12)), f"l{j % 70:02}") for j in range(210)]
    docs = table(spark, rows)
    models = language_id.fit(docs)
    assert models.languages == [f"l{i:02}" for i in range(70)]
    got = language_id.predict(docs, models).collect()
    assert sum(r["language"]["lang_pred"] == r["lang"] for r in got) > 200


def test_long_texts_are_scored_in_stretches(monkeypatch):
    models = language_id.fit_models([(" ".join(SPEECH[x] * 3), x) for x in SPEECH])
    texts = ["the of " * 3000, None, " ".join(SPEECH["de"] * 200), "x" * 5000, ""]
    whole = language_id._entropies(language_id.ScoredWords(models.word_scores), texts, 3)
    monkeypatch.setattr(language_id, "STRETCH", 100)
    monkeypatch.setattr(language_id, "CELLS", 500)
    parts = language_id._entropies(language_id.ScoredWords(models.word_scores), texts, 3)
    assert all(np.allclose(x, y) for x, y in zip(whole, parts, strict=True))


def test_samples_share_the_characters():
    found = [("a", h, 10) for h in range(100)] + [("b", h, 1000) for h in range(100)] + [("c", 5, 10**6), ("c", 4, 10**6 + 1)]
    got = common.within(found[::-1], {"a": 50, "b": 50, "c": 50}, 20_000)
    assert [sum(label == x for x, _ in got) for label in "abc"] == [50, 9, 1]
    assert [h for x, h in got if x == "b"] == list(range(9)) and ("c", 5) in got


def test_languages_without_labels(docs, none):
    models = language_id.fit(none)
    got = {(r["text"] or "").strip()[:4]: r["language"] for r in language_id.predict(docs, models).collect()}
    assert {x["lang_pred"] for x in got.values()} == {"und"}
    # Nothing speaks against a text but that it has no letter.
    assert {t for t, x in got.items() if x["rejected"]} == {"", "1234"}


def brute_kneser_ney(text, word):
    """Nats of a word under an interpolated Kneser-Ney model of ORDER characters, by counting."""
    n = language_id.ORDER
    padded = lambda w: "\x02" * (n - 1) + w + "\x03"
    ends = lambda w: range(n - 1, len(padded(w)))
    seen = [(padded(w), i) for w in text.split() for i in ends(w)]
    counts = [{} for _ in range(n)]
    for w, i in seen:
        counts[n - 1][w[i - n + 1 : i + 1]] = counts[n - 1].get(w[i - n + 1 : i + 1], 0) + 1
    for k in range(n - 1):  # of shorter ones, the characters that precede them
        for gram in {w[i - k - 1 : i + 1] for w, i in seen}:
            counts[k][gram[1:]] = counts[k].get(gram[1:], 0) + 1
    nats = 0.0
    for i in ends(word):
        p = language_id.FLOOR
        for k in range(n):
            ones, twos = (sum(c == x for c in counts[k].values()) for x in (1, 2))
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            gram = padded(word)[i - k : i + 1]
            after = [c for g, c in counts[k].items() if g[:-1] == gram[:-1]]
            if k and after:
                p *= d * len(after) / sum(after)
            if gram in counts[k]:
                p += (counts[k][gram] - (d if k else 0)) / sum(after)
        nats -= np.log(p)
    return nats


def test_smoothing_equals_counting():
    rnd = random.Random(3)
    text = " ".join(rnd.choice(SPEECH["en"]) for _ in range(150))
    models = language_id.fit_models([(text, "en"), (" ".join(SPEECH["fr"]), "fr")])
    words = ["the", "there", "xylo", "on", "a", "fromage"]
    got = models._nats(words)
    assert got[:, 0] == pytest.approx([brute_kneser_ney(text, w) for w in words], rel=1e-9)
    assert got[:, 1] == pytest.approx([brute_kneser_ney(" ".join(SPEECH["fr"]), w) for w in words], rel=1e-9)


def test_smoothed_probabilities_sum_to_one():
    models = language_id.fit_models([(" ".join(SPEECH["en"] * 3), "en")])
    letters = sorted({c for w in SPEECH["en"] for c in w}) + ["\x03"]
    # Words that share a history and differ in the next character alone.
    words = ["th" + c for c in letters if c != "\x03"]
    hashed, owner, at = language_id.grams(["th"] + words, language_id.ORDER)
    nats = {}
    for w in ["th"] + words:
        p = np.exp(-models._nats([w])[0, 0])
        nats[w] = p
    start = models._nats(["t"])[0, 0]
    assert start > 0 and all(0 < p < 1 for p in nats.values())
    # P(next | "th") over all next characters, from differences of prefixes.
    total = 0.0
    for c in letters:
        word = "th" if c == "\x03" else "th" + c
        h, o, _ = language_id.grams([word], language_id.ORDER)
        b = language_id.contexts([word], language_id.ORDER)
        p = language_id.FLOOR
        for k in range(language_id.ORDER):
            if k:
                p = p * models.parts[0].weights[k - 1].rows(b[k - 1][2:3])[0, 0]
            p = p + models.parts[0].probabilities[k].rows(h[k][2:3])[0, 0]
        total += p
    assert total == pytest.approx(1.0, abs=1e-3)


# -- 10 packing ---------------------------------------------------------------------------


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    raw = queries.tokenizer_file("byte_bpe_50k.json").decode()
    tokenizer = Tokenizer.from_str(raw)
    rows = ROWS + [(100 + i, "word " * (i * 37 % 1500), "en") for i in range(60)] + [(200, "<|endoftext|> x", "en")]
    got = packing.pack(packing.token_pieces(table(spark, rows), raw, end_id=2)).collect()
    want = []
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert sum(n for _, n in places) <= 1024
    least = -(-sum(r["length"] for r in got) // 1024)
    assert len(by_sequence) <= least * 1.05 + 1
    assert packing.pack(packing.token_pieces(none, raw, end_id=2)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once_and_waste_little(seed):
    rnd = random.Random(seed)
    counts = {}
    for _ in range(rnd.choice([1, 30, 5000])):
        n = rnd.choice([rnd.randint(1, 1024), rnd.randint(1, 60), 1024, 512, 341])
        counts[n] = counts.get(n, 0) + 1
    used, sequences = {}, 0
    for often, lengths in packing.plan(counts, 1024):
        assert often > 0 and sum(lengths) <= 1024
        sequences += often
        for n in lengths:
            used[n] = used.get(n, 0) + often
    assert used == counts
    least = max(-(-sum(n * c for n, c in counts.items()) // 1024), sum(c for n, c in counts.items() if n > 512))
    assert sequences <= 1.03 * least + 2
