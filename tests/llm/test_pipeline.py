"""The pipeline's stages one after another, each against brute force on its own input."""

import re

from test_operators import brute_components, table, toxic_corpus

import corpus_pipeline


def test_stages(spark, tmp_path):
    rows, labels = toxic_corpus(300)
    clean = [t for i, t, _ in rows if i % 4]
    rows += [(1000 + k, t, "en") for k, t in enumerate(clean[:20])]  # exact copies
    rows += [(2000 + k, t + " zzz" + str(k), "en") for k, t in enumerate(clean[:40])]  # near copies of all but short texts
    rows += [(3000, None, None), (3001, "", "en"), (3002, "!!! 123", "en")]
    d = str(tmp_path)
    table(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == spark.read.parquet(f"{d}/documents.parquet").columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = {i: t for i, t, _ in rows}
    assert set(kept["language_id"]) == set(texts) - {3000, 3001, 3002}
    toxic = {i for i, _, y in labels if y}
    assert set(kept["toxicity"]) == set(kept["language_id"]) - toxic
    first: dict[str, int] = {}
    for i in sorted(kept["toxicity"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert set(kept["exact_dedup"]) == set(first.values())
    brute = brute_components([(i, texts[i], "en") for i in kept["exact_dedup"]], 5, 80)
    assert set(kept["minhash"]) == {i for i, (_, _, stays) in brute.items() if stays} != set(kept["exact_dedup"])
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in packed} == set(kept["minhash"])
    filled: dict[int, int] = {}
    for r in packed:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert max(filled.values()) <= 1024 and len(filled) <= -(-sum(filled.values()) // 1024) + 1


def test_odd_tables(spark, tmp_path):
    """No rows, no labels of either kind, and columns named as the stages name their own."""
    text = [f"the of and to in is was that {k} with from this they have which would there" for k in range(6)]
    taken = "doc_id long, text string, lang string, source string, n_chars long, _language string, _toxicity string, _kept_id string"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows in (("none", []), ("bare", [(k, t, None, "s", 1, "a", "b", "c") for k, t in enumerate(text)] + [(9, None, None, None, None, None, None, None), (10, "1 2", None, "s", 1, "a", "b", "c")])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, taken).write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        packed = corpus_pipeline.run(spark, d).collect()
        assert {r["doc_id"] for r in packed} == {k for k, t, *_ in rows if t and any(c.isalpha() for c in t)}
        kept = corpus_pipeline.language_stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
        assert kept.columns == [c.split()[0] for c in taken.split(", ")]
