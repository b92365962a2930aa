"""Exact vector search over stored embeddings, for one query or many, and candidates from images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import vectors as V

#: Digits that scores are rounded to before they are ordered, so that orders are reproducible.
DIGITS = 6


def candidate_width(k: int) -> int:
    """Chunk candidates that are fetched for each query."""
    return max(4 * k, 12)


def image_width(k: int, images: int) -> int:
    return min(2 * images, 2 * k)


#: Queries that are sent to all tasks at once; more are dealt into blocks of about so many.
SENT_QUERIES = 64


def scored(vectors: DataFrame, queries: DataFrame, embedding: str = "embedding", query_embedding: str = "query_embedding") -> DataFrame:
    """Every vector with its score for every query.

    The few queries of one request are packed into one row, counted before it is broadcast; each
    vector is read once and meets all of them there. More queries than SENT_QUERIES are packed by
    block, and vectors meet the blocks in a shuffled join. ``search_many`` is for what keeps only the best.
    """
    blocks = -(-queries.count() // SENT_QUERIES)
    packed = F.collect_list(F.struct(*queries.columns)).alias("_queries")
    if blocks <= 1:
        met = vectors.crossJoin(F.broadcast(queries.agg(packed)))
    else:
        dealt = queries.withColumn("_block", F.pmod(F.xxhash64(*[F.col(c) for c in queries.columns]), F.lit(blocks)).cast("int"))
        every = vectors.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = every.join(dealt.groupBy("_block").agg(packed).hint("merge"), "_block").drop("_block")
    met = met.withColumn("_query", F.explode("_queries"))
    score = F.round(V.cosine(F.col(embedding), F.col(f"_query.{query_embedding}")), DIGITS)
    kept = [c for c in vectors.columns if c != embedding]
    asked = [F.col(f"_query.{c}").alias(c) for c in queries.columns if c != query_embedding]
    return met.select(*kept, *asked, score.alias("score"))


def top_k(rows: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    """The ``k`` best rows; equal scores by key. One partial top-k a task, then a merge of them."""
    return rows.orderBy(F.col(score).desc_nulls_last(), F.col(key)).limit(k)


def top_k_by_query(rows: DataFrame, k: int, key: str, query: str = "query_id", score: str = "score") -> DataFrame:
    """The ``k`` best rows of each query, with their rank.

    The window's group limit drops all but k rows of a query in each task before the shuffle.
    """
    best = Window.partitionBy(query).orderBy(F.col(score).desc_nulls_last(), F.col(key))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: Vectors and queries of one block; a task compares a block of queries with one block of vectors after the other.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 512

#: Blocks of vectors that one task reads at most.
RANGE = 128


def _packed(rows: DataFrame, key: str, embedding: str, name: str, n: int) -> DataFrame:
    """(block, name): keys and vectors dealt by a hash of their keys into ``n`` rows."""
    known = rows.select(F.col(key).alias("key"), F.col(embedding).cast("array<float>").alias("v")).where("v is not null")
    return known.groupBy(F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("key", "v")).alias(name))


def _matrix(packed: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys, vectors and lengths of one packed block, without vectors of length 0."""
    keys, v = packed.field("key"), packed.field("v")
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    own = flat.reshape(len(packed), -1)
    length = np.sqrt((own * own).sum(axis=1))
    known = np.flatnonzero(length > 0)
    return keys.take(pa.array(known)), own[known], length[known]


class _Best:
    """The ``k`` best vectors so far of each query of a block, and what may still tie with them."""

    def __init__(self, asked: pa.Array, k: int):
        self.queries, self.q, self.q_length = _matrix(asked)
        self.k, self.least = k, np.full(len(self.q), -2.0)
        self.held: list[pa.Table] = []

    def add(self, keys: pa.Array, v: np.ndarray, length: np.ndarray) -> None:
        if not len(v) or not len(self.q):
            return
        rows, columns, scores = [], [], []
        for i, score in enumerate((self.q @ v.T) / (self.q_length[:, None] * length)):
            found = np.flatnonzero(score >= self.least[i])
            if len(found) > self.k:
                # Scores are ordered by their rounded values, so what rounds alike stays.
                own = score[found]
                found = found[own >= np.partition(own, len(own) - self.k)[len(own) - self.k] - 2 * 10.0**-DIGITS]
            rows.append(np.full(len(found), i))
            columns.append(found)
            scores.append(score[found])
        at, to, found = np.concatenate(rows), np.concatenate(columns), np.concatenate(scores)
        if len(at):
            self.held.append(pa.table({"at": at, "key": keys.take(pa.array(to)), "score": found}))
        if sum(map(len, self.held)) > 2 * self.k * len(self.q):
            self.prune()

    def prune(self) -> pa.Table | None:
        """Leaves the best ``k`` rows of each query by rounded score and key, and what is too close to a border of rounding to tell."""
        if not self.held:
            return None
        rows = pa.concat_tables(self.held)
        score = rows["score"].to_numpy()
        scaled = np.abs(score) * 10.0**DIGITS
        rows = rows.append_column("rounded", pa.array(np.copysign(np.floor(scaled + 0.5), score) + 0.0)).append_column("close", pa.array(np.abs(scaled % 1 - 0.5) < 1e-4))
        ordered = not pa.types.is_nested(rows["key"].type)
        rows = rows.sort_by([("at", "ascending"), ("rounded", "descending"), *([("key", "ascending")] if ordered else [])])
        at, rounded, close = (rows[c].to_numpy(zero_copy_only=False) for c in ("at", "rounded", "close"))
        # Sure rows are counted; a query's k-th one bounds what may be among its best.
        sure = np.flatnonzero(~close)
        first = np.searchsorted(at[sure], np.arange(len(self.q)))
        n = np.diff(np.append(first, len(sure)))
        last = np.full(len(self.q), -np.inf)
        last[n >= self.k] = rounded[sure[first[n >= self.k] + self.k - 1]]
        kept = rounded > last[at] - 2
        kept[sure] = np.arange(len(sure)) - first[at[sure]] < self.k if ordered else rounded[sure] >= last[at[sure]]
        self.least = np.maximum(self.least, (last - 2) * 10.0**-DIGITS)
        self.held = [rows.select(["at", "key", "score"]).filter(pa.array(kept))]
        return self.held[0]


def search_many(vectors: DataFrame, queries: DataFrame, k: int, key: str, query: str, embedding: str = "embedding", query_embedding: str = "query_embedding") -> DataFrame:
    """(query, rank, key, score): the ``k`` nearest vectors of each of any number of queries.

    Vectors and queries are packed into blocks by a hash of their keys, and each is shuffled once:
    a task reads a range of the blocks of vectors, one after the other, beside one block of queries,
    holds one product of two bounded matrices and the best ``k`` rows so far, and gives these out at
    its end. There are as many ranges as keep all cores busy and hold at most RANGE blocks each. The
    window over a query then reads ``k`` rows a range. Nothing is broadcast. Vectors that are null or
    have length 0 have no score and are found by no one.
    """
    n_vectors, n_queries = -(-max(1, vectors.count()) // VECTOR_BLOCK), -(-max(1, queries.count()) // QUERY_BLOCK)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    ranges = min(n_vectors, max(-(-2 * cores // n_queries), -(-n_vectors // RANGE)))
    types = {c: df.select(name).schema[0].dataType.simpleString() for c, df, name in (("key", vectors, key), ("query", queries, query))}
    # Fields of a key that is a struct count as nullable, whatever the plan knows of them.
    arrow = {c: to_arrow_type(StructType.fromDDL(f"x {t}")[0].dataType) for c, t in types.items()}
    left = _packed(vectors, key, embedding, "mine", n_vectors).repartitionById(ranges, F.col("block") % ranges).select("mine")
    right = _packed(queries, query, query_embedding, "asked", n_queries).repartitionById(n_queries, F.col("block"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, _Best] = {}
        for batch in batches:
            for mine, block, asked in zip(batch["mine"], batch["block"].to_pylist(), batch["asked"], strict=True):
                if block not in met:
                    met[block] = _Best(asked.values, k)
                met[block].add(*_matrix(mine.values))
        for found in met.values():
            if (rows := found.prune()) is not None:
                told = {"query": found.queries.take(rows["at"].combine_chunks()).cast(arrow["query"]), "key": rows["key"].combine_chunks().cast(arrow["key"]), "score": rows["score"].combine_chunks()}
                yield from pa.table(told).to_batches()

    # Spark pairs partitions of both sides; the blocks of queries are the ones that it holds.
    pairs = left.crossJoin(right.hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(best, f"query {types['query']}, key {types['key']}, score double")
    ranked = top_k_by_query(found.withColumn("score", F.round("score", DIGITS)), k, "key", "query")
    return ranked.select(F.col("query").alias(query), "rank", F.col("key").alias(key), "score")


def merge_queries(best: DataFrame, key: str, query: str = "query_id") -> DataFrame:
    """One row for each key found: its highest score, the first query that gave it, and all
    queries that found it, in order."""
    return best.groupBy(key).agg(
        F.max("score").alias("score"),
        F.max_by(query, F.struct(F.col("score"), -F.col(query))).alias("best_query"),
        F.array_sort(F.collect_set(query)).alias("matched_queries"),
    )


def query_list(question: Column, rewrites: Column) -> Column:
    """The question and those rewrites that are not in the list yet."""
    return F.array_distinct(F.array_compact(F.concat(F.array(question), F.coalesce(rewrites, F.array().cast("array<string>")))))


def query_profile(intents: Column, evidence: Column, shape: Column, rewrites: Column, known: dict[str, list[str]]) -> Column:
    """A profile reduced to known labels, sorted, with the rewrites that differ by more than case, three at most."""
    low = F.transform(rewrites, lambda x: F.lower(x))
    first = F.filter(rewrites, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)

    def closed(labels: Column, name: str) -> Column:
        return F.array_sort(F.array_intersect(labels, F.array(*[F.lit(x) for x in known[name]])))

    shapes = F.array(*[F.lit(x) for x in known["shapes"]])
    return F.struct(
        closed(intents, "intents").alias("intents"),
        closed(evidence, "evidence").alias("evidence_types"),
        F.when(F.array_contains(shapes, shape), shape).alias("answer_shape"),
        F.slice(first, 1, 3).alias("rewrites"),
    )


#: Intents and the words of a question that call for a shape of answer, in order.
SHAPE_RULES = [
    ("procedural", [], "steps"),
    ("reference", ["compare", "difference", "versus", "vs"], "comparison"),
    ("reference", [], "parameter_list"),
    ("regulatory", ["how many", "how much", "limit", "maximum"], "limit"),
    ("regulatory", [], "rule"),
    ("technical", ["what is", "define", "meaning"], "definition"),
]


def default_shape(intents: Column, question: Column) -> Column:
    """The shape of answer that the first fitting rule gives, else summary."""
    low = F.lower(question)
    out = F.lit("summary")
    for intent, words, shape in reversed(SHAPE_RULES):
        fits = F.array_contains(intents, intent)
        if words:
            fits = fits & F.rlike(low, F.lit("|".join(words)))
        out = F.when(fits, shape).otherwise(out)
    return out


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of these keys, with score 0."""
    return rows.join(ids.select(key).distinct(), key, "left_semi").withColumn("score", F.lit(0.0))


def caption_score(variants: Column, caption: Column, section: Column, source: Column) -> Column:
    """The highest share of a variant's words that an image's texts hold; 0 without any word."""
    hay = T.tokens(F.concat_ws(" ", caption, section, source))
    shares = F.transform(variants, lambda v: F.size(F.array_intersect(T.tokens(v), hay)) / F.greatest(F.size(T.tokens(v)), F.lit(1)))
    return F.when(F.size(hay) > 0, F.array_max(shares)).otherwise(F.lit(0.0))


#: Weights of an image's score and caption, their bound, and what is too little.
IMAGE_WEIGHT, CAPTION_WEIGHT, MOST_SUPPORT, LEAST_SUPPORT = 0.16, 0.22, 0.24, 0.07


def image_support(images: DataFrame) -> DataFrame:
    """(chunk_id, support) from images with related_chunk_id, score and caption_score."""
    support = F.least(F.lit(MOST_SUPPORT), F.col("score") * IMAGE_WEIGHT + F.col("caption_score") * CAPTION_WEIGHT)
    told = images.where("related_chunk_id is not null").select(F.col("related_chunk_id").alias("chunk_id"), support.alias("support"))
    return told.where(F.col("support") > LEAST_SUPPORT).groupBy("chunk_id").agg(F.max("support").alias("support"))


def with_image_support(candidates: DataFrame, images: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with what images say for them; chunks that only images speak for join with score 0."""
    support = image_support(images)
    missing = by_ids(chunks, support.join(candidates, "chunk_id", "left_anti"), "chunk_id")
    both = candidates.unionByName(missing, allowMissingColumns=True)
    return both.join(support, "chunk_id", "left").withColumn("image_caption_support", F.coalesce("support", F.lit(0.0))).drop("support")


def image_vectors(images: DataFrame, vectors: DataFrame, documents: DataFrame, file_types: list[str] | None = None) -> DataFrame:
    """Images with their vectors, of documents of these kinds of files only, or of all.

    ``images`` has image_id and document_id, ``vectors`` image_id and embedding, ``documents``
    document_id and file_type. Documents are filtered before anything is joined, and vectors last.
    """
    own = documents.select("document_id", "file_type")
    if file_types is not None:
        own = own.where(F.col("file_type").isin(file_types))
    return images.join(own, "document_id").join(vectors.select("image_id", "embedding"), "image_id")


#: Fixed value: characters of a text that a match shows.
MOST_CONTENT = 4000


def matched_texts(found: DataFrame, rows: DataFrame, key: str, content: str) -> DataFrame:
    """Matches with the first MOST_CONTENT characters of their texts and all other columns but vectors."""
    kept = rows.drop("embedding").withColumn(content, F.left(content, F.lit(MOST_CONTENT)))
    return found.join(kept, key)
