"""Operator 8: near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds its distinct word shingles. Its signature has CHUNKS chunks of CHUNK
minima, each cut to 16 bits. By the pigeonhole principle two signatures that differ in at most
2 * CHUNKS - 1 places agree in some chunk but for one place at most; so every chunk is indexed
once for each place that may be wrong, by its other places, and all such pairs share a key.
At a similarity of 0.8 a chunk of five fails with probability 0.26, ten of them with 1.6e-6.
That is the whole rate at which linked pairs are missed: however many places differ, a pair that
shares a key is decided on the full sets.

Equal sets are one node from the start. In each of ROUNDS rounds every key names one of its
nodes as hub, another one each time, and a node tries the hub of another component whose
signature is nearest; what links so is one component from then on. At last all nodes that
share a key and still are in different components are compared, each pair once, in the join
itself. Links are confirmed on the full sets, and components follow by contracting links until
none is left. Groups are thus never expanded into their pairs, unless their members differ and
really are not linked.

Defined results: a document without words, or without text, has an empty set and is linked
with nothing; one with fewer words than a shingle has one shingle of all its words. Rows that
repeat an id count as one document: links of either hold for both. A row without id has no
component and is kept. An empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CHUNKS, CHUNK = 10, 5
PLACES = CHUNKS * CHUNK
#: Every pair of signatures that differ in at most so many places shares a key; most others of linked pairs do as well.
DISTANCE = 2 * CHUNKS - 1
#: Rounds in which nodes try hubs, before all that is left is compared.
ROUNDS = 2
#: A node with PART pairs or more, and at least one HOT-th of all pairs, is hot; there are at most HOT of them.
HOT, PART = 1024, 256
#: Words whose hashes a worker keeps.
KEPT_WORDS = 200_000

MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


FACTORS = _mixed(np.arange(1, PLACES + 1, dtype=np.uint64) * MIX) | np.uint64(1)


class Shingler:
    """64-bit hashes of the word shingles of whole texts."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's shingles."""
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        # On bytes, lower() touches A-Z alone and split() cuts at the six ASCII spaces alone.
        words = [t.encode().lower().split() if t else [] for t in texts]
        known = self.known
        known.update((w, xxhash.xxh64_intdigest(w)) for w in {w for ws in words for w in ws} - known.keys())
        out = []
        for ws in words:
            h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
            width = min(self.width, len(h))
            total = np.full(max(0, len(h) - width + 1) if len(h) else 0, np.uint64(width))
            for k in range(width):
                total = _mixed(total * MIX + h[k : k + len(total)])
            out.append(np.unique(total))
        return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """PLACES minima of each set, cut to 16 bits; empty sets are not allowed."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), PLACES), np.uint16)
    for k, factor in enumerate(FACTORS):
        x = (flat ^ (factor >> np.uint64(7))) * factor
        x ^= x >> np.uint64(32)
        least = np.minimum.reduceat(x * MIX, starts)
        out[:, k] = _mixed(least) >> np.uint64(48)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """Rows of PLACES keys: by chunk and by the place in it that may differ."""
    out = np.empty(signature.shape, np.uint64)
    for c in range(CHUNKS):
        chunk = signature[:, c * CHUNK : (c + 1) * CHUNK].astype(np.uint64)
        for d in range(CHUNK):
            total = np.full(len(chunk), np.uint64(c * CHUNK + d + 1))
            for k in range(CHUNK):
                if k != d:
                    total = _mixed(total * MIX + chunk[:, k])
            out[:, c * CHUNK + d] = total
    return out.view(np.int64)


def sign(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, set_key, signature array<short>, content); key and signature are null for an
    empty set, content is a hash of the text."""
    common.small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        shingler = Shingler(width)
        for batch in common.freed(batches):
            sets = shingler.sets(batch.column(1).to_pylist())
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list[bytes | None] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            rows: list = [None] * len(sets)
            if some:
                for i, row in zip(some, signatures([sets[i] for i in some]).view(np.int16), strict=True):
                    rows[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int16())), batch.column(2)],
                ["id", "n_shingles", "set_key", "signature", "content"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_shingles long, set_key binary, signature array<short>, content binary"
    return docs.select(docs[id_col], docs[text_col], content_hash(docs[text_col])).mapInArrow(work, schema)


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def keys_of(nodes: DataFrame) -> DataFrame:
    """(key, slot, node) for each node and place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for batch in common.freed(batches):
            if not len(batch):
                continue
            rows = np.array(batch.column(1).flatten()).view(np.uint16).reshape(-1, PLACES)
            keys = index_keys(rows)
            slots = np.tile(np.arange(PLACES, dtype=np.int32), len(rows))
            own = batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), PLACES)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(slots), own], ["key", "slot", "node"])

    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.select("node", "signature").mapInArrow(work, f"key long, slot int, node {kind}")


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles array<long>, brief array<short>) of the documents whose ids are in ``nodes``.

    ``brief`` has the distinct last 16 bits of the shingles.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        shingler = Shingler(width)
        for batch in common.freed(batches):
            sets = shingler.sets(batch.column(1).to_pylist())
            rows = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            brief = pa.array([np.unique(s.astype(np.uint16)).view(np.int16) for s in sets], pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, brief], ["node", "shingles", "brief"])

    wanted = docs.select(docs[id_col].alias("node"), docs[text_col].alias("text")).join(nodes, "node", "left_semi")
    kind = docs.schema[id_col].dataType.simpleString()
    return wanted.mapInArrow(work, f"node {kind}, shingles array<long>, brief array<short>")


def differing(a: Column, b: Column) -> Column:
    """Bits of the places in which two signatures differ."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(0)).otherwise(F.lit(1)).cast("long"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda total, x: total * 2 + x)


def _first_shared_slot(bits: Column) -> Column:
    """The first slot whose key two signatures with these differing bits share.

    The first place is the highest bit. A chunk without a difference counts by its first slot.
    """
    out = F.lit(None).cast("int")
    for c in range(CHUNKS - 1, -1, -1):
        chunk = F.shiftright(bits, PLACES - (c + 1) * CHUNK).bitwiseAND(F.lit((1 << CHUNK) - 1))
        place = F.when(chunk == 0, F.lit(c * CHUNK))
        for d in range(CHUNK):
            place = place.when(chunk == F.lit(1 << (CHUNK - 1 - d)), F.lit(c * CHUNK + d))
        out = F.coalesce(place, out)
    return out


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets.

    A node ``a`` with PART pairs or more, and at least a HOT-th of all of them, has its pairs dealt
    over parts, each with a copy of its set; there are at most HOT such nodes, and as many parts
    again. Sets are never broadcast: what is small when compressed may be large on the driver.
    """
    pairs = common.checkpoint(pairs.select("a", "b"))
    size = max(PART, -(-pairs.count() // HOT))
    often = pairs.groupBy("a").agg(F.count("*").alias("often")).where(F.col("often") >= size)
    hot = F.broadcast(often.select("a", F.ceil(F.col("often") / F.lit(size)).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")).join(hot, "a", "left")
    first = first.select("a", "left", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = dealt.join(second.hint("merge"), "b").join(first.hint("merge"), ["a", "part"])
    common_size = F.size(F.array_intersect("left", "right"))
    measured = both.select("a", "b", common_size.alias("both"), (F.size("left") + F.size("right")).alias("sum"))
    return measured.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b").distinct()


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (node, parent), where a root's parent is itself or not listed."""
    parents = common.checkpoint(parents, in_loop=True)
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        jumped = parents.join(above, "parent", "left").select("node", F.coalesce("up", "parent").alias("next"), "parent")
        jumped = common.checkpoint(jumped, in_loop=True)
        parents = jumped.select("node", F.col("next").alias("parent"))
        if jumped.where("next <> parent").isEmpty():
            return parents.withColumnRenamed("parent", "root")


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of the links (a, b) the smallest node that it is connected to.

    Each round hangs every node on its smallest neighbour if that is smaller, follows these
    trees to their roots, and replaces the links by links between roots.
    """
    links = common.checkpoint(links.select("a", "b"), in_loop=True)
    found = None
    while not links.isEmpty():
        either = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = either.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        tree = roots(hung.select("node", F.least("node", "least").alias("parent")))
        if found is None:
            found = tree
        else:
            step = tree.select(F.col("node").alias("root"), F.col("root").alias("top"))
            found = common.checkpoint(found.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")), in_loop=True)
        left = tree.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = tree.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = links.join(left, "a").join(right, "b").where("x <> y")
        links = common.checkpoint(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), in_loop=True)
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def merged(trees: DataFrame, links: DataFrame) -> DataFrame:
    """(node, tree) after the trees of linked nodes (a, b) have become one, named by its smallest node."""
    first = trees.select(F.col("node").alias("a"), F.col("tree").alias("x"))
    second = trees.select(F.col("node").alias("b"), F.col("tree").alias("y"))
    between = links.join(first, "a").join(second, "b").where("x <> y")
    tops = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    tops = tops.select(F.col("node").alias("tree"), F.col("root").alias("top"))
    return trees.join(tops, "tree", "left").select("node", F.coalesce("top", "tree").alias("tree"))


def hub_pairs(members: DataFrame, trees: DataFrame, thin: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): each node with the nearest hub of another tree, among the hubs of its keys.

    ``turn`` 0 takes the smallest node of a key as its hub, later ones take others by a hash.
    """
    placed = members.select("key", "node").join(trees, "node")
    order = F.xxhash64(F.col("node"), F.lit(turn)) if turn else F.lit(0).cast("long")
    hub = F.min(F.struct(order.alias("o"), F.col("node").alias("hub"), F.col("tree").alias("hub_tree")))
    hubs = placed.groupBy("key").agg(hub.alias("h"), F.min("tree").alias("low"), F.max("tree").alias("high"))
    hubs = hubs.where("low <> high").select("key", "h.hub", "h.hub_tree")
    tries = placed.join(hubs, "key").where("tree <> hub_tree").select("node", "hub").distinct()
    hub_side = thin.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("signature").alias("hub_signature"))
    tries = tries.join(hub_side, "hub").join(thin, "node").where(_sizes_allow(F.col("n"), F.col("hub_n"), percent))
    distance = F.bit_count(differing(F.col("signature"), F.col("hub_signature")))
    tries = tries.select("node", "hub", distance.alias("distance"))
    nearest = tries.groupBy("node").agg(F.min_by("hub", F.struct("distance", "hub")).alias("hub"))
    return nearest.select(F.col("hub").alias("a"), F.col("node").alias("b"))


def pairs_apart(members: DataFrame, trees: DataFrame, thin: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes that share a key, are in different trees and may be alike enough.

    Each pair comes once, from the first of its shared keys, which the join's condition finds.
    The condition also leaves out pairs whose brief sets show that their full sets are not alike
    enough: shared shingles share their last bits, and no more of them than are missing from a
    brief set can hide behind another, so that the bound never loses a link.
    """
    placed = members.join(trees, "node")
    sizes = placed.groupBy("key", "tree").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.max_by("tree", F.struct("size", "tree")).alias("main"), F.count("*").alias("trees"))
    largest = largest.where("trees > 1").select("key", "main")
    brief = sets.select("node", "brief")  # an id that repeats has several, each of which may link
    rows = common.checkpoint(placed.join(largest, "key").select("key", "slot", "node", "tree", "main"))
    told = rows.join(thin, "node").join(brief, "node")
    # One side has the nodes outside a key's largest tree alone; it meets all nodes of the key.
    x, y = told.where("tree <> main").alias("x"), told.alias("y")
    bits = differing(F.col("x.signature"), F.col("y.signature"))
    once = F.transform(F.array(bits), lambda m: _first_shared_slot(m) == F.col("x.slot"))[0]
    apart = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.tree") != F.col("y.tree"))
        & ((F.col("x.node") < F.col("y.node")) | (F.col("y.tree") == F.col("y.main")))
        & _sizes_allow(F.col("x.n"), F.col("y.n"), percent)
    )
    hidden = F.least(F.col("x.n") - F.size("x.brief"), F.col("y.n") - F.size("y.brief"))
    most = F.size(F.array_intersect("x.brief", "y.brief")) + hidden
    alike = F.transform(F.array(most), lambda m: 100 * m >= percent * (F.col("x.n") + F.col("y.n") - m))[0]
    return x.join(y, apart & once & alike).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, kept)."""
    found = _components(docs, width, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _components(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, content, n_shingles, component_id, kept) for each row."""
    signed = common.checkpoint(sign(docs, width, id_col, text_col))
    nodes = signed.where("id is not null and set_key is not null").groupBy("set_key").agg(
        F.min("id").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.count("*").alias("copies")
    )
    nodes = common.checkpoint(nodes)
    thin = nodes.select("node", "n", "signature")

    keys = keys_of(nodes)
    several = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    members = common.checkpoint(keys.join(several, "key"))
    candidates = members.select("node").distinct()
    sets = common.checkpoint(shingle_sets(docs, candidates, width, id_col, text_col))
    thin = common.checkpoint(thin.join(candidates, "node", "left_semi"))
    trees = thin.select("node", F.col("node").alias("tree"))
    for turn in range(ROUNDS):
        trees = common.checkpoint(merged(trees, confirmed(hub_pairs(members, trees, thin, turn, percent), sets, percent)), in_loop=True)
    pairs = common.checkpoint(pairs_apart(members, trees, thin, sets, percent))
    trees = merged(trees, confirmed(pairs, sets, percent))

    # A node that shares no key is a component of its own.
    named = nodes.select("set_key", "node", "copies").join(trees, "node", "left")
    named = named.select("set_key", "copies", F.coalesce("tree", "node").alias("component"))
    named = common.checkpoint(named)
    hot = F.broadcast(named.where(F.col("copies") * HOT >= signed.count()).drop("copies"))  # at most HOT rows
    rows = signed.select("id", "content", "n_shingles", "set_key")
    some = rows.where("set_key is not null")
    rest = some.join(hot, "set_key", "left_anti").join(named.drop("copies"), "set_key", "left")
    alone = rows.where("set_key is null").withColumn("component", F.col("id"))
    final = some.join(hot, "set_key").unionByName(rest).unionByName(alone)
    component = F.when(F.col("id").isNotNull(), F.col("component"))
    return final.select(
        "id",
        "content",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one for each id and text that is kept, and rows without id."""
    found = common.checkpoint(_components(docs, width, percent, id_col, text_col).where("id is not null").select("id", "content", "kept"))
    return common.keep_rows(docs, content_hash(docs[text_col]), found, id_col)
