"""Operator 11: repair of the order of roles in conversations, at the least cost.

Rows stand by turn. A repaired conversation's role initials are ``(s?(ua)+)?``: a walk through four
states (nothing yet, after s, u and a). A conversation is a graph of layers, one for each row,
with the four states in each; edits are its arcs. Costs are small integers, so that Dial's bucket
queue finds the distance of every node to the end without comparing distances; from the first
node, the arcs on which distance falls by just their cost lead to the end, and the least letter
among them at each node spells the least audit.

A conversation may hold any share of all rows, so it is cut into blocks of at most BLOCK rows. A
block has, for each state at its end, the distances from its start, a 4 x 4 table; from the last
block to the first these tables give the distances at all block ends, one small row at a time. Then
every block finds its own distances and walks from each state that it may be entered in, all
blocks apart from each other. At last the walks are put together in order while the rows' texts
stream by; no conversation is held whole, but its audit, which is a value of the result. Blocks
come from a sort of thin rows (roles, digests, no texts) by ranges, in which rows that are the same
are one row with a count. Only the digest of the repaired texts, which depends on all of them in
order, is one task's work for one conversation.

Defined results: null ids and turns keep together and come first, null roles and texts count as
one space. Rows of one turn stand in the order of their role and of their text's SHA-256, so that
rows that are the same are neighbours. A role's initial is its first character, and an empty role
has none and cannot be kept. A conversation without rows has zeros, an empty audit and the digest of
nothing; an empty table gives no rows; texts of any length are taken whole. Only the four columns
are read, so that columns of any other name do not matter.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common
from .substring_dedup import answered

#: Rows that one bucket queue works on.
BLOCK = 4096
#: Short code strings whose tables or walks a worker keeps, and their greatest length.
KEPT_WALKS, SHORT = 50_000, 64
#: States: nothing yet, after s, after u, after a.
STATES = 4
START, AFTER_S, AFTER_U, AFTER_A = range(STATES)
#: What an inserted or changed role leads to, and which role that is.
ALTERNATE = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
ROLE_OF = {AFTER_U: "user", AFTER_A: "assistant"}
#: Classes of role initials, and faults of a row, together a code.
OTHER, FAULTS = 3, 3
NO_FAULT, TRUNCATED, MUST_GO = range(FAULTS)
#: Costs of the edits, in the order of their letters.
DELETE, INSERT, KEEP, REROLE = 3, 2, 0, 2
#: Distances at the end of a conversation: what the roles that are still due cost.
AT_END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
#: White space, and pairs of initials that may stand next to each other.
SPACES = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")


def arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of the edits that use up a row of this code."""
    kind, fault = divmod(code, FAULTS)
    out = [("D", s, s, DELETE) for s in range(STATES)]
    if fault != MUST_GO:
        late = 1 if fault == TRUNCATED else 0
        follows = {0: [(START, AFTER_S)], 1: [(s, AFTER_U) for s in (START, AFTER_S, AFTER_A)], 2: [(AFTER_U, AFTER_A)], OTHER: []}
        out += [("K", a, b, KEEP + late) for a, b in follows[kind]]
        out += [("R", a, b, REROLE + late) for a, b in ALTERNATE.items()]
    return out


ARCS = [sorted(arcs(code)) for code in range((OTHER + 1) * FAULTS)]
#: The same backwards: for each code and state (state before, cost).
INTO = [[[(a, cost) for _, a, b, cost in own if b == s] for s in range(STATES)] for own in ARCS]
INSERTS_INTO = [[a for a, b in ALTERNATE.items() if b == s] for s in range(STATES)]


def distances(codes: bytes, ends: tuple[int, ...]) -> list[int]:
    """By layer and state the least cost from there to the block's end plus what ``ends`` has for it.

    Dial's queue: a bucket for each distance, of which at most the largest arc's cost and one are
    in use around the one that is emptied, besides those of the ends.
    """
    n = len(codes)
    dist = [FAR] * (STATES * (n + 1))
    buckets: dict[int, list[int]] = {}
    for state, d in enumerate(ends):
        if d < FAR:
            dist[STATES * n + state] = d
            buckets.setdefault(d, []).append(STATES * n + state)
    now = min(buckets, default=0)
    while buckets:
        bucket = buckets.get(now, [])
        while bucket:  # arcs without cost refill it
            node = bucket.pop()
            if dist[node] != now:
                continue
            layer, state = divmod(node, STATES)
            near = [(STATES * (layer - 1) + a, now + cost) for a, cost in INTO[codes[layer - 1]][state]] if layer else []
            if layer < n:  # what is inserted at a block's end is the next one's
                near += [(STATES * layer + a, now + INSERT) for a in INSERTS_INTO[state]]
            for other, d in near:
                if d < dist[other]:
                    dist[other] = d
                    (bucket if d == now else buckets.setdefault(d, [])).append(other)
        buckets.pop(now, None)
        now += 1
    return dist


def kept_if_short(found):
    """``found`` of (codes, ...), remembered for short codes, which many conversations share."""
    kept = functools.lru_cache(KEPT_WALKS)(found)
    return functools.wraps(found)(lambda codes, *more: (kept if len(codes) <= SHORT else found)(codes, *more))


@kept_if_short
def crossing(codes: bytes) -> tuple[int, ...]:
    """The least costs from each state at the start to each at the end, row by row."""
    columns = [distances(codes, tuple(0 if s == end else FAR for s in range(STATES)))[:STATES] for end in range(STATES)]
    return tuple(columns[end][start] for start in range(STATES) for end in range(STATES))


@kept_if_short
def walks(codes: bytes, ends: tuple[int, ...]) -> tuple[tuple[str, int], ...]:
    """For each state at the start the least letters of a cheapest way, and the state at its end."""
    dist = distances(codes, ends)
    out = []
    for state in range(STATES):
        letters: list[str] = []
        layer = 0
        while layer < len(codes) and dist[STATES * layer + state] < FAR:
            here = dist[STATES * layer + state]
            tight = [(letter, layer + 1, b) for letter, a, b, cost in ARCS[codes[layer]] if a == state and dist[STATES * (layer + 1) + b] + cost == here]
            b = ALTERNATE[state]
            if dist[STATES * layer + b] + INSERT == here:
                tight.append(("I", layer, b))
            letter, layer, state = min(tight)
            letters.append(letter)
        out.append(("".join(letters), state))
    return tuple(out)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after some of them, by a checksum, were spoilt.

    Each has its number of copies: none where it was dropped, two where it was repeated.
    """
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(words[0], F.lit(":"), words[1]).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def named(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(rows[c], F.lit(" ")) for c in (role_col, text_col))
    return rows.select(rows[conv_col].alias("conv_id"), rows[turn_col].alias("turn"), role.alias("role"), text.alias("text"))


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copies, blank, open, again) without texts; same rows are one.

    ``open`` rows do not end with a stop, and of ``again`` ones an earlier turn has role and text.
    A conversation has a row without digest besides, so that none is lost.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    last = F.substring(trimmed, -1, 1)
    thin = rows.select(
        "conv_id", "turn", "role", digest(F.col("text")).alias("digest"), "copies", (trimmed == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open")
    )
    thin = thin.where("copies > 0").groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("open").alias("open")
    )
    thin = common.checkpoint(thin)
    keys = ["conv", "role", "digest"]
    known = F.struct("conv_id").alias("conv")  # a null id inside a struct is a key like others
    said = thin.where("not blank").select("*", known)
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("late"), "turn")).alias("earliest")
    told = said.groupBy(*keys).agg(F.count("*").alias("n"), earliest)
    several = common.checkpoint(told.where("n > 1"))
    later = answered(said, several, keys, several.agg(F.sum("n")).first()[0] or 0)
    later = later.where(~F.col("turn").eqNullSafe(F.col("earliest.turn"))).select("conv", "turn", "role", "digest", F.lit(True).alias("again"))
    marked = thin.select("*", known).alias("t").join(later.alias("l"), _same_row("t", "l"), "left")
    marked = marked.select("t.conv_id", "t.turn", "t.role", "t.digest", "t.copies", "t.blank", "t.open", F.coalesce("l.again", F.lit(False)).alias("again"))
    none = rows.select("conv_id").distinct()
    empty = none.select("conv_id", *[F.lit(None).cast(marked.schema[c].dataType).alias(c) for c in ("turn", "role", "digest")], F.lit(0).cast("long").alias("copies"), *[F.lit(False).alias(c) for c in ("blank", "open", "again")])
    return marked.unionByName(empty)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _same_row(a: str, b: str) -> Column:
    out = F.col(f"{a}.conv") == F.col(f"{b}.conv")
    for c in ("turn", "role", "digest"):
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


ORDER = ["late", "turn", "role", "digest"]


class _Block:
    """Counts and codes of consecutive rows of one conversation."""

    def __init__(self, row: dict, number: int):
        self.key = {c: row[c] for c in ("conv_id", *ORDER)} | {"part": number}
        self.codes = bytearray()
        self.first, self.last = "", None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None

    def add(self, initial: str, code: int, turn: int | None) -> None:
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        self.codes.append(code)

    def row(self) -> dict:
        counts = {c: getattr(self, c) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "first_turn", "last_turn")}
        return self.key | counts | {"codes": bytes(self.codes), "crossing": crossing(bytes(self.codes))}


def _blocks_of(rows: Iterator[dict], most: int) -> Iterator[dict]:
    block, number = None, 0
    for row in rows:
        if block is None or block.key["conv_id"] != row["conv_id"]:
            if block is not None:
                yield block.row()
            block, number = _Block(row, number), number + 1
        initial = (row["role"] or "")[:1]
        kind = 3 * {"s": 0, "u": 1, "a": 2}.get(initial, OTHER)
        for copy in range(row["copies"]):
            if len(block.codes) == most:
                yield block.row()
                block, number = _Block(row, number), number + 1
            if row["blank"]:
                block.blank += 1
                fault = MUST_GO
            elif row["again"] or copy:
                block.duplicate += 1
                fault = MUST_GO
            else:
                block.truncated += row["open"]
                fault = TRUNCATED if row["open"] else NO_FAULT
            block.add(initial, kind + fault, row["turn"])
    if block is not None:
        yield block.row()


def _in_order(descending: bool = False) -> list[Column]:
    columns = [F.col(c) for c in ("conv_id", *ORDER, "part")]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in columns]


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches_of(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == common.BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(df: DataFrame, work, schema: str) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        yield from _batches_of(work(_rows_of(batches)), arrow)

    return df.mapInArrow(run, schema)


def _blocks(thin: DataFrame, most: int) -> DataFrame:
    """The rows in order, cut into blocks of one conversation each."""
    late = thin.withColumn("late", F.col("turn").isNotNull())
    kinds = {c: thin.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", *ORDER)]
    ranged = late.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = (
        f"conv_id {kinds['conv_id']}, late boolean, turn {kinds['turn']}, role string, digest binary, part long, blank long, duplicate long, truncated long, "
        f"illegal long, turns long, first string, last string, first_turn {kinds['turn']}, last_turn {kinds['turn']}, codes binary, crossing array<long>"
    )
    return _mapped(ranged, functools.partial(_blocks_of, most=most), schema)


def _with_ends(rows: Iterator[dict]) -> Iterator[dict]:
    """From the last block of a conversation to its first, the distances at each one's end."""
    conv, ends = (), AT_END
    for row in rows:
        if conv != (row["conv_id"],):
            conv, ends = (row["conv_id"],), AT_END
        table = row.pop("crossing")
        # Walks depend on differences alone; small numbers let blocks share them.
        least = min(ends)
        yield row | {"ends": [e - least for e in ends]}
        ends = tuple(min(table[STATES * s + e] + ends[e] for e in range(STATES)) for s in range(STATES))


def _with_walks(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        found = walks(row["codes"], tuple(row["ends"]))
        yield row | {"edits": [w for w, _ in found], "exits": [s for _, s in found]}


#: Fields of the result besides the conversation's id.
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Repair:
    """One conversation while its blocks and texts pass by in order."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.place = conv_id, START, START
        self.counts = dict.fromkeys(COUNTS, 0)
        self.turns, self.first_turn, self.last_turn, self.last = 0, None, None, None
        self.audit: list[str] = []
        self.due: list[Iterator[str]] = []
        self.hash, self.some = hashlib.sha256(), False

    def block(self, row: dict) -> None:
        edits = row["edits"][self.state]
        kept_open = 0
        walked = iter(row["codes"])
        for letter in edits:
            if letter != "I":
                code = next(walked)
                kept_open += letter != "D" and code % FAULTS == TRUNCATED
        self.counts["cost"] += DELETE * edits.count("D") + INSERT * edits.count("I") + REROLE * edits.count("R") + kept_open
        self.state = row["exits"][self.state]
        self.audit.append(edits)
        self.due.append(iter(edits))
        for c in ("blank", "duplicate", "truncated", "illegal"):
            self.counts[c] += row[c]
        if row["codes"]:
            if self.last is not None and self.last + row["first"] not in LEGAL:
                self.counts["illegal"] += 1
            self.last = row["last"]
        if row["first_turn"] is not None:
            self.turns += row["turns"] - (row["first_turn"] == self.last_turn)
            self.first_turn = row["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = row["last_turn"]

    def text(self, row: dict) -> None:
        for _ in range(row["copies"]):
            while (letter := self._next()) == "I":
                self._alternate("")
            if letter == "K":
                initial = row["role"][:1]
                self.place = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[initial]
                self._write(row["role"], row["text"])
            elif letter == "R":
                self._alternate(row["text"])

    def _next(self) -> str:
        while True:
            letter = next(self.due[0], None)
            if letter is not None:
                return letter
            self.due.pop(0)

    def _alternate(self, text: str) -> None:
        self.place = ALTERNATE[self.place]
        self._write(ROLE_OF[self.place], text)

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{'\n' if self.some else ''}{role}:{text}".encode())
        self.some = True

    def row(self) -> dict:
        tail = {START: 0, AFTER_S: 2, AFTER_U: 1, AFTER_A: 0}[self.state]
        for _ in range(tail):
            self._alternate("")
        self.counts["cost"] += INSERT * tail
        if self.turns:
            self.counts["gaps"] = self.last_turn - self.first_turn + 1 - self.turns
        return {"conv_id": self.conv_id} | self.counts | {"audit": "".join(self.audit) + "I" * tail, "repaired_sha256": self.hash.hexdigest()}


def _repaired(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks come before the texts of their first row; letters that a block leaves go on to the next texts."""
    now: _Repair | None = None
    for row in rows:
        if now is None or now.conv_id != row["conv_id"]:
            if now is not None:
                yield now.row()
            now = _Repair(row["conv_id"])
        if row["codes"] is not None:
            now.block(row)
        else:
            now.text(row)
    if now is not None:
        yield now.row()


def repair(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text, copies): counts, cost, audit, digest.

    A row has ``copies`` neighbours that are the same; with none it is not there, but its
    conversation is.
    """
    common.small_batches(rows.sparkSession)
    blocks = common.checkpoint(_blocks(common.checkpoint(_faults(rows)), block_rows))
    names = [f for f in blocks.schema if f.name != "crossing"]
    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names)
    backwards = blocks.repartition("conv_id").sortWithinPartitions(*_in_order(descending=True))
    ended = _mapped(backwards, _with_ends, f"{plain}, ends array<long>")
    # Dealt anew, so that blocks of one conversation are walked apart.
    walked = _mapped(ended.repartition("conv_id", *ORDER, "part"), _with_walks, f"{plain}, edits array<string>, exits array<int>")
    texts = rows.where("copies > 0").select("conv_id", F.col("turn").isNotNull().alias("late"), "turn", "role", digest(F.col("text")).alias("digest"), "copies", "text")
    both = walked.unionByName(texts, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", *[F.col(c).asc_nulls_first() for c in ORDER], F.col("part").asc_nulls_last())
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    return _mapped(ordered, _repaired, schema)


def repair_damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """What it takes to repair each conversation after ``damaged``."""
    found = repair(damaged(named(conversations, conv_col, turn_col, role_col, text_col)))
    return found.withColumnRenamed("conv_id", conv_col)
