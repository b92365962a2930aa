"""Operator 2: byte-level BPE encoding and decoding.

A rank file (base64 piece and rank on each line) becomes a sentencepiece BPE model without
any training: each piece is written as one character a byte, its score is its negative rank,
and the normaliser is the identity. sentencepiece then merges the best-scored neighbours,
which are those of the lowest rank. Each match of the pre-token pattern is encoded by itself;
decoding looks the pieces up by id and maps their characters back to bytes.

Defined results: a null text counts as empty; an empty text has no tokens; a text without
spaces is one word, however long; repeated rows and ids each keep a row of their own; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pretokens import WordTable

#: Field numbers and codes of sentencepiece's public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE_FIELD, BPE = 3, 2


def read_ranks(raw: bytes) -> list[bytes]:
    """Pieces in the order of their ranks, which must be 0, 1, 2 and so on."""
    pairs = [line.split() for line in raw.splitlines() if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in pairs)
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be dense and start at 0")
    return [piece for _, piece in ranked]


def byte_letters() -> str:
    """A printable character for each of the 256 bytes: the 188 that are already visible
    in Latin-1 stand for themselves, the others take the code points from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in visible else chr(next(spare)) for b in range(256))


#: Words whose ids and bytes a worker keeps in each of two generations.
PAIRS = 300_000

LETTERS = byte_letters()
TO_LETTERS = {b: LETTERS[b] for b in range(256)}
TO_BYTES = {ord(c): b for b, c in enumerate(LETTERS)}


def to_letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(TO_LETTERS)


def to_bytes(letters: str) -> bytes:
    return letters.translate(TO_BYTES).encode("latin-1")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def serialise_model(pieces: list[bytes]) -> bytes:
    """The sentencepiece model whose ids are the ranks; one unknown piece follows them."""
    out = bytearray()
    for rank, piece in enumerate(pieces):
        score = _varint(2 << 3 | 5) + struct.pack("<f", -rank)
        out += _block(PIECES, _block(1, to_letters(piece).encode()) + score + _number(3, NORMAL))
    out += _block(PIECES, _block(1, b"<unk>") + _number(3, UNKNOWN))
    out += _block(TRAINER, _number(MODEL_TYPE_FIELD, BPE))
    plain = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out + _block(NORMALIZER, plain))


class ByteBpe:
    """Encoder and decoder over one rank file."""

    def __init__(self, raw: bytes, pattern: str):
        self.pieces = read_ranks(raw)
        self.whole = {p: i for i, p in enumerate(self.pieces)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.pieces))
        self.pattern = regex.compile(pattern)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; the pre-tokens of all words go to the model in one call."""
        cut = [self.pattern.findall(w) for w in words]
        tokens = {t for ts in cut for t in ts}
        ids = {t: [self.whole[raw]] for t in tokens if (raw := t.encode()) in self.whole}
        rest = [t for t in tokens if t not in ids]
        letters = [to_letters(t.encode()) for t in rest]
        ids.update(zip(rest, self.model.encode(letters, num_threads=1) if rest else [], strict=True))
        return [[i for t in ts for i in ids[t]] for ts in cut]

    def decode(self, ids: list[int]) -> bytes:
        return to_bytes("".join(map(self.model.id_to_piece, ids)))


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row's whole text."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = common.lasting("bpe ids", (shared.value, pattern), lambda: WordTable(ByteBpe(shared.value, pattern).encode_words))
        for batch in common.freed(batches):
            found = words.look_up(batch.to_pylist())
            yield pa.array([[i for ids in parts for i in ids] for parts in found], pa.list_(pa.int32()))

    return docs.select(docs[id_col].alias(id_col), encode(docs[text_col]).alias("ids"))


def decode_documents(encoded: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of each row's ids; null ids give no bytes."""
    common.small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = ByteBpe(shared.value, pattern)
        for batch in common.freed(batches):
            yield pa.array([codec.decode(ids or []) for ids in batch.to_pylist()], pa.binary())

    return encoded.select(encoded[id_col].alias(id_col), decode(encoded[ids_col]).alias("decoded"))


def round_trip_digests(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text and return (id, n_tokens, ids_sha256, decoded_sha256).

    Both directions run in one pass, so that neither ids nor bytes leave the worker. Each
    distinct word is encoded, and decoded from its ids, once; a document's ids and bytes
    are the concatenation of its words'.
    """
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def make() -> WordTable:
            codec = ByteBpe(shared.value, pattern)
            return WordTable(lambda ws: [(",".join(map(str, ids)), codec.decode(ids)) for ids in codec.encode_words(ws)], PAIRS)

        words = common.lasting("bpe digests", (shared.value, pattern), make)
        for batch in common.freed(batches):
            counts, ids_hex, bytes_hex = [], [], []
            for pairs in words.look_up(batch.to_pylist()):
                ids = ",".join([p[0] for p in pairs])
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_hex.append(hashlib.sha256(ids.encode()).hexdigest())
                bytes_hex.append(hashlib.sha256(b"".join([p[1] for p in pairs])).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(bytes_hex, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    made = docs.select(docs[id_col].alias(id_col), digest(docs[text_col]).alias("d"))
    return made.select(id_col, "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def count_tokens(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long) of each row's whole text."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def make() -> WordTable:
            codec = ByteBpe(shared.value, pattern)
            return WordTable(lambda ws: list(map(len, codec.encode_words(ws))))

        words = common.lasting("bpe counts", (shared.value, pattern), make)
        for batch in common.freed(batches):
            yield pa.array(map(sum, words.look_up(batch.to_pylist())), pa.int64())

    return docs.select(docs[id_col].alias(id_col), count(docs[text_col]).alias("n_tokens"))
