"""Byte-level BPE through a sentencepiece model written from a rank vocabulary.

Every byte is mapped to one printable character, every vocabulary entry becomes a piece with the
negative rank as its score, and text is left as it is (identity normalisation), so the model merges
exactly like the rank file. Pre-tokens are encoded one by one; decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import fresh

VOCABULARY = "byte_bpe_50k.tiktoken"
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"

# Unicode white space, as the pattern of the vocabulary understands it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
END_OF_UNIT = re.compile(rf"[^{SPACE}](?=[{SPACE}])")
BLOCK = 1 << 20


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Byte strings and ranks of a vocabulary file (one base64 string and rank a line)."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """One character for each byte: itself where it prints, else the next free one from U+0100."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol-buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last."""
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary must hold every single byte")
    letters = byte_characters()
    pieces = b"".join(
        _field(1, _field(1, "".join(letters[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, 1))
        for i, t in enumerate(by_rank)
    )
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + unknown + _field(2, trainer) + _field(3, normaliser)


def blocks(text: str) -> Iterator[str]:
    """Cut a text into stretches of about ``BLOCK`` characters that end with a unit."""
    start = 0
    while len(text) - start > BLOCK and (end := END_OF_UNIT.search(text, start + BLOCK)):
        yield text[start : end.end()]
        start = end.end()
    yield text[start:] if start else text


class Codec:
    """Encoder and decoder of one vocabulary; what it remembers is bounded by ``limit`` characters."""

    limit = 6_000_000

    def __init__(self, model: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters = byte_characters()
        value = {c: b for b, c in enumerate(self.letters)}
        n = self.model.get_piece_size() - 1
        self.bytes_of = [bytes(map(value.__getitem__, self.model.id_to_piece(i))) for i in range(n)]
        self.packed = [i.to_bytes(4, "little") for i in range(n)]
        self.whole = dict(zip(self.bytes_of, self.packed, strict=True))
        spaced = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.pattern = regex.compile(spaced)
        self.mapping = dict(enumerate(self.letters))
        self.pieces: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.held = 0

    def _learn_pieces(self, wanted: set[str]) -> None:
        """Ids of pre-tokens: whole entries by look-up, the others merged by the model in one call."""
        new = {p: p.encode() for p in wanted if p not in self.pieces}
        self.held += sum(map(len, new))
        merged = []
        for p, raw in new.items():
            ids = self.whole.get(raw)
            if ids is None:
                merged.append(p)
            else:
                self.pieces[p] = ids
        mapped = [new[p].decode("latin-1").translate(self.mapping) for p in merged]
        packed = self.packed
        for p, ids in zip(merged, self.model.encode(mapped, num_threads=1) if mapped else (), strict=True):
            self.pieces[p] = b"".join([packed[i] for i in ids])

    def _learn(self, units: set[str]) -> None:
        split = self.pattern.findall
        parts = {u: (u,) if u.isascii() and u.removeprefix(" ").isalpha() else tuple(split(u)) for u in units}
        self._learn_pieces({p for ps in parts.values() for p in ps})
        self.held += sum(map(len, parts))
        pieces = self.pieces
        for u, ps in parts.items():
            self.units[u] = pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps])

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A run of white space with the run of other characters after it is a unit: no match of the
        pattern reaches over its end, so units are split and encoded on their own, once for every
        block of texts in which they occur.
        """
        out: list[list[bytes]] = []
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            if self.held > self.limit:
                self.units.clear()
                self.pieces.clear()
                self.held = 0
            known = self.units
            self._learn({u for _, units in waiting for u in units if u not in known})
            for i, units in waiting:
                out[i].append(b"".join(map(known.__getitem__, units)))
            waiting.clear()

        for i, text in enumerate(texts):
            out.append([])
            for stretch in blocks(text):
                waiting.append((i, UNIT.findall(stretch)))
                size += len(stretch)
                if size >= BLOCK:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def text_lengths(docs: DataFrame, text: str = "text", out: str = "n_tokens", ranks: dict[bytes, int] | None = None) -> DataFrame:
    """``docs`` with the encoded length of each text; null and empty texts have 0."""
    shipped = docs.sparkSession.sparkContext.broadcast((serialise_model(ranks or read_ranks()), public_tokenizers.PATTERN))

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(*shipped.value)
        for texts in batches:
            encoded = own.encode_all(t or "" for t in texts)
            yield pd.Series([len(ids) // 4 for ids in encoded], dtype="int64")

    return docs.withColumn(out, lengths.asNondeterministic()(F.col(text)))


def encode_decode(
    docs: DataFrame,
    text: str = "text",
    ranks: dict[bytes, int] | None = None,
    with_ids: bool = False,
    prefix: str = "",
) -> DataFrame:
    """Encode each whole text, decode the ids, and add both digests to ``docs``.

    Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (names behind ``prefix``; columns of
    ``docs`` with these names are replaced), and with ``with_ids`` also ``ids`` (array<int>).

    No shuffle: a text is encoded where it is read. The model is built on the driver from the
    vocabulary file (its size is that of the vocabulary) and sent to the tasks once.

    Null and empty texts have no ids and the digests of the empty string. Texts of any length are
    encoded whole; one long pre-token takes n log n time. Repeated rows are encoded each. An empty
    table gives an empty table. Further columns pass through. General: the scoring tables of this
    library hold no prose.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((serialise_model(ranks or read_ranks()), public_tokenizers.PATTERN))

    @F.pandas_udf(RESULT + (", ids array<int>" if with_ids else ""))
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(*shipped.value)
        for texts in batches:
            rows = []
            for ids in own.encode_all(t or "" for t in texts):
                row = [len(ids) // 4, sha256(ids).hexdigest(), sha256(own.decode(ids)).hexdigest()]
                rows.append([*row, np.frombuffer(ids, "<i4")] if with_ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
            yield pd.DataFrame(rows, columns=names)

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    packed = fresh("_encoded", docs)
    out = docs.withColumn(packed, encoded.asNondeterministic()(F.col(text)))
    return out.withColumns({prefix + n: F.col(packed)[n] for n in names}).drop(packed)
