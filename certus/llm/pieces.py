"""SentencePiece encoding that keeps byte offsets, and decoding.

Normalisation walks the text by longest prefix through the model's compiled
character map (a double-array trie followed by the replacement strings) and
notes for every normalised byte the source byte it came from. Every piece is
projected through that alignment to a span of the original text. Bytes with
which nothing in the map begins stand for themselves, so texts of such bytes
only are aligned without a walk. Segmentation of the normalised text is the
library's; where no piece crosses a word mark, words are independent and their
ids are remembered.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certus.llm.wordcache import WordCache, packed

MARK = "▁"
#: Kinds of pieces in the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if key & 7 == 2 else (8 if key & 7 == 1 else 4, at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class CharMap:
    """The compiled character map: longest-prefix lookup over UTF-8 bytes."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]
        #: Bytes with which a mapped prefix begins.
        self.first = np.zeros(256, bool)
        if self.units:
            root = (self.units[0] >> 10) << ((self.units[0] & 512) >> 6)
            for b in range(256):
                self.first[b] = (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix at a place, and its replacement."""
        if not self.units:
            return None
        found, place = None, 0
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        place = step(self.units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            unit = self.units[place] if place < len(self.units) else 0
            if unit & 0x800000FF != data[i]:
                break
            place ^= step(unit)
            if unit >> 8 & 1:
                start = self.units[place] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found


def words_of(norm: str) -> list[str]:
    """Words of a normalised text without their one leading mark, or with several ones."""
    if MARK * 2 not in norm:
        return norm.split(MARK)[1:]
    return [w[1:] if w[1:2] != MARK else w for w in re.findall(f"{MARK}+[^{MARK}]*", norm)]


class PieceModel:
    """A model file: its pieces, its normaliser and the library's segmentation."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.pieces: list[tuple[str, int]] = []
        blob, self.prefix, self.squeeze, self.escape, self.suffix = b"", True, True, True, False
        for number, value in fields(data):
            if number == 1:
                f = dict(fields(value))
                self.pieces.append((f[1].decode(), f.get(3, NORMAL)))
            elif number == 2:
                self.suffix = bool(dict(fields(value)).get(24, 0))
            elif number == 3:
                f = dict(fields(value))
                blob, self.prefix, self.squeeze, self.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        self.map = CharMap(blob)
        surface = [s for s, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)]
        plain = not blob and self.prefix and not self.squeeze and self.escape and not self.suffix
        self.by_word = plain and not any(kind in (USER_DEFINED, UNUSED) for _, kind in self.pieces) and not any(MARK in s.lstrip(MARK) for s in surface)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        #: Normalised bytes of each piece.
        self.width = np.array([1 if kind == BYTE else 0 if kind == CONTROL else len(s.encode()) for s, kind in self.pieces], np.int64)
        self.unknown = np.array([kind == UNKNOWN for _, kind in self.pieces], bool)
        self.cache = WordCache(self._words)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words without their one leading mark, or with several ones."""
        ids = self.library.encode([w[1:].replace(MARK, " ") if w.startswith(MARK) else w for w in words], num_threads=1)
        return [packed([self.library.piece_to_id(MARK)] if not w else i) for w, i in zip(words, ids, strict=True)]

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the source byte."""
        data = text.encode()
        space = MARK.encode() if self.escape else b" "
        if not data:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        if not self.squeeze and not self.map.first[raw].any():
            blank = raw == 32
            source = np.repeat(np.arange(len(raw)), np.where(blank, len(space), 1)) if blank.any() else np.arange(len(raw))
            out, front, back = data.replace(b" ", space), self.prefix and not self.suffix, self.prefix and self.suffix
            source = np.concatenate([np.zeros(len(space) * front, np.int64), source, np.full(len(space) * back + 1, len(data))])
            return space * front + out + space * back, source
        out, source = bytearray(), []

        def put(piece: bytes, at: int, same: bool = False) -> None:
            own = piece.replace(b" ", space)
            out.extend(own)
            source.extend(range(at, at + len(own)) if same and own == piece else [at] * len(own))

        parts, at = [], 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                hit = n, data[at : at + n]
            parts.append((at, *hit))
            at += hit[0]
        if self.squeeze:
            while parts and parts[0][2] == b" ":
                parts.pop(0)
        if not parts:
            return b"", np.zeros(1, np.int64)
        first = parts[0][0]
        if self.prefix and not self.suffix:
            put(b" ", first)
        was_space = self.squeeze
        for start, _, piece in parts:
            while was_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                put(piece, start, piece == data[start : start + len(piece)])
                was_space = self.squeeze and piece.endswith(b" ")
        end = len(data)
        if self.squeeze:
            while out.endswith(space):
                end = source[-len(space)]
                del out[-len(space) :], source[-len(space) :]
        if self.prefix and self.suffix:
            put(b" ", end)
        return bytes(out), np.array([*source, end], np.int64)

    def encode(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Packed ids with begin and end, and the byte span of every id.

        Bytes of a text that a piece's normalised bytes came from are its span;
        begin, end and a mark that stands for no source byte have empty ones.
        """
        begin, end = packed([self.bos]), packed([self.eos])
        norm, source = self.normalise(text)
        if self.by_word:
            inner = self.cache.ids(words_of(norm.decode()))
        else:
            inner = packed(self.library.encode(text))
        ids = np.frombuffer(inner, "<u4")
        widths = self.width[ids]
        unknown = np.flatnonzero(self.unknown[ids])
        if len(unknown):  # an unknown piece covers what the others leave
            said = self.library.encode(text, out_type=str)
            widths[unknown] = [len(said[i].encode()) for i in unknown]
        edges = np.concatenate([[0], np.cumsum(widths)])
        if edges[-1] != len(norm):
            raise ValueError("pieces don't cover the normalised text")
        starts, stops, size = source[edges[:-1]], source[edges[1:]], len(text.encode())
        return begin + inner + end, np.concatenate([[0], starts, [size]]), np.concatenate([[0], stops, [size]])

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def loaded(path: str) -> PieceModel:
    """The model, read once by each Python process."""
    return PieceModel(path)


def _rows(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b, out = whole.slice(at, 200), []
                for text in b.column(1).to_pylist():
                    ids, starts, stops = model.encode(text or "")
                    back = model.decode(ids)
                    if digest:
                        spans = zlib.crc32(np.stack([starts, stops]).astype("<u4").tobytes())
                        out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), spans))
                    else:
                        out.append((np.frombuffer(ids, "<u4").astype(np.int32), starts, stops, back))
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"] if digest else ["ids", "starts", "stops", "decoded"]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()] if digest else [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
                columns = [pa.array([r[k] for r in out], kinds[k]) for k in range(4)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *names])

    return run


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, starts, stops (byte spans of the text) and decoded of every document.

    ids carry begin and end. A null text is an empty one. Repeated rows and
    null ids pass as they are; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_rows(model or default_model(), False), "doc_id long, ids array<int>, starts array<long>, stops array<long>, decoded string")


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Like encode_pieces, with counts and digests in place of the lists."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_rows(model or default_model(), True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
