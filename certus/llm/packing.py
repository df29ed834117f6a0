"""Packing tokenised documents by minimum bin slack.

Documents are cut into pieces of at most ``capacity`` tokens. How many pieces
have each length is all that a packing depends on, and that histogram has at
most ``capacity`` entries for any corpus. Minimum bin slack is solved on it: a
bin takes the longest length left, a bitset subset-sum programme over the
lengths still available finds the fullest combination around it, and the
combination is taken out as often as the counts allow. The pieces are then
matched to the places of the plan by their rank among pieces of equal length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certus.llm.common import saved
from certus.llm.wordcache import WordCache, together

CAPACITY, END_ID = 1024, 2
#: A space before one of these characters begins a token of the byte-level
#: pattern, whatever stands before it; none of them is white space.
BREAK = re.compile(" (?=[!-~¡-ɏͰ-ᄓぁ-鿿])")
#: A line end between two such characters is a token of its own.
LINE = re.compile("\n(?<=[!-~¡-ɏͰ-ᄓぁ-鿿]\n)(?=[!-~¡-ɏͰ-ᄓぁ-鿿])")
NEWLINE = 198
#: Words that a process remembers.
REMEMBERED = 400_000
#: Stands before the first word of a line, which no space precedes.
FIRST = "\0"
#: Latin letters, which the byte-level pattern keeps together with a space before them, and a mark that is a token of its own.
LETTERS = re.compile("(\0?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@]?)")
#: What stands for each byte in the model's vocabulary: printable characters themselves, the others from U+0100 on.
SPACE = "Ġ"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = dict(zip([b for b in range(256) if b not in PRINTABLE], range(256, 512), strict=False))


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


class ByteLevel:
    """The tokenizer file, with the ids of words remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel as ByteLevelPattern

        self.library = Tokenizer.from_file(path)
        #: Tokens that the library takes out of a text before anything else.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.apart = self._encode(["\n"])[0] == np.array([NEWLINE], "<u4").tobytes()
        before = self.library.pre_tokenizer
        self.direct = self.library.normalizer is None and isinstance(before, ByteLevelPattern) and before.use_regex and not before.add_prefix_space
        self.cache = WordCache(self._parts, REMEMBERED)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of the parts of split(); Latin words with one mark at most go to the library's model at once."""
        found = list(map(LETTERS.fullmatch, parts)) if self.direct else [None] * len(parts)
        ids: list[int] = []
        ends, rest, tokens, marks = [0], [], self.library.model.tokenize, {}
        for part, m in zip(parts, found, strict=True):
            if m:
                first, word, mark = m.groups()
                word = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
                ids += [t.id for t in tokens(word if first else SPACE + word)]
                if mark:
                    if mark not in marks:
                        marks[mark] = [t.id for t in tokens(mark)]
                    ids += marks[mark]
            else:
                rest.append(part)
            ends.append(4 * len(ids))
        packed = np.array(ids, "<u4").tobytes()
        others = iter(self._words([w if w == "\n" else w[1:] if w[0] == FIRST else " " + w for w in rest]))
        return [packed[s:e] if m else next(others) for m, s, e in zip(found, ends, ends[1:], strict=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Words without white space inside are encoded in one go, a line each."""
        simple = [w for w in words if self.apart and len(w.split()) == 1 and not w[-1].isspace() and w.lstrip(" ") == w.lstrip()]
        known = {}
        for at in range(0, len(simple), 5000):
            some = simple[at : at + 5000]
            ids = np.array(self.library.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == NEWLINE)
            if len(ends) == len(some) - 1:
                starts = np.r_[0, ends + 1]
                data = ids.tobytes()
                known.update((w, data[4 * s : 4 * e]) for w, s, e in zip(some, starts, np.r_[ends, len(ids)], strict=True))
        rest = [w for w in words if w not in known]
        known.update(zip(rest, self._encode(rest), strict=True))
        return [known[w] for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts; what a text holds of special tokens counts as such, none are added.

        Texts that hold any go to the library whole, the others word by word.
        """
        out = []
        for some in together(texts):
            whole = [k for k, t in enumerate(some) if any(a in t for a in self.added)]
            own = self.cache.ids_of_all([[] if k in whole else split(t) for k, t in enumerate(some)])
            for k, ids in zip(whole, self._encode([some[k] for k in whole]), strict=True):
                own[k] = ids
            out += own
        return out


def plain(line: str) -> bool:
    """Whether only single spaces before printable Latin-1 characters occur, so that every space begins a token."""
    if not line.isprintable() or "  " in line or line[-1:] == " ":
        return False
    try:
        line.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def split(text: str) -> list[str]:
    """A text in parts that the tokenizer never joins.

    A part stands for a space and itself, after FIRST for what follows it
    alone; a line end between parts is a part.
    """
    out: list[str] = []
    for line in LINE.split(text):
        if out:
            out.append("\n")
        own = line.split(" ") if plain(line) else BREAK.split(line)
        own[0] = FIRST + own[0]
        out += own if len(own[0]) > 1 else own[1:]
    return out


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteLevel:
    """The tokenizer, read once by each Python process."""
    return ByteLevel(path)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces; only the first may be shorter."""
    first = (length - 1) % capacity + 1
    return [(0, first), *[(s, capacity) for s in range(first, length, capacity)]]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = loaded(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b, out = whole.slice(at, 200), []
                texts = [t or "" for t in b.column(1).to_pylist()]
                for doc, own in zip(b.column(0).to_pylist(), model.encode(texts), strict=True):
                    ids = memoryview(own + end)
                    for k, (s, n) in enumerate(cuts(len(ids) // 4, capacity)):
                        out.append((doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), part, seen[n]))
                        seen[n] += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum not over room."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << (length * k) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + k
            total -= length * k
    return taken


def bin_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many bins have each, for a histogram of lengths."""
    left, plan = dict(counts), []
    while left:
        longest = max(left)
        left[longest] -= 1
        taken = fullest({x: n for x, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[x] // n for x, n in taken.items())
        for x, n in taken.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        plan.append((taken, times))
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces in a bin, first bin, first offset), ascending by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    bins, ranks = 0, {}
    for taken, times in plan:
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            out.setdefault(length, []).append((ranks.get(length, 0), n, bins, offset))
            ranks[length] = ranks.get(length, 0) + n * times
            offset += n * length
        bins += times
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def _placed(plan: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                rows = np.flatnonzero(length == x)
                at = plan[x][np.searchsorted(plan[x][:, 0], rank[rows], side="right") - 1]
                turn, place = np.divmod(rank[rows] - at[:, 0], at[:, 1])
                sequence[rows], offset[rows] = at[:, 2] + turn, at[:, 3] + place * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and then id 2; a null text is an empty one, of
    length 1. Repeated rows and null ids are packed like others; other columns
    are ignored; an empty table packs to nothing. Only the histogram of lengths
    (at most ``capacity`` rows) reaches the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    pieces = saved(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity), schema))
    held = saved(pieces.groupBy("part", "length").count())
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(places(bin_plan(counts, capacity))), out)
