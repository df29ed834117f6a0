"""Scores of whole documents under a recurrent language model and a unigram base.

Counts of all words cover all training documents: chunks count their words,
buckets of words add them up and answer with the sums. The most frequent words
are the recurrent model's own. The others are in classes by their first two
bytes; how likely one is, given its class, is read from the counts, and for
unseen words from how words are spelled (runs of two and of four bytes,
counted over all different training words). The recurrent weights start from a
bounded sample of pieces of training documents. Then every chunk trains them
further on all of its training documents, and the weights of all chunks are
averaged, each by the words that it learned from.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certus.llm.common import chunk_count, in_chunks, saved
from certus.llm.gru import GRU

#: Words of the recurrent model, classes of rare ones, bytes of text that its weights are first trained on.
FREQUENT, RARE, SAMPLE_BYTES = 1024, 48, 3 << 20
#: Characters of a piece of a text in that sample.
PIECE = 1 << 15
#: Of so many training documents one is learned from in its chunk (1: all are), and at which rate.
TUNED_OF, TUNED_RATE = 1, 0.002
#: Size of the spelling model: runs of four bytes, the most frequent ones; others are spelled by pairs.
RUNS = 100_000
END, SMOOTH = b"", 0.1


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words, then the end."""
    return [*text.lower().split(), END]


def rare_class(word: bytes) -> int:
    """The class of a word by its first two bytes; a word's end counts as a space."""
    return ((word[0] if word else 32) * 31 + (word[1] if len(word) > 1 else 32)) % RARE


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def _texts(docs: pa.Table) -> tuple[list, list[bytes]]:
    return docs.column("doc_id").to_pylist(), [t or b"" for t in docs.column("text").cast(pa.binary()).to_pylist()]


def _by_bucket(words: set[bytes], buckets: int) -> list[list[bytes]]:
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in sorted(words):
        out[zlib.crc32(w) % buckets].append(w)
    return out


def _counted(buckets: int):
    """Chunk to buckets: its different words, and how often training documents have them."""

    def run(docs: pa.Table) -> pa.Table:
        number, train, seen = docs.column("chunk")[0].as_py(), Counter(), set()
        for i, text in zip(*_texts(docs), strict=True):
            (seen if is_held_out(i) else train).update(words_of(text))
        rows = [(b, number, b" ".join(own), np.fromiter(map(train.get, own, repeat(0)), "<i8", len(own)).tobytes()) for b, own in enumerate(_by_bucket(seen | train.keys(), buckets)) if own]
        names, kinds = ["bucket", "chunk", "words", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """Bucket to chunks: total counts of their words. One row without a chunk: what the bucket has in all."""
    sent = [w.as_py().split(b" ") for w in rows.column("words")]
    counts = [np.frombuffer(c.as_py(), "<i8") for c in rows.column("counts")]
    total: dict[bytes, int] = {}
    for words, n in zip(sent, counts, strict=True):
        for w, k in zip(words, n.tolist(), strict=True):
            total[w] = total.get(w, 0) + k
    out = [(c, rows.column("bucket")[0].as_py(), np.fromiter(map(total.__getitem__, words), "<i8", len(words)).tobytes()) for c, words in zip(rows.column("chunk").to_pylist(), sent, strict=True)]
    known = {w: k for w, k in total.items() if k}
    top = sorted(known.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]
    classes = np.zeros(RARE, np.int64)
    for w, k in known.items():
        classes[rare_class(w)] += k
    text = np.frombuffer(b"   " + b"   ".join(w for w in known if w) + b" ", np.uint8).astype(np.int64)
    runs = text[:-3] << 24 | text[1:-2] << 16 | text[2:-1] << 8 | text[3:]
    # a run ends within a word or at its end; before a word stand spaces
    runs, n_runs = np.unique(runs[(text[2:-1] != 32) | (text[3:] != 32)], return_counts=True)
    n = len(out)
    return pa.table(
        {
            "chunk": pa.array([*[r[0] for r in out], None], pa.int32()),
            "bucket": pa.array([*[r[1] for r in out], None], pa.int32()),
            "counts": pa.array([*[r[2] for r in out], None], pa.binary()),
            "tokens": pa.array([*[None] * n, sum(known.values())], pa.int64()),
            "different": pa.array([*[None] * n, len(known)], pa.int64()),
            "once": pa.array([*[None] * n, sum(k == 1 for k in known.values())], pa.int64()),
            "top": pa.array([*[None] * n, [{"word": w, "n": k} for w, k in top]], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
            "classes": pa.array([*[None] * n, classes.tolist()], pa.list_(pa.int64())),
            "runs": pa.array([*[None] * n, runs.tolist()], pa.list_(pa.int64())),
            "n_runs": pa.array([*[None] * n, n_runs.tolist()], pa.list_(pa.int64())),
        }
    )


class Spelling:
    """Probability of a word's bytes and its end: runs of four, backed off to pairs."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray, most: int = RUNS):
        pairs = np.full((256, 256), 0.05)
        np.add.at(pairs, (runs >> 8 & 255, runs & 255), counts)
        pairs[32, 32] = 0  # a word isn't empty
        self.pairs = pairs / pairs.sum(1, keepdims=True)
        kept = np.argsort(-counts, kind="stable")[:most]
        order = np.argsort(runs[kept])
        self.runs, self.counts = runs[kept][order], counts[kept][order].astype(np.float64)
        self.contexts, first = np.unique(self.runs >> 8, return_index=True)
        self.totals = np.add.reduceat(self.counts, first) if len(first) else np.zeros(0)
        #: Weight of the pairs in each context: the number of different bytes that follow it.
        self.kinds = np.diff(np.r_[first, len(self.runs)]).astype(np.float64)

    def of(self, runs: np.ndarray) -> np.ndarray:
        """Probability of the last byte of each run after the three others."""
        lower = self.pairs[runs >> 8 & 255, runs & 255]
        if not len(self.runs):
            return lower
        at = np.minimum(np.searchsorted(self.contexts, runs >> 8), len(self.contexts) - 1)
        known = self.contexts[at] == runs >> 8
        place = np.minimum(np.searchsorted(self.runs, runs), len(self.runs) - 1)
        n = np.where(self.runs[place] == runs, self.counts[place], 0)
        first = runs >> 8 == 0x202020  # no word is empty, and so a space can't follow three
        return np.where(known & ~(first & (runs & 255 == 32)), (n + self.kinds[at] * lower) / (self.totals[at] + self.kinds[at]), lower)

    def logs(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        text = np.frombuffer(b"   " + b"   ".join(words) + b" ", np.uint8).astype(np.int64)
        steps = np.r_[0, np.cumsum(np.log(np.maximum(self.of(text[:-3] << 24 | text[1:-2] << 16 | text[2:-1] << 8 | text[3:]), 1e-300)))]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 3)
        return steps[ends - 2] - steps[ends - 2 - np.fromiter(map(len, words), np.int64, len(words)) - 1]

    def class_mass(self) -> np.ndarray:
        """Probability that a spelled word is in each class of rare words."""
        out, byte = np.zeros(RARE), np.arange(256)
        first = self.of(0x20202000 + byte)
        for b in np.flatnonzero(byte != 32):
            np.add.at(out, (b * 31 + byte) % RARE, first[b] * self.of(0x20200000 + (b << 8) + byte))
        return out


class Scorer:
    """What scoring needs besides a chunk's counts: the totals, the frequent words, spelling, the weights."""

    def __init__(self, tokens: int, different: int, once: int, top: list[tuple[bytes, int]], classes: np.ndarray, spelling: Spelling):
        self.tokens, self.different, self.spelling = tokens, different, spelling
        self.words = {w: k for k, (w, _) in enumerate(top)}
        self.words.setdefault(END, len(self.words))
        counts = np.zeros(len(self.words) + RARE)
        counts[: len(top)] = [n for _, n in top]
        self.rare = np.array(classes, np.float64)
        for w, n in top:
            self.rare[rare_class(w)] -= n
        counts[-RARE:] = self.rare = np.maximum(self.rare, 0)
        #: Share of rare words that are new, as far as words seen once tell.
        self.unseen = min(0.9, max(0.01, (once + 1) / (self.rare.sum() + 2)))
        self.mass = np.maximum(spelling.class_mass(), 1e-12)
        self.model = GRU(counts, RARE)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        n = len(self.words)
        return np.array([k if (k := self.words.get(w)) is not None else n + rare_class(w) for w in words], np.int64)

    def train(self, documents: Iterable[list[bytes]], **how) -> int:
        """Number of words learned from."""
        documents = [self.numbers(w) for w in documents if w]
        return self.model.train(documents, self.words[END], **how) if documents else 0

    def rare_logs(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Log-probability of words, given their class of rare words: from counts and from spelling."""
        own = np.fromiter(map(rare_class, words), np.int64, len(words))
        spelled = np.log(self.unseen) + self.spelling.logs(words) - np.log(self.mass[own])
        counted = np.log(np.maximum((1 - self.unseen) * counts / np.maximum(1, self.rare[own]), 1e-300))
        return np.logaddexp(spelled, counted)

    def base_logs(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.tokens + SMOOTH * (self.different + 1)))


def _scored(scorer: Scorer, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = _texts(docs)
        tokens = [words_of(t) for t in texts]
        seen = set().union(*tokens) if tokens else set()
        said = dict(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        words, counts = [], [np.zeros(0, np.int64)]
        for b, own in enumerate(_by_bucket(seen, buckets)):
            if own:
                words += own
                counts.append(np.frombuffer(said[b], "<i8"))
        counts = np.concatenate(counts)
        place = {w: k for k, w in enumerate(words)}
        number = scorer.numbers(words)
        extra = np.where(number >= len(scorer.words), scorer.rare_logs(words, counts), 0)
        base = scorer.base_logs(counts)
        at = [np.fromiter(map(place.__getitem__, t), np.int64, len(t)) for t in tokens]
        score = scorer.model.score([number[a] for a in at], scorer.words[END])
        score = (score + np.array([extra[a].sum() for a in at])) / np.log(10)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array(list(map(is_held_out, ids)), pa.bool_()),
                "n_tokens": pa.array(list(map(len, tokens)), pa.int64()),
                "n_known": pa.array([int((counts[a] > 0).sum()) for a in at], pa.int64()),
                "train_tokens": pa.array([scorer.tokens] * len(ids), pa.int64()),
                "base_score": pa.array([float(base[a].sum()) for a in at], pa.float64()),
                "score": pa.array(score.astype(np.float64), pa.float64()),
            }
        )

    return run


def _tuned(scorer: Scorer):
    """Chunk to weights: what its documents make of them, and from how many words."""

    def run(docs: pa.Table) -> pa.Table:
        own = copy.copy(scorer)
        own.model = copy.copy(scorer.model)
        own.model.p = dict(scorer.model.p)
        order = docs.append_column("row", pa.array(range(docs.num_rows))).sort_by([("doc_id", "ascending"), ("text", "ascending")]).column("row")
        n = own.train(map(words_of, _texts(docs.take(order))[1]), passes=1, rate=TUNED_RATE)
        return pa.table({"chunk": docs.column("chunk").slice(0, 1), "words": pa.array([n], pa.int64()), "weights": pa.array([own.model.packed()], pa.binary())})

    return run


def _added(rows: pa.Table) -> pa.Table:
    """The weights of some chunks times their words, added up."""
    total = sum(n * np.frombuffer(w, "<f4").astype(np.float64) for n, w in zip(rows.column("words").to_pylist(), rows.column("weights").to_pylist(), strict=True))
    return pa.table({"words": pa.array([sum(rows.column("words").to_pylist())], pa.int64()), "weights": pa.array([total.astype("<f8").tobytes()], pa.binary())})


def tune(scorer: Scorer, dealt: DataFrame, chunks: int) -> int:
    """Averages the weights that the chunks' training documents lead to; the number of words learned from."""
    share = dealt.where((F.crc32(F.col("doc_id").cast("string")) % 10 != 0) & (F.pmod(F.xxhash64("text", "doc_id", F.lit("tune")), F.lit(TUNED_OF)) == 0))
    own = share.groupBy("chunk").applyInArrow(_tuned(scorer), "chunk int, words long, weights binary").where("words > 0")
    groups = int(np.ceil(np.sqrt(chunks)))
    sums = own.groupBy(F.pmod("chunk", F.lit(groups)).alias("part")).applyInArrow(lambda rows: _added(rows.select(["words", "weights"])), "words long, weights binary")
    held = sorted((r.words, bytes(r.weights)) for r in sums.collect())
    words = sum(n for n, _ in held)
    if words:
        scorer.model.unpack(sum(np.frombuffer(w, "<f8") for _, w in held) / words)
    return words


def fitted(docs: DataFrame) -> tuple[Scorer, DataFrame, DataFrame, int]:
    """The scorer, the documents dealt to chunks, the counts of each chunk's words, and the number of chunks."""
    chunks = chunk_count(docs)
    dealt = in_chunks(docs, chunks)
    summed = "chunk int, bucket int, counts binary, tokens long, different long, once long, top array<struct<word: binary, n: long>>, classes array<long>, runs array<long>, n_runs array<long>"
    counted = dealt.groupBy("chunk").applyInArrow(_counted(chunks), "bucket int, chunk int, words binary, counts binary")
    counted = saved(counted.groupBy("bucket").applyInArrow(_summed, summed))
    totals = counted.where("chunk is null")
    n = totals.agg(F.sum("tokens").alias("tokens"), F.sum("different").alias("different"), F.sum("once").alias("once")).first()
    top = totals.select(F.explode("top").alias("t")).select("t.word", "t.n").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    classes = totals.select(F.posexplode("classes").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    runs = totals.select(F.explode(F.arrays_zip("runs", "n_runs")).alias("r")).groupBy("r.runs").agg(F.sum("r.n_runs").alias("n")).orderBy(F.desc("n"), "runs").limit(RUNS)
    runs = runs.toArrow()
    spelling = Spelling(runs.column("runs").to_numpy(), runs.column("n").to_numpy())
    mass = np.zeros(RARE)
    for r in classes:
        mass[r.k] = r.n
    scorer = Scorer(n["tokens"] or 0, n["different"] or 0, n["once"] or 0, [(bytes(r.word), r.n) for r in top], mass, spelling)
    scorer.train(sample(docs))
    tune(scorer, dealt, chunks)
    return scorer, dealt, counted.where("chunk is not null").select("chunk", "bucket", "counts"), chunks


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Both scores are log10 probabilities of the whole text: base_score under
    smoothed counts of single words, score under the recurrent model. Rows
    whose crc32 of doc_id as text is divisible by 10, or whose doc_id is null,
    are held out. A null text is an empty one, of one token, the end. Repeated
    rows count as often as they occur; other columns are ignored.
    """
    scorer, dealt, answers, chunks = fitted(docs.select("doc_id", "text"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(scorer, chunks), schema)


def sample(docs: DataFrame, most: int = SAMPLE_BYTES) -> list[list[bytes]]:
    """Words of pieces of training texts, of about that many bytes in all, the first ones by a hash.

    Texts of any length are in it by pieces; the last piece of a text has its end.
    """
    usable = docs.where((F.crc32(F.col("doc_id").cast("string")) % 10 != 0) & (F.octet_length("text") > 0))
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    last = F.floor((F.char_length("text") - 1) / PIECE).cast("int")
    spot = lambda piece: F.pmod(F.xxhash64("doc_id", piece, F.lit("lm")), F.lit(1 << 30))
    chosen = F.filter(F.sequence(F.lit(0), last), lambda piece: spot(piece) < int((1 << 30) * min(1.0, most / max(1, total))))
    pieces = usable.select("doc_id", "text", last.alias("last"), F.explode(chosen).alias("piece"))
    pieces = pieces.select(spot(F.col("piece")).alias("spot"), (F.col("piece") == F.col("last")).alias("ends"), F.substring(F.col("text"), F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("text"))
    out, size = [], 0
    for r in pieces.orderBy("spot", "text").limit(most // 64).toLocalIterator():
        text = r.text.encode("utf-8", "surrogatepass")
        size += len(text)
        if size > 2 * most:
            break
        out.append(words_of(text) if r.ends else text.lower().split())
    return out
