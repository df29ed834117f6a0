"""Offset-preserving encoding against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from certus.llm.pieces import CharMap, PieceModel, default_model, encode_pieces, fields, piece_digests

TEXTS = ["", None, " ", "Hello  world", " lead and trail ", "a\n\nb\tc", "über 漢字 🙂", "▁mark ▁ x", "x" * 5000, "no break " * 800, "  \n  ", "<s> </s> <0x0A>"]


@pytest.fixture(scope="module")
def model():
    return PieceModel(default_model())


def random_texts(n):
    r = random.Random(3)
    return ["".join(r.choice(" \n\tab▁é　漢🙂.,'") for _ in range(r.randrange(14))) for _ in range(n)]


def test_ids_and_decoding_match_the_library(model):
    for text in [t or "" for t in TEXTS] + random_texts(1500):
        ids, _, _ = model.encode(text)
        want = model.library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert model.decode(ids) == model.library.decode(want)


def test_spans_hold_the_pieces(model):
    for text in [t or "" for t in TEXTS] + random_texts(1500):
        ids, starts, stops = model.encode(text)
        data, ids = text.encode(), np.frombuffer(ids, "<u4").tolist()
        inner = range(1, len(ids) - 1)
        assert b"".join(data[starts[i] : stops[i]] for i in inner) == data
        for i in inner:
            piece, kind = model.pieces[ids[i]]
            own = data[starts[i] : stops[i]]
            if kind == 6:
                assert own == bytes([int(piece[1:-1], 16)])
            else:
                assert own.decode().replace("▁", " ") == (piece[1:] if i == 1 else piece).replace("▁", " ")


def test_word_path_equals_whole_path(model):
    other = PieceModel(default_model())
    other.by_word = False
    for text in random_texts(400):
        a, b = model.encode(text), other.encode(text)
        assert a[0] == other.library.encode(text, add_bos=True, add_eos=True) or a[0][4:-4] == b[0][4:-4]
        assert (a[1] == b[1]).all() and (a[2] == b[2]).all()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_compiled_map_normalises_like_the_library(model, rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = dict(fields(library.serialized_model_proto()))[3]
    mine = PieceModel(default_model())
    mine.map = CharMap(dict(fields(spec))[2])
    mine.prefix = mine.escape = False
    mine.squeeze = bool(dict(fields(spec)).get(4, 1))
    mine.prefix = bool(dict(fields(spec)).get(3, 1))
    mine.escape = bool(dict(fields(spec)).get(5, 1))
    texts = ["ＡＢＣ　ｄｅｆ", "ﬁne ½ Å é é", "  two  spaces ", "ＫＡＤＯＫＡＷＡ ㌔㍍", "İSTANBUL ẞ", "\tx\ny\r", "가각", ""] + random_texts(200)
    for text in texts:
        norm, source = mine.normalise(text)
        assert norm.decode() == library.normalize(text), repr(text)
        assert len(source) == len(norm) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(text.encode())


def field(number, kind, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3 | kind) + (varint(value) if kind == 0 else varint(len(value)) + value)


@pytest.fixture(scope="module", params=["nmt_nfkc", "nfkc_cf"])
def mapped(request, tmp_path_factory):
    """The model with the compiled character map of a normalisation rule."""
    with open(default_model(), "rb") as f:
        data = f.read()
    spec = dict(fields(dict(fields(sentencepiece.SentencePieceNormalizer(rule_name=request.param).serialized_model_proto()))[3]))
    ours = field(1, 2, request.param.encode()) + field(2, 2, spec[2]) + field(3, 0, 1) + field(4, 0, 1) + field(5, 0, 1)
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(b"".join(field(n, 2, v) for n, v in fields(data) if n != 3) + field(3, 2, ours))
    return PieceModel(str(path))


def test_encoding_through_a_character_map(mapped):
    """Ids are the library's, and so is the part of the text that each piece stands for."""
    assert mapped.map.first.any() and not mapped.by_word
    odd = ["ＡＢＣ　ｄｅｆ", "ﬁne ½ Å é é", "  two  spaces ", "ＫＡＤＯＫＡＷＡ ㌔㍍", "İSTANBUL ẞ", "a\tb\r", "가각", "plain words only", "x ﬁ" * 300]
    for text in odd + [t or "" for t in TEXTS[:7]] + random_texts(400):
        ids, starts, stops = mapped.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == mapped.library.encode(text, add_bos=True, add_eos=True), repr(text)
        data, said = text.encode(), mapped.library.encode(text, return_type="proto").pieces
        for p, a, b in zip(said, starts[1:-1].tolist(), stops[1:-1].tolist(), strict=True):
            if mapped.pieces[p.id][1] != 6:
                assert (a, b) == (p.begin, p.end) and data[a:b].decode() == p.surface, (text, p.piece)
        assert starts[0] == stops[0] == 0 and starts[-1] == stops[-1] == len(data)


def test_alignment_without_a_walk_equals_the_walk(model):
    slow = PieceModel(default_model())
    slow.map.first = np.ones(256, bool)
    for text in [t or "" for t in TEXTS] + random_texts(600):
        a, b = model.normalise(text), slow.normalise(text)
        assert a[0] == b[0] and a[1].tolist() == b[1].tolist()


def test_frames(spark, model):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "x", "y"), (3, "Hello  world", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_pieces(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.doc_id] or "" if r.doc_id is not None else "x"
        assert r.ids == model.library.encode(text, add_bos=True, add_eos=True)
        assert r.decoded == model.library.decode(r.ids)
    for r in piece_digests(docs).where("doc_id is not null").collect():
        ids = model.library.encode(TEXTS[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()
    assert piece_digests(docs.limit(0)).count() == 0
