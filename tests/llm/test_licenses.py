"""Licence scan: planted notices, headers and bodies; near misses; against templates at every place."""

import random

import numpy as np
import pytest

from certus.llm.license_texts import BODIES, NOTICES
from certus.llm.licenses import CONFIRMED, STEP, WINDOW, Classifier, Hasher, confirmed, notices_in, scan_licenses, shares, windows, words

SCHEMA = "doc_id long, text string, families int"
SOME = ["the", "of", "tion", "license", "under", "public", "open", "version", "general", "mit", "anonly"]


def prose(r, n):
    return " ".join(r.choice(SOME) for _ in range(n))


def other(r, n):
    return " ".join("".join(r.choice("abdeiklmnorstu") for _ in range(r.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    r = random.Random(4)
    return Classifier([prose(r, 12) for _ in range(400)] + [other(r, 25) for _ in range(800)])


def families(model, text):
    return sorted({x[0] for x in notices_in(model, Hasher(), [text])[0]})


def wrapped(text, width):
    w = text.split()
    return "\n".join("# " + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_planted_notices(spark):
    r = random.Random(2)
    rows, want = [], {}
    for i, (name, notice) in enumerate((k, n) for k, own in NOTICES.items() for n in own):
        rows.append((i, f"{other(r, 12)}.\n{notice}.\n{other(r, 5)}"))
        want[i] = name
    for i in range(100, 160):
        rows.append((i, "\n".join(other(r, r.randrange(30)) for _ in range(4))))
    rows += [(200, None), (201, ""), (202, "x" * 200_000), (203, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (None, "Released under the MIT License."), (203, "no licence at all"), (204, other(r, 100_000))]
    got = scan_licenses(spark.createDataFrame([(*x, 1) for x in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append((x.families, x.n_notices))
    for i, name in want.items():
        assert by[i] == [(name, 1)], (rows[i], by[i])
    assert by[200] == by[201] == by[202] == by[204] == [("", 0)] and by[None] == [("MIT", 1)]
    assert sorted(by[203]) == [("", 0), ("CC-BY-NC-4.0,MIT", 3)]
    assert all(by[i] == [("", 0)] for i in range(100, 160))
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", sorted(BODIES))
def test_bodies_and_headers(model, name):
    r = random.Random(name)
    for text in BODIES[name]:
        for form in (text, wrapped(text, 11), f"{other(r, 70)}\n{wrapped(text, 9)}\n{other(r, 40)}", f"{other(r, 30)} {text} {other(r, 60)}"):
            assert families(model, form) == [name], form
        # the same words in another order, or half of them, are no licence
        w = text.split()
        for loose in (" ".join(r.sample(w, len(w))), " ".join(x for i, x in enumerate(w) if i // 3 % 2)):
            assert families(model, loose) == [], loose


@pytest.mark.parametrize("name", sorted(NOTICES))
def test_wrapped_and_embedded_notices(model, name):
    r = random.Random(name)
    for text in NOTICES[name]:
        w = text.split()
        half = len(w) // 2
        for form in (" ".join(w[:half]) + "\n" + " ".join(w[half:]), f"{other(r, 20)} {text}", f"{other(r, 200)} {text} {other(r, 300)}"):
            assert families(model, form) == [name], form


def test_near_misses(model):
    r = random.Random(1)
    for text in ["a general licence to print money under the public eye", "all the rights of the reserved seats", "the license of the mit library is open", "version 2.0 of the public general", "licensed driver under the age of 30", *(prose(r, r.randrange(5, 60)) for _ in range(60))]:
        assert families(model, text) == [], text
    assert families(model, "some words before: licensed under the mit license and after") == ["MIT"]
    assert families(model, "Copyright 2019 Some Company. All rights reserved.") == ["all-rights-reserved"]


def test_classifier_finds_what_templates_hold(model):
    """Against template comparison at every window, without the classifier; the unknown class alone may reject."""
    r, missed, held = random.Random(6), 0, 0
    every = [(n, t) for own in (NOTICES, BODIES) for n, texts in own.items() for t in texts]
    for _ in range(150):
        text = f"{other(r, r.randrange(40))} {r.choice(every)[1]} {other(r, r.randrange(40))}"
        w, plain = words(text), set()
        best = shares(w)
        plain = {name for name, x in best.items() if x[0] >= CONFIRMED and x[:2] == max(y[:2] for y in best.values())}
        got = set(families(model, text))
        assert got <= plain or not plain
        held, missed = held + len(plain), missed + len(plain - got)
    assert held and missed <= 0.03 * held


def test_windows_cover_units():
    lengths = np.array([0, 1, WINDOW, WINDOW + 1, 5 * WINDOW + 3])
    unit, start, end = windows(lengths)
    for u, n in enumerate(lengths.tolist()):
        own = [(a, b) for x, a, b in zip(unit.tolist(), start.tolist(), end.tolist()) if x == u]
        assert {i for a, b in own for i in range(a, b)} == set(range(n)) and all(b - a <= WINDOW for a, b in own)
        assert all(b - a == STEP for (a, _), (b, _) in zip(own, own[1:]))
    assert confirmed(words("nothing here"), ["MIT"]) is None
