"""The analyser on queries whose class theory fixes."""

import pytest

from certus.plans.analyze import analyze
from certus.plans.query import Database, Query, Table, atom


def database(**keys):
    db = Database()
    db.tables = {name: Table(None, tuple(key)) for name, key in keys.items()}
    return db


XY = atom("r", a="x", b="y")


@pytest.mark.parametrize(
    ("keys", "q", "attacks", "kind", "forest"),
    [
        ({"r": "a", "s": "c"}, Query((), (XY, atom("s", c="y", d="z"))), {(0, 1): "weak"}, "first-order", True),
        ({"r": "a", "s": "cd"}, Query((), (XY, atom("s", c="y", d="z", e="w"))), {(0, 1): "strong"}, "first-order", False),
        ({"r": "a", "s": "c"}, Query((), (XY, atom("s", c="y", d="x"))), {(0, 1): "weak", (1, 0): "weak"}, "polynomial", False),
        ({"r": "a", "s": "c"}, Query((), (XY, atom("s", c="z", d="y"))), {(0, 1): "strong", (1, 0): "strong"}, "coNP-complete", False),
        ({"r": "a", "s": "c"}, Query((), (XY, atom("s", c="z", d="x", e="y"))), {(0, 1): "strong", (1, 0): "weak"}, "coNP-complete", False),
        ({"r": "a", "s": "c"}, Query(("y",), (XY, atom("s", c="z", d="y"))), {}, "first-order", True),
    ],
)
def test_classes(keys, q, attacks, kind, forest):
    got = analyze(database(**{k: list(v) for k, v in keys.items()}), q)
    assert (got["attack_graph"], got["complexity"], got["forest"]) == (attacks, kind, forest)
    assert got["strategy"] == ("blocks" if got["trees"] is not None else "division" if kind == "first-order" else "search")
    assert (got["trees"] is not None) == (forest or q.free == ("y",))


def test_self_join_is_unknown():
    got = analyze(database(r=["a"]), Query((), (XY, atom("r", a="y", b="z"))))
    assert (got["complexity"], got["strategy"], got["forest"]) == ("unknown", "search", False)


def test_unbound_free_variable():
    with pytest.raises(ValueError, match="free"):
        Query(("q",), (XY,))
