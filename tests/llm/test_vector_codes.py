from __future__ import annotations

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from cmdlode.llm import vector_codes as vc
from cmdlode.llm.queries import queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, row int, code string, error int, part int"


def brute(rows, entries=vc.ENTRIES, rounds=vc.ROUNDS):
    """Plain loops over Python integers; rows are (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], None
    width = -(-max(len(r[1]) for r in kept) // vc.PARTS) or 1
    parts = []
    for _, vector, _ in kept:
        v = [math.floor(float(np.float32(x)) * vc.SCALE) for x in vector]
        v += [0] * (width * vc.PARTS - len(v))
        parts.append([v[p * width : (p + 1) * width] for p in range(vc.PARTS)])
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, sum(parts[i], [])))[:entries]
    books = [[list(parts[i][p]) for i in first] for p in range(vc.PARTS)]

    def assign():
        return [
            [min((sum((a - b) ** 2 for a, b in zip(x, entry)), e) for e, entry in enumerate(books[p])) for p, x in enumerate(own)]
            for own in parts
        ]

    for _ in range(rounds):
        given = assign()
        for p, e in itertools.product(range(vc.PARTS), range(len(first))):
            own = [parts[i][p] for i in range(len(kept)) if given[i][p][1] == e]
            if own:
                books[p][e] = [sum(column) // len(own) for column in zip(*own)]
    given = assign()
    errors = [sum(d for d, _ in row) for row in given]
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    sha = hashlib.sha256(text.encode()).hexdigest()
    by_label = {}
    for r, error in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + error
    out = [(r[0], "".join(f"{e:02x}" for _, e in row), error, by_label[r[2]]) for r, row, error in zip(kept, given, errors)]
    return sorted(out, key=repr), sha


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 9, "x", 8, 7) for r in rows], SCHEMA)

    return make


def ours(frame, **options):
    coded, books = vc.compress(frame, **options)
    rows = vc.label_errors(coded).select("vec_id", "code", "error", "label_error").collect()
    return sorted((tuple(r) for r in rows), key=repr), vc.books_digest(books)


def clusters(n, dims, seed):
    rng = random.Random(seed)
    centers = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.1) for x in centers[i % 5]], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("dims,entries,block", [(8, 6, 4), (16, 16, 64), (5, 4, 3), (72, 8, 16)])
def test_equal_to_loops(vectors, dims, entries, block):
    rows = clusters(150, dims, dims)
    assert ours(vectors(rows), entries=entries, block=block) == brute(rows, entries)


def test_rows_that_are_dropped_and_odd_ones(vectors):
    nan, inf = float("nan"), float("inf")
    rows = clusters(40, 8, 1) + [(90, None, 1), (91, [0.1, None], 1), (92, [nan] * 8, 1), (93, [0.5, -inf], 1), (None, [0.25] * 8, None)]
    rows += [(94, [], 2), (95, [0.5, 0.25, -0.75], 2), (7, [0.125] * 8, 3), (7, [0.125] * 8, 3), (7, [-0.125] * 8, 3)]
    found, sha = ours(vectors(rows), entries=8, block=5)
    assert (found, sha) == brute(rows, 8)
    assert {r[0] for r in found} >= {None, 94, 95} and not {r[0] for r in found} & {90, 91, 92, 93}


def test_ties_go_to_the_lower_entry(vectors):
    rows = [(i, [0.0] * 4, None) for i in range(20)] + [(30, [1.0] * 4, 1), (31, [0.5] * 4, 1)]
    assert ours(vectors(rows), entries=22) == brute(rows, 22)
    found, _ = ours(vectors(rows), entries=22)
    assert {code for vec_id, code, _, _ in found if vec_id < 20} == {"00000000"}


def test_negative_values_are_floored(vectors):
    rows = [(i, [-0.0001 * i, 0.0001 * i, -1.5, 1.5], i % 2) for i in range(30)]
    assert ours(vectors(rows), entries=3) == brute(rows, 3)


def test_large_values_stay_exact(vectors):
    rows = [(i, [8000.5 + i, -900.25 * i, 3.0, 1e30], 0) for i in range(12)]
    found, _ = ours(vectors(rows), entries=2)
    held = [(i, [*v[:3], vc._LIMIT / vc.SCALE], label) for i, v, label in rows]
    assert found == brute(held, 2)[0]


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], None)]])
def test_nothing_to_code(vectors, rows):
    found, _ = ours(vectors(rows))
    assert found == ([(1, "00000000", 0, 0)] if rows and rows[0][1] == [] else [])


def test_decoded_is_near(vectors):
    frame = vectors(clusters(60, 8, 3))
    coded, books = vc.compress(frame, entries=16)
    joined = coded.select("vec_id", "error", vc.decoded(coded["code"], books).alias("near")).join(frame, "vec_id").collect()
    for row in joined:
        far = sum((math.floor(a * vc.SCALE) - b * vc.SCALE) ** 2 for a, b in zip(row["embedding"], row["near"]))
        assert far == row["error"]


def test_places_follow_the_curve():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        places = vc.hilbert_places(cells, bits)
        assert sorted(places.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1)
        assert (steps == 1).all()  # neighbours on the curve are neighbours in space


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(5)
    smaller = 0
    for _ in range(200):
        center = rng.integers(-500, 500, 4)
        x = center + rng.integers(-60, 60, (20, 4))
        book = rng.integers(-600, 600, (32, 4))
        short = vc.shortlist(x.min(axis=0), x.max(axis=0), book)
        whole = ((x[:, None] - book) ** 2).sum(axis=2)
        assert set(whole.argmin(axis=1)) <= set(short.tolist())
        assert (short[vc.nearest(x, book[short])[0]] == whole.argmin(axis=1)).all()
        smaller += len(short) < len(book)
    assert smaller > 150


def test_query_is_the_same_again(spark):
    run = lambda: sorted(map(tuple, queries()["op11_vector_codes"](spark, "/root/testdata/sf0.001").collect()))
    assert run() == run()
