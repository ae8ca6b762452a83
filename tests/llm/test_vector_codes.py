from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from epistola.llm import vector_codes
from epistola.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    size = width // parts
    cut = [[(v + [0] * (width - len(v)))[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for x in cut:
                got.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            books[p] = [[sum(c) // len(c) for c in zip(*got[k], strict=True)] if k in got else e for k, e in enumerate(books[p])]
    out, by_label = [], {}
    for (key, _, label), x in zip(kept, cut, strict=True):
        best = [nearest(x[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] = by_label.get(label, 0) + error
        out.append((key, "".join(f"{k:02x}" for _, k in best), error, label))
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((key, code, error, by_label[label], digest) for key, code, error, label in out), key=str)


def answer(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return sorted((tuple(r) for r in QUERIES["op13_vector_codes"](spark, str(folder)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vectors(seed, n, width=32, few=False):
    r = random.Random(seed)
    middle = [[r.gauss(0, 0.2) for _ in range(width)] for _ in range(9)]
    return [(i, [round(m + r.gauss(0, 0.05), 1 if few else 6) for m in r.choice(middle)], r.choice([0, 1, 1, 1, None])) for i in range(n)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = vectors(1, 260)
    rows += [(None, rows[0][1], 1), (None, rows[9][1], 1), rows[5], rows[5], (900, None, 1), (901, [float("nan")] * 32, 1), (902, [float("inf")] + [0.0] * 31, 1), (903, [None] + [0.0] * 31, 1), (904, [], 2), (905, [0.5] * 30, 3)]
    assert answer(spark, tmp_path, rows) == brute(rows)


def test_ties_keep_the_lower_index(spark, tmp_path):
    rows = vectors(2, 200, 16, few=True)
    assert answer(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 2)], [(3, [0.25] * 16, None)]])
def test_small_tables(spark, tmp_path, rows):
    assert answer(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("spread", [3, 40, 20_000, vector_codes.LARGEST])
def test_bounds_decide_as_full_scans_do(spread):
    r = np.random.default_rng(spread)
    parts, entries, size = 4, 24, 3
    points = r.integers(-spread, spread + 1, (900, parts, size))
    books = r.integers(-spread, spread + 1, (parts, entries, size))
    found = [vector_codes.scan(points[:, p], books[p]) for p in range(parts)]
    codes, least, second = (np.stack([f[i] for f in found], 1) for i in range(3))
    codes, upper, lower = codes.astype(np.uint8), vector_codes._up(vector_codes._root_up(least)), vector_codes._down(vector_codes._root_down(second))
    scans = []
    for step in (spread // 2, spread // 20, spread // 100, 0, 0):
        old, books = books, books + r.integers(-step, step + 1, books.shape)
        scans.append(vector_codes.reassign(points, codes, upper, lower, old, books))
        for p in range(parts):
            want, least, second = vector_codes.scan(points[:, p], books[p])
            assert (codes[:, p] == want).all()
            assert (upper[:, p].astype(float) ** 2 >= least).all() and (lower[:, p] <= np.sqrt(second.astype(float))).all()
    if spread > 100:
        assert scans[-1] == 0 and scans[2] < points.shape[0] * parts / 2


def test_other_names_and_columns(spark):
    rows = [("a", [0.1, 0.2, 0.3], "x"), ("b", [0.9, 0.2, 0.1], "y")]
    frame = spark.createDataFrame(rows, "key string, ints array<double>, codes string")
    made, books = vector_codes.encode(frame, "key", "ints", None, parts=2, entries=2, rounds=1)
    assert sorted((r.key, r.codes.hex(), r.error) for r in made.collect()) == [("a", "0000", 0), ("b", "0101", 0)] and books.shape == (2, 2, 2)
    with pytest.raises(ValueError):
        vector_codes.encode(frame, "key", "ints", None, entries=257)
