"""Vector codes against plain Lloyd rounds."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import elkan
from folioflow.llm._work import temporary

ROW = "vec_id long, embedding array<float>, label int, code string, error int, n int"


def plain(rows, parts=8, entries=16, rounds=6):
    """Every distance of every round, vectors of one length."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * float(np.float32(x))) for x in r[1]]))
    out = []
    for length in {len(r[1]) for r in kept}:
        own = [r for r in kept if len(r[1]) == length]
        x = np.array([[math.floor(4096 * float(np.float32(c))) for c in r[1]] for r in own], object).reshape(len(own), length)
        cuts = [length * p // parts for p in range(parts + 1)]
        book, codes, error = [], [], 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            c, y = x[:entries, a:b].copy(), x[:, a:b]
            for turn in range(rounds + 1):
                d = ((y[:, None, :] - c[None, :, :]) ** 2).sum(axis=2) if b > a else np.zeros((len(y), len(c)), object)
                near = [min(range(len(c)), key=lambda j, row=row: (row[j], j)) for row in d]
                if turn < rounds:
                    for j in set(near):
                        mine = [k for k in range(len(y)) if near[k] == j]
                        c[j] = [sum(y[k][t] for k in mine) // len(mine) for t in range(b - a)]
            book += [v for row in c for v in row]
            codes.append(near)
            error = error + np.array([d[k][j] for k, j in enumerate(near)], object)
        digest = hashlib.sha256(",".join(map(str, book)).encode()).hexdigest()
        out += [(r[0], "".join(f"{c[k]:02x}" for c in codes), int(error[k]), r[2], digest) for k, r in enumerate(own)]
    total = Counter()
    for _, _, e, label, _ in out:
        total[label] += e
    return Counter((i, code, e, total[label], sha) for i, code, e, label, sha in out)


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], ROW).repartition(3)
    with temporary(spark):
        return Counter(map(tuple, elkan.compress(table, **options).collect()))


def test_codes_equal_those_of_all_distances(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 16))
    rows = [(i, (centres[i % 9] + rng.normal(size=16) * 0.2).tolist(), i % 4 if i % 7 else None) for i in range(600)]
    # Few values make many equal distances.
    rows += [(1000 + i, rng.integers(-1, 2, 16).astype(float).tolist(), 9) for i in range(300)]
    rows += [(2000, [0.0] * 16, None), (2000, [0.0] * 16, None), (None, [1.0] * 16, None), rows[5], rows[5]]
    rows += [(3000, None, 1), (3001, [float("nan")] * 16, 1), (3002, [float("inf")] + [0.0] * 15, 1), (3003, [None] + [0.0] * 15, 1)]
    assert found(spark, rows) == plain(rows)


def test_lengths_few_rows_and_no_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=size).tolist(), None) for i, size in enumerate([16] * 40 + [11] * 30 + [3] * 20 + [24] * 5)]
    assert found(spark, rows) == plain(rows)
    rows = [(1, [], 0), (2, [], 0)]
    assert sorted(found(spark, rows)) == [(1, "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest()), (2, "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest())]
    assert found(spark, [(1, None, 0)]) == Counter() == found(spark, [])


def test_too_large_components_are_an_error(spark):
    with pytest.raises(ValueError, match="too large"):
        found(spark, [(1, [1e6] * 8, 0)])


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 30, (500, 8)) for c in rng.integers(-4000, 4000, 12)]).astype(np.int64)
    book = x[rng.choice(len(x), 16, replace=False)].copy()
    code, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), elkan.UNKNOWN, np.int64), np.zeros((len(x), 16), np.int64)
    computed = []
    for _ in range(6):
        computed.append(elkan.nearest(x, book, code, upper, lower))
        d = ((x[:, None] - book) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all()
        assert (upper >= np.sqrt(d.min(axis=1))).all() and (lower <= np.sqrt(d)).all()
        after = np.array([x[code == j].sum(axis=0) // max(1, (code == j).sum()) if (code == j).any() else book[j] for j in range(16)])
        moves = elkan._ceil_root(((after - book) ** 2).sum(axis=1))
        upper, lower, book = upper + moves[code], np.maximum(lower - moves, 0), after
    assert computed[0] <= 16 * len(x) and sum(computed[3:]) < 3 * 16 * len(x) / 5
    for n in (0, 1, 2, 3, 4, 2**52 - 1, 2**61 - 1, (2**30) ** 2 - 1, (2**30) ** 2):
        assert elkan._floor_root(np.array([n]))[0] == math.isqrt(n)
        assert elkan._ceil_root(np.array([n]))[0] == math.isqrt(n) + (math.isqrt(n) ** 2 < n)
