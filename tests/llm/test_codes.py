"""Exact products by limbs, and product codes against plain Python."""

import hashlib
import math

import numpy as np
import pytest

from fleetlens.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, x int, code string, row int, key string, n int, place int, part int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, "k", 3, 4, 5) for r in rows], SCHEMA)


@pytest.mark.parametrize("bits, width", [(3, None), (26, None), (26, 5), (29, 7), (28, 24), (20, 1)])
def test_products_are_exact(bits, width):
    rng = np.random.default_rng(bits)
    left, right = (rng.integers(-(1 << bits), (1 << bits) + 1, (n, 8)) for n in (50, 20))
    left[0], right[0], left[1], right[1] = -(1 << bits), -(1 << bits), 0, (1 << bits) - 1
    exact = [[sum(a * b for a, b in zip(x, y)) for y in right.tolist()] for x in left.tolist()]
    assert codes.exact_products(left, right, width).tolist() == exact


def test_limbs_stay_below_the_bound():
    for length in (1, 8, 1000, 1 << 20):
        width = codes.limb_width(length)
        assert width > 0 and length * ((1 << width) - 1) ** 2 < 1 << 53
        most = codes.most_bits(length)
        assert length * (2 << most) ** 2 <= 1 << 63
    x = np.array([[-(1 << 26), (1 << 26) - 1, -1, 0]])
    parts = codes.limbs(x, 5)
    assert len(parts) == 6 and all(abs(p).max() < 32 for p in parts)
    assert (sum(p.astype(np.int64) << (5 * i) for i, p in enumerate(parts)) == x).all()


def plain(rows, parts=16, entries=64, rounds=2):
    """What ``compress_vectors`` returns, one number at a time."""
    kept = []
    for vec_id, vector, label in rows:
        if vector is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        x = [math.floor(256 * v) for v in vector]
        if all(abs(v) < 1 << (61 - max(len(x), 1).bit_length()) // 2 for v in x):
            kept.append((vec_id, x, label))
    if not kept:
        return []
    ids = sorted({k[0] for k in kept}, key=lambda i: (i is None, i or 0))
    length = len(min(k[1] for k in kept if k[0] == ids[0]))
    kept = [k for k in kept if len(k[1]) == length]
    ids = [i for i in ids if any(k[0] == i for k in kept)][:entries]
    width = -(-length // parts)

    def cut(x):
        x = x + [0] * (parts * width - length)
        return [x[p * width : (p + 1) * width] for p in range(parts)]

    books = list(zip(*(cut(min(k[1] for k in kept if k[0] == i)) for i in ids)))
    books = [[list(e) for e in b] for b in books]

    def assign():
        found = []
        for _, x, _ in kept:
            each = [[sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]] for p, part in enumerate(cut(x))]
            found.append([(d.index(min(d)), min(d)) for d in each])
        return found

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(k[1])[p] for k, f in zip(kept, found) if f[p][0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    errors = [sum(d for _, d in f) for f in found]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [
        (k[0], "".join(f"{n:02x}" for n, _ in f), e, sum(o for o, m in zip(errors, kept) if m[2] == k[2]), digest)
        for k, f, e in zip(kept, found, errors)
    ]


def same(df, rows, **kinds):
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(plain(rows, **kinds), key=str)


def test_codes_of_random_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(0, 0.3, 32).tolist(), int(i) % 3) for i in rng.permutation(150)]
    rows += [(500, [1e5] * 31 + [-1e5], None), (501, [3e4] * 32, None), (502, [-7.25] * 32, 2)]
    rows += [(-1, None, 1), (-2, [None] + [0.0] * 31, 1), (-3, [math.nan] * 32, 1), (-4, [math.inf] * 32, 1), (-5, [1e300] * 32, 1)]
    same(codes.compress_vectors(vectors_of(spark, rows).repartition(4)), rows)


def test_ties_repeated_rows_and_few_vectors(spark):
    rows = [(3, [0.0] * 16, 1), (3, [0.0] * 16, 1), (2, [0.5] * 16, None), (1, [1.0, -1.0] * 8, None), (1, [-0.001] * 16, 5), (None, [2.0] * 16, 5)]
    same(codes.compress_vectors(vectors_of(spark, rows)), rows)
    only_unnamed = [(None, [1.0] * 16, None), (None, [0.0] * 16, None)]
    same(codes.compress_vectors(vectors_of(spark, only_unnamed)), only_unnamed)


def test_lengths(spark):
    uneven = [(i, [i / 7 * (j + 1) for j in range(19)], i % 2) for i in range(9)] + [(20, [1.0], 0), (21, [], 0), (22, [2.0] * 20, 0)]
    same(codes.compress_vectors(vectors_of(spark, uneven), entries=4), uneven, entries=4)
    long = [(i, [((i * j) % 11) / 4 for j in range(5000)], i) for i in range(5)]
    same(codes.compress_vectors(vectors_of(spark, long), entries=3), long, entries=3)
    empty = [(1, [], 1), (2, [], 1)]
    same(codes.compress_vectors(vectors_of(spark, empty)), empty)


def test_nothing_to_encode(spark):
    assert codes.compress_vectors(vectors_of(spark, [(1, None, 1)])).collect() == []
    assert codes.compress_vectors(vectors_of(spark, [(1, [1.0], 1)]).where("false")).collect() == []
