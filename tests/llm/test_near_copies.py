import random

import numpy as np
import pytest

from fleetlens.llm import jaccard
from fleetlens.llm.links import components


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = [find(i) if sets[i] else None for i in range(len(rows))]
    return sets, groups


@pytest.fixture(scope="module")
def rows(prose):
    """Families of near copies with chains, equal texts, a line that all share, short and empty texts."""
    rng, out = random.Random(5), []
    line = prose(12, 99)
    for family in range(6):
        base = prose(60 + 25 * family, family) + line
        for _ in range(7):
            out.append(" ".join(base))
            base = [w if rng.random() > 0.006 else f"x{rng.random()}" for w in base] + [f"y{rng.random()}"] * rng.randrange(2)
    out += [" ".join(prose(80, 50 + i) + line) for i in range(10)]
    for family in range(3):  # long texts, on both sides of a power of two
        base = prose(1000 + 30 * family, 200 + family)
        out += [" ".join(base), " ".join([*base[:300], "zz", *base[301:]]), " ".join(base[: 900 + 10 * family])]
    out += ["One two", "one TWO", "one two three", "", "  \n", None, None, "a", out[0], out[0], "école É", "École É", "x " * 3000]
    rng.shuffle(out)
    return [(100 - i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_groups(docs_of, rows, size, percent):
    sets, groups = brute(rows, size, percent)
    least = {}
    for (i, _), g in zip(rows, groups):
        least[g] = min(least.get(g, i), i)
    expected = sorted((i, len(s), least[g] if g is not None else i) for (i, _), s, g in zip(rows, sets, groups))
    got = jaccard.group_documents(docs_of(*rows), size, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == expected


def test_one_of_each_stays(docs_of, rows):
    _, groups = brute(rows, 5, 80)
    least = {}
    for (i, _), g in zip(rows, groups):
        least[g] = min(least.get(g, i), i)
    stay = sorted(i for (i, _), g in zip(rows, groups) if g is None or least[g] == i)
    repeated = rows + rows[:20]  # rows repeated as they are
    got = jaccard.keep_one_of_each(docs_of(*repeated))
    again = [i for i, t in rows[:20] if not (t or "").split()]  # those are in no group
    assert sorted(r.doc_id for r in got.collect()) == sorted(stay + again)
    assert got.columns == docs_of(*rows).columns


def test_rows_without_id(docs_of, prose):
    text = " ".join(prose(50))
    got = jaccard.group_documents(docs_of((None, text), (3, text), (None, "alone here"), (None, None)))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(None, 47, 3), (3, 47, 3), (None, 1, None), (None, 0, None)]))
    kept = jaccard.keep_one_of_each(docs_of((None, text), (3, text), (None, "alone here"), (None, None)))
    assert sorted(str(r.text) for r in kept.collect()) == sorted([text, "alone here", "None"]) and kept.where("doc_id = 3").count() == 1


def test_empty(docs_of):
    assert jaccard.group_documents(docs_of().where("false")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_that_share_their_high_bits():
    """They are neither taken for one another between long sets nor counted as shared inside one."""
    long = np.arange(20_000, dtype=np.uint64) << np.uint64(24)
    (n, x), (m, y) = jaccard.unpack(jaccard.pack(long), jaccard.pack(long + np.uint64(1)))
    assert (n, m, len(np.intersect1d(x, y))) == (20_000, 20_000, 0)
    twice, other = np.array([5 << 24, (5 << 24) + 1, 9 << 24], np.uint64), np.array([7 << 24, 8 << 24], np.uint64)
    (n, x), (m, y) = jaccard.unpack(jaccard.pack(twice), jaccard.pack(other))
    assert (n, m, len(np.intersect1d(x, y))) == (3, 2, 0)
