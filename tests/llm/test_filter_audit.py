"""Orders of filters, one at a time, against the counts on lattice edges."""

import math
import re
from itertools import permutations

import numpy as np

from fleetlens.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, failed int, n int, digest string, good boolean, cells int"
PLENTY = " ".join(f"w{i}" for i in range(200))


def fails(row, rows):
    doc_id, text = row[0], row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    conditions = [
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        bool(re.search("[#$%&*|]", text)),
        doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in rows),
    ]
    return {f for f, c in zip("ABCDE", conditions) if c}


def one_by_one(rows, labels):
    failed = [fails(r, rows) for r in rows]
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    found, shares = {}, {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left, before = mine, set()
            for step, f in enumerate(order, 1):
                out = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                redundant = sum(f in m[1] and bool(m[1] & before) for m in mine)
                facts = (len(left), len(out), redundant, sum(m[1] == {f} for m in mine), sum(m[0] in good for m in out), sum(m[0] in toxic for m in out))
                found[part, "".join(order), step] = facts
                shares[part, f] = shares.get((part, f), 0) + len(out)
                before.add(f)
    return {(*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "p", 1, 2, "d", True, 3) for r in rows], SCHEMA)
    marks = spark.createDataFrame([(*x, "p", 7) for x in labels], "doc_id long, quality int, toxic int, part string, n int")
    got = [tuple(r) for r in filter_audit.audit_filters(docs, marks).collect()]
    assert len(got) == len(set(got)) and set(got) == one_by_one(rows, labels)


def test_paths_are_counted():
    lattice = filter_audit.Lattice()
    applied = [bin(s).count("1") for s in lattice.before.tolist()]
    assert lattice.weight.tolist() == [math.factorial(k) * math.factorial(4 - k) for k in applied]
    assert len(lattice.orders) == 600 and all(lattice.weight[lattice.bit == b].sum() == 120 for b in (1, 2, 4, 8, 16))


def test_all_orders(spark):
    rng = np.random.default_rng(0)
    texts = [PLENTY, PLENTY + " $", PLENTY.upper(), "w " * 300, "W# " * 250, "short", "Short", "|", "", None, "a\x0bb\x1cc\x85d " * 60, PLENTY + "\n" + PLENTY]
    rows = [(int(i), texts[rng.integers(len(texts))], [None, "", "x", "y"][rng.integers(4)]) for i in rng.permutation(120)]
    labels = [(int(i), [0, 1, None][rng.integers(3)], [0, 1, None][rng.integers(3)]) for i in rng.integers(0, 140, 90)]
    check(spark, rows, [*labels, (None, 1, 1)])


def test_odd_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "a b", "y"), (2, "a b", "x"), (None, "a b", "x"), (None, "a b", "x"), (1, None, "x"), (4, "", None)]
    rows += [(5, "very long " * 100_000, "z"), (6, "very long " * 100_000, "z"), (7, "É" * 49 + "A", "z"), (8, "É" * 50 + "A", "z")]
    check(spark, rows, [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1)])
    check(spark, rows[:1], [])


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
