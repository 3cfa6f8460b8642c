"""Order-dependent helpers against plain Python, with keys that span several pieces."""

import random

import pytest

from fleetlens.operators.ordering import (
    PIECE,
    assign_ids,
    cut_pieces,
    number_within,
    plain,
    running_last,
    running_sum,
)
from pyspark.sql import functions as F


def make_rows(seed):
    rng = random.Random(seed)
    keys = ["hot"] * 12 + ["a", "b", "c", None]
    rows = [(rng.choice(keys), i, rng.choice([None, None, i])) for i in range(300)]
    rng.shuffle(rows)
    return rows


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.fixture(scope="module", params=[1, 2])
def pieces(spark, request):
    rows = make_rows(request.param)
    df = spark.createDataFrame(rows, "k string, i long, v long")
    cut = cut_pieces(df, ["k", "i"], 7)
    assert cut.select(PIECE).distinct().count() > 4
    return rows, cut


def test_running_sum(pieces):
    rows, cut = pieces
    got = {r.i: (r.upto, r.before) for r in running_sum(running_sum(cut, ["k"], {"upto": F.col("v")}), ["k"], {"before": F.col("v")}, including=False).collect()}
    for group in by_key(rows).values():
        total = 0
        for _, i, v in group:
            assert got[i] == (total + (v or 0), total)
            total += v or 0


@pytest.mark.parametrize("backwards", [False, True])
def test_running_last(pieces, backwards):
    rows, cut = pieces
    got = {r.i: r.seen for r in running_last(cut, ["k"], {"seen": F.col("v")}, backwards=backwards).collect()}
    for group in by_key(rows).values():
        seen = None
        for _, i, v in reversed(group) if backwards else group:
            assert got[i] == seen
            seen = v if v is not None else seen


def test_running_last_including(pieces):
    rows, cut = pieces
    got = {r.i: r.seen for r in running_last(cut, ["k"], {"seen": F.col("v")}, including=True).collect()}
    for group in by_key(rows).values():
        seen = None
        for _, i, v in group:
            seen = v if v is not None else seen
            assert got[i] == seen


def test_subset_keeps_its_order(pieces):
    rows, cut = pieces
    got = {r.i: r.seen for r in running_last(cut.where("i % 5 = 0"), ["k"], {"seen": F.col("i")}).collect()}
    for group in by_key([r for r in rows if r[1] % 5 == 0]).values():
        seen = None
        for _, i, _v in group:
            assert got[i] == seen
            seen = i


def test_number_within(pieces):
    rows, cut = pieces
    got = {r.i: r.n for r in plain(number_within(cut, ["k"], "n")).collect()}
    for group in by_key(rows).values():
        assert [got[i] for _, i, _v in group] == list(range(1, len(group) + 1))


def test_assign_ids_are_dense_and_ordered(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 3).alias("x"))
    rows = sorted((r.x, r.k, r.n) for r in assign_ids(df, ["x", "k"], 11, "n", 6).collect())
    assert [n for _, _, n in rows] == list(range(11, 511))


def test_assign_ids_of_nothing(spark):
    assert assign_ids(spark.range(0), ["id"], 1, "n").count() == 0
