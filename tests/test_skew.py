"""Joins with a hot key and NULL keys give the rows of a plain join."""

import pytest

from fleetlens.operators import skew
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sides(spark):
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 40)
    fact = spark.range(2000).select(F.col("id").alias("row"), key.cast("long").alias("k"))
    dim = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    return fact, dim


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("join", [skew.join_unique, skew.join_checked])
def test_same_rows(sides, how, join):
    fact, dim = sides
    got = join(fact, dim, ["k"], how, ["row"])
    want = fact.join(dim, "k", how).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_hot_keys_are_few(sides):
    fact, _ = sides
    hot = {r._hot_k: r._shares for r in skew.hot_keys(fact, ["k"], 8).collect()}
    assert set(hot) == {7, None}
    assert hot[7] >= 3


def test_hot_key_is_spread(sides):
    fact, dim = sides
    plan = skew.join_unique(fact, dim, ["k"], "inner", ["row"])._jdf.queryExecution().toString()
    assert "_share" in plan


def test_size_check(sides, monkeypatch):
    fact, dim = sides
    assert skew.fits_broadcast(dim)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 10)
    assert not skew.fits_broadcast(dim)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 10**6)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 100)
    assert not skew.fits_broadcast(dim)


def test_empty_sides(sides):
    fact, dim = sides
    nothing = fact.where("row < 0")
    assert skew.join_unique(nothing, dim, ["k"], "inner", ["row"]).count() == 0
    assert skew.join_unique(fact, dim.where("v < 0"), ["k"], "left", ["row"]).count() == 2000


def test_no_pass_where_nothing_can_be_spread(sides, monkeypatch):
    fact, dim = sides
    monkeypatch.setattr(skew, "hot_keys", lambda *a: pytest.fail("counted keys"))
    assert skew.join_unique(fact, dim, ["k"], "inner", ["k"]).count() == fact.join(dim, "k").count()
