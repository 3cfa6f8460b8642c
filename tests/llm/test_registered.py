"""Every registered query of the subpackage, against its SQL twin where there is one."""

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from fleetlens.llm.queries import QUERIES
from fleetlens.llm.twins import ORACLES
from tests.checking import differences, open_duckdb

SMALL = "/root/testdata/sf0.001"


def test_names():
    names = set(entry_points.queries())
    assert {*QUERIES, "pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near copies", "repeated passages", "personal data", "packing"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    assert differences(QUERIES[name](spark, SMALL), open_duckdb(SMALL), ORACLES[name]) == []
