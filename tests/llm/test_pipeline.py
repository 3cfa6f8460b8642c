"""The stages against plain Python over the same documents."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlens.llm import packing, surrogates
from fleetlens.sources.storage import stored
from tests.llm.test_near_copies import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = spark.createDataFrame([(9001, "12 34 --", "en", "x", 8), (9002, None, None, None, None), (9003, "日本語", None, "x", 3)], docs.schema)
    docs = docs.unionByName(more)
    columns, steps = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL))
        steps.append(docs)
    named, apart, cut, hidden, packed = ([r.asDict() for r in s.collect()] for s in steps)
    assert all(s.columns == columns for s in steps[:4])

    raw = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert {r["doc_id"] for r in named} == {r["doc_id"] for r in raw}
    assert sum(r["lang"] == o["lang"] for r, o in zip(sorted(named, key=lambda r: r["doc_id"]), sorted(raw, key=lambda r: r["doc_id"]))) >= 0.97 * len(raw)

    rows = [(r["doc_id"], r["text"]) for r in named]
    _, groups = brute(rows, 5, 80)
    least = {}
    for (i, _), g in zip(rows, groups):
        least[g] = min(least.get(g, i), i)
    assert sorted(r["doc_id"] for r in apart) == sorted(least.values())

    first = {}
    for r in sorted(cut, key=lambda r: r["doc_id"]):
        words = r["text"].lower().split()
        for j in range(len(words) - 49):
            assert first.setdefault(tuple(words[j : j + 50]), r["doc_id"]) == r["doc_id"]
    whole = {r["doc_id"]: r["text"] for r in apart}
    assert all(r["n_chars"] == len(r["text"]) for r in cut if r["text"] != whole[r["doc_id"]])

    before = {r["doc_id"]: r["text"] for r in cut}
    for r in hidden:
        old = surrogates.mentions(before[r["doc_id"]])
        assert len(surrogates.mentions(r["text"])) == len(old) and r["n_chars"] == len(r["text"])
        assert not any(before[r["doc_id"]][a:b] in r["text"] for a, b, _, _ in old)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in hidden:
        own = sorted((p for p in packed if p["doc_id"] == r["doc_id"]), key=lambda p: p["start"])
        assert [x for p in own for x in p["ids"]] == [*tokenizer.encode(r["text"], add_special_tokens=False).ids, packing.END_ID]
    fills = np.bincount([p["sequence_id"] for p in packed], [p["length"] for p in packed])
    assert fills.max() == 2048 and (fills < 2048).sum() <= 1
