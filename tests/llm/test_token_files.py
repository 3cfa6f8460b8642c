"""Huffman-coded token files: best codes, blocks, checkpoints, and documents read back."""

import heapq
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import token_files as files
from fleetlens.llm.queries import QUERIES
from fleetlens.sources.storage import new_path

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "Word, word! (word) WORD;", "a\x1cb \x85x  é ́q don't İst <0x41>\n\t", "日本語 😀 1234 12.5 x.!?)", "<|endoftext|> 's it's y'", "ÉCOLE: École,; ß"]


def unlimited(counts):
    """Bits of all symbols under a best code without a limit."""
    heap, total = [c for c in counts if c], 0
    heapq.heapify(heap)
    if len(heap) == 1:
        return heap[0]
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@pytest.mark.parametrize("n", [1, 2, 3, 17, 500])
def test_lengths_are_best(n):
    rng = np.random.default_rng(n)
    for counts in (rng.integers(1, 1000, n), rng.integers(0, 3, n) + (np.arange(n) == 0), np.ones(n, np.int64)):
        bits = files.code_lengths(counts)
        assert int((bits * counts).sum()) == unlimited(counts.tolist())
        assert ((bits > 0) == (counts > 0)).all()


@pytest.mark.parametrize("longest", [3, 4, 5])
def test_lengths_are_best_under_a_limit(longest):
    rng = np.random.default_rng(longest)
    for _ in range(8):
        counts = (2.0 ** rng.uniform(0, 12, 6)).astype(np.int64)
        fits = [x for x in itertools.product(range(1, longest + 1), repeat=6) if sum(2.0**-b for b in x) <= 1]
        assert int((files.code_lengths(counts, longest) * counts).sum()) == min(int(np.dot(x, counts)) for x in fits)


def test_too_many_symbols_for_the_limit():
    with pytest.raises(ValueError, match="do not fit"):
        files.code_lengths(np.ones(9, np.int64), 3)
    assert (files.code_lengths(np.ones(8, np.int64), 3) == 3).all()


def test_codes_are_canonical_and_free_of_prefixes():
    bits = files.code_lengths(np.array([5, 0, 9, 1, 1, 30]))
    code = files.Code(bits)
    texts = {i: format(int(code.codes[i]), f"0{bits[i]}b") for i in np.flatnonzero(bits)}
    in_order = sorted(texts, key=lambda i: (bits[i], i))
    assert [texts[i] for i in in_order] == sorted(texts.values())
    assert not any(a != b and texts[b].startswith(texts[a]) for a in texts for b in texts)


@pytest.mark.parametrize("symbols, step", [(1, 4), (2, 1), (40, 7), (30_000, 256)])
def test_blocks_give_back_any_run(symbols, step):
    rng = np.random.default_rng(symbols)
    weights = 1.0 / np.arange(1, symbols + 1) ** 2
    ids = rng.choice(symbols, 3000, p=weights / weights.sum()).astype(np.uint16)
    code = files.Code(files.code_lengths(np.bincount(ids, minlength=files.ALPHABET)))
    doc_ids, lists = [7, None, -3, 8], [ids[:100], ids[:0], ids[100:101], ids[101:]]
    data = files.write_block(code, doc_ids, lists, step)
    block = files.Block(code, data)
    assert [d if k else None for d, k in zip(block.doc_ids.tolist(), block.known.tolist())] == doc_ids
    assert block.sizes.tolist() == [100, 0, 1, 2899] and (block.ids() == ids).all()
    assert len(block.checks) == -(-3000 // step)
    for first, last in [(0, 1), (0, 0), (99, 101), (step, 2 * step), (2999, None), (3000, None), (1, 2999), (255, 513)]:
        assert (block.ids(first, last) == ids[first:last]).all()
    with pytest.raises(ValueError, match="damaged"):
        files.Block(code, data[:-12] + bytes([data[-12] ^ 1]) + data[-11:])
    with pytest.raises(ValueError, match="not a block"):
        files.Block(files.Code(np.array([1, 1])), data)


def expected(rows):
    """(doc_id, start, n_tokens, crc) of (doc_id, text) by the tokenizer itself."""
    tokenizer, found = Tokenizer.from_file(WORDS), []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        found.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    starts = itertools.accumulate([0, *(r[1] for r in found)])
    return [(r[0], s, *r[1:]) for s, r in zip(starts, found)]


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_query_against_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = ordered(QUERIES["op11_huffman_files"](spark, SMALL))
    assert got == [r[:4] for r in expected([tuple(d) for d in docs])]


def test_odd_tables(docs_of):
    long = "some long text, " * 60_000
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, None), (None, "no id"), (None, None), (5, ODD[2]), (5, ODD[2]), (-4, long)]
    assert ordered(files.through_files(docs_of(*rows), WORDS, with_ids=True)) == expected(rows)
    assert files.through_files(docs_of(*rows).where("false"), WORDS).collect() == []


def test_many_blocks_in_many_pieces(spark, docs_of):
    rows = [(int(i), f"text {i} " * (i % 9)) for i in np.random.default_rng(0).permutation(300)]
    folder = new_path(spark, "files")
    files.write_tokens(files.encode_documents(docs_of(*rows).repartition(5), WORDS), folder, longest=12, block_ids=40, step=5)
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.count() > 30 and blocks.select("piece").distinct().count() > 1
    assert spark.read.parquet(f"{folder}/code").selectExpr("max(bits) <= 12").first()[0]
    assert ordered(files.read_tokens(spark, folder)) == expected(rows)
