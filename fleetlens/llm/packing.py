"""Packing of token sequences by a non-negative least-squares plan over the length histogram.

A document is cut into full sequences and a rest. Shallow combinations of rest lengths that fill
a sequence exactly are enumerated; how often to repeat each follows from a least-squares fit to
the histogram of rests, rounded to what is there. Rests that the plan leaves over are laid
end to end and cut at the sequence length. Only the histogram, with one row per length below
the sequence length, reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.word_ids import WordEncoder, portions
from fleetlens.llm.workers import tidy
from fleetlens.operators.ordering import cut_pieces, number_within, running_sum
from fleetlens.sources.storage import stored

LENGTH = 2048
END_ID = 1
#: In combinations of three, the middle length takes such a share of what the longest leaves.
SHARES = (2, 3, 4, 6)
ROUNDS = 400


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """row (unique), doc_id, doc_tokens and ids (16-bit, without the closing id) of every text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.at(path)
        for batch in batches:
            ids = pa.concat_arrays([encoder.encode(some) for some in portions(batch["text"])])
            tokens = pc.add(pc.divide(pc.binary_length(ids), 2), 1).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], tokens, ids], ["doc_id", "doc_tokens", "ids"])
            pa.default_memory_pool().release_unused()

    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = coded.mapInArrow(tidy(encode), "doc_id long, doc_tokens long, ids binary")
    return stored(coded.withColumn("row", F.monotonically_increasing_id()), "tokens")


def combinations(length: int) -> list[tuple[int, ...]]:
    """Two or three lengths that add up to ``length``, in falling order."""
    found = {(length - a, a) for a in range(1, length // 2 + 1)}
    for longest in range(length - 2, 0, -1):
        left = length - longest
        found |= {tuple(sorted((longest, left // s, left - left // s), reverse=True)) for s in SHARES if left // s}
    return sorted(found)


def fit_repeats(histogram: np.ndarray, combos: list[tuple[int, ...]]) -> np.ndarray:
    """Non-negative repeats whose total use of each length comes nearest to the histogram.

    Minimises the squared differences by multiplicative updates, which keep every value
    non-negative and never move away from the optimum.
    """
    part = np.array([i for i, c in enumerate(combos) for _ in c])
    of = np.array([x for c in combos for x in c])
    size = len(histogram)
    goal = np.bincount(part, histogram[of], len(combos))
    x = np.minimum.reduceat(histogram[of], np.flatnonzero(np.r_[True, part[1:] != part[:-1]])) / 4.0
    for _ in range(ROUNDS):
        use = np.bincount(of, x[part], size)
        x = x * goal / np.maximum(np.bincount(part, use[of], len(combos)), 1e-12)
    return x


def round_repeats(histogram: np.ndarray, combos: list[tuple[int, ...]], x: np.ndarray) -> list[tuple[int, int]]:
    """(combination, times) with whole times that use no length more often than it occurs."""
    left, order = histogram.astype(np.int64).copy(), np.argsort(-x, kind="stable")
    times = np.zeros(len(combos), np.int64)
    for rounded in (True, False):  # first as fitted, then whatever else fits exactly
        for j in order:
            lengths, counts = np.unique(combos[j], return_counts=True)
            most = int((left[lengths] // counts).min())
            take = min(most, int(x[j] + 0.5)) if rounded else most
            left[lengths] -= take * counts
            times[j] += take
    return [(int(j), int(times[j])) for j in np.flatnonzero(times)]


def plan_slots(histogram: np.ndarray, length: int) -> tuple[int, np.ndarray]:
    """Number of planned sequences, and rows (rest length, first rank, until rank, sequence, offset)."""
    combos = combinations(length)
    taken, slots, sequence = np.zeros(length, np.int64), [], 0
    if histogram.any():
        for j, times in round_repeats(histogram, combos, fit_repeats(histogram.astype(float), combos)):
            offset = 0
            for part in combos[j]:
                slots.append((part, taken[part], taken[part] + times, sequence, offset))
                taken[part] += times
                offset += part
            sequence += times
    return sequence, np.array(sorted(slots), np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) in sequences of at most ``length`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids
    (array). Every
    document ends with ``END_ID``; a null or empty text consists of that id alone. Every sequence
    but the last of all is full. Repeated rows, and rows without id, are packed like any other. An
    empty table gives an empty result. Other columns are not read.
    """
    tokens = encode_documents(docs, path)
    facts = tokens.select("row", "doc_tokens", F.floor(F.col("doc_tokens") / length).alias("full"), (F.col("doc_tokens") % length).alias("rest"))
    # At most ``length`` rows.
    counts = dict(facts.groupBy("rest").count().collect())
    histogram = np.array([counts.get(i, 0) if i else 0 for i in range(length)], np.int64)
    planned, slots = plan_slots(histogram, length)
    all_full = facts.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]

    pieces = cut_pieces(facts.withColumn("all", F.lit(0)), ["rest", "row"])
    ranked = number_within(pieces, ["rest"], "rank").select("row", "rank")
    placed = running_sum(pieces, ["all"], {"full_before": F.col("full")}, including=False)
    placed = placed.join(ranked, "row")

    starts = slots[:, 0] * (1 << 40) + slots[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, rank = batch["rest"].to_numpy(), batch["rank"].to_numpy() - 1
            at = np.searchsorted(starts, rest * (1 << 40) + rank, "right") - 1
            hit = slots[np.maximum(at, 0)] if len(slots) else np.zeros((len(rest), 5), np.int64)
            fits = (at >= 0) & (hit[:, 0] == rest) & (rank < hit[:, 2])
            sequence = np.where(fits, hit[:, 3] + rank - hit[:, 1], -1)
            columns = [batch["row"], batch["rest"], batch["full"], batch["full_before"], pa.array(sequence), pa.array(np.where(fits, hit[:, 4], 0))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "rest", "full", "full_before", "sequence", "at"])

    kinds = "row long, rest long, full long, full_before long, sequence long, at long"
    chosen = stored(placed.select("row", "rest", "full", "full_before", "rank").mapInArrow(tidy(assign), kinds), "chosen")
    left = chosen.where("sequence < 0 AND rest > 0").select("row", "rest", F.lit(0).alias("all"))
    stream = running_sum(cut_pieces(left, ["rest", "row"]), ["all"], {"stream": F.col("rest")}, including=False)
    plan = chosen.join(stream.select("row", "stream"), "row", "left")
    after_plan, after_full = planned, planned + all_full

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in PIECE_COLUMNS]
            lists: list[np.ndarray] = []
            for r in batch.to_pylist():
                raw = np.frombuffer(r["ids"], "<u2")
                ids = np.empty(len(raw) + 1, "<u4")
                ids[:-1], ids[-1] = raw, END_ID
                for start, size, sequence, offset in _pieces(r, length, after_plan, after_full):
                    own = ids[start : start + size]
                    facts = (r["doc_id"], start, size, zlib.crc32(own.tobytes()), len(ids), sequence, offset)
                    for column, value in zip(out, facts, strict=True):
                        column.append(value)
                    if with_ids:
                        lists.append(own)
            columns = [pa.array(c, pa.int64()) for c in out]
            if with_ids:
                ends, flat = np.cumsum([0, *map(len, lists)]), np.concatenate([np.zeros(0, "<u4"), *lists])
                columns.append(pa.ListArray.from_arrays(ends.astype(np.int32), flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = tokens.select("row", "doc_id", "ids").join(plan, "row").drop("row")
    names = PIECE_COLUMNS + ["ids"] * with_ids
    return joined.mapInArrow(tidy(cut), ", ".join(f"`{c}` {'array<int>' if c == 'ids' else 'long'}" for c in names))


PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pieces(row: dict, length: int, after_plan: int, after_full: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of one document."""
    for i in range(row["full"]):
        yield i * length, length, after_plan + row["full_before"] + i, 0
    start, rest = row["full"] * length, row["rest"]
    if rest and row["sequence"] >= 0:
        yield start, rest, row["sequence"], row["at"]
    elif rest:
        offset, sequence = row["stream"] % length, after_full + row["stream"] // length
        first = min(rest, length - offset)
        yield start, first, sequence, offset
        if first < rest:
            yield start + first, rest - first, sequence + 1, 0
