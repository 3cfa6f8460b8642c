"""Product codes of integer vectors with exact arithmetic.

Vectors become integers and are cut into parts; each part is replaced by the number of the nearest
entry of its codebook. Distances come from dot products, which a float64 matrix product gives
exactly as long as it stays below 2^53. Integers are therefore split into limbs so narrow that no
product of limbs, summed over a part, gets there; the products are put together again in int64. So
results are the same on every machine and under every cut of the rows.

Codebooks (entries x dimensions) are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.workers import Batches, tidy
from fleetlens.operators.skew import join_checked
from fleetlens.sources.storage import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: float64 holds all integers up to 2^53.
EXACT_BITS = 53
#: Rows whose products are worked out at a time.
AT_ONCE = 8192


def most_bits(length: int) -> int:
    """Bits of components with which squared distances of vectors of this length stay in int64."""
    return (61 - max(length, 1).bit_length()) // 2


def limb_width(length: int) -> int:
    """Bits per limb with which dot products of ``length`` limbs stay below 2^53."""
    return (EXACT_BITS - max(length, 1).bit_length()) // 2


def limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """float64 limbs, lowest first; all but the last, which has the sign, lie in [0, 2^width)."""
    found = []
    while x.size and max(int(x.max()), -int(x.min())) >= 1 << width:
        found.append((x & ((1 << width) - 1)).astype(np.float64))
        x = x >> width
    return [*found, x.astype(np.float64)]


def exact_products(left: np.ndarray, right: np.ndarray, width: int | None = None) -> np.ndarray:
    """``left @ right.T`` of int64 matrices, by float64 products of their limbs."""
    width = width or limb_width(left.shape[1])
    rights = [limb.T for limb in limbs(right, width)]
    total = np.zeros((len(left), len(right)), np.int64)
    for i, a in enumerate(limbs(left, width)):
        for j, b in enumerate(rights):
            total += (a @ b).astype(np.int64) << (width * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry of ``book`` to each row (the first, if several), and the squared distance."""
    from_entry = (book * book).sum(axis=1) - 2 * exact_products(x, book)
    number = from_entry.argmin(axis=1)
    return number, (x * x).sum(axis=1) + from_entry[np.arange(len(x)), number]


def in_parts(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows cut into equal parts, with zeros behind the last component where they do not come out even."""
    padded = np.zeros((len(x), -(-x.shape[1] // parts) * parts), np.int64)
    padded[:, : x.shape[1]] = x
    return padded.reshape(len(x), parts, padded.shape[1] // parts)


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label (as text) and x: floor(scale * component), of every vector that takes part."""

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["vector"]
            there = column.is_valid()
            batch, column = batch.filter(there), column.filter(there)
            values = np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(scale))  # null: NaN
            sizes = column.value_lengths().to_numpy()
            ends = np.append(0, np.cumsum(sizes))
            limits = np.array([2.0 ** most_bits(n) for n in range(int(sizes.max(initial=0)) + 1)])
            fits = np.abs(values) < np.repeat(limits[sizes], sizes)
            bad = np.append(0, np.cumsum(~fits))
            keep = pa.array(bad[ends[1:]] == bad[ends[:-1]])
            whole = pa.ListArray.from_arrays(ends.astype(np.int32), np.where(fits, values, 0).astype(np.int32))
            columns = [batch["vec_id"], batch["label"], whole]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "x"]).filter(keep)

    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    return rows.mapInArrow(tidy(floors), "vec_id long, label string, x array<int>")


def first_entries(rows: DataFrame, entries: int, dimension: int) -> np.ndarray:
    """The vectors of the smallest ids, ascending; of an id with several vectors the smallest one."""
    # At most ``entries`` rows from here on.
    ids = rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    ids = ids.withColumnRenamed("vec_id", "of")
    chosen = rows.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("of"))).groupBy("vec_id").agg(F.min("x").alias("x"))
    found = [r.x for r in chosen.orderBy(F.col("vec_id").asc_nulls_last()).collect()]
    return np.array(found, np.int64).reshape(len(found), dimension)


def _on_rows(dimension: int, books: np.ndarray, use: Callable) -> Callable[[Batches], Batches]:
    """A function on batches that gives ``use`` each slice of rows with its numbers and distances."""

    def each(batches: Batches) -> Batches:
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(first, AT_ONCE)
                x = in_parts(some["x"].flatten().to_numpy().reshape(some.num_rows, dimension).astype(np.int64), books.shape[0])
                found = [nearest(x[:, p], books[p]) for p in range(books.shape[0])]
                yield from use(some, x, np.stack([n for n, _ in found], 1), np.stack([d for _, d in found], 1))
        yield from use(None, None, None, None)

    return each


def improve(rows: DataFrame, dimension: int, books: np.ndarray) -> np.ndarray:
    """Codebooks (part, entry, position) after one round over all rows; every task adds up its own first."""
    parts, entries, width = books.shape

    def add_up(batches: Batches) -> Batches:
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)

        def gather(some, x, numbers, distances) -> Batches:
            if some is not None:
                for p in range(parts):
                    np.add.at(sums[p], numbers[:, p], x[:, p])
                    counts[p] += np.bincount(numbers[:, p], minlength=entries)
                return
            used = np.flatnonzero(np.repeat(counts.ravel(), width))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(sums.ravel()[used]), pa.array(np.repeat(counts.ravel(), width)[used])], ["place", "total", "n"]
            )

        yield from _on_rows(dimension, books, gather)(batches)

    sums = rows.select("x").mapInArrow(tidy(add_up), "place long, total long, n long")
    # One row per component of the codebooks.
    found = sums.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    better = books.copy().ravel()
    for r in found:
        better[r.place] = r.total // r.n
    return better.reshape(books.shape)


def compress_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of ``vectors`` (vec_id, embedding, label).

    A null vector, or one with components that are null, not finite, or too large for exact
    distances in 64 bits (2^26 / ``scale`` at 128 components), takes no part. All have the length
    of the vector with the smallest vec_id; others take no part. If ``parts`` does not divide that
    length, the last part is filled with zeros. Codebooks begin with the vectors of the smallest
    different ids (an id with several vectors: the smallest one; rows without id come last); with
    fewer ids than ``entries`` they are shorter. Equally near entries: the first. Repeated rows are
    encoded, and weigh, each. Labels are compared as text, nulls together. An empty table gives an
    empty result. Other columns are not read.
    """
    rows = stored(integer_vectors(vectors, scale), "integers")
    first = rows.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", "x")).alias("row")).first().row
    dimension = len(first.x) if first else 0
    rows = rows.where(F.size("x") == dimension)
    books = np.ascontiguousarray(in_parts(first_entries(rows, entries, dimension), parts).transpose(1, 0, 2))
    for _ in range(rounds if first else 0):
        books = improve(rows, dimension, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def write(some, x, numbers, distances) -> Batches:
        if some is not None:
            codes = [row.tobytes().hex() for row in numbers.astype(np.uint8)]
            columns = [some["vec_id"], some["label"], pa.array(codes, pa.string()), pa.array(distances.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    coded = rows.mapInArrow(tidy(_on_rows(dimension, books, write)), "vec_id long, label string, code string, error long")
    # A null label is a key of its own.
    key = [F.coalesce("label", F.lit("")).alias("key"), F.col("label").isNull().alias("no_label")]
    coded = stored(coded.select("vec_id", *key, "code", "error"), "coded")
    by_label = coded.groupBy("key", "no_label").agg(F.sum("error").alias("label_error"))
    joined = join_checked(coded, by_label, ["key", "no_label"], "inner", ["vec_id", "code"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
