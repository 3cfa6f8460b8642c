"""Nearest neighbours by inner product, with cross-polytope hashing and exact reranking.

Vectors are scaled by the largest norm and get one more component that makes them unit vectors,
so that the largest inner product is the smallest angle. Three rounds of random signs and fast
Hadamard transforms rotate them; the axis they then lie nearest to, with its sign, is their bucket
in a table. A query looks into its ``probes`` nearest axes in each of ``tables`` tables. The
vectors of a bucket meet its queries in blocks of bounded size, where products are exact and only
the best of a query go on. Equal vectors are searched once. A query that finds too few is compared
with all vectors, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.workers import tidy
from fleetlens.sources.storage import stored

TABLES, PROBES, NEAREST = 12, 20, 20
#: Vectors, and queries, in a block.
BLOCK_ROWS = 4096
#: Scores this near to the last that counts are computed again, one by one.
SLACK = 1e-9


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-random rotation of the rows of ``x`` for a table."""
    size = 1 << (x.shape[1] - 1).bit_length()
    signs = np.random.default_rng(table).choice([-1.0, 1.0], (3, size))
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for sign in signs:
        y *= sign
        half = 1
        while half < size:
            z = y.reshape(len(y), -1, 2, half)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), size)
            half *= 2
        y /= np.sqrt(size)
    return y


def nearest_axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Numbers of the nearest signed axes of each row, as many as ``probes``."""
    y = rotated(x, table)
    signed = np.concatenate([y, -y], axis=1)
    probes = min(probes, signed.shape[1])
    return np.argpartition(-signed, probes - 1, axis=1)[:, :probes]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64)[column.offsets[0].as_py() :][: column.offsets[-1].as_py()].reshape(len(column), -1)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, asked: Column, k: int = NEAREST, tables: int = TABLES, probes: int = PROBES
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row that is ``asked``.

    ``vectors`` holds vec_id and embedding. Ties go to the smaller vec_id. Rows without id, and
    vectors that are null or zero or hold null or non-finite components take no part. Vectors
    of different lengths never meet. Equal vectors of different ids are all candidates, and rows of
    the query's own id are none. Repeated rows count each, an empty table gives an empty result,
    other columns are not read.
    """
    most = k + 1  # with the query itself
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), asked.alias("asked"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("v"))).withColumn("key", F.xxhash64("v"))
    # The smallest ids of each vector are enough; Spark cuts the groups down before it shuffles them.
    line = Window.partitionBy("key", "v").orderBy("vec_id")
    first = rows.withColumn("place", F.row_number().over(line)).where(F.col("place") <= most)
    classes = first.groupBy("key", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "key", "v", "members"), "vectors")
    queries = rows.where("asked").join(classes.select("key", "v", "cid"), ["key", "v"]).select("vec_id", F.col("cid").alias("qid"))
    queries = stored(queries, "queries")
    asking = classes.join(queries.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi")
    asking = stored(asking.select("cid", "v"), "asking")

    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    largest = classes.agg(F.coalesce(F.max(size), F.lit(1.0))).first()[0]
    least = classes.select("cid", "v", F.col("members")[0].alias("first"))
    found = _meet(_placed(least, tables, 1, largest), _placed(asking.withColumn("first", F.lit(None).cast("long")), tables, probes, None), most)
    best = _best(found, classes, most)
    best = stored(best, "best")

    # Fewer than wanted, though there are more of that length: compare with all.
    totals = classes.groupBy(F.size("v").alias("dim")).agg(F.sum(F.size("members")).alias("all"))
    counted = asking.withColumn("dim", F.size("v")).join(totals, "dim").join(best.withColumnRenamed("qid", "cid"), "cid", "left")
    short = counted.where(F.coalesce(F.size("list"), F.lit(0)) < F.least(F.lit(most), "all")).select("cid", "v")
    short = stored(short, "short")
    if not short.isEmpty():
        place = [F.size("v").alias("dim"), F.lit(-1).alias("table"), F.lit(-1).alias("axis")]
        everything = _meet(least.select("*", *place), short.select("*", F.lit(None).cast("long").alias("first"), *place), most)
        more = _best(everything, classes, most)
        best = best.join(short.select(F.col("cid").alias("qid")), "qid", "left_anti").unionByName(more)

    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = queries.withColumnRenamed("vec_id", "query_id").join(best, "qid").select("query_id", F.posexplode(others).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")


def _placed(vectors: DataFrame, tables: int, probes: int, largest: float | None) -> DataFrame:
    """Each of ``vectors`` (cid, v, first) in its ``probes`` buckets of every table: dim, table, axis.

    ``largest`` is the norm that data vectors are scaled by; queries have none, they are made unit vectors.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    names = [*vectors.columns, "dim", "table", "axis"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["v"].value_lengths().to_numpy()
            for dim in np.unique(dims):
                some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = _matrix(some["v"])
                norm = np.linalg.norm(x, axis=1)
                unit = x / (largest or norm[:, None])
                last = np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2)) if largest else np.zeros(len(x))
                unit = np.column_stack([unit, last])
                for table in range(tables):
                    axes = nearest_axes(unit, table, probes)
                    own = some.take(pa.array(np.repeat(np.arange(len(x)), axes.shape[1])))
                    where = [np.full(axes.size, dim, np.int32), np.full(axes.size, table, np.int32), axes.ravel().astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, where)], names)

    return vectors.mapInArrow(tidy(place), f"{kinds}, dim int, table int, axis int")


def _meet(data: DataFrame, asking: DataFrame, most: int) -> DataFrame:
    """qid, cid, first, score of the best of every query in every bucket, block by block."""
    bucket = ["dim", "table", "axis"]
    data, asking = stored(data, "data"), stored(asking, "asked")

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))

    # One row per bucket: at most tables times axes of them for each vector length.
    sizes = stored(blocks(data, "rows").join(blocks(asking, "asks"), bucket), "buckets")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        own_block = F.pmod(F.xxhash64("cid"), F.col(own).cast("long")).cast("int")
        all_blocks = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return side.join(sizes, bucket).select(*bucket, "cid", "v", "first", own_block.alias(own), all_blocks.alias(other))

    def compare(x: pa.Table, q: pa.Table) -> pa.Table:
        names = ["qid", "cid", "first", "score"]
        if not len(x) or not len(q):
            return pa.table({"qid": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "first": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        xs, qs = _matrix(x["v"].combine_chunks()), _matrix(q["v"].combine_chunks())
        scores = qs @ xs.T
        if len(xs) > most:
            last = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
            at, of = np.nonzero(scores >= (last - SLACK * np.maximum(1, np.abs(last)))[:, None])
        else:
            at, of = (a.ravel() for a in np.indices(scores.shape))
        # The same sum in the same order wherever the two vectors meet.
        exact = np.concatenate([(qs[at[i : i + 4096]] * xs[of[i : i + 4096]]).sum(axis=1) for i in range(0, len(at), 4096)])
        first = x["first"].to_numpy()[of]
        order = np.lexsort([first, -exact, at])
        at, of, exact, first = at[order], of[order], exact[order], first[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < most
        columns = [q["cid"].to_numpy()[at[keep]], x["cid"].to_numpy()[of[keep]], first[keep], exact[keep]]
        return pa.table(dict(zip(names, columns, strict=True)))

    cell = [*bucket, "rows", "asks"]
    left = dealt(data, "rows", "asks").select(*cell, "cid", "v", "first").groupBy(*cell)
    right = dealt(asking, "asks", "rows").select(*cell, "cid", "v").groupBy(*cell)
    return left.cogroup(right).applyInArrow(compare, "qid long, cid long, first long, score double")


def _best(found: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """qid with the list of its best (score, vec_id), best first, at most ``most``."""
    once = found.groupBy("qid", "cid").agg(F.min("first").alias("first"), F.max("score").alias("score"))
    line = Window.partitionBy("qid").orderBy(F.col("score").desc(), "first")
    top = once.withColumn("place", F.row_number().over(line)).where(F.col("place") <= most)
    each = top.join(classes.select("cid", "members"), "cid").select("qid", "score", F.explode("members").alias("vec_id"))
    entry = F.struct((-F.col("score")).alias("minus"), "vec_id", "score")
    listed = each.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, most).alias("list"))
    return listed.select("qid", F.transform("list", lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))).alias("list"))
