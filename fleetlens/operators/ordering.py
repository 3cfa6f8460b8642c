"""Row numbers, running sums and last values in key order, without one task per key.

The rows are sorted over all tasks and cut into pieces of about equal size, so a key with a third
of all rows spans many pieces. Windows then run inside (piece, key) only, and what a key carries
from one piece to the next travels in a table with one row per piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.skew import join_checked
from fleetlens.sources.storage import stored

PIECE, AT = "_piece", "_at"
# monotonically_increasing_id puts the partition above bit 33 and the row below it
_ROW_BITS = 33
# Jumps that are made one by one before all are doubled.
STEPS = 6


def cut_pieces(df: DataFrame, order: list[str], pieces: int | None = None) -> DataFrame:
    """Sort by ``order`` (unique together) and store, with the piece and place of every row.

    Without a number of ``pieces`` Spark sizes them by their bytes.
    """
    ranged = df.repartitionByRange(pieces, *order) if pieces else df.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id())
    return stored(placed, "pieces").withColumn(PIECE, F.shiftright(AT, _ROW_BITS))


def plain(df: DataFrame) -> DataFrame:
    return df.drop(PIECE, AT)


def assign_ids(
    df: DataFrame,
    order_keys: list[str],
    start: int | Column = 1,
    name: str = "id",
    pieces: int | None = None,
) -> DataFrame:
    """Dense ids in the order of ``order_keys``, which must be unique together."""
    return _numbered(cut_pieces(df, order_keys, pieces), df.columns, start, name)


def number_in_order(df: DataFrame, name: str = "position") -> DataFrame:
    """Dense numbers from 1 for the rows of a sorted DataFrame, in the order they come in."""
    placed = stored(df.withColumn(AT, F.monotonically_increasing_id()), "sorted")
    return _numbered(placed.withColumn(PIECE, F.shiftright(AT, _ROW_BITS)), df.columns, 1, name)


def _numbered(placed: DataFrame, columns: list[str], start: int | Column, name: str) -> DataFrame:
    sizes = placed.groupBy(PIECE).agg(F.count("*").alias("_size"))
    line = Window.orderBy(PIECE)
    offsets = sizes.select(PIECE, (F.sum("_size").over(line) - F.col("_size")).alias("_before"))
    first = F.lit(start) if isinstance(start, int) else start
    row = F.col(AT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(F.broadcast(offsets), PIECE).select(
        (first + F.col("_before") + row).cast("long").alias(name), *columns
    )


def running_sum(
    df: DataFrame, key: list[str], values: dict[str, Column], including: bool = True
) -> DataFrame:
    """Sums over the rows of the same key up to this one (without it if not ``including``)."""
    return _running(df, key, values, "sum", including, False)


def running_last(
    df: DataFrame,
    key: list[str],
    values: dict[str, Column],
    including: bool = False,
    backwards: bool = False,
) -> DataFrame:
    """Last non-NULL value among the earlier rows of the same key (later rows if ``backwards``)."""
    return _running(df, key, values, "last", including, backwards)


def number_within(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Row number inside each key, from 1."""
    return running_sum(df, key, {name: F.lit(1).cast("long")})


def _running(
    df: DataFrame, key: list[str], values: dict[str, Column], how: str, including: bool, backwards: bool
) -> DataFrame:
    names = list(values)
    rows = df.select(
        *[c for c in df.columns if c not in names],
        F.struct(*key).alias("_key"),
        *[v.alias(f"_v_{n}") for n, v in values.items()],
    )
    kept = [c for c in df.columns if c not in names]
    carried = _carried(rows, names, how, backwards)

    place = F.col(AT).desc() if backwards else F.col(AT).asc()
    frame = Window.partitionBy(PIECE, "_key").orderBy(place)
    frame = frame.rowsBetween(Window.unboundedPreceding, Window.currentRow if including else -1)
    joined = rows.join(F.broadcast(carried), PIECE, "left")
    same = F.col("_carry_key").isNotNull() & F.col("_carry_key").eqNullSafe(F.col("_key"))
    results = []
    for n in names:
        carry = F.when(same, F.col(f"_carry_{n}"))
        if how == "sum":
            inside = F.coalesce(F.sum(f"_v_{n}").over(frame), F.lit(0))
            results.append((inside + F.coalesce(carry, F.lit(0))).alias(n))
        else:
            inside = F.last(f"_v_{n}", ignorenulls=True).over(frame)
            results.append(F.coalesce(inside, carry).alias(n))
    return joined.select(*kept, *results)


def _carried(rows: DataFrame, names: list[str], how: str, backwards: bool) -> DataFrame:
    """For each piece the last key of the pieces before it and what that key has gathered there.

    Everything here has one row per piece, gathered by aggregations that combine before the shuffle.
    """
    end, begin = (F.min_by, F.max_by) if backwards else (F.max_by, F.min_by)
    bounds = rows.groupBy(PIECE).agg(end("_key", AT).alias("_tail"), begin("_key", AT).alias("_head"))

    def gathered(n: str) -> Column:
        value = F.col(f"_v_{n}")
        return F.sum(value) if how == "sum" else end(value, F.when(value.isNotNull(), F.col(AT)))

    last_keys = (
        rows.join(F.broadcast(bounds), PIECE)
        .where(F.col("_key").eqNullSafe(F.col("_tail")))
        .groupBy(PIECE, "_tail", "_head")
        .agg(*[gathered(n).alias(f"_t_{n}") for n in names])
    )
    in_turn = F.col(PIECE).desc() if backwards else F.col(PIECE).asc()
    line = Window.orderBy(in_turn)
    # A piece of one single key that goes on from the piece before extends that piece's chain.
    goes_on = F.col("_head").eqNullSafe(F.col("_tail")) & F.col("_head").eqNullSafe(F.lag("_tail").over(line))
    chained = last_keys.withColumn("_step", F.when(goes_on, 0).otherwise(1)).withColumn(
        "_chain", F.sum("_step").over(line)
    )
    chain = Window.partitionBy("_chain").orderBy(in_turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = [
        (F.sum(f"_t_{n}") if how == "sum" else F.last(f"_t_{n}", ignorenulls=True)).over(chain).alias(f"_t_{n}")
        for n in names
    ]
    return chained.select(PIECE, "_tail", *so_far).select(
        PIECE,
        F.lag("_tail").over(line).alias("_carry_key"),
        *[F.lag(f"_t_{n}").over(line).alias(f"_carry_{n}") for n in names],
    )


def reached(found: DataFrame, jumps: DataFrame) -> DataFrame:
    """command_id of all commands that a chain of ``jumps`` (command_id, _to) leads to, the first ones included.

    Each command has at most one jump, to a later one. What is found grows by jumps of doubled length.
    """
    while not jumps.isEmpty():
        # found holds the first 2^k commands of each chain, and a jump passes over 2^k of them
        more = found.join(jumps, "command_id").select(F.col("_to").alias("command_id"))
        found = stored(found.unionByName(more), "found")
        onward = jumps.select(F.col("command_id").alias("_to"), F.col("_to").alias("_then"))
        jumps = stored(
            join_checked(jumps, onward, ["_to"], "inner", ["command_id"]).select("command_id", F.col("_then").alias("_to")),
            "jumps",
        )
    return found


def reached_nearby(found: DataFrame, jumps: DataFrame) -> DataFrame:
    """Like `reached`, where most chains are short: the first ``STEPS`` jumps are made one by one, on the chains alone."""
    front = found = stored(found.distinct(), "found")
    for _ in range(STEPS):
        front = join_checked(jumps, front, ["command_id"], "left_semi", ["_to"]).select(F.col("_to").alias("command_id"))
        front = stored(front.distinct(), "front")
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    return found.unionByName(reached(front, jumps))
