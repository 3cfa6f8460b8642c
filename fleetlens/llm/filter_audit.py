"""How filters interact: what every order of them removes at every step, and each filter's Shapley share.

A document is the set of filters that it fails, so a part of the corpus is 32 counts. The orders of
the filters are the paths through the lattice of their subsets, from none applied to all applied,
and an edge of it is "these have been applied, now this one". What an edge removes depends on the
two alone, so 80 edges answer all 600 steps of the 120 orders. Counted forward, the paths that
reach the state before an edge, and backward, those that leave the state behind it, multiply to the
number of orders that use the edge; with these weights the edges of a filter add up to what it
removes over all orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.skew import join_checked
from fleetlens.sources.storage import stored

FILTERS = "ABCDE"
STATES = 1 << len(FILTERS)
#: Parts of the corpus that are worked out at a time in a task.
PARTS_AT_ONCE = 256
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


class Lattice:
    """Edges between sets of applied filters, and where the steps of all orders lie on them."""

    def __init__(self, filters: str = FILTERS) -> None:
        n = len(filters)
        states = np.arange(1 << n)
        forward, backward = np.zeros(len(states), np.int64), np.zeros(len(states), np.int64)
        forward[0] = backward[-1] = 1
        edges = [(s, f) for s in states.tolist() for f in range(n) if not s >> f & 1]
        for s, f in edges:  # a state comes after all states below it
            forward[s | 1 << f] += forward[s]
        for s, f in reversed(edges):
            backward[s] += backward[s | 1 << f]
        self.before = np.array([s for s, _ in edges])
        self.bit = np.array([1 << f for _, f in edges])
        self.weight = forward[self.before] * backward[self.before | self.bit]
        self.same_filter = (self.bit[:, None] == self.bit).astype(np.int64)

        number = {edge: i for i, edge in enumerate(edges)}
        self.orders, self.steps, self.edge_of = [], [], []
        for order in permutations(range(n)):
            state = 0
            for step, f in enumerate(order, 1):
                self.orders.append("".join(filters[g] for g in order))
                self.steps.append(step)
                self.edge_of.append(number[state, f])
                state |= 1 << f

        # Which documents (by the set of filters they fail) count at which edge.
        reaches, fails = (states & self.before[:, None]) == 0, (states & self.bit[:, None]) != 0
        self.kept = (reaches & ~fails).T.astype(np.int64)
        self.removed = (reaches & fails).T.astype(np.int64)
        self.redundant = (~reaches & fails).T.astype(np.int64)
        self.unique = (states == self.bit[:, None]).T.astype(np.int64)

    def audit(self, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
        """The columns ``COUNTS`` of every step, from documents by (part, set of failed filters)."""
        removed = n @ self.removed
        shapley = (removed * self.weight) @ self.same_filter
        found = [n @ self.kept, removed, n @ self.redundant, n @ self.unique, good @ self.removed, toxic @ self.removed, shapley]
        return [f[:, self.edge_of] for f in found]


def failed_of_text(text: Column) -> Column:
    """Set (bits) of the filters A to D that a text without null fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n_words, n_different = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    conditions = [n_words < 200, 100 * n_different < 50 * n_words, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (``source``), order and step of the five filters, with ``COUNTS``.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic. A null text counts
    as empty, a null source as ''. Equal texts are compared over the whole table. Repeated rows
    count each, and are no copies of one another, as neither id is smaller; a row without id is no
    copy, has no copies and no labels. A document with several labels is good, or toxic, if one of
    them says so. Long texts are whole. An empty table gives an empty result. Other columns are not
    read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        failed_of_text(text).alias("failed"),
    )
    # Repeated rows are counted before they meet anything.
    rows = stored(facts.groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("n")), "facts")
    named = rows.where(F.col("doc_id").isNotNull())
    # The first document of each text is found without gathering its copies, and met under both keys.
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    copied = F.when(F.col("is_first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    met = join_checked(named.join(firsts, ["digest", "doc_id"], "left"), known, ["doc_id"], "left", ["digest", "part"])
    met = met.select("part", (F.col("failed") + copied).alias("failed"), "n", "good", "toxic")
    alone = rows.where(F.col("doc_id").isNull()).select("part", "failed", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    cells = met.unionByName(alone).groupBy("part", "failed").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )
    # At most STATES cells per part.
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return parts.mapInArrow(_all_steps, f"part string, filter_order string, step int, {counts}")


def _all_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lattice = Lattice()
    per_part = len(lattice.orders)
    for whole in batches:
        for first in range(0, whole.num_rows, PARTS_AT_ONCE):
            batch = whole.slice(first, PARTS_AT_ONCE)
            cells, rows = batch["cells"].flatten(), batch.num_rows
            at = np.repeat(np.arange(rows), batch["cells"].value_lengths().to_numpy())
            tables = []
            for name in ("n", "good", "toxic"):
                tables.append(np.zeros((rows, STATES), np.int64))
                tables[-1][at, cells.field("failed").to_numpy()] = cells.field(name).to_numpy()
            columns = [
                batch["part"].take(pa.array(np.repeat(np.arange(rows), per_part))),
                pa.array(lattice.orders * rows),
                pa.array(lattice.steps * rows, pa.int32()),
                *(pa.array(c.ravel()) for c in lattice.audit(*tables)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])
