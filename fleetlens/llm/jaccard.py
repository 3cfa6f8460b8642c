"""Groups of documents whose sets of word n-grams have a large Jaccard similarity, exactly.

Documents with equal sets form a class, and only classes are compared. Each set is sorted in one
global order, rare shingles first, and only as much of its head is indexed as a partner must
share. The lists of the index are cut into blocks by set size; the place of a shingle in a set
bounds the sizes of possible partners, so an entry skips all other blocks.

Answers are derived from those of similar sets: first all sets of a list are compared only with the
set that leads it. What is thereby linked has the same answer, a group, and inside a group nothing is
compared any more. Only sets of one list in different groups are, and a list within one group is
skipped as a whole. How common a shingle is comes from a sketch of fixed size over all documents;
it decides the order, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.links import components
from fleetlens.llm.shingles import portions, shingle_lists, to_bytes, to_numbers
from fleetlens.llm.workers import tidy
from fleetlens.sources.storage import forget, stored

#: The sketch has 2 ** SKETCH_BITS counters, and travels in slabs.
SKETCH_BITS, SLABS = 20, 16
#: Bits of a token above its hash, for how common it is.
LEVEL_BITS = 5
#: Least and most 64-bit words of the parities of a set; in between there are two bits for each shingle.
PARITY_WORDS = (8, 512)
#: Ids (8 bytes) that are still broadcast.
BROADCAST_IDS = 2_000_000
#: Shingles up to which a set travels with 40 bits of each: two such sets agree by chance in one of 10,000 pairs.
SHORT_SET = 10_000


def _arrow(columns: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in types.items()], list(types))


def describe_sets(docs: DataFrame, words: int) -> DataFrame:
    """Per document doc_id, fetch, n (set size) and key (hash of the set); with counters in between.

    Rows with ``slab`` hold a part of the sketch of their task: how often shingles occur.
    """
    types = {"doc_id": pa.int64(), "fetch": pa.int64(), "n": pa.int64(), "key": pa.int64(), "slab": pa.int32(), "counts": pa.binary()}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            sizes, keys = [], []
            for _, texts in portions(batch["text"].to_pylist()):
                for shingles in shingle_lists(texts, words):
                    own = np.unique(shingles)
                    np.add.at(sketch, (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                    sizes.append(len(own))
                    keys.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
            none = [None] * len(sizes)
            yield _arrow({"doc_id": batch["doc_id"], "fetch": batch["fetch"], "n": sizes, "key": keys, "slab": none, "counts": none}, types)
        part = len(sketch) // SLABS
        none = [None] * SLABS
        slabs = [sketch[i * part : (i + 1) * part].astype("<i8").tobytes() for i in range(SLABS)]
        yield _arrow({"doc_id": none, "fetch": none, "n": none, "key": none, "slab": list(range(SLABS)), "counts": slabs}, types)

    kinds = "doc_id long, fetch long, n long, key long, slab int, counts binary"
    return stored(docs.select("doc_id", "fetch", "text").mapInArrow(tidy(describe), kinds), "sets")


def _summed(slabs: DataFrame, by: Column) -> DataFrame:
    """Slabs of each value of ``by`` added up; one sum per slab is held at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, counts in zip(batch["slab"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                found = np.frombuffer(counts, "<i8")
                sums[slab] = sums[slab] + found if slab in sums else found
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["slab", "counts"])

    return slabs.repartition(SLABS, by).mapInArrow(tidy(add), "slab int, counts binary")


def levels(slabs: DataFrame) -> np.ndarray:
    """How common the shingles of each counter are: by how many standard deviations it is above the usual.

    A shingle that is in more documents than chance would add to its counter so comes behind rarer ones.
    """
    first = _summed(slabs, F.xxhash64("slab", "counts"))
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    part = len(total) // SLABS
    for slab, counts in _summed(first, F.col("slab")).collect():  # SLABS rows of a fixed size
        total[slab * part : (slab + 1) * part] += np.frombuffer(counts, "<i8")
    usual = total.mean()
    above = np.maximum((total - usual) / np.sqrt(usual + 1), 0)
    above = np.where(above < 12, above, 12 + np.log2(np.maximum(above, 12) / 12))
    return np.clip(np.ceil(above), 0, (1 << LEVEL_BITS) - 1).astype(np.uint8)


def tokens_of(shingles: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Different shingles in the global order: by level, then by hash."""
    own = np.unique(shingles)
    high = level[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort(high << np.uint64(63 - LEVEL_BITS) | own >> np.uint64(LEVEL_BITS + 1)).astype(np.int64)


def parities(tokens: np.ndarray) -> np.ndarray:
    """A bit for each class of tokens (by their last bits): whether their number is odd."""
    least, most = PARITY_WORDS
    bits = 64 * min(most, max(least, 1 << max(0, len(tokens) // 32 - 1).bit_length()))
    odd = np.bincount(tokens & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _folded(longer: str, other: str) -> Column:
    """Parities with half as many classes, if there are more than in ``other``; sizes that can link differ no more."""
    half = F.size(other)
    both = F.zip_with(F.slice(longer, 1, half), F.slice(longer, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(longer) > half, both).otherwise(F.col(longer))


def head_entries(docs: DataFrame, words: int, percent: int, level: np.ndarray) -> DataFrame:
    """token, key, n, pos of the head of every set; the entry at place 1 has the parities of the set."""
    shared = docs.sparkSession.sparkContext.broadcast(level)  # 2 ** SKETCH_BITS bytes
    types = {"token": pa.int64(), "key": pa.int64(), "n": pa.int32(), "pos": pa.int32(), "parity": pa.list_(pa.int64())}

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in portions(batch["text"].to_pylist()):
                token, key, size, pos, parity = [], [], [], [], []
                for shingles in shingle_lists(texts, words):
                    n = len(own := np.unique(shingles))
                    if not n:
                        continue
                    head = n - -(-percent * n // 100) + 1
                    order = tokens_of(own, shared.value)
                    token.append(order[:head])
                    key.append(np.full(head, xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63), np.int64))
                    size.append(np.full(head, n, np.int32))
                    pos.append(np.arange(1, head + 1, dtype=np.int32))
                    parity += [parities(order), *[None] * (head - 1)]
                if token:
                    yield _arrow({"token": np.concatenate(token), "key": np.concatenate(key), "n": np.concatenate(size), "pos": np.concatenate(pos), "parity": parity}, types)

    return stored(docs.select("text").mapInArrow(tidy(enter), "token long, key long, n int, pos int, parity array<long>"), "heads")


def _least_common(na: Column, nb: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))


def linked_pairs(pairs: DataFrame, sizes: DataFrame, facts: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) of keys whose sets are similar enough, by their whole sets.

    The parities of two sets differ in no more places than the sets do; that rules out most pairs
    before the texts of the others are read again. Sets are compared by 40 bits of each shingle:
    two sets of 20,000 different shingles agree by chance in 0.0004 of them.
    """
    one = sizes.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    two = sizes.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    differing = F.aggregate(
        F.zip_with(_folded("pa", "pb"), _folded("pb", "pa"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    na, nb = F.col("na"), F.col("nb")
    sized = F.lit(percent) * F.greatest(na, nb) <= 100 * F.least(na, nb)
    close = F.when(sized, differing <= na + nb - 2 * _least_common(na, nb, percent))
    likely = stored(pairs.join(one, "a").join(two, "b").where(close).select("a", "b"), "likely")
    # Each set goes to the second ones of its pairs; those stay where they are.
    routes = likely.groupBy(F.col("a").alias("key")).agg(F.collect_list("b").alias("to"))
    routes = routes.unionByName(likely.select(F.col("b").alias("key"), F.array().cast("array<bigint>").alias("to")).distinct())
    routes = routes.groupBy("key").agg(F.flatten(F.collect_list("to")).alias("to"))
    fetch = facts.join(routes.select("key"), "key", "left_semi").groupBy("key").agg(F.min("fetch").alias("fetch"))
    routes = stored(routes.join(fetch, "key"), "routes")
    wanted = F.broadcast(routes) if routes.agg(F.coalesce(F.sum(F.size("to") + 3), F.lit(0))).first()[0] <= BROADCAST_IDS else routes
    heads = likely.select(F.col("b").alias("key")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # rows that a task meets again as they are
        for batch in batches:
            keys = batch["key"].to_pylist()
            new = [k not in done and not done.add(k) for k in keys]
            batch = batch.filter(pa.array(new, pa.bool_()))
            for first, texts in portions(batch["text"].to_pylist()):
                own = [pack(np.unique(s)) for s in shingle_lists(texts, words)]
                part = batch.slice(first, len(own))
                yield pa.RecordBatch.from_arrays([part["key"], part["to"], pa.array(own, pa.binary())], ["key", "to", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                (n, x), (m, y) = unpack(x.as_buffer(), y.as_buffer())
                common = len(np.intersect1d(x, y))
                keep.append(100 * common >= percent * (n + m - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = docs.join(wanted, "fetch").select("key", "to", "text").mapInArrow(tidy(sets), "key long, to array<long>, shingles binary")
    found = stored(found, "found")
    sa = found.select(F.col("key").alias("a"), F.explode("to").alias("b"), F.col("shingles").alias("sa"))
    sb = found.join(_small(heads), "key", "left_semi").select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    linked = stored(sa.join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(tidy(compare), "a long, b long"), "linked")
    forget(found, likely, routes)
    return linked


def pack(shingles: np.ndarray) -> bytes:
    """A set as bytes: 40 bits of each shingle, or all 64 if the set is long or 40 do not tell its own apart."""
    short = len(shingles) <= SHORT_SET and len(np.unique(shingles >> np.uint64(24))) == len(shingles)
    return b"\5" + to_bytes(shingles) if short else b"\10" + shingles.astype("<u8").tobytes()


def unpack(*raw: bytes) -> list[tuple[int, np.ndarray]]:
    """Size and numbers of sets from ``pack``; all 64 bits if all have them, else the high 40 of each."""
    raw = [bytes(x) for x in raw]
    sets = [to_numbers(x[1:]) if x[0] == 5 else np.frombuffer(x, "<u8", offset=1) for x in raw]
    if len({x[0] for x in raw}) > 1:
        return [(len(s), s if x[0] == 5 else s >> np.uint64(24)) for s, x in zip(sets, raw, strict=True)]
    return [(len(s), s) for s in sets]


def _block(size: Column, percent: int) -> Column:
    """Blocks of set sizes; sizes in one block differ by no more than the similarity allows."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")


def group_documents(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Two documents are linked when their sets of ``words``-word shingles have at least ``percent``
    hundredths of their union in common. component_id is the smallest doc_id reachable. A null text
    or one without words has no shingles and is linked with nothing; its component is itself.
    Repeated rows each give a row. Rows without id take part, and get the component of the others.
    An empty table gives an empty result. Other columns are not read.
    """
    named = _rooted(docs, words, percent)
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component"))
    grouped = named.where("n > 0").join(least, "root").select("doc_id", "n", "component")
    alone = named.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))
    return grouped.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest doc_id (rows without id come last).

    Rows without any shingle are in no group and all stay. All columns are kept.
    """
    named = _rooted(docs, words, percent)
    rows = named.groupBy("fetch").agg(F.min("root").alias("root"), F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count("*").alias("times"))
    rows = stored(rows, "rows")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("fetch"))
    stays = rows.where("n > 0").groupBy("root").agg(F.min_by("fetch", order).alias("fetch")).select("fetch", F.lit(True).alias("stays"))
    judged = stored(rows.where("n > 0").join(stays, "fetch", "left").select("fetch", "times", F.coalesce("stays", F.lit(False)).alias("stays")), "judged")
    # Rows that are repeated as they are go too, and one of each comes back.
    gone = judged.where("NOT stays OR times > 1").select(F.col("fetch").alias("__row"))
    again = judged.where("stays AND times > 1").select(F.col("fetch").alias("__row"))
    keyed = docs.withColumn("__row", _fetch())
    once = keyed.join(_small(again), "__row", "left_semi").dropDuplicates(["__row"])
    return keyed.join(_small(gone), "__row", "left_anti").unionByName(once).select(*docs.columns)


def _fetch() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _small(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _rooted(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, fetch (hash of id and text), n and root of every row; equal roots mean one group."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fetch().alias("fetch"), F.col("text").cast("string").alias("text"))
    described = describe_sets(docs, words)
    facts = described.where("slab IS NULL").select("doc_id", "fetch", "n", "key")
    level = levels(described.where("slab IS NOT NULL").select("slab", "counts"))
    entries = head_entries(docs, words, percent, level)
    sizes = stored(entries.where("pos = 1").select("key", "n", "parity").dropDuplicates(["key"]), "parities")

    # Lists of more than one set.
    lists = entries.groupBy("token").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last")
    alive = stored(entries.select("token", "key", "n", "pos").join(lists.select("token"), "token").distinct(), "lists")
    forget(entries)
    # Each list is led by the set that shares most of its head. Among copies that were changed here
    # and there this is the one that was not: the others have shingles of their own in front.
    head = F.first("n") - F.ceil(percent * F.first("n") / 100) + 1
    shared = alive.groupBy("key").agg((F.count("*") / head).alias("shared"))
    leads = alive.select("token", "key").join(shared, "key").groupBy("token").agg(F.max_by("key", F.struct("shared", "key")).alias("lead"))
    stars = alive.select("token", "key").join(leads, "token").where("key <> lead")
    links = linked_pairs(stars.select(F.col("key").alias("a"), F.col("lead").alias("b")).distinct(), sizes, facts, docs, words, percent)
    links = links.unionByName(_across_groups(alive, links, sizes, facts, docs, words, percent))

    roots = components(links)
    named = facts.join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    named = stored(named.select("doc_id", "fetch", "n", F.coalesce("root", "key").alias("root")), "named")
    forget(described, alive, sizes)
    return named


def _across_groups(
    alive: DataFrame, links: DataFrame, sizes: DataFrame, facts: DataFrame, docs: DataFrame, words: int, percent: int
) -> DataFrame:
    """Links between sets that share a list but not yet a group.

    In each list the entries outside its largest group look for partners, so a group with very
    many sets is only ever met by others, never by itself.
    """
    roots = components(links).select(F.col("node").alias("key"), "root")
    rooted = alive.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = stored(rooted, "rooted")
    shares = rooted.groupBy("token", "root").agg(F.count("*").alias("rows"))
    mixed = shares.groupBy("token").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    mixed = stored(rooted.join(mixed.select("token", "main"), "token"), "mixed")

    n, pos = F.col("n"), F.col("pos")
    # A partner of size m shares at most n - pos + 1 shingles, and must share percent / (100 + percent) of n + m.
    most = F.least(100 * n / percent, (n - pos + 1) * (100 + percent) / percent - n)
    least = percent * n / 100
    reached = F.sequence(_block(F.greatest(F.lit(1), F.ceil(least)), percent), _block(F.greatest(F.lit(1), F.ceil(least), F.floor(most)), percent))
    asking = mixed.where("root <> main").select(
        "token", F.col("key").alias("a"), n.alias("na"), pos.alias("ia"), F.col("root").alias("ra"), F.explode(reached).alias("block")
    )
    asked = mixed.select(
        "token", _block(n, percent).alias("block"), F.col("key").alias("b"), n.alias("nb"), pos.alias("ib"), F.col("root").alias("rb"), "main"
    )
    na, nb, ia, ib = (F.col(c) for c in ("na", "nb", "ia", "ib"))
    smaller, place = F.least(na, nb), F.when((na < nb) | ((na == nb) & (ia <= ib)), ia).otherwise(ib)
    fits = (
        (F.col("ra") != F.col("rb"))
        & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b")))
        & (percent * F.greatest(na, nb) <= 100 * smaller)
        & (place <= smaller - F.ceil(2 * percent * smaller / (100 + percent)) + 1)
        & (1 + F.least(na - ia, nb - ib) >= _least_common(na, nb, percent))
    )
    pairs = stored(asking.join(asked, ["token", "block"]).where(fits).select("a", "b").distinct(), "pairs")
    forget(rooted, mixed)
    return linked_pairs(pairs, sizes, facts, docs, words, percent)
