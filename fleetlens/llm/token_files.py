"""Token ids in files: canonical length-limited Huffman codes in independent blocks.

One code for the whole corpus comes from the counts of all ids. Code lengths are limited by
package-merge, so that one table of ``1 << LONGEST`` entries decodes every code with one look.
Only the counts reach the driver: one row per id of the vocabulary (at most 65,536).

Files lie in a folder with two parts, both written by Spark, so that a lost task leaves nothing
behind: ``code`` has a row (id, count, bits) per id that occurs, ``blocks`` a row per block with
the number of its piece of the document order, its place there, its number of ids and its bytes:

    magic "FLT1", crc32 of the code lengths (u32), crc32 of the packed bits (u32), checkpoint step
    (u32), documents (u64), ids (u64), checkpoints (u64); then per document its id (i64), whether
    it has one (u8) and its number of ids (u64); then per checkpoint a bit offset (u64); then the
    codes, first bit highest, with eight zero bytes behind them.

All numbers are little-endian. A block holds whole documents and can be read on its own. Every
``step`` ids a checkpoint says at which bit the next code begins, so any run of ids can be read from
the checkpoint before it, and all checkpoints of a block are decoded side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.word_ids import WordEncoder, portions
from fleetlens.llm.workers import tidy
from fleetlens.sources.storage import new_path, stored

END_ID = 1
#: Longest code in bits; 65,536 ids need 16 at least.
LONGEST = 20
#: A block is closed when it has so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
STEP = 256
MAGIC, HEADER = b"FLT1", struct.Struct("<4sIIIQQQ")
ALPHABET = 1 << 16
SPARE = 8


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits per symbol (0: does not occur) of a best code whose codes have at most ``longest`` bits.

    Package-merge: a list of symbols by count is paired up and merged with the symbols again, once
    per bit. The cheapest 2n - 2 entries of the last list, traced back, hold each symbol as often
    as its code has bits. Equal counts go by symbol, symbols before packages.
    """
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        bits[used] = 1
        return bits
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols do not fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    packages, levels = np.zeros(0, np.int64), []
    for _ in range(longest):
        merged = np.concatenate([weights, packages])
        by_weight = np.argsort(merged, kind="stable")
        levels.append(by_weight < len(weights))
        merged = merged[by_weight]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1::2]
    take = 2 * len(used) - 2
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:take].sum())
        bits[order[:symbols]] += 1
        take = 2 * (take - symbols)
    return bits


class Code:
    """Canonical code of given lengths: shorter codes first, equal lengths by symbol."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits.astype(np.uint8)
        self.digest = zlib.crc32(self.bits.tobytes())
        self.width = int(self.bits.max(initial=1))
        used = np.flatnonzero(bits)
        order = used[np.argsort(bits[used], kind="stable")]
        # In canonical order every code begins where the one before it ends in the table.
        spans = np.left_shift(1, self.width - bits[order])
        firsts = np.cumsum(spans) - spans
        if len(used) and int(spans.sum()) > 1 << self.width:
            raise ValueError("these lengths are not those of a prefix code")
        self.codes = np.zeros(len(bits), np.uint64)
        self.codes[order] = firsts >> (self.width - bits[order])
        self.symbol = np.zeros(1 << self.width, np.uint16)
        self.symbol[: spans.sum()] = np.repeat(order, spans)

    def pack(self, ids: np.ndarray, step: int = STEP) -> tuple[np.ndarray, bytes]:
        """Bit offsets of every ``step``-th id, and the codes of all ids end to end."""
        sizes = self.bits[ids]
        if len(ids) and not sizes.all():
            raise ValueError("an id without a code")
        ends = np.cumsum(sizes, dtype=np.int64)
        starts = ends - sizes
        total = int(ends[-1]) if len(ids) else 0
        # A code lies in the 64 bits from the 32-bit word in which it begins; some code begins in each word.
        window = self.codes[ids] << (64 - (starts & 31) - sizes).astype(np.uint64)
        word = starts >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.bitwise_or.reduceat(window, first) if len(ids) else np.zeros(0, np.uint64)
        words = np.zeros(len(sums) + 1, np.uint64)
        words[:-1] = sums >> np.uint64(32)
        words[1:] |= sums & np.uint64(0xFFFFFFFF)
        return starts[::step], words.astype(">u4").tobytes()[: -(-total // 8)] + bytes(SPARE)

    def unpack(self, packed: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
        """Ids of runs of ``count`` codes that begin at bits ``at`` of ``packed``, end to end.

        All runs go on side by side, one id of each at a time.
        """
        # 32 bits from every byte on: enough for a code that begins in that byte
        wide = packed.astype(np.uint32)
        windows = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
        shift, mask = 32 - self.width, np.uint32((1 << self.width) - 1)
        place, found = at.astype(np.int64), np.empty((count, len(at)), np.uint16)
        for row in found:
            row[:] = self.symbol[(windows[place >> 3] >> (shift - (place & 7)).astype(np.uint32)) & mask]
            place += self.bits[row]
        return found.T.ravel()


def write_block(code: Code, doc_ids: list[int | None], lists: list[np.ndarray], step: int = STEP) -> bytes:
    """The bytes of a block of whole documents."""
    ids = np.concatenate([np.zeros(0, np.uint16), *lists])
    checks, packed = code.pack(ids, step)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    head = HEADER.pack(MAGIC, code.digest, zlib.crc32(packed), step, len(lists), len(ids), len(checks))
    numbers = np.array([i or 0 for i in doc_ids], "<i8"), known, np.array([len(x) for x in lists], "<u8"), checks.astype("<u8")
    return b"".join([head, *(n.tobytes() for n in numbers), packed])


class Block:
    """A block that was read: its documents, and its ids on demand."""

    def __init__(self, code: Code, data: bytes) -> None:
        magic, digest, crc, self.step, n_docs, self.n_ids, n_checks = HEADER.unpack_from(data)
        if magic != MAGIC or digest != code.digest:
            raise ValueError("not a block of this code")
        self.code, at = code, HEADER.size
        numbers = []
        for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u8", n_checks)):
            numbers.append(np.frombuffer(data, kind, n, at))
            at += numbers[-1].nbytes
        self.doc_ids, self.known, sizes, self.checks = numbers
        self.sizes = sizes.astype(np.int64)
        if zlib.crc32(memoryview(data)[at:]) != crc:
            raise ValueError("a block is damaged")
        self.packed = np.frombuffer(data, np.uint8, offset=at)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids from ``first`` up to ``last``, read from the checkpoint before ``first`` on."""
        last = self.n_ids if last is None else min(last, self.n_ids)
        if first >= last:
            return np.zeros(0, np.uint16)
        begin, end = first // self.step, -(-last // self.step)
        low = int(self.checks[begin]) >> 3
        high = int(self.checks[end]) >> 3 if end < len(self.checks) else len(self.packed)
        part, at = self.packed[low : high + SPARE], self.checks[begin:end].astype(np.int64) - 8 * low
        rest = last - (end - 1) * self.step
        found = np.concatenate([self.code.unpack(part, at[:-1], self.step), self.code.unpack(part, at[-1:], rest)])
        return found[first - begin * self.step :]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """row (unique), doc_id, n_tokens, ids_crc32 and ids (16-bit) of every text, the closing id among them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.at(path), np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            ids = pa.concat_arrays([encoder.encode(some) for some in portions(batch["text"])])
            ids = pc.binary_join_element_wise(ids, pa.scalar(end, pa.binary()), pa.scalar(b"", pa.binary()))
            crcs = [zlib.crc32(np.frombuffer(x.as_buffer(), "<u2").astype("<u4")) for x in ids]
            tokens = pc.divide(pc.binary_length(ids), 2).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], tokens, pa.array(crcs, pa.int64()), ids], ["doc_id", "n_tokens", "ids_crc32", "ids"])
            pa.default_memory_pool().release_unused()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = plain.mapInArrow(tidy(encode), "doc_id long, n_tokens long, ids_crc32 long, ids binary")
    return stored(coded.withColumn("row", F.monotonically_increasing_id()), "tokens")


def count_ids(tokens: DataFrame) -> DataFrame:
    """id and count over all rows; every task counts its own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ALPHABET, np.int64)
        for batch in batches:
            column = batch["ids"]
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            if len(column):
                counts += np.bincount(np.frombuffer(column.buffers()[2], "<u2")[ends[0] // 2 : ends[-1] // 2], minlength=ALPHABET)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "count"])

    return tokens.select("ids").mapInArrow(count, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write_tokens(tokens: DataFrame, folder: str, longest: int = LONGEST, block_ids: int = BLOCK_IDS, step: int = STEP) -> None:
    """Write ``tokens`` (as ``encode_documents`` gives them) as files into ``folder``, by ascending doc_id.

    Rows without id come first; rows with the same id go by the crc32 of their ids.
    """
    spark = tokens.sparkSession
    # One row per id of the vocabulary.
    found = np.array([tuple(r) for r in count_ids(tokens).collect()], np.int64).reshape(-1, 2)
    counts = np.zeros(ALPHABET, np.int64)
    counts[found[:, 0]] = found[:, 1]
    bits = code_lengths(counts, longest)
    used = np.flatnonzero(counts)
    rows = zip(used.tolist(), counts[used].tolist(), bits[used].tolist(), strict=True)
    spark.createDataFrame(list(rows), "id long, count long, bits int").coalesce(1).write.parquet(f"{folder}/code")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(bits)
        piece, first, doc_ids, lists = 0, 0, [], []

        def block() -> pa.RecordBatch:
            size = sum(map(len, lists))
            data = write_block(code, doc_ids, lists, step)
            return pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([first]), pa.array([size]), pa.array([data], pa.binary())], names)

        for batch in batches:
            piece = batch["piece"][0].as_py() if len(batch) else piece
            held = sum(map(len, lists))
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                doc_ids.append(doc_id)
                lists.append(np.frombuffer(ids.as_buffer(), "<u2"))
                held += len(lists[-1])
                if held >= block_ids:
                    yield block()
                    first, held, doc_ids, lists = first + held, 0, [], []
            lists = [x.copy() for x in lists]  # they lie in the batch, which goes
        if lists:
            yield block()

    names = ["piece", "first", "n_ids", "data"]
    order = ["doc_id", "ids_crc32", "row"]
    ranged = tokens.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select(F.spark_partition_id().cast("long").alias("piece"), "doc_id", "ids")
    blocks = ranged.mapInArrow(tidy(pack), "piece long, first long, n_ids long, data binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of files in ``folder``: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (array).

    ``start`` is the number of ids of all documents before this one.
    """
    known = spark.read.schema("id long, count long, bits int").parquet(f"{folder}/code")
    bits = np.zeros(ALPHABET, np.int64)
    for r in known.select("id", "bits").collect():  # one row per id of the vocabulary
        bits[r.id] = r.bits
    blocks = spark.read.schema("piece long, first long, n_ids long, data binary").parquet(f"{folder}/blocks")
    names = ["piece", "doc_id", "place", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(bits)
        for batch in batches:
            for piece, first, data in zip(batch["piece"].to_pylist(), batch["first"].to_pylist(), batch["data"], strict=True):
                block = Block(code, data.as_buffer())
                ids = block.ids().astype("<u4")
                ends = np.append(0, np.cumsum(block.sizes))
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
                columns = [
                    pa.array(np.full(len(crcs), piece)), pa.array(block.doc_ids, mask=block.known == 0),
                    pa.array(first + ends[:-1]), pa.array(block.sizes), pa.array(crcs, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in names)
    found = blocks.select("piece", "first", "data").mapInArrow(tidy(unpack), kinds)
    # One row per piece of the sorted documents.
    sizes = blocks.groupBy("piece").agg(F.sum("n_ids").alias("size"))
    line = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("piece", F.coalesce(F.sum("size").over(line), F.lit(0)).alias("before"))
    return found.join(F.broadcast(before), "piece").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *names[5:]
    )


def through_files(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """All ``docs`` (doc_id, text) written with the tokenizer at ``path`` and read back: see ``read_tokens``.

    A null or empty text, or one of white space, is the closing id alone. Long texts are whole in
    one block. Repeated rows, and rows without id, are written like any other. An empty table gives
    files without blocks and an empty result. Other columns are not read.
    """
    folder = new_path(docs.sparkSession, "token_files")
    write_tokens(encode_documents(docs, path), folder)
    return read_tokens(docs.sparkSession, folder, with_ids)
