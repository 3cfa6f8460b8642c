"""Subword pieces by merges that a keyed hash may skip, and back to the same text.

The pieces and their scores come from a merge-type SentencePiece model. The candidates of a word
wait in its agenda, best score first, leftmost among equals; each one that comes up is skipped
when the keyed hash of its place falls below the dropout. Which segmentation a word gets depends
on a key drawn from the seed, the document's text and the place in it, so runs agree and every
occurrence varies; if ``variants`` are asked for, on the word and on which of these its place draws. No piece of such a model goes on past the start of a space, so words are
merged on their own; words of one length are merged side by side.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from fleetlens.llm.packing import portions
from fleetlens.llm.workers import tidy

SPACE = "▁"
#: Segmentations that a worker remembers, and the longest word (characters) it does.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 40
#: Bytes of text that are split into words at a time, and characters of words merged side by side.
AT_ONCE, SIDE_BY_SIDE = 2 << 20, 1 << 17
NEVER = -np.inf
MASK = (1 << 64) - 1

_known: dict[str, PieceCoder] = {}


def _place(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What a candidate's place in its word adds to its key."""
    return first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + end.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def _drawn(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """32 bits for each candidate."""
    x = keys ^ place
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)


class PieceCoder:
    """Encodes and decodes with the pieces of one model file."""

    def __init__(self, path: str) -> None:
        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        self.surface: list[bytes] = []
        scores = [model.get_score(i) for i in range(size)]
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(b"")
            else:
                self.ids[piece] = i
                self.surface.append(piece.replace(SPACE, " ").encode())
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("this model has pieces that go on past a space")
        # Symbols are the pieces and, numbered behind them, characters of pieces that are none themselves.
        # All other characters share the number ``size``, as they never merge.
        self.size = size
        extra = sorted({c for p in self.ids for c in p} - self.ids.keys())
        self.symbols = self.ids | {c: size + 1 + i for i, c in enumerate(extra)}
        self.single = np.full(0x110000, size, np.int64)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.single[ord(c)] = i
        pairs = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)
        self.scores = np.array(scores)
        self.seen: dict[tuple, dict[str, bytes]] = defaultdict(dict)

    @staticmethod
    def at(path: str) -> PieceCoder:
        """The coder of this worker process, which lives on from task to task."""
        if path not in _known:
            _known[path] = PieceCoder(path)
        return _known[path]

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and score of each pair of symbols; the score is ``NEVER`` if they make no piece."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        piece = self.merged[at]
        return piece, np.where(self.pairs[at] == key, self.scores[piece], NEVER)

    def merge(self, words: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words of one length, one word after the other, and how many each word has."""
        return self._merged(*self._first(words), keys, dropout)[:2]

    def _first(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Symbols of words of one length, and piece and score of each with the one behind it."""
        n, rows = len(words[0]), len(words)
        symbol = self.single[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")].reshape(rows, n)
        score, piece = np.full((rows, n), NEVER), np.zeros((rows, n), np.int64)
        if n > 1:
            piece[:, :-1], score[:, :-1] = self._found(symbol[:, :-1], symbol[:, 1:])
        return symbol, piece, score

    def _merged(
        self, symbol: np.ndarray, piece: np.ndarray, score: np.ndarray, keys: np.ndarray, dropout: float, passed: list | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, how many each word has, and which are left of rows from ``_first``, which are written over.

        A candidate is known by its word and by where it begins and ends. ``passed`` gets the rows and places of each
        step, if it is given.
        """
        rows, n = symbol.shape
        alive = np.ones((rows, n), bool)
        after = np.tile(np.arange(1, n + 1), (rows, 1))
        before = np.tile(np.arange(-1, n), (rows, 1))
        row, limit = np.arange(rows), np.uint64(dropout * 2**32)
        while len(row):
            i = score[row].argmax(axis=1)
            waiting = score[row, i] > NEVER
            row, i = row[waiting], i[waiting]
            j = after[row, i]
            k = after[row, j]
            score[row, i] = NEVER
            if passed is not None:
                passed.append((row, _place(i, k)))
            r = row
            if limit:
                taken = _drawn(keys[row], _place(i, k)) >= limit
                r, i, j, k = row[taken], i[taken], j[taken], k[taken]
            symbol[r, i] = piece[r, i]
            alive[r, j], score[r, j], after[r, i] = False, NEVER, k
            more = k < n
            r2, i2, k2 = r[more], i[more], k[more]
            before[r2, k2] = i2
            piece[r2, i2], score[r2, i2] = self._found(symbol[r2, i2], symbol[r2, k2])
            h = before[r, i]
            more = h >= 0
            r2, i2, h2 = r[more], i[more], h[more]
            piece[r2, h2], score[r2, h2] = self._found(symbol[r2, h2], symbol[r2, i2])
        return symbol[alive], alive.sum(axis=1), alive

    def _merge_each(self, words: list[str], of: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` for occurrences (``of``: numbers of their words), of which many skip no candidate.

        Those have the pieces of their word without dropout, which is merged once; its candidates tell which they are.
        """
        first = self._first(words)
        passed: list[tuple[np.ndarray, np.ndarray]] = []
        plain, counts, _ = self._merged(*(x.copy() for x in first), keys[:0], 0.0, passed)
        clear, limit = np.ones(len(of), bool), np.uint64(dropout * 2**32)
        waiting = np.arange(len(of))
        for row, place in passed:
            at = np.full(len(words), -1)
            at[row] = np.arange(len(row))
            at = at[of[waiting]]
            waiting, at = waiting[at >= 0], at[at >= 0]
            good = _drawn(keys[waiting], place[at]) >= limit
            clear[waiting[~good]] = False
            waiting = waiting[good]
        rest = np.flatnonzero(~clear)
        sizes = counts[of]
        symbols, sizes[rest], _ = self._merged(*(x[of[rest]] for x in first), keys[rest], dropout)
        ends, own_ends = np.cumsum(sizes), np.cumsum(counts)
        out = np.zeros(int(sizes.sum()), np.int64)
        kept = np.repeat(clear, sizes)
        out[~kept] = symbols
        shift = np.where(clear, own_ends[of] - ends, 0)
        out[kept] = plain[(np.arange(len(out)) + np.repeat(shift, sizes))[kept]]
        return out, sizes

    def merge_long(self, words: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """The same as ``merge``, word by word and with a heap, for words of any length."""
        out, counts, limit = [], [], int(dropout * 2**32)
        for word, key in zip(words, keys.tolist() or [0] * len(words), strict=True):
            n = len(word)
            after, before = [*range(1, n + 1)], [*range(-1, n)]
            agenda: list[tuple[float, int, int, int]] = []

            def offer(i: int, j: int, k: int, agenda=agenda, word=word) -> None:
                found = self.ids.get(word[i:k])
                if found is not None:
                    heappush(agenda, (-self.scores[found], i, j, k))

            for i in range(n - 1):
                offer(i, i + 1, i + 2)
            while agenda:
                _, i, j, k = heappop(agenda)
                if after[i] != j or after[j] != k:
                    continue  # one of the two is no longer there
                x = key ^ (i * 0x9E3779B97F4A7C15 + k * 0xC2B2AE3D27D4EB4F) & MASK
                x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & MASK
                if (x >> 32) < limit:
                    continue
                after[i], after[j] = k, 0
                if k < n:
                    before[k] = i
                    offer(i, k, after[k])
                if before[i] >= 0:
                    offer(before[i], i, k)
            i, first = 0, len(out)
            while i < n:
                out.append(self.symbols.get(word[i : after[i]], self.size))
                i = after[i]
            counts.append(len(out) - first)
        return np.array(out, np.int64), np.array(counts)

    def _new(self, words: list[str], seed: int, variant: int, variants: int, dropout: float, literal: str) -> Iterator[tuple[str, bytes]]:
        """Ids of different words, little-endian unsigned 32-bit."""
        same = defaultdict(list)
        for w in words:
            same[len(w)].append(w)
        if same.pop(0, None):
            yield "", b""
        for n, some in same.items():
            step = max(1, SIDE_BY_SIDE // n)
            for group in (some[i : i + step] for i in range(0, len(some), step)):
                own = seed * variants + variant
                merge = self.merge if n <= LONGEST_REMEMBERED else self.merge_long
                keys = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), own) for w in group] if dropout else [], np.uint64)
                symbols, counts = merge(group, keys, dropout)
                ends = np.cumsum(counts)
                raw, at = symbols.astype("<u4").tobytes(), [0, *(ends * 4).tolist()]
                odd = np.zeros(len(group), bool)
                odd[np.searchsorted(ends, np.flatnonzero(symbols >= self.size), "right")] = True
                for w, i, j, strange in zip(group, at[:-1], at[1:], odd.tolist(), strict=True):
                    yield w, self._with_bytes(w, raw[i:j], literal) if strange else raw[i:j]

    def _with_bytes(self, word: str, raw: bytes, literal: str) -> bytes:
        """The same ids with the bytes of characters that are no piece in their place."""
        out, place = [], 0
        for s in np.frombuffer(raw, "<u4").tolist():
            if s < self.size:
                out.append(s)
                place += len(self._piece_text(s))
            else:
                c = SPACE if word[place] == literal else word[place]
                out += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
                place += 1
        return np.array(out, "<u4").tobytes()

    def _piece_text(self, i: int) -> str:
        return self.surface[i].decode()

    def encode(self, texts: list[str | None], seed: int = 0, dropout: float = 0.0, variants: int | None = None) -> list[bytes]:
        """Ids of whole texts (null: none), little-endian unsigned 32-bit. Without dropout they are the
        model's own, but for the character U+2581 in a text, which the model would turn into a space."""
        flat, ends = self.encode_all(pa.array(texts, pa.string()), seed, dropout, variants)
        raw, at = flat.tobytes(), (ends * 4).tolist()
        return [raw[i:j] for i, j in zip(at, at[1:])]

    def encode_all(self, texts: pa.Array, seed: int, dropout: float, variants: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text ends (after a leading 0)."""
        variants = variants if dropout else 1
        texts = texts.fill_null("")
        literal, border = self._unused(texts)
        marked = pc.replace_substring(pc.replace_substring(texts, SPACE, literal), " ", SPACE)
        marked = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", SPACE), marked, "")
        words = pc.split_pattern(pc.replace_substring_regex(marked, f"([^{SPACE}]){SPACE}", f"\\1{border}{SPACE}"), border)
        coded = words.flatten().dictionary_encode()
        borders = words.offsets.to_numpy() - words.offsets[0].as_py()
        word = coded.indices.to_numpy().astype(np.int64)
        # What each place of a text draws: a key, or which variant.
        keys = [xxhash.xxh64_intdigest(t, seed) for t in texts.cast(pa.binary()).to_pylist()]
        counts = np.diff(borders)
        place = np.arange(len(word)) - np.repeat(borders[:-1], counts)
        drawn = (place.astype(np.uint64) + np.repeat(np.array(keys, np.uint64), counts)) * np.uint64(0x9E3779B97F4A7C15)
        if variants is None:
            flat, lengths = self._each(coded.dictionary.to_pylist(), word, drawn ^ (drawn >> np.uint64(29)), literal, dropout)
            return flat, np.append(0, np.cumsum(lengths))[borders]
        code = word * variants + ((drawn >> np.uint64(33)) % np.uint64(variants)).astype(np.int64)

        wanted = np.zeros(len(coded.dictionary) * variants, bool)
        wanted[code] = True
        sizes, starts, parts, total = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64), [], 0
        for v in range(variants):
            own = np.flatnonzero(wanted[v::variants])
            found = self._segmented(coded.dictionary.take(pa.array(own)).to_pylist(), literal, seed, v, variants, dropout)
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            sizes[own * variants + v], starts[own * variants + v] = size, total + np.cumsum(size) - size
            parts += found
            total += int(size.sum())
        flat = np.frombuffer(b"".join(parts), "<u4")
        lengths = sizes[code]
        ends = np.append(0, np.cumsum(lengths))
        return flat[np.arange(ends[-1]) + np.repeat(starts[code] - ends[:-1], lengths)], ends[borders]

    def _each(self, words: list[str], word: np.ndarray, keys: np.ndarray, literal: str, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each occurrence (number of its word) under its own key, one after the other, and how many each has."""
        sizes = np.zeros(len(word), np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))[word]
        order, parts = [], []
        for n in np.unique(length[length > 0]).tolist():
            some, step = np.flatnonzero(length == n), max(1, SIDE_BY_SIDE // n)
            for at in (some[i : i + step] for i in range(0, len(some), step)):
                own, of = np.unique(word[at], return_inverse=True)
                known = [words[w] for w in own.tolist()]
                if n <= LONGEST_REMEMBERED:
                    symbols, counts = self._merge_each(known, of, keys[at], dropout)
                else:
                    symbols, counts = self.merge_long([known[w] for w in of.tolist()], keys[at], dropout)
                ends = np.cumsum(counts)
                odd = np.unique(np.searchsorted(ends, np.flatnonzero(symbols >= self.size), "right"))
                if len(odd):
                    strange = np.zeros(len(at), bool)
                    strange[odd] = True
                    plain = symbols[~np.repeat(strange, counts)]
                    rows = zip(odd.tolist(), (ends[odd] - counts[odd]).tolist(), ends[odd].tolist(), strict=True)
                    pieces = [np.frombuffer(self._with_bytes(known[of[i]], symbols[x:y].astype("<u4").tobytes(), literal), "<u4") for i, x, y in rows]
                    counts[odd] = np.fromiter(map(len, pieces), np.int64, len(pieces))
                    strange = np.repeat(strange, counts)
                    symbols = np.zeros(len(strange), np.int64)
                    symbols[~strange], symbols[strange] = plain, np.concatenate(pieces)
                sizes[at] = counts
                order.append(at)
                parts.append(symbols.astype("<u4"))
        ends = np.cumsum(sizes)
        out = np.zeros(int(sizes.sum()), "<u4")
        for at, ids in zip(order, parts, strict=True):
            own = np.cumsum(sizes[at])
            out[np.arange(len(ids)) + np.repeat(ends[at] - own, sizes[at])] = ids
        return out, sizes

    def _segmented(self, words: list[str], literal: str, seed: int, variant: int, variants: int, dropout: float) -> list[bytes]:
        """Ids of different words under one variant; short words are remembered."""
        if sum(map(len, self.seen.values())) > REMEMBERED:
            self.seen.clear()
        held = self.seen[seed, dropout, variants, variant]
        found = dict(self._new([w for w in words if w not in held], seed, variant, variants, dropout, literal))
        ids = [found[w] if w in found else held[w] for w in words]
        held.update((w, i) for w, i in found.items() if len(w) <= LONGEST_REMEMBERED and literal not in w)
        return ids

    @staticmethod
    def _unused(texts: pa.Array) -> tuple[str, str]:
        """Two characters that no text has: one to stand for a literal U+2581, one between words."""
        found: list[str] = []
        for code in range(0x10FFFF, 0xF0000, -1):
            if not pc.any(pc.match_substring(texts, chr(code))).as_py():
                found.append(chr(code))
                if len(found) == 2:
                    return found[0], found[1]
        raise ValueError("these texts use every character there is")

    def decode(self, ids: list[int]) -> str:
        """The text of these ids; the space that encoding put in front is taken away again."""
        raw = b"".join([self.surface[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str, seed: int = 0, dropout: float = 0.1, variants: int | None = None) -> DataFrame:
    """doc_id, n_pieces and ids (array) of every text of ``docs`` (doc_id, text).

    A null or empty text has no ids. Repeated rows give the same ids, as do equal texts. An empty
    table gives an empty result. Other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder.at(path)
        for batch in batches:
            coded = [coder.encode_all(some, seed, dropout, variants) for some in portions(batch["text"], AT_ONCE)]
            counts = np.concatenate([np.zeros(0, np.int64), *[np.diff(ends) for _, ends in coded]])
            flat = pa.array(np.concatenate([np.zeros(0, "<u4"), *[ids for ids, _ in coded]]).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts), lists], ["doc_id", "n_pieces", "ids"])
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(encode), "doc_id long, n_pieces long, ids array<int>")


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ``coded`` (doc_id, ids); null ids give the empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder.at(path)
        for batch in batches:
            texts = [coder.decode(ids or []) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(tidy(decode), "doc_id long, text string")
