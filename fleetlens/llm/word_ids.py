"""Token ids of whole texts under a tokenizer whose tokens never span white space."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Bytes of text that are split into words at a time.
AT_ONCE = 12 << 20

#: Words of Latin letters up to U+00FF, which the tokenizer's normalizer keeps but for their case,
#: with a few marks behind them, which it never joins to letters.
PLAIN = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?)]{0,8})$"
LINE = 256

_known: dict[str, WordEncoder] = {}


class Runs:
    """Many sequences of ids, each a run of one flat array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes = flat, sizes
        self.starts = np.cumsum(sizes) - sizes

    @staticmethod
    def of(lists: list[list[int]]) -> Runs:
        return Runs(np.fromiter(chain.from_iterable(lists), "<u2"), np.fromiter(map(len, lists), np.int64, len(lists)))

    def pick(self, at: np.ndarray) -> np.ndarray:
        """The runs with these numbers, end to end."""
        sizes = self.sizes[at]
        shift = (self.starts[at] - (np.cumsum(sizes) - sizes)).astype(np.int32)
        places = np.repeat(shift, sizes)
        places += np.arange(len(places), dtype=np.int32)
        return self.flat[places]


class WordEncoder:
    """Ids of texts under a tokenizer whose tokens never span white space, word by word.

    Each different word is encoded once for a portion of texts, and all that is done for every
    place of a word is done on arrays. A word of plain letters, with or without marks behind it,
    skips the tokenizer's normalizer, which would only lower its case. Ids are little-endian
    unsigned 16-bit. The tokenizer's own threads stay off, as Spark runs tasks side by side.
    """

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("the ids of this tokenizer do not fit 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.letters = Tokenizer(self.whole.model)
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), to_bytes])

    @staticmethod
    def at(path: str) -> WordEncoder:
        """The encoder of this worker process, which lives on from task to task."""
        if path not in _known:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _known[path] = WordEncoder(path)
        return _known[path]

    def _any(self, words: list[str]) -> Runs:
        return Runs.of([e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)])

    def _plain(self, words: list[str]) -> Runs:
        """Ids of words of plain letters: each ends with the only token of it that ends a word."""
        lines = [" ".join(words[i : i + LINE]) for i in range(0, len(words), LINE)]
        flat = Runs.of([e.ids for e in self.letters.encode_batch_fast(lines, add_special_tokens=False)]).flat
        ends = np.flatnonzero(self.ends[flat]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(flat)):
            raise ValueError("words and word ends differ")
        return Runs(flat, np.diff(ends, prepend=0))

    def _ids(self, words: pa.Array) -> Runs:
        """Ids of different words."""
        parts = pc.extract_regex(words, PLAIN)
        plain = pc.is_valid(parts)
        whole = self._any(words.filter(pc.invert(plain)).to_pylist())
        # Case makes no difference, but each letter has its own small form.
        low = pc.utf8_lower(parts.field("core")).filter(plain).dictionary_encode()
        tail = parts.field("tail").filter(plain).dictionary_encode()
        cores, tails = self._plain(low.dictionary.to_pylist()), self._any(tail.dictionary.to_pylist())
        # Every word is two runs: letters and what is behind them, or all of it and nothing.
        known = Runs(
            np.concatenate([cores.flat, tails.flat, whole.flat]),
            np.concatenate([cores.sizes, tails.sizes, whole.sizes, [0]]),
        )
        n_cores, n_tails, is_plain = len(cores.sizes), len(tails.sizes), plain.to_numpy(zero_copy_only=False)
        runs = np.empty((len(words), 2), np.int64)
        runs[is_plain, 0] = low.indices.to_numpy()
        runs[is_plain, 1] = n_cores + tail.indices.to_numpy()
        runs[~is_plain, 0] = n_cores + n_tails + np.arange(len(whole.sizes))
        runs[~is_plain, 1] = len(known.sizes) - 1
        return Runs(known.pick(runs.ravel()), known.sizes[runs].sum(axis=1))

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of every text (null: none) as binary."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = words.flatten().dictionary_encode()
        known, at = self._ids(coded.dictionary), coded.indices.to_numpy()
        ends = np.append(0, np.cumsum(known.sizes[at]))
        borders = (ends[words.offsets.to_numpy() - words.offsets[0].as_py()] * 2).astype(np.int32)
        ids = known.pick(at)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(borders.tobytes()), pa.py_buffer(ids.tobytes())])


def portions(texts: pa.Array, most: int = AT_ONCE) -> Iterator[pa.Array]:
    """Slices of the texts with about ``most`` bytes each."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(first, last - first)
        first = last
