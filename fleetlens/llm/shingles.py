"""Hashed words and shingles of whole texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from fleetlens.llm.workers import REMEMBERED as KEPT

#: Words whose hash a worker remembers.
REMEMBERED = 150_000
#: Bytes of text that are split into words at a time.
AT_ONCE = 1 << 21


class WordHashes(dict):
    """64-bit hashes of words, found once and then looked up."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = WordHashes()
KEPT.append(_words)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def factors(n: int) -> np.ndarray:
    """Odd factors for the places of a shingle."""
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def portions(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, texts as bytes with A-Z lower-cased; null as empty), about ``AT_ONCE`` bytes together."""
    some, size, first = [], 0, 0
    for i, text in enumerate(texts):
        some.append((text or "").encode("utf-8", "surrogatepass").lower())
        size += len(some[-1])
        if size >= AT_ONCE:
            yield first, some
            some, size, first = [], 0, i + 1
    if some:
        yield first, some


def shingle_lists(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The hashed shingles of ``size`` words of each text, in order.

    Words are the runs between white space (space, tab, newlines, vertical tab, form feed). A text
    with fewer words than ``size`` has one shingle of all its words, one without words has none.
    """
    if len(_words) > REMEMBERED:
        _words.clear()
    lines = [t.split() for t in texts]
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    total = int(counts.sum())
    find = _words.__getitem__
    line = np.fromiter((h for words in lines for h in map(find, words)), np.uint64, total)
    place = factors(size)
    rolled = np.zeros(max(total - size + 1, 0), np.uint64)
    for k in range(size):
        rolled += line[k : k + len(rolled)] * place[k]
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(rolled[at : at + n - size + 1])
        elif n:
            short = (line[at : at + n] * place[:n]).sum(dtype=np.uint64) + np.uint64(size - n)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(line[:0])
        at += n
    return out


def to_bytes(shingles: np.ndarray) -> bytes:
    """The high 40 bits of each shingle, five bytes each."""
    return (shingles >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def to_numbers(raw: bytes) -> np.ndarray:
    """What ``to_bytes`` has kept of each shingle, as numbers."""
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()
