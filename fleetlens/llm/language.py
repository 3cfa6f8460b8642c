"""Languages of mixed texts: scripts narrow the candidates, Viterbi labels spans of words.

Each language is learned as a table of character trigrams of fixed size. A word's score for a
language is the log likelihood of its trigrams. Languages in which the script of a word does not
occur are out for that word. Over the words of a text the best path of languages is found, where
each change of language costs ``SWITCH``. Tables have one row per language and trigram bucket, so
their size does not depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.workers import tidy

BUCKETS = 1 << 16
#: Cost of a change of language, in nats.
SWITCH = 8.0
#: A script counts for a language that has at least this share of its letters in it.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
#: Most languages that are learned from one table.
MOST_LANGUAGES = 1000

# First and last code point of blocks by script; letters elsewhere are of script 0.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0B80, 0x0BFF, "Tamil"),
    (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0x20000, 0x3134F, "Han"),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for _, _, name in SCRIPTS)]
#: Code points (in words of four bytes) that are looked at together.
AT_ONCE = 1 << 20

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point 0, or one more than the number of its script if it is a letter."""
    if not _letters:
        table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
        for first, last, name in SCRIPTS:
            table[first : last + 1] *= 1 + SCRIPT_NAMES.index(name)
        _letters.append(table)
    return _letters[0]


@dataclass
class Words:
    """The words of a list of texts, one after the other."""

    buckets: np.ndarray  # of the trigram around every letter
    starts: np.ndarray  # first letter of each word, among the letters
    at: np.ndarray  # first code point of each word
    letters: np.ndarray  # letters of each word
    script: np.ndarray  # of the first letter of each word
    text: np.ndarray  # which text each word is from


def words_of(texts: list[str]) -> Words:
    """Maximal runs of letters, with the hashed trigrams of their lower-case letters."""
    table = letter_table()
    line = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    kind = table[line]
    is_letter = kind > 0
    place = np.flatnonzero(is_letter)
    first = ~is_letter[place - 1]
    starts = np.flatnonzero(first)
    codes = np.where(is_letter, line, 0).astype(np.uint64)
    mixed = codes[place - 1] * np.uint64(0x9E3779B97F4A7C15) + codes[place] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[place + 1] * np.uint64(0x165667B19E3779F9)
    buckets = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
    at = place[starts]
    text = np.searchsorted(np.cumsum(lengths), at - 1, "right")
    letters = np.diff(np.append(starts, len(place)))
    return Words(buckets.astype(np.int64), starts, at - 1 - (np.cumsum(lengths) - lengths)[text], letters, kind[at].astype(np.int64) - 1, text)


def split_texts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) in lower case, with about ``AT_ONCE`` characters together; null as empty."""
    some, size, first = [], 0, 0
    for i, text in enumerate(texts):
        some.append((text or "").lower())
        size += len(some[-1])
        if size >= AT_ONCE:
            yield first, some
            some, size, first = [], 0, i + 1
    if some:
        yield first, some


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # bucket x language
    fits: np.ndarray  # script x language
    usual: int = 0  # the language with the most letters

    def emissions(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word x language scores, and which words have any candidate at all."""
        scores = np.add.reduceat(self.logs[words.buckets], words.starts, axis=0) if len(words.starts) else np.zeros((0, len(self.langs)), np.float32)
        fits = self.fits[words.script]
        known = fits.any(axis=1)
        scores -= scores.max(axis=1, keepdims=True, initial=-np.inf)
        scores[known[:, None] & ~fits] = -1e4
        scores[~known] = 0
        return scores, known


def learn(docs: DataFrame) -> Model:
    """Count the trigrams and scripts of all texts of ``docs`` (text, lang) by language.

    Rows without text or language teach nothing. Languages are the values of ``lang``; with more
    than ``MOST_LANGUAGES`` of them this is not a language column, and is refused.
    """
    rows = docs.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            texts = batch["text"].to_pylist()
            for lang in set(langs):
                held = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                for _, some in split_texts([texts[i] for i in np.flatnonzero(langs == lang)]):
                    words = words_of(some)
                    held[:BUCKETS] += np.bincount(words.buckets, minlength=BUCKETS)
                    held[BUCKETS:] += np.bincount(words.script, words.letters, len(SCRIPT_NAMES)).astype(np.int64)
            if len(sums) > 8:  # else kept until the end of the task
                yield from rows_of(sums)
        yield from rows_of(sums)

    def rows_of(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        while sums:
            lang, held = sums.popitem()
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(held[at])], ["lang", "bucket", "n"])

    counts = rows.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # A language has at most BUCKETS + len(SCRIPT_NAMES) rows here.
    table = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    found = sorted(table.limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    dense = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(found)))
    for j, (_, buckets, n) in enumerate(found):
        dense[buckets, j] = n
    grams, scripts = dense[:BUCKETS], dense[BUCKETS:]
    # Witten-Bell: unseen trigrams share as much as there are different ones.
    total, kinds = grams.sum(axis=0), np.maximum((grams > 0).sum(axis=0), 1)
    logs = np.log((grams + kinds / BUCKETS) / np.maximum(total + kinds, 1)).astype(np.float32)
    letters = scripts.sum(axis=0)
    fits = scripts > SCRIPT_SHARE * np.maximum(letters, 1)
    return Model([lang for lang, _, _ in found], logs, fits, int(letters.argmax()) if found else 0)


def best_paths(scores: np.ndarray, text: np.ndarray, texts: int, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word, all texts side by side, one word of each at a time."""
    counts = np.bincount(text, minlength=texts)
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    falling = counts[order]
    longest = int(falling[0]) if texts else 0
    active = np.searchsorted(-falling, -np.arange(longest), "left")
    width = scores.shape[1]
    came = np.empty(scores.shape, np.int16)
    value, own = np.zeros((texts, width), np.float64), np.arange(width, dtype=np.int16)
    for t in range(longest):
        n = active[t]
        at, v = starts[:n] + t, value[:n]
        top = v.argmax(axis=1)
        change = v[np.arange(n), top] - switch
        better = change[:, None] > v
        came[at] = np.where(better, top[:, None], own)
        value[:n] = np.where(better, change[:, None], v) + scores[at]
    path = np.empty(len(scores), np.int64)
    state = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        path[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return path


def label_texts(model: Model, texts: list[str | None], always: bool = False) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, share of the letters in it, spans) of each text; spans are (first, end, language).

    Places are counted in the lower-cased text. Letters in a script that no learned language has
    form spans of ``und``. The language with the most letters wins, ties go to the smaller name,
    and ``und`` wins only alone or with more letters than any language. With ``always`` every text
    with a letter gets a language: without a word of any, the most common one with score 0.
    """
    out: list[tuple[str, float, list[tuple[int, int, str]]]] = []
    names, width = [*model.langs, UNKNOWN], len(model.langs)
    for _, some in split_texts(texts):
        words = words_of(some)
        if width:
            scores, known = model.emissions(words)
            path = np.where(known, best_paths(scores, words.text, len(some)), width)
        else:
            path = np.full(len(words.starts), width)
        votes = np.bincount(words.text * (width + 1) + path, words.letters, len(some) * (width + 1)).reshape(-1, width + 1)
        total = np.maximum(votes.sum(axis=1), 1)
        won = votes.argmax(axis=1)
        if always and width:
            won = np.where(votes[:, :width].any(axis=1), votes[:, :width].argmax(axis=1), model.usual)
        share = votes[np.arange(len(some)), won] / total
        won = np.where(votes.sum(axis=1) > 0, won, width)
        new = np.flatnonzero(np.append(True, (np.diff(words.text) != 0) | (np.diff(path) != 0))) if len(path) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(path)) - 1
        ends = words.at[last] + words.letters[last] if len(path) else new
        spans: list[list[tuple[int, int, str]]] = [[] for _ in some]
        for doc, first, end, lang in zip(words.text[new].tolist(), words.at[new].tolist(), ends.tolist(), path[new].tolist(), strict=True):
            spans[doc].append((first, end, names[lang]))
        out += [(names[w], float(s), span) for w, s, span in zip(won, share, spans, strict=True)]
    return out


def identify(docs: DataFrame, model: Model, spans: bool = False, always: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and, if wanted, ``spans`` (in place of columns so named).

    A null text, or one without letters, is ``und`` with score 0; so is one in unknown scripts, unless
    a language is ``always`` wanted. Nothing but the text is looked at.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_LANGUAGES fixed tables
    kind = "lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label_texts(shared.value, batch["text"].to_pylist(), always)
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            rows = [[dict(zip(("first", "end", "lang"), s, strict=True)) for s in f[2]] if spans else None for f in found]
            columns.append(pa.array(rows, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *columns], [*kept, "lang_pred", "score", "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    named = docs.select(*kept).mapInArrow(tidy(label), f"{fields}, {kind}")
    return named if spans else named.drop("spans")


def held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with held_out: whether CRC-32 of the id as text is a multiple of five (false without id)."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.withColumn("held_out", F.coalesce(fold, F.lit(False)))


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that are not held out.

    Rows without id are neither held out nor learned from. An empty table gives an empty result.
    """
    rows = held_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))
    model = learn(rows.where("NOT held_out AND doc_id IS NOT NULL"))
    return identify(rows.select("doc_id", "held_out", "text"), model, always=True).select("doc_id", "held_out", "lang_pred", "score")
