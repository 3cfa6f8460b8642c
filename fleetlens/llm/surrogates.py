"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

An entity is a type and a canonical form (a phone number without its punctuation, an address in
lower case), so different spellings stay one entity. Its surrogate is a keyed function of both,
rendered in the format of each mention: the same everywhere, without any table of all entities.
Where two entities would get the same surrogate, or one that is itself an entity of the corpus,
one of them tries again until all differ; only these exceptions are kept, and reach the documents
that mention them by a join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.workers import tidy
from fleetlens.sources.storage import stored

KEY = b"surrogates"
#: Exceptions that are still broadcast.
BROADCAST_ROWS = 500_000
#: More attempts than a type with room for all its entities can need.
MOST_ATTEMPTS = 200

# Titles before a name, by the gender they tell.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Doña", "госпожа", "κυρία"],
    "m": ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "κύριος"],
    "n": ["Dr", "Prof", "Professor", "Doctor"],
}
GENDER = {t: g for g, names in TITLES.items() for t in names}
# Alphabets by script.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
#: Given names are made of syllables and an ending that tells the gender, in each alphabet.
SYLLABLES = ["al be ca da el fi ga ha io ju ka li ma ne or pa ro sa te vi", "ал бе ва да ел зи ка ла ма не ор па ро са те ви", "αλ βε γα δα ελ φι κα λι μα νε ορ πα ρο σα τε"]
ENDINGS = [{"f": "na ra la", "m": "rt nd ck", "n": "nn ll sh"}, {"f": "на ра ла", "m": "рт нд ск", "n": "ин ей ис"}, {"f": "να ρα λα", "m": "ος ης ων", "n": "ις υς ιν"}]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS: list[tuple[str, str]] = [
    ("email", r"(?<![\w.+-])[\w+-][\w.+-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?!\w)"),
    ("secret", r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)"),
    ("secret", r"(?i:(?<=password=)|(?<=passwd=)|(?<=secret=)|(?<=api_key=)|(?<=token=))[^\s\"'&;,]{6,}"),
    ("secret", r"(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z])"),
    ("iban", r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("ip", rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"),
    ("phone", r"(?<![\w+])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)"),
]
FINDER = re.compile("|".join(f"(?P<{kind}{i}>{p})" for i, (kind, p) in enumerate(PATTERNS)))
HINT = re.compile(r"[0-9@=]|[0-9a-f]{32}")
NAME = r"[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*"
TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(GENDER, key=len, reverse=True))})\.? ({NAME}(?: {NAME}){{0,2}})")
#: Words that carry a title, for a quick look.
TITLE_WORDS = sorted(GENDER)

Entity = tuple[str, str]


def _luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _iban(value: str) -> bool:
    moved = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def canonical(kind: str, mention: str) -> str | None:
    """The form in which spellings of one entity agree; None if the mention is none after all."""
    if kind == "email":
        return mention.lower()
    if kind in ("phone", "ssn"):
        digits = re.sub(r"\D", "", mention)
        return "+" * mention.startswith("+") + digits if 7 <= len(digits) <= 15 else None
    if kind == "card":
        digits = re.sub(r"\D", "", mention)
        return digits if _luhn(digits) or (len(digits) == 16 and digits[0] in "23456") else None
    if kind == "iban":
        value = mention.replace(" ", "")
        return value if _iban(value) else None
    return mention


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(first, end, kind, canonical form) of all entities of a text, in order and apart from each other."""
    found = []
    if HINT.search(text):
        for m in FINDER.finditer(text):
            kind = m.lastgroup.rstrip("0123456789")
            form = canonical(kind, m.group())
            if form is not None:
                found.append((m.start(), m.end(), kind, form))
    if any(t in text for t in TITLE_WORDS):
        found += _names(text, found)
    return sorted(found)


def _names(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Words of titled names, and the same words wherever else the text has them."""
    kinds: dict[str, str] = {}
    for m in TITLED.finditer(text):
        words = []
        for w in m.group(2).split(" "):
            if not (w[0].isupper() or w[0].lower() == w[0].upper()):
                break
            words.append(w)
        for w in words[:-1]:
            kinds.setdefault(w, f"given-{GENDER[m.group(1)]}")
        if words:
            kinds.setdefault(words[-1], "family")
    if not kinds:
        return []
    each = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, kinds), key=len, reverse=True))})(?!\w)")
    spans = [(m.start(), m.end(), kinds[m.group()], m.group().casefold()) for m in each.finditer(text)]
    return [s for s in spans if not any(a < s[1] and s[0] < b for a, b, _, _ in taken)]


class Draws:
    """Numbers drawn from a keyed hash of an entity and an attempt."""

    def __init__(self, key: bytes, kind: str, form: str, attempt: int) -> None:
        self.seed, self.pool, self.block = (key, f"{kind}\0{attempt}\0{form}".encode("utf-8", "surrogatepass")), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 2**64:
            key, what = self.seed
            self.pool = int.from_bytes(blake2b(what, key=key[:64], digest_size=64, salt=self.block.to_bytes(16, "big")).digest())
            self.left, self.block = 2**512, self.block + 1
        self.pool, drawn = divmod(self.pool, n)
        self.left //= n
        return drawn


def _alphabet(c: str) -> int:
    low = c.lower()
    return next((i for i, a in enumerate(ALPHABETS) if low in a), 0 if c.isascii() or ord(c) < 0x250 else -1)


def _letter(c: str, draw: Draws) -> str:
    """Another letter of the same script and case, another digit for a digit; the rest as it is."""
    if c.isdigit():
        return chr(ord(c) - int(c) + draw.below(10)) if c.isdecimal() else str(draw.below(10))
    if not c.isalpha():
        return c
    script = _alphabet(c)
    if script >= 0:
        new = ALPHABETS[script][draw.below(len(ALPHABETS[script]))]
        return new.upper() if c.isupper() else new
    near = [x for x in map(chr, range(ord(c) & ~63, (ord(c) & ~63) + 64)) if x.isalpha()]
    return near[draw.below(len(near))]


def surrogate(kind: str, form: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The canonical form of the surrogate of an entity."""
    draw = Draws(key, kind, form, attempt)
    if kind == "email":
        local = form.rpartition("@")[0]
        more = "".join(ALPHABETS[0][draw.below(26)] for _ in range(max(0, 4 - len(local)) + attempt // 8))
        host = "".join(ALPHABETS[0][Draws(key, "host", form.rpartition("@")[2], i).below(26)] for i in range(8))
        return "".join(_letter(c, draw) for c in local) + more + "@" + host + ".example.org"
    if kind == "ip":
        return ".".join(str(n + draw.below(m)) for n, m in ((11, 111), (0, 256), (0, 256), (1, 254)))
    if kind == "card":
        body = form[0] + "".join(str(draw.below(10)) for _ in form[1:-1])
        good = _luhn(form)
        return next(body + str(d) for d in range(10) if _luhn(body + str(d)) == good)
    if kind == "phone" and form[0] == "+":  # the country stays
        kept = 2 if form[1] in "17" else 3
        return form[:kept] + "".join(_letter(c, draw) for c in form[kept:])
    if kind == "secret":
        hexadecimal = re.fullmatch("[0-9a-f]+", form)
        kept = 4 if re.match("A[KS]IA", form) else 0
        return form[:kept] + "".join("0123456789abcdef"[draw.below(16)] if hexadecimal else _letter(c, draw) for c in form[kept:])
    if kind == "iban":
        body = "".join(_letter(c, draw) for c in form[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + form[:2] + "00")) % 97
        return f"{form[:2]}{check:02d}{body}"
    if kind.startswith("given"):
        return _given(form, kind[-1], draw, attempt)
    changed = "".join(_letter(c, draw) for c in form)
    return changed + "".join(_letter("a", draw) for _ in range(attempt // 8)) if kind == "family" else changed


def _given(form: str, gender: str, draw: Draws, attempt: int) -> str:
    script = _alphabet(form[0])
    if script < 0:
        return "".join(_letter(c, draw) for c in form)
    parts, ends = SYLLABLES[script].split(), ENDINGS[script][gender].split()
    return "".join(parts[draw.below(len(parts))] for _ in range(2 + attempt // 4)) + ends[draw.below(len(ends))]


def render(kind: str, mention: str, form: str, made: str) -> str:
    """The surrogate ``made`` in the format of one mention of the entity."""
    if kind in ("phone", "card", "ssn", "iban"):
        new = iter(made.lstrip("+"))
        return "".join(next(new) if c.isalnum() else c for c in mention)
    if kind == "email" and mention != form:
        local = mention.rpartition("@")[0]
        return "".join(m.upper() if i < len(local) and local[i].isupper() else m for i, m in enumerate(made))
    if kind == "family" or kind.startswith("given"):
        return made.upper() if len(mention) > 1 and mention.isupper() else made[:1].upper() + made[1:]
    return made


def replace(text: str, made: Callable[[str, str], str]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and (kind, first, end) of each in the new text."""
    out, spans, at, size = [], [], 0, 0
    for first, end, kind, form in mentions(text):
        new = render(kind, text[first:end], form, made(kind, form))
        out += [text[at:first], new]
        size += first - at
        spans.append((kind, size, size + len(new)))
        size, at = size + len(new), end
    return "".join([*out, text[at:]]), spans


def _attempted(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, form, attempt with the surrogate ``made``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [surrogate(*x, key) for x in zip(b["kind"].to_pylist(), b["form"].to_pylist(), b["attempt"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["kind"], b["form"], b["attempt"], pa.array(made, pa.string())], ["kind", "form", "attempt", "made"])

    return entities.select("kind", "form", "attempt").mapInArrow(tidy(make), "kind string, form string, attempt int, made string")


def exceptions(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """The entities (kind, form) that need more than one attempt: kind, form, attempt.

    Of entities with the same surrogate the one with the smallest form keeps it, unless it is itself
    the form of an entity. The others go on until all surrogates differ.
    """
    # Names count by their family of types: no given name may become another's.
    group = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    real = entities.select(group.alias("group"), F.col("form").alias("clash"))
    real = stored(real.distinct(), "real")
    settled, waiting, changed = None, entities.withColumn("attempt", F.lit(0)), []
    for attempt in range(MOST_ATTEMPTS):
        tried = _attempted(waiting, key).select("kind", "form", "attempt", group.alias("group"), F.col("made").alias("clash"))
        tried = stored(tried, "tried")
        keeper = tried.groupBy("group", "clash").agg(F.min(F.struct("form", "kind")).alias("keeper"))
        free = keeper.join(real, ["group", "clash"], "left_anti")
        free = free if settled is None else free.join(settled, ["group", "clash"], "left_anti")
        marked = tried.join(free, ["group", "clash"], "left")
        own = F.col("keeper").isNotNull() & (F.col("keeper.form") == F.col("form")) & (F.col("keeper.kind") == F.col("kind"))
        marked = stored(marked.withColumn("good", F.coalesce(own, F.lit(False))), "marked")
        good = marked.where("good")
        if attempt:
            changed.append(good.select("kind", "form", "attempt"))
        taken = good.select("group", "clash")
        settled = taken if settled is None else settled.unionByName(taken)
        waiting = marked.where("NOT good").select("kind", "form", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            break
    else:
        raise RuntimeError("some type has more entities than surrogates of its format")
    none = entities.select("kind", "form", F.lit(0).alias("attempt")).where("false")
    for some in changed:
        none = none.unionByName(some)
    return stored(none, "exceptions")


def replace_entities(docs: DataFrame, key: bytes = KEY, spans: bool = True) -> DataFrame:
    """``docs`` with ``text`` replaced, and ``spans`` (array of kind, first, end in the new text).

    Null and empty texts stay as they are, with no spans. All other columns are kept as they are,
    a column named spans is replaced. Repeated rows get the same surrogates. Texts are whole.
    """
    kept = [c for c in docs.columns if c not in ("text", "spans")]
    keyed = docs.select(*kept, "text").withColumn("__tid", F.xxhash64("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {(t, kind, form) for t, text in zip(b["__tid"].to_pylist(), b["text"].to_pylist(), strict=True) if text for _, _, kind, form in mentions(text)}
            columns = list(zip(*sorted(rows))) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["__tid", "kind", "form"])

    found = stored(keyed.select("__tid", "text").mapInArrow(tidy(find), "__tid long, kind string, form string").distinct(), "mentions")
    again = exceptions(found.select("kind", "form").distinct(), key)
    swaps = found.join(again, ["kind", "form"]).groupBy("__tid").agg(F.collect_list(F.struct("kind", "form", "attempt")).alias("__swaps"))
    swaps = stored(swaps, "swaps")
    swaps = F.broadcast(swaps) if again.count() <= BROADCAST_ROWS and found.join(again, ["kind", "form"]).count() <= BROADCAST_ROWS else swaps
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    kinds = ", ".join(x for x in (fields, "text string, spans array<struct<kind:string,first:int,end:int>>") if x)
    struct = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, places = [], []
            for text, swapped in zip(b["text"].to_pylist(), b["__swaps"].to_pylist(), strict=True):
                attempts = {(s["kind"], s["form"]): s["attempt"] for s in swapped or []}
                new, at = replace(text, lambda k, f, a=attempts: surrogate(k, f, a.get((k, f), 0), key)) if text else (text, [])
                texts.append(new)
                places.append([dict(zip(("kind", "first", "end"), s, strict=True)) for s in at])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(texts, pa.string()), pa.array(places, struct)], [*kept, "text", "spans"])

    done = keyed.join(swaps, "__tid", "left").select(*kept, "text", "__swaps").mapInArrow(tidy(swap), kinds)
    return done if spans else done.drop("spans")
