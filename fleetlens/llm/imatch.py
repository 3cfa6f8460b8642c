"""I-Match fingerprints: hashes of the terms in a band of document frequency.

The lexicon holds the terms whose inverse document frequency, as a share of the largest possible
one, lies in a band. Each of ``SUBSETS`` random parts of the lexicon keeps one term in ``KEEP``.
For each part the distinct terms of a text that lie in it are sorted and hashed; a fingerprint is
the row of these hashes. Texts that differ in a few terms still agree in most parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.sources.storage import shuffle_partitions, stored

SPACE = r"[\x20\x09-\x0D]+"
SUBSETS, KEEP = 16, 64
BAND = (0.2, 0.9)
#: Lexicon entries (a term's hash and its parts: 16 bytes) that are still broadcast.
BROADCAST_TERMS = 3_000_000
#: Pieces of the id order for each shuffle partition, and at most.
PIECES, MOST_PIECES = 4, 4096


def distinct_terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), SPACE)), "")


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Terms in the band with the hash ``key`` and the parts (bits of ``parts``) that hold them.

    Terms that are in no part never matter, and are left out before they are counted.
    """
    n = docs.count()
    terms = docs.select(F.explode(distinct_terms(F.col("text"))).alias("term")).select("term", _parts(F.col("term")).alias("parts"))
    counted = terms.where("parts <> 0").groupBy("term", "parts").agg(F.count("*").alias("df"))
    share = F.log(F.lit(float(max(n, 2))) / F.col("df")) / F.log(F.lit(float(max(n, 2))))
    return counted.where(share.between(*band)).select("term", "parts")


def _parts(term: Column) -> Column:
    """Bits of the parts that a term is in: part s holds it if byte s of its MD5 is below 256 / KEEP."""
    low = [f"{i:02x}" for i in range(256 // KEEP)]
    digest, none = F.md5(term.cast("binary")), F.lit(0)
    bits = [F.when(F.substring(digest, 2 * s + 1, 2).isin(low), F.lit(1 << s)).otherwise(none) for s in range(SUBSETS)]
    return sum(bits[1:], bits[0])


def next_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the text and id that follow in descending doc_id; after the last, the first.

    Ids are cut into ranges by quantiles, and a window runs inside each range. The first row of
    a range also goes, as a guest, to the end of the range before it. Ids that are null come last,
    rows of the same id follow descending text.
    """
    spark = docs.sparkSession
    pieces = min(MOST_PIECES, PIECES * shuffle_partitions(spark))
    shares = [i / pieces for i in range(1, pieces)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 100 * pieces)).first()[0] or []
    bounds = sorted(set(bounds))
    edges = F.array(*[F.lit(x) for x in bounds]).cast("array<bigint>")
    at = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(edges, lambda e: e < F.col("doc_id"))))
    rows = docs.withColumn("piece", at.cast("int"))
    # One row per range: at most ``pieces`` and one for null ids.
    firsts = sorted(rows.groupBy("piece").agg(F.max("doc_id")).collect())
    guests = None
    for i, (_, first) in enumerate(firsts):
        host = firsts[(i + 1) % len(firsts)][0]
        same = F.col("doc_id").isNull() if first is None else F.col("doc_id") == F.lit(first)
        guests = F.when(same, F.lit(host)) if guests is None else guests.when(same, F.lit(host))
    rows = rows.withColumn("guest", F.lit(0))
    if guests is not None:
        ids = [f for _, f in firsts if f is not None]
        near = F.col("doc_id").isin(ids) | F.col("doc_id").isNull() if len(ids) < len(firsts) else F.col("doc_id").isin(ids)
        more = docs.where(near).withColumn("piece", guests.cast("int")).withColumn("guest", F.lit(1))
        rows = rows.unionByName(more)
    line = Window.partitionBy("piece").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    return (
        rows.withColumn("row", F.row_number().over(line))
        .withColumn("next_text", F.lead("text").over(line))
        .withColumn("next_id", F.lead("doc_id").over(line))
        .where("guest = 0")
        .drop("guest")
    )


def fingerprint_documents(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of all texts of ``docs`` (doc_id, text) and of their edited forms.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. In the edited text the last half of the code points gives way to the first as many
    of the next document. A null text counts as empty. A text without any term in a part of the
    lexicon gets its own MD5 as fingerprint. Repeated rows each give a row. An empty table gives
    an empty result. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = stored(lexicon(docs, band), "lexicon")
    keyed = words.select(F.xxhash64("term").alias("key"), "parts")
    small = words.count() <= BROADCAST_TERMS

    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    both = next_texts(docs).withColumn("edited", edited)
    key = ["piece", "row", "doc_id", "side"]
    sides = both.select(
        "piece", "row", "doc_id",
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("text").alias("text")),
            F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")),
        )).alias("of"),
    ).select("piece", "row", "doc_id", "of.side", "of.text")
    # In place 0 each text has its own facts, so that the terms need not carry them.
    raw = F.col("text").cast("binary")
    facts = F.concat_ws(" ", F.length("text"), F.md5(raw), F.when(F.col("side") == 1, F.sha2(raw, 256)))
    terms = sides.select(*key, F.posexplode(F.concat(F.array(facts), distinct_terms(F.col("text")))).alias("pos", "term"))
    if small:
        # Inside the texts of a corpus 64 bits tell its terms apart.
        hashed_term = F.when(F.col("pos") > 0, F.xxhash64("term"))
        found = terms.withColumn("key", hashed_term).join(F.broadcast(keyed), "key", "left")
    else:
        found = terms.join(words, "term", "left")
    found = found.where("pos = 0 OR parts IS NOT NULL")
    members = F.filter(
        F.array(*[F.when(F.col("parts").bitwiseAND(F.lit(1 << s)) != 0, F.lit(s)) for s in range(SUBSETS)]),
        lambda s: s.isNotNull(),
    )
    split = F.when(F.col("pos") == 0, F.array(F.lit(-1))).otherwise(members)
    parts = found.select(*key, "term", F.explode(split).alias("part"))
    # All groupings are by the piece first, which is how the rows lie already.
    hashed = parts.groupBy(*key, "part").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    short = F.substring(F.md5(F.concat_ws(" ", "terms").cast("binary")), 1, 8)
    prints = hashed.groupBy(*key).agg(
        F.max(F.when(F.col("part") < 0, F.col("terms")[0])).alias("facts"),
        F.collect_list(F.when(F.col("part") >= 0, F.struct(F.col("part"), short.alias("hash")))).alias("hashes"),
    )
    by_part = F.map_from_entries("hashes")
    slots = [F.coalesce(F.element_at(by_part, F.lit(s)), F.lit("")) for s in range(SUBSETS)]
    fact = F.split("facts", " ")
    prints = prints.select(
        "piece", "row", "doc_id", "side",
        fact[0].cast("long").alias("n_chars"), F.when(F.col("side") == 1, fact[2]).alias("sha"),
        F.when(F.size("hashes") == 0, fact[1]).otherwise(F.concat_ws("-", *slots)).alias("print"),
    )
    one = prints.groupBy("piece", "row", "doc_id").agg(
        F.max(F.when(F.col("side") == 0, F.col("n_chars"))).alias("n_chars"), F.max("sha").alias("edited_sha256"),
        F.max(F.when(F.col("side") == 0, F.col("print"))).alias("fingerprint"),
        F.max(F.when(F.col("side") == 1, F.col("print"))).alias("edited_fingerprint"),
    )
    one = stored(one, "prints")
    follows = _followers(one)
    return follows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )


def _followers(prints: DataFrame) -> DataFrame:
    """The fingerprint of the row that follows: the next in the same range, else the first of the one below."""
    # One row per range, at most as many as ranges.
    firsts = sorted(prints.where(F.col("row") == 1).select("piece", "fingerprint").collect())
    after = {p: firsts[i - 1][1] for i, (p, _) in enumerate(firsts)}
    table = prints.sparkSession.createDataFrame(list(after.items()) or [(0, "")], "piece int, wrap string")
    line = Window.partitionBy("piece").orderBy("row")
    inside = prints.withColumn("next_print", F.lead("fingerprint").over(line))
    return inside.join(F.broadcast(table), "piece").withColumn("next_print", F.coalesce("next_print", "wrap"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the parts with terms on either side whose hashes agree; 1 for equal fingerprints."""
    pairs = F.arrays_zip(F.split(a, "-").alias("a"), F.split(b, "-").alias("b"))
    used = F.size(F.filter(pairs, lambda p: (p["a"] != "") | (p["b"] != "")))
    same = F.size(F.filter(pairs, lambda p: (p["a"] != "") & (p["a"] == p["b"])))
    whole = (F.instr(a, "-") > 0) & (F.instr(b, "-") > 0)
    return F.when(a == b, F.lit(1.0)).when(whole & (used > 0), same / used).otherwise(F.lit(0.0)).cast("double")
