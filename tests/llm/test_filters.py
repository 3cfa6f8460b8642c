"""URL verdicts, I-Match fingerprints and shards on small tables; twins are tested with the queries."""

import hashlib
import itertools
import random
import zlib

import duckdb

from fleetlens.llm import imatch, sharding, url_reputation
from fleetlens.llm.queries import RULES
from fleetlens.llm.twins import OP4, OP5
from tests.checking import differences


def test_urls(spark):
    urls = [
        "http://WWW.Example.org/es/x?q", "https://example.org/en/12", "x.org", None, "", "ftp://notexample.org/es/", "//a.com/de/", "http://a.com/de/",
        "http://a.com/fr/#f", "http://a.com?x=/de/", "http://com/de/1", "http://b.co.uk/de/", "http://1.2.3.4/a", "http://a.com/a\nb", "http://É.Net/", "://h/p", "a://b://c",
    ]
    pages = spark.createDataFrame([(i, u, 1, "b") for i, u in enumerate(urls * 2)] + [(None, urls[0], 1, "b")], "page_id long, url string, n int, host string")
    labels = spark.createDataFrame([(i % 34, i % 3 == 0) for i in range(60)] + [(None, True), (2, None)], "page_id long, bad boolean")
    got = url_reputation.judge_urls(pages, labels, RULES)
    rows = {r.page_id: r for r in got.collect()}
    assert got.count() == 35
    assert [(rows[i].host, rows[i].path) for i in range(10)] == [
        ("www.example.org", "/es/x"), ("example.org", "/en/12"), ("", ""), ("", ""), ("", ""), ("notexample.org", "/es/"), ("", ""), ("a.com", "/de/"), ("a.com", "/fr/"), ("a.com", ""),
    ]
    assert [rows[i].rule for i in (0, 1, 5, 7, 8, 9, 10, 11)] == ["example.org/es/", "example.org/en/1", "org/", "com/de/", "com/fr/", None, "com/de/", None]
    assert [rows[i].verdict for i in (0, 1, 5, 7, 8)] == ["block", "block", "allow", "block", "allow"]
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    labels_table = labels.selectExpr("page_id AS doc_id", "CASE WHEN bad THEN 0 WHEN NOT bad THEN 1 END AS quality", "0 AS toxic").toPandas()
    con.register("labels", labels_table)
    assert differences(got, con, OP4) == []


def test_reputation_is_shrunk(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else 'good'}.x{i % 7}.net/p") for i in range(120)] + [(500, "http://new.x1.net/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 60) for i in range(120)], "page_id long, bad boolean")
    rows = {r.page_id: r for r in url_reputation.judge_urls(pages, labels, [], 0.5).collect()}
    assert rows[0].verdict == "block" and rows[100].verdict == "allow"
    assert rows[500].n_labelled == 0 and rows[100].bad_rate_low <= rows[500].bad_rate_low < rows[0].bad_rate_low


def test_urls_of_empty_tables(spark):
    pages, labels = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean")
    assert url_reputation.judge_urls(pages, labels, RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_reputation.judge_urls(one, labels, RULES).first().verdict == "allow"


def test_fingerprints(docs_of, prose):
    texts = [" ".join(prose(40 + i, i // 3)) for i in range(40)] + [None, "", "a", "É école é", "  ", "\u0000x y", " ".join(prose(3000, 4))]
    docs = docs_of(*[(i * 3, t) for i, t in enumerate(texts)], (6, texts[2]), (6, "zz"), (None, "no id"), (None, None))
    got = imatch.fingerprint_documents(docs)
    rows = got.collect()
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    edited = {}
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited.setdefault((i, len(t)), []).append(hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest())
    for r in rows:
        assert r.edited_sha256 in edited[r.doc_id, r.n_chars]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    for i, t in order:
        prints.setdefault(t, set()).update(r.fingerprint for r in rows if r.doc_id == i and r.n_chars == len(t))
    assert len(prints[""]) == 1 and len(rows) == len(order)


def test_fingerprint_twin_beyond_the_broadcast(spark, docs_of, prose, monkeypatch):
    docs = docs_of(*[(i, " ".join(prose(60, i // 2) + [f"own{i}"])) for i in range(60)])
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert differences(imatch.fingerprint_documents(docs), con, OP5) == []
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 0)
    assert differences(imatch.fingerprint_documents(docs), con, OP5) == []


def test_fingerprints_of_few(docs_of):
    assert imatch.fingerprint_documents(docs_of().where("false")).count() == 0
    one = imatch.fingerprint_documents(docs_of((5, "abcd"))).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


def least_largest(sizes, shards):
    return min(
        max(sum(sizes[a:b]) for a, b in zip((0, *cuts), (*cuts, len(sizes))))
        for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1)
    )


def test_cuts():
    rng = random.Random(3)
    for _ in range(60):
        sizes, shards = [rng.choice([0, 1, 5, 9, 60]) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 5)
        best = least_largest(sizes, shards)
        cuts = sharding.cut_groups(sizes, shards)
        parts = [sum(sizes[a:b]) for a, b in zip((0, *cuts), (*cuts, len(sizes)))]
        assert sharding.smallest_capacity(sizes, shards) == best == max(parts) and len(parts) == shards


def test_shards(docs_of, prose):
    texts = [" ".join(prose(20 + i % 30, i)) for i in range(400)] + ["same text"] * 300 + ["", None, "é" * 9]
    docs = docs_of(*enumerate(texts), (3, texts[3]), (None, "x"))
    rows = sharding.shard_documents(docs, 8).collect()
    assert len(rows) == len(texts) + 2
    by_id = dict(enumerate(texts))
    shard_of, slots = {}, {}
    for r in rows:
        text = by_id.get(r.doc_id, "x") or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "bytes", None)
        assert shard_of.setdefault(text, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    total = sum(r.size for r in rows)
    largest = max(sum(r.size for r in rows if r.shard == s) for s in slots)
    assert largest <= max(total / 8 + 1500, 300 * 25 + 1500)
    assert sharding.shard_documents(docs.where("false")).count() == 0


def test_likeness_of_equal_and_other(spark):
    df = spark.createDataFrame([("a-b-", "a-c-"), ("a--", "a--"), ("md5", "md5"), ("md5", "a-b-"), ("--x", "-y-")], "a string, b string")
    assert [r[0] for r in df.select(imatch.likeness(df.a, df.b)).collect()] == [0.5, 1.0, 1.0, 0.0, 0.0]
