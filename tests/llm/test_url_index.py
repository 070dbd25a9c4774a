"""Digest arrays against sets of strings; rules by plain reading; the query against its SQL."""

import random

from pyspark.sql import functions as F

from emberline.llm import url_index
from emberline.llm.common import scratch_path
from emberline.llm.url_index import ORACLE, RULES, build_index, digest, judge, op5_digest_array, probe

SF_DIR = "/root/testdata/sf0.001"


def test_digest_is_that_of_spark(spark):
    for text in ("", "a", "host/päth/ü", "x" * 1000):
        (r,) = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).collect()
        assert r.h & 0xFFFFFFFFFFFFFFFF == digest(text)


def test_many_shards_equal_a_set(spark, monkeypatch):
    monkeypatch.setattr(url_index, "SHARD_KEYS", 50)
    random.seed(1)
    listed = [f"host{random.randrange(200)}/p{k}" for k in range(400)]
    manifest = build_index(spark.createDataFrame([(x,) for x in [*listed, *listed, None, ""]], "address string"), scratch_path(spark, "u"))
    assert manifest.count() > 4
    asked = [*listed[:200], *[x + "?" for x in listed[:200]], "", None, "never"]
    found = probe(spark.createDataFrame(list(enumerate(asked)), "id long, address string"), "address", manifest).collect()
    assert {r.id: r.listed for r in found} == {k: (x or "") in {*listed, ""} for k, x in enumerate(asked)}


def test_equal_digests_are_told_apart(spark, monkeypatch):
    manifest = build_index(spark.createDataFrame([("first",), ("second",)], "address string"), scratch_path(spark, "u"))
    (r,) = manifest.collect()
    shard = url_index.Shard(r.path)
    clash = shard.digests[:1].copy()
    wrong = shard.text(0) + b"!"
    assert shard.holds(clash, [wrong]).tolist() == [False]
    assert shard.holds(clash, [shard.text(0)]).tolist() == [True]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:end], rest[end:]
        path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in RULES:
        rule_host, _, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, best


def test_rules_and_odd_addresses(spark):
    urls = [
        None, "", "no scheme", "http://", "http://Example.ORG/en/12", "http://a.example.org/en/2", "http://org/", "http://x.org", "ftp://x.org?q/",
        "http://x.com/fr/", "http://y.x.com/de/a#/fr/", "http://notexample.org/es/", "http://example.org/es/?x", "a://b://c/d", "http://İ.org/x",
        "http://x.net/a\nb", "http://xcom/fr/",
    ]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(5, urls[5], "h")], "page_id long, url string, address string")
    listed = spark.createDataFrame([("x.net/a\nb",), ("",)], "address string")
    found = judge(pages, listed).collect()
    assert len(found) == len(urls) + 1
    for r in found:
        host, path, best = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best[0] if best else None)
        assert r.verdict == (best[1] if best else "block" if host + path in ("x.net/a\nb", "") else "allow")
    assert judge(pages.limit(0), listed.limit(0)).count() == 0


def test_query(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_DIR}/pages.parquet'")
    found = sorted(op5_digest_array(spark, SF_DIR).collect(), key=lambda r: r.page_id)
    expected = con.execute(f"SELECT page_id, host, path, rule, verdict, listed FROM ({ORACLE}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in found] == expected
