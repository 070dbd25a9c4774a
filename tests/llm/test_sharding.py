"""Shards by sampled splitters against sums over the rows themselves."""

import zlib

from emberline.llm import sharding
from emberline.llm.sharding import op8_sampled_splitters, quantiles, shard_by_size

SF_DIR = "/root/testdata/sf0.001"


def check(found, shards, largest):
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    sums = [sum(r.size for r in by.get(k, [])) for k in range(shards)]
    mean = sum(sums) / shards
    assert all(abs(x - mean) <= largest + 1 for x in sums)


def test_hot_text_long_rows_and_nulls(frame, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 40)
    rows = [(i, "the same text") for i in range(400)] + [(1000 + i, f"text number {i}" * (1 + i % 7)) for i in range(800)]
    rows += [(5000, "long " * 200), (5001, None), (5002, ""), (None, "no id"), (7, "the same text"), (7, "the same text")]
    docs = frame(rows)
    found = shard_by_size(docs, 8).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in found) == sorted(
        (i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    check(found, 8, max(r.size for r in found))
    # The hot text is subdivided.
    assert len({r.shard for r in found if r.text_crc32 == zlib.crc32(b"the same text")}) > 1
    assert len({r.part for r in found}) > 8


def test_empty_and_single(frame):
    assert shard_by_size(frame([(1, "x")]).limit(0), 4).count() == 0
    (only,) = shard_by_size(frame([(1, "x")]), 4).collect()
    assert only.slot == 0 and only.size == 17


def test_quantiles():
    assert quantiles([], 4) == []
    assert quantiles([(1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 4, 4)], 2) == [(3, 3, 3)]


def test_no_python_on_the_executors(spark):
    plan = op8_sampled_splitters(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD[Row"))


def test_query(spark):
    import duckdb

    found = op8_sampled_splitters(spark, SF_DIR).collect()
    expected = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF_DIR}/documents.parquet'").fetchall()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found) == sorted((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in expected)
    assert {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None}
    check(found, 40, max(r.size for r in found))


def test_samples_are_decided_row_by_row(frame):
    """About as many keys as asked for, more of the large rows, without a sort or a limit that would gather them in one task."""
    docs = frame([(i, "x" * (984 if i % 10 == 0 else 84)) for i in range(4000)])
    rows = sharding.keyed(docs)
    total = 400 * 1000 + 3600 * 100
    keys = sharding.drawn(rows, 400, total)
    assert keys == sorted(keys) and abs(len(keys) - 400) < 100
    large = sum(k[1] % 10 == 0 for k in keys)
    # The large rows hold 53 of 100 bytes.
    assert 0.35 < large / len(keys) < 0.65
