"""Archives: round trips of records, and captures against the pages they were made from."""

import hashlib
import io

import pytest

from emberline.llm import warc
from emberline.llm.common import reliable_cut, scratch_path
from emberline.llm.warc import assemble, capture_records, members, op9_transactions, parse, read_records, record_types, write_archives

SF_DIR = "/root/testdata/sf0.001"


def expected(pages):
    holder = {}
    for i, _, html in pages:
        if len((html or "").encode()) >= 1000 and i is not None:
            holder[html] = max(i, holder.get(html, i))
    rows = []
    for i, _, html in pages:
        data = (html or "").encode()
        to = holder.get(html) if len(data) >= 1000 else None
        to = None if to == i else to
        rows.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return rows


def run(spark, pages, **more):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = reliable_cut(write_archives(record_types(df.repartition(3)), scratch_path(spark, "w")))
    return assemble(read_records(spark, manifest, **more))


def key(r):
    return tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)


def digest(r):
    about = dict(r.metadata.fields)
    return (
        int(about["page-id"]) if about["page-id"] else None, r.response.payload_bytes, r.response.payload_digest, r.response.type,
        int(about["refers-to-page"]) if about["refers-to-page"] else None,
    )


PAGES = [
    (1, "http://a.b/c?d", "x" * 1000), (2, "http://a.b/e", "x" * 1000), (9, None, "x" * 1000), (3, "http://a/ \r\nEvil: 1", "y" * 999), (4, "u", "y" * 999),
    (5, "http://ü/é", None), (6, "", ""), (7, "http://a", "é" * 500), (8, "http://a", "é" * 500), (None, "http://n", "z" * 2000), (10, "http://n", "z" * 2000),
    (None, "http://n", "only null" * 200), (11, "http://crlf", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 100), (12, "http://twice", "t" * 50), (12, "http://twice", "t" * 50),
]


def test_pages_come_back(spark):
    found = run(spark, PAGES, keep_payload=True).collect()
    assert sorted(map(digest, found), key=key) == sorted(expected(PAGES), key=key)
    payload = {digest(r)[0]: r.response.payload for r in found if r.response.type == "response"}
    assert bytes(payload[11]).decode() == PAGES[12][2] and payload.get(1) is None
    assert all(r.request is not None and r.request.http_head.startswith("GET /") for r in found)
    evil = next(r for r in found if digest(r)[0] == 3)
    assert "\n" not in evil.target_uri and "Evil" in evil.target_uri
    by_id = {r.capture_id: r for r in found}
    for r in found:
        if r.response.type == "revisit":
            assert by_id[r.response.refers_to_id].response.payload_digest == r.response.payload_digest


def test_metadata_may_name_the_request(spark):
    rows = [
        ("response", "<r>", None, "u"), ("request", "<q>", "<r>", "u"), ("metadata", "<m>", "<q>", "u"), ("response", "<s>", None, "v"),
        ("metadata", "<n>", "<gone>", "v"), ("warcinfo", "<w>", None, None),
    ]
    schema = warc.RECORD
    df = spark.createDataFrame([(t, i, c, u, None, "h", 1, "d", {"k": i}) for t, i, c, u in rows], schema)
    found = {r.capture_id: r for r in assemble(df).collect()}
    assert set(found) == {"<r>", "<s>"}
    assert found["<r>"].metadata.record_id == "<m>" and found["<r>"].request.record_id == "<q>"
    assert found["<s>"].metadata is None and found["<s>"].request is None


def test_members_in_small_reads():
    data = b"".join(capture_records(1, "http://a/b", b"<p>" * 50, "ab" * 20, None))
    for size in (1, 7, 100, 1 << 20):
        got = [parse(m) for m in members(io.BytesIO(data), size)]
        assert [h["warc-type"] for h, _ in got] == ["request", "response", "metadata"]
        assert got[1][1].endswith(b"<p>" * 50)
    with pytest.raises(ValueError):
        list(members(io.BytesIO(data[:-3])))


def test_empty_and_rolled_files(spark, monkeypatch):
    assert run(spark, []).count() == 0
    monkeypatch.setattr(warc, "FILE_BYTES", 600)
    found = run(spark, PAGES).collect()
    assert sorted(map(digest, found), key=key) == sorted(expected(PAGES), key=key)


def test_query(spark):
    import duckdb

    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF_DIR}/pages.parquet'").fetchall()
    found = op9_transactions(spark, SF_DIR).collect()
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(expected(pages), key=key)
