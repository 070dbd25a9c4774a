"""Token ids against the tokenizer itself; round trips of the plane files; packing against the ids of every document."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from emberline.llm import packing, token_store, tokens
from emberline.llm.common import reliable_cut, scratch_path
from emberline.llm.packing import open_windows, pack, tail_windows
from emberline.llm.token_store import Reader, Writer, from_planes, read_tokens, to_planes, write_tokens

SF_DIR = "/root/testdata/sf0.001"
letters = list("abXYéßÉ019²½_'\"-.,!  \n\t\r\x0b\x1c\x85\xa0«ªº·ʰ中ΩДé€😀’") + ["'s", "'ll", "  ", " \n", "<|endoftext|>", "'S", "don't", " the"]


def ids_of(text):
    return tokens.encoder().tokenizer.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.sampled_from(letters), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_pieces_equal_the_whole(text):
    assert np.frombuffer(tokens.encoder().encode(text), "<u4").tolist() == ids_of(text)


def test_strings_of_added_tokens_are_those_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    for text in ("one<|endoftext|>two", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|> x", "中<|endoftext|>", "<|endof text|>"):
        assert np.frombuffer(tokens.encoder().encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert len(tokens.encoder().encode("one<|endoftext|>two")) == 12


def test_small_caches_change_nothing():
    import public_tokenizers

    few = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY), cache=16)
    text = " ".join(f"word{i} and, other-{i * i} things." for i in range(200))
    assert np.frombuffer(few.encode(text), "<u4").tolist() == ids_of(text)
    assert len(few.pieces) <= 16
    long = "x" * 100_000 + " " + "yz-" * 50_000
    assert np.frombuffer(few.encode(long), "<u4").tolist() == ids_of(long)


def test_every_code_point_is_of_the_same_kind():
    encoder = tokens.encoder()
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 5000):
        text = "".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}." for c in points[at : at + 5000])
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(text)


def test_plain_strings_of_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    library.encode_special_tokens = True
    for text in ("one<|endoftext|>two", "<|endoftext|> x"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.encoder(plain=True).encode(text), "<u4").tolist() == ids and 50256 not in ids


@given(st.lists(st.integers(0, 2**32 - 1), max_size=100), st.booleans())
@settings(max_examples=100, deadline=None)
def test_planes_round_trip(ids, bits):
    a = np.array(ids, "<u4")
    planes = to_planes(a, bits)
    assert len(planes) == (32 if bits else 4)
    assert from_planes(planes, len(a)).tolist() == ids


@pytest.mark.parametrize("bits", [False, True])
def test_files_and_runs(tmp_path, bits):
    rng = np.random.default_rng(2)
    docs = [(i, rng.integers(0, 50257, n).astype("<u4")) for i, n in enumerate([0, 1, 7, 8, 9, 100, 3, 0, 25])] + [(None, np.array([5], "<u4"))]
    out = Writer(str(tmp_path), "t", bits, block=8)
    for i, ids in docs:
        out.add(i, ids.tobytes())
    file = Reader(out.close())
    whole = np.concatenate([ids for _, ids in docs])
    assert file.docs == [i for i, _ in docs] and file.lengths == [len(ids) for _, ids in docs]
    assert list(file.checksums()) == [zlib.crc32(ids.tobytes()) for _, ids in docs]
    for start, n in [(0, 0), (0, 5), (7, 2), (8, 8), (3, 100), (len(whole) - 1, 1)]:
        assert file.run(start, n).tolist() == whole[start : start + n].tolist()
    with pytest.raises(ValueError):
        short = tmp_path / "short"
        short.write_bytes(b"PLANES01" + b"x" * 40)
        Reader(str(short))


CASES = [(3, "one two three"), (1, None), (2, ""), (2, "again two"), (None, "no id"), (9, "w " * 5000), (4, "same"), (4, "same")]


def test_stored_tokens(spark, frame):
    manifest = reliable_cut(write_tokens(frame(CASES), scratch_path(spark, "t"), block=64))
    found = sorted(read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    order = sorted(CASES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for (i, text), r in zip(order, found, strict=True):
        ids = np.array([*ids_of(text), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    empty = reliable_cut(write_tokens(frame(CASES).limit(0), scratch_path(spark, "t")))
    assert empty.count() == 0 and read_tokens(spark, empty).count() == 0


def test_store_query(spark):
    import duckdb

    found = sorted(token_store.op4_bit_planes(spark, SF_DIR).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, text) in zip(found, duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY 1").fetchall(), strict=True):
        ids = np.array([*ids_of(text), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@given(st.lists(st.integers(1, 32), max_size=30))
@settings(max_examples=300, deadline=None)
def test_windows(lengths):
    tiers = (4, 8, 16, 32)
    full, rest = open_windows([(n, k, k, 0) for k, n in enumerate(lengths)], tiers)
    windows = full + tail_windows(rest)
    assert all(sum(p[0] for p in w) == tier for tier, w in windows)
    assert all(tier in tiers for tier, _ in full)
    got = {}
    for _, w in windows:
        for n, _, doc, start in w:
            got.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, part in sorted(got[doc]):
            assert start == at
            at += part
        assert at == n


def check_packed(rows, expected):
    """``expected``: ids with the end id, for each document; ids of documents are distinct."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(expected)
    for i, own in pieces.items():
        ids, at = np.array(expected[i], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    for step in {r.step_group for r in rows}:
        own = [r for r in rows if r.step_group == step]
        assert len({r.tier for r in own}) == 1 and sum(r.length for r in own) <= packing.STEP_TOKENS


def test_packing_cases(frame, monkeypatch):
    monkeypatch.setattr(packing, "ROUND_IDS", 3000)
    cases = [(1, None), (2, ""), (3, "a few words"), (4, "long text " * 4000), (5, "x " * 2047)] + [(100 + i, "some words " * i) for i in range(60)]
    rows = pack(frame(cases), keep_ids=True).collect()
    check_packed(rows, {i: [*ids_of(t), 1] for i, t in cases})
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert pack(frame(cases).limit(0)).count() == 0
    same = pack(frame([(1, "twice here"), (1, "twice here")], parts=1)).collect()
    assert sum(r.length for r in same) == 2 * (len(ids_of("twice here")) + 1)


def test_packing_query(spark):
    import duckdb

    expected = {i: [*ids_of(t), 1] for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()}
    check_packed(packing.op6_multi_length_packing(spark, SF_DIR).collect(), expected)
