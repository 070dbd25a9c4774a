"""Exact joins against all pairs; components; blocks that are cut into chunks."""

import random
import re

import numpy as np
import pytest

from emberline.llm import similarity
from emberline.llm.components import components
from emberline.llm.similarity import Chunk, Groups, bitmap_width, dual_join, near_duplicates, one_of_each, op3_signature_trees, star

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def expected(rows):
    """doc_id, set size, least id of the component, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()), key=str)


def changed(rng, words, share):
    return [w if rng.random() > share else f"w{rng.randrange(10**6)}" for w in words]


def corpus(seed=1):
    """Copies, near copies at all distances, chains, a passage that unrelated texts share, and plain texts."""
    rng = random.Random(seed)
    new = lambda n: [f"v{rng.randrange(10**5)}" for _ in range(n)]
    rows = []
    add = lambda words: rows.append((len(rows) * 3 % 1009 + 1000 * (len(rows) * 3 // 1009), " ".join(words)))
    for _ in range(6):
        origin = new(rng.randrange(20, 120))
        for share in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.08):
            add(changed(rng, origin, share))
    chain = new(100)
    for _ in range(12):
        add(chain)
        chain = chain[3:] + new(3)
    passage = new(60)
    for _ in range(40):
        add(new(10) + passage + new(rng.randrange(3, 40)))
    for _ in range(30):
        add(new(rng.randrange(1, 60)))
    return rows


EDGES = [
    (5001, None), (5002, ""), (5003, " \n\t"), (5004, "a"), (5005, "A"), (5006, "a b c d"), (5007, "a b c d e"), (5008, "b a"), (5009, "a b c d e f"),
    (5010, "a\xa0b c d e"), (5011, "É é"), (5012, "é é"), (None, "a b c d e"), (None, "only this one has no id"), (5004, "a"), (5004, "another text of one id"),
    (5013, "x " * 3000), (5014, "x " * 4000), (5015, "İ i"),
]


def test_all_pairs(frame):
    rows = corpus() + EDGES
    assert result(frame(rows)) == expected(rows)


@pytest.mark.parametrize("codes, sets", [(300, 10), (4000, 7)])
def test_chunks_and_parts(frame, monkeypatch, codes, sets):
    """Blocks in many chunks: what is left of them is joined across, and what is near the leader with those linked to it."""
    monkeypatch.setattr(similarity, "CHUNK_CODES", codes)
    monkeypatch.setattr(similarity, "CHUNK_SETS", sets)
    monkeypatch.setattr(similarity, "BATCH_CODES", 500)
    rng = random.Random(9)
    origin = [f"u{k}" for k in range(150)]
    rows = [(k, " ".join(changed(rng, origin, rng.choice((0.005, 0.02, 0.04))))) for k in range(90)] + [(1000 + i, t) for i, t in corpus(2)]
    assert result(frame(rows)) == expected(rows)


def test_empty_table(frame):
    assert near_duplicates(frame([(1, "x")]).limit(0)).count() == 0
    assert one_of_each(frame([(1, "x")]).limit(0)).count() == 0


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(3)
    codes = []
    for _ in range(25):
        origin = np.unique(rng.integers(0, 2**63, rng.integers(5, 200)).astype(np.uint64))
        for share in (0, 0.1, 0.2, 0.3):
            codes.append(np.unique(np.concatenate([origin[rng.random(len(origin)) >= share / 2], rng.integers(0, 2**63, 2).astype(np.uint64)])))
    ids, sizes = list(range(len(codes))), [len(c) for c in codes]
    want, got = Groups(), Groups()
    for a in ids:
        for b in range(a):
            both = len(np.intersect1d(codes[a], codes[b]))
            if 100 * both >= 75 * (sizes[a] + sizes[b] - both):
                want.join(a, b)
    chunk = Chunk(ids, sizes, codes, bitmap_width(codes))
    links = dual_join(chunk, chunk, Groups())
    for a, b in links:
        got.join(a, b)
    assert [got.root(x) for x in ids] == [want.root(x) for x in ids]
    assert len(links) == sum(want.root(x) != x for x in ids)
    halves = Chunk(ids[:50], sizes[:50], codes[:50], 1024), Chunk(ids[50:], sizes[50:], codes[50:], 1024)
    across = Groups()
    for pair in ((halves[0], halves[0]), (halves[1], halves[1]), halves):
        dual_join(*pair, across)
    assert [across.root(x) for x in ids] == [want.root(x) for x in ids]
    linked, near = star(0, ids, sizes, codes)
    assert linked[0] and all(n for is_linked, n in zip(linked, near) if is_linked)


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    seen = Groups()
    for a, b in links:
        seen.join(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for pair in links for x in pair}
    assert {x: found.get(x, x) for x in nodes} == {x: seen.root(x) for x in nodes}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(frame):
    rows = corpus() + EDGES
    docs = frame(rows)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    alone = {r[2] for r in expected(rows) if r[1]}
    with_words = [r for r in found if shingles(r[1])]
    # One row per component, from the component; texts without words all stay.
    assert len(with_words) == len({(c, i is None) for i, n, c in expected(rows) if n and (i == c)} | set()) + sum(
        1 for i, t in [(5004, "another text of one id")] if (i, t) in found
    )
    assert {i for i, _ in with_words} == alone
    assert [i for i, t in found if not shingles(t)] == [5001, 5002, 5003]


def test_query(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op3_signature_trees(spark, SF_DIR).collect()), key=str)
    assert found == expected(rows)


def test_one_of_repeated_rows_whatever_the_columns_names(spark):
    names = "doc_id long, text string, __h long, __H_ string, __doc_id long, __twice_h long"
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, 1, "a", 2, 3), (1, text, 1, "a", 2, 3), (2, text, 4, "b", 5, 6), (3, None, 7, "c", 8, 9)], names)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, text, 1, "a", 2, 3), (3, None, 7, "c", 8, 9)]
