"""Greedy string tiling against the textbook loop; leaks planted in several forms."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from emberline.llm import decontam
from emberline.llm.decontam import Items, find_leaks, op2_string_tiling, window_hashes, without_leaks, words_of

SF_DIR = "/root/testdata/sf0.001"


def plain_tiles(a, b, least):
    """Longest common unmarked run first, of equal ones that with the least starts, until none is long enough."""
    a_taken, b_taken, tiles = [False] * len(a), [False] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not a_taken[i + n] and not b_taken[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        i, j, n = best
        a_taken[i : i + n] = b_taken[j : j + n] = [True] * n
        tiles.append(best)


words = st.lists(st.sampled_from("abcd"), min_size=3, max_size=24)


@given(words, words, st.sampled_from([1, 2, 7, 1_000_000]))
@settings(max_examples=400, deadline=None)
def test_tiles(a, b, seeds):
    """However many seeds are held at a time, tiles are those of the textbook loop, and ``leaks`` counts their words."""
    items = Items([(1, " ".join(a))], tile=3, covered=0.0)
    numbers = items.numbers
    doc = np.array([numbers.get(w, 0) for w in b], np.int64)
    code = window_hashes(doc, 3)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontam, "SEEDS", seeds)
        expected = plain_tiles(a, b, 3)
        assert items.tiling(items.words[0], doc, items.runs(0, doc, code, np.arange(len(code)))) == expected
        found = items.leaks(" ".join(b))
    assert found == ([(1, len(expected), sum(n for _, _, n in expected), len(a))] if expected else [])


def test_long_equal_words_stay_small(monkeypatch):
    """60,000 equal words have 5.8 million pairs of windows with an item of a hundred; they are never held together."""
    largest = 0
    monkeypatch.setattr(decontam, "SEEDS", 20_000)

    def watched(*columns, real=decontam.joined):
        nonlocal largest
        largest = max(largest, len(columns[0]))
        return real(*columns)

    monkeypatch.setattr(decontam, "joined", watched)
    assert Items([(1, "a " * 100)]).leaks("a " * 60_000) == [(1, 1, 100, 100)]
    # Seeds of a step, then one or two runs for each of the diagonals.
    assert largest < 300_000


def test_phrase_of_all_items(monkeypatch):
    """A phrase that all items share costs no loop over them: only the item that can be covered is tiled."""
    tiled = []
    monkeypatch.setattr(Items, "runs", lambda self, k, *rest, real=Items.runs: tiled.append(k) or real(self, k, *rest))
    phrase = "one phrase that all of them have "
    texts = [phrase + " ".join(f"w{i}x{j}" for j in range(20)) for i in range(500)]
    assert Items(list(enumerate(texts))).leaks(phrase * 30 + texts[7]) == [(7, 1, 27, 27)] and tiled == [7]


def test_windows_are_karp_rabin_sums():
    ids = np.array([5, 6, 7, 8, 5, 6, 7])
    code = window_hashes(ids, 3)
    assert code[0] == code[4] and len(set(code[:4].tolist())) == 4 and len(window_hashes(ids[:2], 3)) == 0


ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."
OTHER = "a second passage about ships that sail over the northern sea in winter when ice is thin and days are short"


def test_planted_leaks(spark, frame, monkeypatch):
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(n))
    w = ITEM.rstrip(".").split()
    docs = [
        (1, f"{filler(50)} {ITEM} {filler(50)}"),
        (2, f"{filler(9)} {' '.join(w[10:])}. {filler(9)} {' '.join(w[:10])}"),  # reordered
        (3, ITEM.upper().replace(" ", "  \n")),
        (4, " ".join(w[:9])),  # less than half
        (5, filler(500)), (6, None), (7, ""), (8, " ".join(reversed(w))), (9, f"{ITEM} {OTHER}"), (1, ITEM), (10, f"{ITEM} " * 50),
        (11, " ".join(x if k % 6 else "changed" for k, x in enumerate(w))),
    ]
    bench = spark.createDataFrame(
        [(100, ITEM, 1), (200, OTHER, 1), (300, "too short", 1), (400, None, 1), (500, "", 1)], "item_id long, text string, doc_id long"
    )
    for block in (decontam.BLOCK_CHARACTERS, 40):
        found = sorted((r.doc_id, r.item_id) for r in find_leaks(frame(docs), bench, block=block).collect())
        assert found == [(1, 100), (1, 100), (2, 100), (3, 100), (9, 100), (9, 200), (10, 100), (11, 100)]
        kept = without_leaks(frame(docs), bench, block=block)
        assert kept.columns == frame(docs).columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8]
    (two,) = find_leaks(frame(docs[1:2]), bench).collect()
    assert (two.n_tiles, two.covered_words, two.item_words) == (2, 20, 20)
    assert find_leaks(frame(docs), bench.limit(0)).count() == 0 and without_leaks(frame(docs), bench.limit(0)).count() == len(docs)
    assert find_leaks(frame(docs).limit(0), bench).count() == 0


def test_query(spark):
    import duckdb

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    found = {(r.doc_id, r.item_id): r.covered_words for r in op2_string_tiling(spark, SF_DIR).collect()}
    for d, text in docs:
        b = words_of(text)
        for i, item in items:
            a = words_of(item)
            if set(a) & set(b) and sum(tuple(a[k : k + 4]) in {tuple(b[j : j + 4]) for j in range(len(b) - 3)} for k in range(len(a) - 3)) * 4 >= len(a) / 2:
                covered = sum(n for _, _, n in plain_tiles(a, b, 4))
                assert (covered >= len(a) / 2) == ((d, i) in found)
                assert found.pop((d, i), covered) == covered
    assert not found
