import math
import random
import re
from collections import Counter

import pytest

from emberline.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = set()
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in terms & c.keys():
                df = sum(t in other for _, other in held)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, i is not None, i))
        for rank, (score, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.add((item, rank, i, -score))
    return out


def made(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "-x", "."]) for _ in range(n))


@pytest.mark.parametrize("spread, block_bytes, seed", [(64, 2_000_000, 1), (1, 400, 2), (2, 1, 3)])
def test_equals_brute_force(spark, frame, monkeypatch, spread, block_bytes, seed):
    """Crowded sketches (bounds far off), many blocks, ties and copies give the same ranking."""
    monkeypatch.setattr(L, "SPREAD", spread)
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcDEé1") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    docs = [(i, made(rng, rng.choice([1, 5, 30, 200]), vocabulary)) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(40)] + [(300, None), (301, ""), (302, "-- !"), (None, docs[3][1]), (7, docs[3][1])]
    items = [(i, made(rng, rng.randint(1, 12), vocabulary)) for i in range(12)] + [(3, "more words"), (20, None), (21, "?!"), (22, "unheard0")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = {tuple(r) for r in L.search(frame(docs), asked, 10, block_bytes=block_bytes).collect()}
    assert found == brute(docs, items, 10)


def test_bounds_are_bounds():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    block = L.Block.of([(i, made(rng, 20, vocabulary)) for i in range(20)])
    ranking = L.Ranking(block, 100, 5000, [rng.randint(0, 5000) for _ in block.vocabulary], 5)
    held = [(Counter(L.terms(made(rng, 80, vocabulary))), 90) for _ in range(50)]
    bounds = ranking.bounds(ranking.sketches(held, 128))
    for row, (c, m) in enumerate(held):
        for item, pairs in enumerate(ranking.pairs):
            assert bounds[row, item] >= sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in pairs if t in c)
    ranking.add(list(range(50)), held)
    assert ranking.scored < ranking.looked


def test_long_text_and_empty_tables(spark, frame):
    items = spark.createDataFrame([(1, "needle in hay")], "item_id long, text string")
    rows = [(1, "hay " * 200_000 + "needle"), (2, "needle"), (3, "other")]
    docs = frame(rows)
    assert {tuple(r) for r in L.search(docs, items).collect()} == brute(rows, [(1, "needle in hay")], 50)
    assert L.search(docs.limit(0), items).count() == 0 and L.search(docs, items.limit(0)).count() == 0
