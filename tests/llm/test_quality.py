"""Counts by plain Python; estimates against concentration steps on arrays; verdicts on planted outliers."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from emberline.llm.quality import (
    KEPT_SHARE, NAMES, P, RATES, chi2_below, chi2_quantile, consistency, counts_of, judged, keep_good, mcd, op10_robust_outliers,
)

SF_DIR = "/root/testdata/sf0.001"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = Counter(windows)
    covered = {k for i, w in enumerate(windows) if again[w] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@given(st.lists(st.sampled_from(["a", "b", "a b c d e f g h", " ", "\n", "\t", "\x0b", "\xa0", "\x85", "#", "é|", "<x>", "\r"]), max_size=40).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_counts(text):
    assert counts_of(text)[:5] == plain_counts(text)


def test_chi_squared():
    assert chi2_below(5.348, 6) == pytest.approx(0.5, abs=1e-3)
    assert chi2_quantile(0.975, 6) == pytest.approx(14.449, abs=1e-2)
    assert 1 < consistency(0.975, 6) < consistency(0.75, 6)


def test_estimates_withstand_outliers_and_equal_array_steps(spark):
    rng = np.random.default_rng(1)
    true = np.array([1.7, 0.1, 0.2, 0.3, 0.1, 0.1])
    clean = true + rng.normal(size=(900, P)) * 0.1
    far = true + 4 + rng.normal(size=(180, P)) * 0.05
    rows = np.vstack([clean, far])
    df = spark.createDataFrame([(None, "s", r.tolist()) for r in rows], "lang string, source string, x array<double>").repartition(3)
    (found,) = mcd(df).collect()
    centre, inverse = np.array(found.centre), np.array(found.inverse).reshape(P, P)
    assert np.abs(centre - true).max() < 0.03
    # One more concentration step from the result, on arrays, stays where it is.
    floors = np.diag([RATES[n] ** 2 for n in NAMES])
    d = np.einsum("ij,jk,ik->i", rows - centre, inverse, rows - centre)
    inner = rows[d <= chi2_quantile(0.975, P)]
    again = np.cov(inner.T, bias=True) * consistency(0.975, P) + floors
    assert np.abs(inner.mean(0) - centre).max() < 0.01
    assert np.abs(np.linalg.inv(again) - inverse).max() < 0.05 * np.abs(inverse).max()
    assert (d[:900] < 60).all() and (d[900:] > 100).all()
    assert 0 < KEPT_SHARE < 1


def prose(rng, n):
    words = ["the", "over", "river", "stone", "garden", "and", "light", "walks", "under", "morning", "of", "small", "house", "Anna"]
    return " ".join(rng.choice(words) + (". " if rng.random() < 0.1 else "") + str(rng.choice(words)) for _ in range(n))


def test_verdicts(frame, spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 100)) for i in range(300)]
    junk = [(1000, " ".join(f"{w}###$$$" for w in prose(rng, 100).split())), (1001, prose(rng, 100).upper()), (1002, prose(rng, 60).replace(" ", " | "))]
    base = [(2000, None), (2001, ""), (2002, "few words only"), (2003, "one two three four five six seven eight nine " * 9)]
    twice = [rows[0], rows[0]]
    docs = frame(rows + junk + base + twice)
    found = [(r.doc_id, r.base_failed, r.kept) for r in judged(docs).collect()]
    assert len(found) == docs.count()
    kept = {i for i, _, k in found if k}
    assert kept == {i for i, _ in rows}
    assert {i for i, b, _ in found if b} == {i for i, _ in base}
    good = keep_good(docs)
    assert good.columns == docs.columns and good.count() == len(rows) + 2
    # An id that two texts share: only the text that fails goes.
    both = frame(rows + [(0, "few words only")])
    assert keep_good(both).filter("doc_id = 0").count() == 1
    empty = frame([(1, "x")]).limit(0)
    assert judged(empty).count() == 0 and keep_good(empty).count() == 0


def test_the_pool_of_all_is_found_among_many_languages(spark):
    from pyspark.sql import functions as F

    from emberline.llm.quality import pooled_rows

    pool = F.lit("\u0001pooled")
    names = spark.range(0, 12_000, 1, 4).select(F.when(F.col("id") == 11_999, pool).otherwise(F.concat(F.lit("l"), "id")).alias("g_lang"))
    rows = spark.createDataFrame([("l1", [1.0]), (None, [2.0]), ("z", [3.0])], "lang string, x array<double>")
    found = sorted((r.lang, r.source, r.x[0]) for r in pooled_rows(rows, names, pool).collect())
    assert found == [("\u0001pooled", "\u0001pooled", k) for k in (1.0, 2.0, 3.0)] + [("l1", "\u0001pooled", 1.0)]
    assert pooled_rows(rows, names.filter(F.col("g_lang") != pool), pool).count() == 1
    assert pooled_rows(rows, names.limit(0), pool).count() == 0


def test_null_groups(frame):
    rng = random.Random(6)
    docs = frame([(i, prose(rng, 100)) for i in range(30)], lang=None, source=None)
    assert judged(docs).filter("kept").count() == 30


def test_query(spark):
    import duckdb

    found = {r.doc_id: r for r in op10_robust_outliers(spark, SF_DIR).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text, quality FROM '{SF_DIR}/documents.parquet' LEFT JOIN '{SF_DIR}/labels.parquet' USING (doc_id)").fetchall()
    assert len(found) == len(rows)
    for doc_id, text, quality in rows:
        r, expected = found[doc_id], plain_counts(text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r.base_failed and r.kept)
        assert r.kept or r.base_failed or quality != 1
