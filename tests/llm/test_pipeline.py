"""The corpus pipeline stage by stage, each against plain Python on its own input."""

import re

import numpy as np

import corpus_pipeline
from emberline.llm.common import reliable_cut, table
from tests.llm.test_quality import plain_counts
from tests.llm.test_secrets import plain_base
from tests.llm.test_similarity import expected, shingles
from tests.llm.test_tokens import check_packed, ids_of

SF_DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "packing"]
    docs = table(spark, SF_DIR, "documents")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(reliable_cut(stage(spark, steps[-1], SF_DIR), name))
        if name != "packing":
            assert steps[-1].dtypes == docs.dtypes, name
    given, good, single, clean, safe, packed = (rows_of(s) for s in steps)

    assert set(good) <= set(given)
    for row in given:
        c = plain_counts(row[1] or "")
        if c[0] < 20 or 100 * c[4] > 30 * c[0]:
            assert row not in good
    assert len(good) > 0.75 * len(given)

    component = {i: c for i, _, c in expected([(r[0], r[1]) for r in good])}
    assert single == [r for r in good if component[r[0]] == r[0]]

    items = [r.text for r in table(spark, SF_DIR, "benchmark").collect()]
    whole = [" ".join(re.findall(r"\w+", t.lower())) for t in items]
    for r in single:
        if any(w in " ".join(re.findall(r"\w+", r[1].lower())) for w in whole):
            assert r not in clean
        elif not any(shingles(t) & shingles(r[1]) for t in items):
            assert r in clean

    assert [r[0] for r in safe] == [r[0] for r in clean]
    for before, after in zip(clean, safe):
        assert not plain_base(after[1]) and after[4] == len(after[1])
        assert before == after or "[SECRET]" in after[1]

    check_packed(steps[-1].collect(), {r[0]: [*ids_of(r[1]), 1] for r in safe})
    ran = rows_of(corpus_pipeline.run(spark, SF_DIR).select("doc_id", "start", "length", "ids_crc32"))
    assert [r[0] for r in ran] and sum(r[2] for r in ran) == sum(r[2] for r in packed)
    assert all(len(np.unique(r[-1])) > 0 for r in packed)


def test_all_are_registered():
    import __spark_entry__ as contract

    names = contract.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(k) for k in range(1, 14)} and "pipeline" in names
    assert "op5_digest_array" in contract.oracle_sql()
