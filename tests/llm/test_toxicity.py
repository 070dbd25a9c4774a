"""Decoding of hidden words, the channel's search against all paths, held-out accuracy."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from emberline.llm import toxicity
from emberline.llm.toxicity import CLASSES, LetterModel, Restorer, code_of, fit, fit_rows, fold_of, lattice, letter_triples, op7_noisy_channel, score, viterbi

SF_DIR, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def model_of(text):
    code = [0, *(code_of(c) if c.isalpha() else 0 for c in text.lower()), 0]
    counts = np.zeros(CLASSES**3)
    for a, b, c in zip(code, code[1:], code[2:]):
        counts[(a * CLASSES + b) * CLASSES + c] += 1
    return LetterModel(counts)


TEXT = "the idiot and the moron said stupid things about a clown who is a pathetic loser and worthless scum it is disgusting trash of them " * 5


def test_viterbi_equals_all_paths():
    model = model_of(TEXT)
    for token in ("1d10t", "m0r0n", "cl*wn", "lo55er", "sttuuupid", "7ra$h", "aabb", "|d|ot"):
        places = lattice(token)
        best = min(
            (sum(c for _, c in path) - sum(
                model.log[x][y][z] for x, y, z in zip(*(
                    lambda s: (s, s[1:], s[2:]))([0, 0, *(code_of(c) for p, _ in path for c in p), 0]))), "".join(p for p, _ in path))
            for path in itertools.product(*places)
        )
        assert viterbi(places, model) == best[1], token


def test_hidden_words_come_back():
    words = Restorer(model_of(TEXT), cache=8).words
    for hidden, word in {
        "1d10t": "idiot", "M0r0n!": "moron", "st00pid": None, "i d i o t": "idiot", "idiooooot": "idiot", "p@thet1c": "pathetic",
        "w.o.r.t.h.l.e.s.s": "worthless", "tr@$h,": "trash", "lo$er": "loser", "$cum": "scum", "s-c-u-m": "scum", "sttuuupid": "stupid",
        "(clown)": "clown", "***trash***": "trash", "plain": "plain", "I D I O T": "idiot",
    }.items():
        assert word is None or word in words(f"the {hidden} of them"), hidden
    assert words("a b") >= {"a", "b"} and words("   ") == set()


def test_long_and_joined_tokens_are_decoded():
    words = Restorer(model_of(TEXT), cache=8).words
    filler = "said about them" * 4
    for hidden, word in {
        f"idi{'o' * 60}t": "idiot", f"m0r{'o' * 500}n!": "moron", "idiot,moron": "moron", "idiot/moron": "idiot", "idiot:m0r0n": "moron",
        '{"id":1,"user":"someone","text":"an-1d10t_and:$cum","more":[1,2,3]}': "idiot", "they,said/that:he=is;a$cum,and,$cum:of/them;all=day": "scum",
        "_".join(["said", "about"] * 8 + ["p@thet1c"] + ["them"] * 8): "pathetic", ".".join(["that"] * 12 + ["id.i0t"] + ["them"] * 12): "idiot",
        f"{filler}m0r0n{filler}".replace(" ", ""): "moron", f"{filler}{filler}1d1ot{filler}".replace(" ", ""): "idiot",
    }.items():
        assert word in words(f"the {hidden} of them"), hidden
    long = "the,".join(["said"] * 30) + ",whatever,skills,pathetically"
    assert not {"hate", "kill", "pathetic"} & words(long + ",2")
    some = Restorer(model_of(TEXT), wanted={"moron": 1.0}).words(f"{filler}m0r0n{filler}".replace(" ", ""))
    assert "moron" in some and len(some) < 10


def test_triples_cover_all_texts(frame):
    counts = letter_triples(frame([(k, t) for k, t in enumerate(["ab", None, "", "Abé", "b" * 100])])).reshape(CLASSES, CLASSES, CLASSES)
    assert counts[2, 2, 2] >= 98 and counts.sum() >= 100


def test_fit_never_sees_fold_nought_and_is_bounded(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (7, None), (8, 5), (3, 1)], "doc_id long, toxic int")
    picked = fit_rows(labels, rows=40)
    assert picked.count() == 40 and picked.filter(fold_of(F.col("fit_id")) == 0).count() == 0
    assert fit_rows(labels).filter("fit_id is null").count() == 0


def test_cases(spark, frame):
    docs = frame([(k, f"word{k} plain text " + ("you idiot" if k % 2 else "you friend")) for k in range(120)] + [(900, None), (901, ""), (901, ""), (902, "an 1d1ot"), (903, "i d i o t " * 3), (904, "friend")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, toxic int")
    out = score(docs, fit(docs, labels)).collect()
    assert len(out) == 126
    by = {r.doc_id: r.score for r in out}
    assert all(0 <= s <= 1 for s in by.values())
    assert by[902] > 0.5 and by[903] > 0.5 and by[904] < 0.5 and by[900] < 0.5 and by[901] == by[900]
    one_class = score(docs, fit(docs, labels.filter("toxic = 0"))).collect()
    assert {r.score for r in one_class} == {0.0}
    assert score(docs.limit(0), fit(docs, labels)).count() == 0


def test_query_on_held_out_rows(spark):
    import duckdb
    import zlib

    found = {r.doc_id: r for r in op7_noisy_channel(spark, LARGER).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{LARGER}/labels.parquet'").fetchall())
    assert len(found) == duckdb.sql(f"SELECT count(*) FROM '{LARGER}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in found.items())
    held = [(r.score, labels[i]) for i, r in found.items() if r.held_out and i in labels]
    toxic, other = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + (a == b) / 2 for a in toxic for b in other) / (len(toxic) * len(other))
    right = sum((s >= 0.5) == bool(y) for s, y in held) / len(held)
    assert auc > 0.93 and right > 0.97, (auc, right)
    assert math.isfinite(auc) and toxicity.FIT_ROWS >= 10_000
