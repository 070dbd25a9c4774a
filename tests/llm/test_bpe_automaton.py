import hashlib
import random

import numpy as np
import pytest

from emberline.llm import bpe_automaton as B

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(B.VOCABULARY))


def merged(word, merges, spelling):
    """BPE by its definition: the first merge that applies anywhere, at its leftmost places, until none applies."""
    tokens = [spelling[c] for c in word]
    while True:
        found = [(r, k) for k in range(len(tokens) - 1) for r, (u, v, _) in enumerate(merges) if (u, v) == (tokens[k], tokens[k + 1])]
        if not found:
            return tokens
        r, k = min(found)
        tokens[k : k + 2] = [merges[r][2]]


@pytest.mark.parametrize("seed", range(40))
def test_automaton_equals_merging(seed):
    rng = random.Random(seed)
    text = {i: c for i, c in enumerate("abc")}
    merges, seen = [], set(text.values())
    for _ in range(200):
        u, v = rng.choice(list(text)), rng.choice(list(text))
        if text[u] + text[v] not in seen and len(text[u] + text[v]) <= 7 and len(merges) < 14:
            w = len(text)
            text[w] = text[u] + text[v]
            seen.add(text[w])
            merges.append((u, v, w))
    machine, base = B.Automaton(text, merges, cache=5), {c: i for i, c in enumerate("abc")}
    for _ in range(150):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        assert machine.path(word) == merged(word, merges, base)
    assert machine.path("a" * 50) == merged("a" * 50, merges, base)


def test_a_dead_merge_makes_no_token():
    # a never stands before aa, so aaa comes from aa and a alone.
    text = {0: "a", 1: "aa", 2: "aaa"}
    merges = [(0, 0, 1), (0, 1, 2), (1, 0, 2)]
    machine = B.Automaton(text, merges)
    assert (0, 1) not in machine.block
    for n in range(12):
        assert machine.path("a" * n) == merged("a" * n, merges, {"a": 0})


def test_equals_the_library(library):
    rng, codec = random.Random(5), B.codec()
    letters = "aabdeehinnorst'S’ÉéİΣς ßǅ\t\x1c\x85 x́한中😀‍²½_-.<|>\x00"
    texts = ["", " ", "'S 's don't WE'RE", "<|endoftext|>a <|startoftext|>b", "<|ENDOFTEXT|>", "a" * 3000, "ab" * 2000, "1234 5½", "é É"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("aehilnorst") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 767), rng.randint(0xE000, 0x1FFFF)])) for _ in range(9)) for _ in range(2000)]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == expected
        assert codec.decode(codec.encode(text)) == library.decode(expected, skip_special_tokens=False)


def test_query(spark, frame, library, tmp_path):
    rows = [(1, "Hello, World's end"), (2, None), (3, ""), (4, "Hello, World's end"), (5, "long words " * 30_000), (1, "twice"), (None, "x")]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.op12_token_automaton(spark, str(tmp_path)).collect()}
    expected = set()
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False).encode()
        expected.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
    assert found == expected


def test_empty_table(spark, frame):
    assert B.decode(B.encode(frame([(1, "a")]).limit(0))).count() == 0
