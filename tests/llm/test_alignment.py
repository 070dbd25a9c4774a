import hashlib
import random
from collections import Counter

import pytest

from emberline.llm import alignment as A
from emberline.llm.common import reliable_cut

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def plain():
    """(tokens of A, tokens of B) of a text as (id, bytes), by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(v): v for v in shown} | {chr(256 + k): v for k, v in enumerate(v for v in range(256) if v not in shown)}

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        same = b"".join(s for _, s in left) == whole == b"".join(s for _, s in right)
        return (left, right) if same else ([], [])

    return tokens


def spans(tokens):
    at, out = 0, []
    for i, spelled in tokens:
        out.append((at, at + len(spelled), i))
        at += len(spelled)
    return out


def brute(docs, plain):
    rows, held = [], Counter()
    for doc_id, text in docs:
        a, b = map(spans, plain(text))
        links = [(x, y) for p, q, x in a for r, s, y in b if p < s and r < q]
        held.update(set(links))
        ends = sorted({q for _, q, _ in a} & {q for _, q, _ in b})
        groups, before = [], 0
        for end in ends:
            side = lambda t: ",".join(str(i) for p, q, i in t if before <= p and q <= end)  # noqa: B023, E731
            groups.append(side(a) + "|" + side(b))
            before = end
        rows.append((doc_id, len(a), len(b), groups, links))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return {
        (i, na, nb, len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
         hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, na, nb, g, links in rows
    }, held


def sample():
    rng = random.Random(8)
    parts = ["the", "Übergröße", "naïve", "  ", "\n ", " \n", "12345", "don't", "日本語", "😀", "x_y", "<s>", "</s>", "<|endoftext|>", "<0x41>", "aaa", "aaaaa", "\t", "ﬁ", "é", "\x00", "\x1c", "½", "Antidisestablishmentarianism", "the,", "."]
    docs = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for i in range(250)]
    docs += [(i + 300, "".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))) for i in range(100)]
    return docs + [(900, None), (901, ""), (902, " "), (903, "a▁b and more"), (904, " the"), (905, "the "), (906, docs[0][1]), (0, "twice"), (None, "no id")]


@pytest.mark.parametrize("head, fold, chars", [(A.HEAD, A.FOLD, A.BATCH_CHARS), (40, 50, 100), (0, 1, 1)])
def test_equals_brute_force(spark, frame, plain, monkeypatch, head, fold, chars):
    """Whether all pairs, some or none are in the broadcast head, however often tasks fold and whatever a batch holds, the result is the same."""
    monkeypatch.setattr(A, "FOLD", fold)
    monkeypatch.setattr(A, "BATCH_CHARS", chars)
    docs = sample()
    found = {tuple(r) for r in A.alignment_scores(frame(docs), head=head).collect()}
    assert found == brute(docs, plain)[0]


def test_pair_counts(spark, frame, plain):
    docs = sample()
    links = reliable_cut(A.aligned(frame(docs), keep_groups=True), "aligned")
    found = {(r.key >> 32, r.key & 0xFFFFFFFF): r.n for r in A.pair_counts(links).collect()}
    assert found == dict(brute(docs, plain)[1])
    assert {r.groups for r in links.filter("doc_id IN (900, 901, 903)").collect()} == {""}
    assert links.filter("doc_id = 905").first().groups.startswith("262|")


def test_groups_of_shifted_tokens():
    """Three bytes, of A in tokens of two and one, of B in one and two: one group, in which only the first of B and the last of A do not meet."""
    own = A.aligner()
    two = next(i for i in range(len(own.len_a)) if own.len_a[i] == 2)
    one = next(i for i in range(len(own.len_a)) if own.len_a[i] == 1)
    left = next(i for i in range(len(own.len_b)) if own.len_b[i] == 1)
    right = next(i for i in range(len(own.len_b)) if own.len_b[i] == 2)
    empty, (n_groups, text, keys, links) = own.align([[], [two, one]], [[], [left, right]])
    assert empty[:2] == (0, "") and n_groups == 1 and text == f"{two},{one}|{left},{right}"
    assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(n) for k, n in zip(keys, links)} == {(two, left): 1, (two, right): 1, (one, right): 1}


def test_long_text_and_empty_table(spark, frame, plain):
    text = "long text " * 40_000
    row = A.alignment_scores(frame([(1, text)])).first()
    assert row.n_a > 80_000 and row.n_a + row.n_b <= 2 * row.n_links and row.n_best == row.n_links == row.count_sum
    assert A.alignment_scores(frame([(1, "a")]).limit(0)).count() == 0
