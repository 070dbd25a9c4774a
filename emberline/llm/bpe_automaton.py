"""BPE by a token automaton that is compiled from the merges, one gadget after the other.

The automaton reads tokens; its state is the token read last. It begins as one loop over the base symbols, which accepts every spelling
symbol by symbol. The gadget of the merge ``u v -> w`` of rank r then

* blocks arc v behind u from r on (a state that ends in u takes v no longer),
* adds arc w wherever arc u could be taken at r, and
* lets the state behind w take over what is blocked behind v at r.

What is blocked later does not reach arcs and states that were made before. When all gadgets are in, exactly one path spells a word, and it is the
word's encoding. A gadget is kept as its block (u, v) -> r; the arcs and states that it hands down follow from the constituents of w, so
the table has one entry per merge, and an arc of the automaton is decided once and then looked up.

A word is walked symbol by symbol in a trie of the tokens: at each place one token ends, the one that the automaton admits, so the work is in
proportion to the length. Words come from the vocabulary file's own normalizer and pattern. Decoding emits the labels of the arcs.

Defined results: a null or empty text has no ids; the string of an added token in a text gives that token's id; texts of any length are encoded
whole; repeated rows, ties and other columns have no bearing on a row's ids; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberline.llm.common import cut, importable
from emberline.llm.tokens import byte_letters, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
# Cached pieces, words and arcs of a Python worker; longer pieces are encoded anew each time.
CACHE, CACHE_LETTERS = 250_000, 64
# Stands behind a word's last letter where the vocabulary marks word ends.
END = "\uffff"
START = -1
TOKEN = ""
NO_ARCS: dict[int, bool] = {}
NEVER = 1 << 40
# White space as Unicode has it, where words end in any case (fixed value).
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# The word pattern of the vocabulary for lower-case ASCII without blanks (fixed value).
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class Automaton:
    """Tokens by their spelling (symbols, END last where a word ends), and the merges in their order."""

    def __init__(self, spellings: dict[int, str], merges: list[tuple[int, int, int]], cache: int = CACHE):
        self.block: dict[tuple[int, int], int] = {}
        self.behind: dict[int, list[tuple[int, int]]] = {}
        self.ahead: dict[int, list[tuple[int, int]]] = {}
        made = {w for _, _, w in merges}
        for token in spellings.keys() - made:
            self.behind[token] = self.ahead[token] = [(token, NEVER)]
        for rank, (u, v, w) in enumerate(merges):
            # A merge whose parts never stand side by side makes nothing.
            if u in self.behind and v in self.behind and self.admits(u, v):
                self._gadget(rank, u, v, w)
        self.table: dict[int, dict[int, bool]] = {}
        self.most, self.n_table = cache, 0
        # Trie: a node's symbols lead to nodes, and TOKEN to the token that ends there.
        self.trie: dict = {}
        for token in self.behind:
            node = self.trie
            for symbol in spellings[token]:
                node = node.setdefault(symbol, {})
            node[TOKEN] = token

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        """Both lists name constituents with the rank up to which their blocks were handed down: of a state those at the token's end, of
        an arc those at its start."""
        self.block[u, v] = rank
        self.behind[w] = [(w, NEVER), *((t, min(upto, rank)) for t, upto in self.behind[v])]
        self.ahead[w] = [(w, NEVER), *((t, min(upto, rank)) for t, upto in self.ahead[u])]

    def admits(self, state: int, token: int) -> bool:
        """Whether the state behind a token has an arc for ``token``."""
        block = self.block
        for u, before in self.behind[state]:
            for v, upto in self.ahead[token]:
                rank = block.get((u, v))
                # An arc is made after its own gadget's block, so a block of the same rank reaches it (u = v).
                if rank is not None and rank < before and rank <= upto:
                    return False
        return True

    def _arc(self, state: int, token: int) -> bool:
        """Decide an arc and note it in the table."""
        if self.n_table >= self.most:
            self.table.clear()
            self.n_table = 0
        taken = self.table.setdefault(state, {})[token] = state == START or self.admits(state, token)
        self.n_table += 1
        return taken

    def path(self, word: str) -> list[int]:
        """The tokens of the one path that spells ``word``."""
        n, table = len(word), self.table
        last: list[int | None] = [START] + [None] * n
        begins = [0] * (n + 1)
        for at in range(n):
            state = last[at]
            if state is None:
                continue
            node, arcs = self.trie, table.get(state, NO_ARCS)
            for to in range(at, n):
                node = node.get(word[to])
                if node is None:
                    break
                token = node.get(TOKEN)
                if token is None:
                    continue
                taken = arcs.get(token)
                if taken or (taken is None and self._arc(state, token)):
                    last[to + 1], begins[to + 1] = token, at
        out = []
        while n:
            if last[n] is None:
                raise ValueError("the vocabulary has no token for a symbol")
            out.append(last[n])
            n = begins[n]
        return out[::-1]


class Codec:
    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.tokenizer = Tokenizer.from_file(path)
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.end = END if end else ""
        spell = lambda t: t.removesuffix(end) + END if end and t.endswith(end) else t
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.automaton = Automaton({i: spell(t) for t, i in ids.items()}, merges, cache)
        self.labels = {i: t for t, i in ids.items()}
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.labels.update({i: t for t, i in self.added.items()})
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.most = cache

    def _word(self, spelled: str) -> bytes:
        found = self.words.get(spelled)
        if found is None:
            found = np.array(self.automaton.path(spelled + self.end), "<u4").tobytes()
            if len(spelled) <= CACHE_LETTERS:
                if len(self.words) >= self.most:
                    self.words.clear()
                self.words[spelled] = found
        return found

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece without white space: lower-cased, split into words, each word walked."""
        if piece.isascii():
            # Printable or not, ASCII bytes keep their length in byte letters.
            words = [w.translate(self.letters) for w in _ASCII_WORDS.findall(piece.lower())]
        else:
            plain = self.tokenizer.normalizer.normalize_str(piece)
            words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
        return b"".join([self._word(w) for w in words])

    def _plain(self, text: str) -> list[bytes]:
        out, pieces = [], self.pieces
        for piece in _BLANKS.split(text):
            found = pieces.get(piece)
            if found is None:
                found = self._piece(piece)
                if len(piece) <= CACHE_LETTERS:
                    if len(pieces) >= self.most:
                        pieces.clear()
                    pieces[piece] = found
            out.append(found)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return b"".join(self._plain(text))
        out = []
        for k, part in enumerate(self.added_pattern.split(text)):
            out += [np.array([self.added[part]], "<u4").tobytes()] if k % 2 else self._plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the path, between blanks, as a vocabulary without decoder has it."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(vocabulary: str = VOCABULARY) -> Codec:
    """The codec of this Python worker. ``vocabulary``: a path that exists on every machine, or a name among the public ones."""
    return Codec(vocabulary_path(vocabulary))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers): one row per document, in the task that reads it."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = codec(vocabulary).encode
        for batch in batches:
            for part in cut(batch):
                ids = [to_ids(text or "") for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return importable(rows).mapInArrow(task, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, text of rows (doc_id, ids); null ids decode to the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_text = codec(vocabulary).decode
        for batch in batches:
            for part in cut(batch):
                texts = pa.array([to_text(ids or b"") for ids in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], schema=schema)

    return importable(encoded.select("doc_id", "ids")).mapInArrow(task, "doc_id long, ids binary, text string")


def op12_token_automaton(spark, sf_dir: str) -> DataFrame:
    back = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return back.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
