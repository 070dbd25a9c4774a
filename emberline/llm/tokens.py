"""Token ids of texts by a public byte-level BPE, with a bounded cache of pieces.

A byte-level BPE with its usual word pattern never joins across the start of `` x`` (a blank before a non-blank), so a text may be encoded
piece by piece there, and a piece met before is only looked up. Other pieces are merged by tiktoken, over the ranks and the bytes of the
vocabulary file itself. Results are those of ``Tokenizer.encode(text, add_special_tokens=False)`` of the tokenizers library (tested, all code points
included): the string of a special token in a text gives that token's id, for which such texts go whole through the library, or, with
``plain``, it is ordinary text.
"""

from __future__ import annotations

import json
import re
import struct
from functools import cached_property, lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
# Cached pieces of a Python worker, some 45 MB at most; longer ones are not kept.
CACHE, CACHE_LETTERS = 250_000, 64
# A blank before white space or at the end: texts with one are split by the pattern below it.
_ODD_BLANK = re.compile(r" (?:\s|\Z)")
_BEFORE_WORD = re.compile(r" (?=\S)")
# The word pattern of byte-level BPE (fixed value).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, int]:
    """The letters (code points) that stand for bytes in a byte-level vocabulary: printable bytes are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(others)}


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is; a bare name is one of the public tokenizers' files."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every token of a byte-level vocabulary file, added ones left out."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    byte_of = {c: b for b, c in byte_letters().items()}
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        raise ValueError("the ids of the vocabulary do not follow its merges")
    return {i: bytes(map(byte_of.__getitem__, map(ord, t))) for t, i in model["vocab"].items()}


def added_strings(path: str) -> list[str]:
    """The strings of a vocabulary file's added tokens."""
    with open(path, encoding="utf-8") as file:
        return [t["content"] for t in json.load(file).get("added_tokens", [])]


class Encoder:
    def __init__(self, path: str, cache: int = CACHE, plain: bool = False):
        import tiktoken

        self.path = path
        added = [] if plain else added_strings(path)
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        ranks = {spelled: i for i, spelled in token_bytes(path).items()}
        self.merge = tiktoken.Encoding("pieces", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces: dict[str, bytes] = {}
        self.most = cache

    @cached_property
    def tokenizer(self):
        """The library's tokenizer, some 35 MB, loaded where a text holds the string of an added token."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _piece(self, piece: str) -> bytes:
        ids = self.merge(piece)
        made = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_LETTERS:
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            self.pieces[piece] = made
        return made

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *later = _BEFORE_WORD.split(text) if _ODD_BLANK.search(text) else text.split(" ")
        get = self.pieces.get
        # A piece of several ids is never empty, and the empty piece is no piece.
        out = [(get(first) or self._piece(first)) if first else b""]
        for piece in later:
            piece = " " + piece
            out.append(get(piece) or self._piece(piece))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY, plain: bool = False) -> Encoder:
    """The encoder of this Python worker. ``vocabulary``: a path that exists on every machine, or a name among the public ones."""
    return Encoder(vocabulary_path(vocabulary), plain=plain)
