"""Benchmark decontamination by greedy string tiling.

Words of a test item and of a document are matched by tiles: again and again the longest run of words that both have, and that no tile has
taken yet on either side, becomes a tile, until none of ``tile`` words is left. Runs are found from shared seeds: all word windows of ``tile`` words have
a Karp-Rabin hash, those of a document are looked up in the sorted hashes of the test items, and hits in a row on one diagonal make a
run, whose words are compared. An item is leaked by a document if its tiles cover the stated share of its words, in whatever order they stand.

Test items are the stated query set: they go to the tasks in blocks of bounded size, each document is matched in its own task, and
nothing is shuffled. Items whose windows in the document could not cover enough are passed over before tiling, which changes no result.

Defined results: null and empty texts leak nothing; an item of fewer words than a tile can have no tile and is never leaked; repeated
documents or items give rows each; an empty table on either side gives no rows. Of tiles of one length that with the least place in the item, then in the
document, comes first. A very long text is matched whole: seeds are turned into runs SEEDS at a time, so memory follows the text, the block of items
and the runs, not the pairs of equal windows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from emberline.llm.common import importable, map_batches

TILE = 4
COVERED = 0.5
# Characters of test items that a task holds at a time.
BLOCK_CHARACTERS = 8_000_000
# Pairs of equal windows that are held at a time.
SEEDS = 1_000_000
WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows: polynomials of the word numbers modulo 2^64."""
    n = len(ids) - size + 1
    code = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        for k in range(size):
            code = code * _BASE + mixed[k : k + n]
    return code


def joined(diagonal: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows that follow each other on a diagonal made one."""
    order = np.lexsort((start, diagonal))
    diagonal, start, windows = diagonal[order], start[order], windows[order]
    follows = (diagonal[1:] == diagonal[:-1]) & (start[1:] == start[:-1] + windows[:-1])
    heads = np.flatnonzero(np.concatenate(([True], ~follows))) if len(start) else np.zeros(0, np.int64)
    return diagonal[heads], start[heads], np.add.reduceat(windows, heads) if len(heads) else windows


class Items:
    """A block of test items: word numbers, and the sorted hashes of their windows."""

    def __init__(self, items: list[tuple[int | None, str | None]], tile: int = TILE, covered: float = COVERED):
        self.tile, self.covered = tile, covered
        self.numbers: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        for item_id, text in items:
            words = words_of(text or "")
            if len(words) >= tile:
                self.ids.append(item_id)
                self.words.append(np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64))
        self.codes = codes = [window_hashes(w, tile) for w in self.words]
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order] if codes else np.zeros(0, np.int64)
        self.at = np.concatenate([np.arange(len(c)) for c in codes])[order] if codes else np.zeros(0, np.int64)

    def leaks(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, tiles, words covered, words of the item) of the items that ``text`` leaks."""
        if not len(self.code):
            return []
        words = words_of(text)
        doc = np.array([self.numbers.get(w, 0) for w in words], np.int64)
        code = window_hashes(doc, self.tile)
        different, which = np.unique(code, return_inverse=True)
        first, last = np.searchsorted(self.code, different, "left"), np.searchsorted(self.code, different, "right")
        shared = np.flatnonzero(last > first)
        if not len(shared):
            return []
        # Every window of the items that the document has, once, however often the document repeats it.
        counts = (last - first)[shared]
        hits = np.repeat(first[shared] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        item, at = self.item[hits], self.at[hits]
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        begins = np.flatnonzero(np.diff(item, prepend=-1))
        # A window covers the words up to the next one's start; an item's last window all of its own.
        reach = np.minimum(np.diff(at, append=0), self.tile)
        reach[np.append(begins[1:], len(at)) - 1] = self.tile
        places = np.flatnonzero((last > first)[which])
        found = []
        for k, most in zip(item[begins].tolist(), np.add.reduceat(reach, begins).tolist()):
            size = len(self.words[k])
            if most < self.covered * size:
                continue
            tiles = self.tiling(self.words[k], doc, self.runs(k, doc, code, places))
            covered = sum(n for _, _, n in tiles)
            if covered >= self.covered * size:
                found.append((self.ids[k], len(tiles), covered, size))
        return found

    def runs(self, k: int, doc: np.ndarray, code: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int]]:
        """The longest runs (- words, start in item ``k``, start in the document) of equal words of at least ``tile``. ``places`` are the windows of the
        document that may have an equal one."""
        a, order = self.words[k], np.argsort(self.codes[k], kind="stable")
        own = self.codes[k][order]
        first, last = np.searchsorted(own, code[places], "left"), np.searchsorted(own, code[places], "right")
        upto = np.cumsum(last - first)
        parts = []
        at = 0
        while at < len(places):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SEEDS, "right")))
            counts = (last - first)[at:end]
            seeds = np.repeat(first[at:end] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            a_at, b_at = order[seeds], np.repeat(places[at:end], counts)
            same = np.ones(len(a_at), bool)
            for step in range(self.tile):
                same &= a[a_at + step] == doc[b_at + step]
            parts.append(joined(b_at[same] - a_at[same], a_at[same], np.ones(int(same.sum()), np.int64)))
            at = end
        if not parts:
            return []
        # Runs that a cut has parted come together again.
        diagonal, start, windows = joined(*(np.concatenate(x) for x in zip(*parts)))
        return list(zip((-windows - self.tile + 1).tolist(), start.tolist(), (start + diagonal).tolist()))

    def tiling(self, a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Tiles (start in a, start in b, words), longest first; of equal ones that with the least starts."""
        heapq.heapify(runs)
        left = len(a)
        a_taken, b_taken = np.zeros(len(a), bool), np.zeros(len(b), bool)
        tiles = []
        while runs and left >= self.tile:
            n, i, j = heapq.heappop(runs)
            taken = a_taken[i : i - n] | b_taken[j : j - n]
            if not taken.any():
                a_taken[i : i - n] = b_taken[j : j - n] = True
                tiles.append((i, j, -n))
                left += n
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
            for s, e in zip(edges[::2], edges[1::2]):
                if e - s >= self.tile:
                    heapq.heappush(runs, (-int(e - s), i + int(s), j + int(s)))
        return tiles


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple]]:
    """The items in blocks of some ``size`` characters; a block at a time is on the driver."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // size
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
    tile: int = TILE, covered: float = COVERED, block: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """doc_id, item_id, n_tiles, covered_words, item_words, coverage: the leaked items of every document."""
    schema = "doc_id long, item_id long, n_tiles int, covered_words int, item_words int"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in item_blocks(benchmark, item_col, item_text_col, block):
        prepared = docs.sparkSession.sparkContext.broadcast(Items(items, tile, covered))

        def match(columns: dict[str, list], prepared=prepared) -> dict[str, list]:
            found = [(d, *leak) for d, t in zip(columns["doc_id"], columns["text"]) if t for leak in prepared.value.leaks(t)]
            names = [c.split()[0] for c in schema.split(", ")]
            return dict(zip(names, map(list, zip(*found)))) if found else {n: [] for n in names}

        made = map_batches(rows, match, schema)
        out = made if out is None else out.unionByName(made)
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text", tile: int = TILE,
    covered: float = COVERED, block: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    importable(docs)

    def free_of(prepared):
        def clean(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: not (t and prepared.value.leaks(t))).astype(bool)

        return F.pandas_udf(clean, "boolean")

    for items in item_blocks(benchmark, item_col, item_text_col, block):
        prepared = docs.sparkSession.sparkContext.broadcast(Items(items, tile, covered))
        docs = docs.filter(free_of(prepared)(F.col(text_col)))
    return docs


def op2_string_tiling(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
