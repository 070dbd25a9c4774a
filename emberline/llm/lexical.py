"""Ranked lexical search with hashed max-sketches.

One pass over the documents counts what the weights need: documents, terms, and of each term of the items the documents that hold it. A second pass
ranks. In it every document becomes a sketch: an array of coordinates, SPREAD times as many as it has different terms, where a term's hash names its
coordinate and the largest impact of the terms that fall together stands there. The items of a block are looked up in all sketches of a batch at once: the
weighted sum of a document's coordinates is a bound from above on its score, as no term of the item has more impact than its coordinate shows.
Documents are then scored exactly from the highest bound down, until the bound is less than the lowest score of the best ``k`` that the task has
found, in this batch or before. Each task sends its best ``k`` per item, and the best of these are the result; no bound drops a document
that could belong to it, ties included.

Items are taken in blocks of bounded bytes; a block is one broadcast and two passes over the documents.

Defined results: a null, empty or sign-only text, of document or item, has no terms and no rows; documents without any term do not count; rows with
one item_id are one item with the terms of all of them; equal scores go by ascending doc_id, a null doc_id first; repeated rows of documents are
documents of their own; very long texts are read whole; without documents or items there are no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from emberline.llm.common import cut, importable, reliable_cut

TOP = 50
# Bytes of item text in a block, sketch coordinates per different term, and numbers that a batch of sketches or look-ups may hold.
BLOCK_BYTES, SPREAD, BATCH_CELLS = 2_000_000, 64, 4_000_000
BATCH_DOCS = 1_000
HASHES = 200_000
# A to Z in lower case; letters of terms (digits, a to z, all beyond ASCII) as they are; all else separates (fixed rule).
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: int, n_docs: int, n_terms: int) -> int:
    """A document's m: 50 and half its length in hundredths of the mean length."""
    return 50 + (50 * n * n_docs) // n_terms


class _Hashes(dict):
    def __missing__(self, term: bytes) -> int:
        if len(self) >= HASHES:
            self.clear()
        self[term] = code = xxhash.xxh3_64_intdigest(term)
        return code


@dataclass
class Block:
    """Items and their terms. ``starts`` and ``which`` list each item's terms as numbers."""

    items: list[int]
    vocabulary: list[bytes]
    starts: np.ndarray
    which: np.ndarray

    @classmethod
    def of(cls, rows: list) -> "Block":
        by_item: dict[int, set[bytes]] = {}
        for item, text in rows:
            by_item.setdefault(item, set()).update(terms(text))
        items = [i for i, found in by_item.items() if found]
        vocabulary = sorted(set().union(*(by_item[i] for i in items)))
        number = {t: k for k, t in enumerate(vocabulary)}
        lists = [sorted(number[t] for t in by_item[i]) for i in items]
        starts = np.cumsum([0, *map(len, lists)])[:-1]
        return cls(items, vocabulary, starts, np.array([k for found in lists for k in found], np.int64))

    def terms_of(self, k: int) -> np.ndarray:
        return self.which[self.starts[k] : self.starts[k + 1] if k + 1 < len(self.starts) else None]


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Block]:
    """All rows of an item share a block, so a block has about ``block_bytes`` of text, or one item's."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    for k in range(n):
        found = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        block = Block.of([(r.item_id, r.text) for r in found])
        if block.items:
            yield block


def corpus_counts(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and the documents that hold each term of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(shared.value)}
        asked = number.keys()
        n_docs = n_terms = 0
        held: Counter = Counter()
        for batch in batches:
            for part in cut(batch):
                for text in part.column(1).to_pylist():
                    found = terms(text)
                    if found:
                        n_docs, n_terms = n_docs + 1, n_terms + len(found)
                        held.update(asked & set(found))
        rows = [(-1, n_docs), (-2, n_terms), *((number[t], n) for t, n in held.items())]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows)], schema=schema)

    sums = importable(docs).mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in sums.collect()}
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(k, 0) for k in range(len(block.vocabulary))], np.int64)


class Ranking:
    """The best ``k`` documents of every item of a block that a task has met, in ascending order of (score, -id)."""

    def __init__(self, block: Block, n_docs: int, n_terms: int, weights: list[int], k: int):
        self.block, self.n_docs, self.n_terms, self.k = block, n_docs, n_terms, k
        self.weights = np.array(weights, np.int64)
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in block.vocabulary], np.uint64)
        self.pairs = [[(block.vocabulary[t], weights[t]) for t in block.terms_of(i).tolist()] for i in range(len(block.items))]
        self.best: list[list[tuple]] = [[] for _ in block.items]
        self.least = np.ones(len(block.items), np.int64)
        self.codes = _Hashes()
        self.scored = self.looked = 0

    def sketches(self, found: list[tuple[Counter, int]], width: int) -> np.ndarray:
        # An impact is below 1,000,000.
        out = np.zeros(len(found) * width, np.int32)
        for row, (held, m) in enumerate(found):
            tf = np.fromiter(held.values(), np.int64, len(held))
            impact = (1_000_000_000 * tf // (1000 * tf + 20 * m)).astype(np.int32)
            at = np.fromiter(map(self.codes.__getitem__, held), np.uint64, len(held)) & np.uint64(width - 1)
            np.maximum.at(out[row * width : (row + 1) * width], at.astype(np.int64), impact)
        return out.reshape(len(found), width)

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """Documents by items."""
        at = (self.hashes & np.uint64(sketches.shape[1] - 1)).astype(np.int64)
        weighted = sketches[:, at] * self.weights
        return np.add.reduceat(weighted[:, self.block.which], self.block.starts, axis=1)

    def add(self, ids: list, counted: list[tuple[Counter, int]]) -> None:
        """Documents of one batch: ids, and (terms with their numbers, m)."""
        by_width: dict[int, list[int]] = {}
        for row, (held, _) in enumerate(counted):
            by_width.setdefault(1 << max(6, (SPREAD * len(held) - 1).bit_length()), []).append(row)
        bounds = np.zeros((len(ids), len(self.block.items)), np.int64)
        for width, rows in by_width.items():
            step = max(1, BATCH_CELLS // max(width, len(self.block.which)))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                bounds[some] = self.bounds(self.sketches([counted[r] for r in some], width))
        self._rank(ids, counted, bounds)

    def _rank(self, ids: list, counted: list[tuple[Counter, int]], bounds: np.ndarray) -> None:
        self.looked += bounds.size
        for item in np.flatnonzero((bounds >= self.least).any(axis=0)).tolist():
            column = bounds[:, item]
            rows = np.flatnonzero(column >= self.least[item])
            best, pairs = self.best[item], self.pairs[item]
            for row in rows[np.argsort(-column[rows], kind="stable")].tolist():
                if column[row] < self.least[item]:
                    break
                held, m = counted[row]
                score = 0
                for term, w in pairs:
                    if term in held:
                        score += w * (1_000_000_000 * held[term] // (1000 * held[term] + 20 * m))
                self.scored += 1
                if score <= 0:
                    continue
                # A null id comes first among equals.
                entry = (score, math.inf if ids[row] is None else -ids[row], ids[row])
                if len(best) < self.k:
                    heapq.heappush(best, _Entry(entry))
                elif _Entry(entry) > best[0]:
                    heapq.heapreplace(best, _Entry(entry))
                if len(best) == self.k:
                    self.least[item] = best[0].of[0]

    def rows(self) -> Iterator[tuple]:
        for item, best in zip(self.block.items, self.best):
            for entry in best:
                yield item, entry.of[2], entry.of[0]


class _Entry:
    """Orders by score, then by descending id; the id itself, which may be null, is not compared."""

    __slots__ = ("of",)

    def __init__(self, of: tuple):
        self.of = of

    def __lt__(self, other: "_Entry") -> bool:
        return self.of[:2] < other.of[:2]


def ranked(docs: DataFrame, block: Block, k: int = TOP) -> DataFrame:
    """item_id, doc_id, score: the best ``k`` documents of each item in every task."""
    n_docs, n_terms, df = corpus_counts(docs, block)
    weights = [weight(n_docs, n) for n in df.tolist()]
    shared = docs.sparkSession.sparkContext.broadcast((block, weights))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        ranking = Ranking(block, n_docs, n_terms, weights, k)
        for batch in batches:
            for part in cut(batch, BATCH_DOCS):
                ids, counted = [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = terms(text)
                    if found:
                        ids.append(doc_id)
                        counted.append((Counter(found), length_part(len(found), n_docs, n_terms)))
                ranking.add(ids, counted)
        rows = list(ranking.rows())
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows[at : at + 10_000])], schema=schema)

    return importable(docs).mapInArrow(task, "item_id long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest scores above 0 of every item."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = [ranked(slim, block, k) for block in blocks(items, item_col, item_text_col, block_bytes)]
    if len(parts) > 1:
        parts = [reliable_cut(p, "ranked") for p in parts]
    none = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return (
        reduce(DataFrame.unionByName, parts or [none])
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


def op13_max_sketches(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
held AS (
    SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM held, corpus GROUP BY term
),
scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus
    GROUP BY item_id, doc_id
),
placed AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 50
"""
