"""Alignment of two tokenizers over a corpus: where their tokens end together, which of their ids overlap, and in how many documents.

A is a byte-level BPE, B a sentencepiece model that puts a blank in front; both read the bytes of blank + text. Offsets where tokens of both end cut
them into groups; two tokens are linked when their bytes overlap. The count of a pair of ids is the number of documents that hold it linked.

* **Identity map.** An array gives for each id of A the id of B with the same bytes. Pairs of that kind, nearly all groups of common words, are
  counted in one vector of the length of the vocabulary per task; only the other pairs, folded per task first, enter the shuffle as pairs.
* **Arrays.** The texts of a batch are laid end to end; the ends of the tokens of both sides, sorted together, cut the bytes into intervals, and each
  interval is the overlap of exactly one linked pair. Groups, links and their numbers follow from a few array operations a batch.
* **Counts come back** without a shuffle of documents: the identity pairs' and the best counts are vectors of vocabulary length, and of the
  other pairs the most frequent, ``HEAD`` at most by an exact count, are broadcast. Pairs below them are few to a document and in few documents each;
  they alone are joined by key.

Defined results: texts that are null or empty, or whose tokens' bytes are not blank + text (a text with U+2581), have no tokens: zeros and an empty
string. The strings of special tokens are plain text. Ties for the highest count all count as best. Texts of any length are aligned whole; repeated
rows are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.llm import tokens
from emberline.llm.common import cut, importable, reliable_cut

VOCABULARY_B = "piece_bpe_32k.model"
# Pairs whose counts are broadcast at most (16 bytes each), and links that a task gathers before it folds or emits them.
HEAD, FOLD = 2_000_000, 2_000_000
# Characters of text that are aligned at a time; a longer text is alone in its batch.
BATCH_CHARS = 500_000
BITS = 32


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.merge = tokens.Encoder(path_a, cache=1, plain=True).merge
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        bytes_a = tokens.token_bytes(path_a)
        self.bytes_b = [
            bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("\u2581", " ").encode()
            for i in range(self.model.get_piece_size())
        ]
        n_a, n_b = max(bytes_a) + 1, len(self.bytes_b)
        self.len_a = np.array([len(bytes_a.get(i, b"")) for i in range(n_a)], np.int64)
        self.len_b = np.array([len(v) for v in self.bytes_b], np.int64)
        # Of several ids of B with the same bytes, the piece goes before the byte.
        same = {self.bytes_b[i]: i for i in sorted(range(n_b), key=lambda i: not self.model.is_byte(i))}
        self.same = np.array([same.get(bytes_a.get(i), -1) for i in range(n_a)], np.int64)
        # What a token writes into the groups' text, by whether it is the last of its side in its group.
        self.written = [f"{i}{end}" for i in range(n_a) for end in ",|"] + [f"{i}{end}" for i in range(n_b) for end in ",;"]

    def _tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both token lists of each text, empty ones where B's bytes are others than blank + text (A's never are)."""
        right = self.model.encode(texts, num_threads=1)
        for k, text in enumerate(texts):
            if not text or b"".join(map(self.bytes_b.__getitem__, right[k])) != (" " + text).encode():
                right[k] = []
        return [self.merge(" " + text) if found else [] for text, found in zip(texts, right)], right

    def align(self, left: list[list[int]], right: list[list[int]]) -> Iterator[tuple]:
        """n_groups, the groups' text, keys of the linked pairs (sorted, each once), their links: for each pair of token lists over the same bytes."""
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (left, right))
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        upto_a, upto_b = np.cumsum(list(map(len, left))), np.cumsum(list(map(len, right)))
        # Where each text's bytes end.
        doc_ends = np.concatenate([[0], ends_a])[upto_a]
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        ends = ends[np.diff(ends, prepend=-1) > 0]
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        common = ends[(ends_a[at_a] == ends) & (ends_b[at_b] == ends)]
        n_groups = np.diff(np.searchsorted(common, doc_ends, "right"), prepend=0)
        # Tokens in the order of the text: a group's tokens of A, then those of B.
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a + (common[group_a] == ends_a)
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (len(self.len_a) + b) + (common[group_b] == ends_b)
        written = list(map(self.written.__getitem__, order.tolist()))
        # Links: text, a, b as one number, so that one sort serves the batch.
        n_b = len(self.len_b)
        size = len(self.len_a) * n_b
        found, links = np.unique(np.searchsorted(doc_ends, ends) * size + a[at_a] * n_b + b[at_b], return_counts=True)
        firsts = np.searchsorted(found, np.arange(len(left) + 1) * size)
        keys = (found % size) // n_b << BITS | found % n_b
        upto = [0, *(upto_a + upto_b).tolist()]
        for k in range(len(left)):
            some = slice(firsts[k], firsts[k + 1])
            yield int(n_groups[k]), "".join(written[upto[k] : upto[k + 1]])[:-1], keys[some], links[some]

    def rows(self, texts: list[str]) -> Iterator[tuple]:
        """n_a, n_b, n_groups, groups' text, keys, links of each text."""
        left, right = self._tokens(texts)
        for a, b, found in zip(left, right, self.align(left, right)):
            yield len(a), len(b), *found


@lru_cache(maxsize=1)
def aligner(vocabulary_a: str = tokens.VOCABULARY, vocabulary_b: str = VOCABULARY_B) -> Aligner:
    """The aligner of this Python worker; paths that exist on every machine, or names among the public tokenizers' files."""
    return Aligner(tokens.vocabulary_path(vocabulary_a), tokens.vocabulary_path(vocabulary_b))


def by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of (place, doc_id, text) with some BATCH_CHARS characters each."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
    first = chars = 0
    for k, n in enumerate(lengths):
        if k > first and chars + n > BATCH_CHARS:
            yield batch.slice(first, k - first)
            first, chars = k, 0
        chars += n
    if first < len(lengths):
        yield batch.slice(first)


LINKED = (
    "place long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "same_ids binary, same_n binary, pair_keys binary, pair_n binary"
)


def aligned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_a: str = tokens.VOCABULARY, vocabulary_b: str = VOCABULARY_B,
    keep_groups: bool = False,
) -> DataFrame:
    """A row per document: numbers of tokens, groups and links, the groups' digest (and, with ``keep_groups``, their text), the ids of A that are
    linked with their same-bytes id (u32) and the keys of the other linked pairs (i64), each with its links (u32) in the document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema_text = LINKED + (", groups string" if keep_groups else "")
    schema = to_arrow_schema(_parse_datatype_string(schema_text))

    def row(place, doc_id, n_a: int, n_b: int, n_groups: int, text: str, keys: np.ndarray, n: np.ndarray, same: np.ndarray) -> tuple:
        plain = same[keys >> BITS] == keys & ((1 << BITS) - 1)
        return (
            place, doc_id, n_a, n_b, n_groups, int(n.sum()), hashlib.sha256(text.encode()).hexdigest() if text else "",
            (keys[plain] >> BITS).astype("<u4").tobytes(), n[plain].astype("<u4").tobytes(),
            keys[~plain].tobytes(), n[~plain].astype("<u4").tobytes(), text,
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(vocabulary_a, vocabulary_b)
        for batch in batches:
            for part in by_length(batch):
                places, ids, texts = (c.to_pylist() for c in part.columns)
                found = own.rows([t or "" for t in texts])
                rows = [row(p, i, *x, own.same) for p, i, x in zip(places, ids, found)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    rows = docs.select(
        F.monotonically_increasing_id().alias("place"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return importable(rows).mapInArrow(task, schema_text)


def pair_counts(links: DataFrame, vocabulary_a: str = tokens.VOCABULARY, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """key (a << 32 | b), n: the documents that hold each linked pair, of a stored table of ``aligned`` rows."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = aligner(vocabulary_a, vocabulary_b).same
        vector = np.zeros(len(same), np.int64)
        folded, waiting, n_waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            found, counts = np.unique(np.concatenate(waiting or [np.zeros(0, np.int64)]), return_counts=True)
            keys, inverse = np.unique(np.concatenate([folded[0], found]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, inverse, np.concatenate([folded[1], counts]))
            return keys, n

        rows = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], schema=schema)
        for batch in batches:
            for part in cut(batch, 500):
                plain = np.frombuffer(b"".join(part.column(0).to_pylist()), "<u4")
                vector += np.bincount(plain, minlength=len(vector))
                waiting.append(np.frombuffer(b"".join(part.column(1).to_pylist()), "<i8"))
                n_waiting += len(waiting[-1])
                if n_waiting >= FOLD:
                    folded, waiting, n_waiting = fold(), [], 0
                    if len(folded[0]) >= FOLD:
                        yield rows(*folded)
                        folded = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield rows(*fold())
        met = np.flatnonzero(vector)
        yield rows(met << BITS | same[met], vector[met])

    folded = importable(links.select("same_ids", "pair_keys")).mapInArrow(task, "key long, n long")
    return folded.groupBy("key").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, most: int) -> int:
    """The least count n for which at most ``most`` pairs have n or more, among powers of two."""
    level = F.floor(F.log2("n")).cast("int")
    found = {r.level: r.pairs for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect()}
    total, least = 0, max(found, default=0) + 1
    for k in sorted(found, reverse=True):
        total += found[k]
        if total > most:
            break
        least = k
    return 1 << least


def with_counts(
    links: DataFrame, counts: DataFrame, head: int = HEAD, vocabulary_a: str = tokens.VOCABULARY, vocabulary_b: str = VOCABULARY_B
) -> DataFrame:
    """place, n_best, count_sum of stored ``aligned`` rows: links whose pair's count is the highest of its id of A, and the sum of the counts
    of all links. ``counts`` is a stored table of ``pair_counts``."""
    spark: SparkSession = links.sparkSession
    a = F.shiftright("key", BITS)
    least = head_of(counts, head)
    numbers = lambda df: [c.to_numpy() for c in df.toArrow().columns]
    ids, best = numbers(counts.groupBy(a.alias("a")).agg(F.max("n").alias("n")))
    keys, n = numbers(counts.filter(F.col("n") >= least))
    # Sizes: one row per id of A, and at most ``head`` pairs, counted above.
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((ids, best, keys[order], n[order]))
    schema = pa.schema([("place", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("rare", pa.list_(pa.int64())), ("rare_n", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = aligner(vocabulary_a, vocabulary_b).same
        ids, best, keys, n = shared.value
        highest = np.zeros(len(same), np.int64)
        highest[ids] = best

        def look(asked: np.ndarray) -> np.ndarray:
            """Counts, 0 for a pair that is not in the head."""
            at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
            return np.where(keys[at] == asked, n[at], 0) if len(keys) else np.zeros(len(asked), np.int64)

        for batch in batches:
            for part in cut(batch, 500):
                place, same_ids, same_n, pair_keys, pair_n = (c.to_pylist() for c in part.columns)
                plain = np.frombuffer(b"".join(same_ids), "<u4").astype(np.int64)
                asked = np.concatenate([plain << BITS | same[plain], np.frombuffer(b"".join(pair_keys), "<i8")])
                links = np.frombuffer(b"".join(same_n + pair_n), "<u4").astype(np.int64)
                sizes = [len(x) // 4 for x in same_n + pair_n]
                doc = np.repeat(np.tile(np.arange(len(place)), 2), sizes)
                found = look(asked)
                n_best, count_sum = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                np.add.at(n_best, doc, links * ((found == highest[asked >> BITS]) & (found > 0)))
                np.add.at(count_sum, doc, links * found)
                rare, rare_n = [[] for _ in place], [[] for _ in place]
                for k in np.flatnonzero(found == 0):
                    rare[doc[k]].append(int(asked[k]))
                    rare_n[doc[k]].append(int(links[k]))
                columns = [place, n_best, count_sum, rare, rare_n]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

    asked = links.select("place", "same_ids", "same_n", "pair_keys", "pair_n")
    schema_text = "place long, n_best long, count_sum long, rare array<long>, rare_n array<long>"
    scored = importable(asked).mapInArrow(task, schema_text)
    if least <= 1:
        return scored.select("place", "n_best", "count_sum")
    # Rare pairs: fewer than ``least`` documents each, so no key is hot.
    scored = reliable_cut(scored, "scored")
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
    rare = counts.filter(F.col("n") < least).withColumn("a", a).join(F.broadcast(highest), "a").select("key", "n", "highest")
    added = (
        scored.select("place", F.explode(F.arrays_zip("rare", "rare_n")).alias("r"))
        .select("place", F.col("r.rare").alias("key"), F.col("r.rare_n").alias("links"))
        .join(rare, "key")
        .groupBy("place")
        .agg(F.sum(F.when(F.col("n") == F.col("highest"), F.col("links")).otherwise(0)).alias("b"), F.sum(F.col("links") * F.col("n")).alias("s"))
    )
    return scored.join(added, "place", "left").select(
        "place", (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum")
    )


def alignment_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    links = reliable_cut(aligned(docs, id_col, text_col), "aligned")
    counts = reliable_cut(pair_counts(links), "pair-counts")
    scores = with_counts(links, counts, head)
    return links.join(scores, "place").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_identity_map(spark, sf_dir: str) -> DataFrame:
    return alignment_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
