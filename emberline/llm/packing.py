"""Hierarchical packing of documents into training sequences of several lengths.

A task packs the documents of its partition, so nothing is shuffled. Whole windows of the longest tier are cut off long documents; what is
left of them, and every short document, is routed to the smallest tier that holds it. Windows are opened from the longest pieces to the
shortest; a gap is filled with the longest piece that fits, which comes from a shorter tier, and when none fits, with the head of one.
So all windows are full, except that the last tokens of a partition are laid out in sequences of smaller powers of two. Sequences of a tier are
grouped into training steps of one token count.

Sequence and step numbers carry the partition number in their upper half. Documents are packed in rounds of bounded size.

Defined results: a null or empty text is its end id alone; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberline.llm import tokens
from emberline.llm.common import cut, freed, importable

TIERS = (256, 512, 1024, 2048)
END_ID = 1
STEP_TOKENS = 65_536
# A round of packing ends with this many pieces or ids.
ROUND_PIECES, ROUND_IDS = 8_192, 2_000_000
BATCH_ROWS = 1_000

# A piece: length, place in the round (for ties), document's number in the round, start.
Piece = tuple[int, int, int, int]


def open_windows(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows (tier, pieces in order) out of pieces no longer than the longest tier, and the pieces of the last window,
    which could not be filled."""
    pool, full = sorted(pieces), []
    while pool:
        window = [pool.pop()]
        tier = next(t for t in tiers if t >= window[0][0])
        gap = tier - window[0][0]
        while gap and pool:
            at = bisect_right(pool, (gap, 1 << 62))
            if at:
                window.append(pool.pop(at - 1))
                gap -= window[-1][0]
            else:
                n, k, doc, start = pool.pop(0)
                window.append((gap, k, doc, start))
                insort(pool, (n - gap, k, doc, start + gap))
                gap = 0
        if gap:
            return full, window
        full.append((tier, window))
    return full, []


def tail_windows(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """The last pieces, cut so that each sequence is a power of two long."""
    left, windows, queue = sum(p[0] for p in pieces), [], list(pieces)
    while left:
        tier = gap = 1 << (left.bit_length() - 1)
        window = []
        while gap:
            n, k, doc, start = queue.pop(0)
            window.append((min(n, gap), k, doc, start))
            if n > gap:
                queue.insert(0, (n - gap, k, doc, start + gap))
            gap -= window[-1][0]
        windows.append((tier, window))
        left -= tier
    return windows


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, "
    "step_group long"
)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.VOCABULARY, end_id: int = END_ID,
    tiers: tuple[int, ...] = TIERS, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece; with ``keep_ids`` also the piece's ids, as little-endian unsigned 32-bit integers."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema_text = SCHEMA + (", ids binary" if keep_ids else "")
    schema = to_arrow_schema(_parse_datatype_string(schema_text))
    ending, longest = np.array([end_id], "<u4").tobytes(), tiers[-1]

    class Packer:
        def __init__(self, partition: int):
            self.base = partition << 32
            self.sequences = self.steps = 0
            self.open_steps: dict[int, list[int]] = {}
            self.begin([], {})

        def begin(self, pieces: list[Piece], docs: dict[int, tuple]) -> None:
            self.pieces, self.docs, self.n_ids = pieces, docs, sum(len(d[1]) // 4 for d in docs.values())
            self.rows: list[tuple] = []
            self.next_doc = max(docs, default=-1) + 1

        def step_of(self, tier: int) -> int:
            """Steps hold sequences of one tier and STEP_TOKENS tokens."""
            step = self.open_steps.get(tier)
            if step is None or step[1] + tier > STEP_TOKENS:
                step = self.open_steps[tier] = [self.steps, 0]
                self.steps += 1
            step[1] += tier
            return self.base | step[0]

        def emit(self, tier: int, window: list[Piece]) -> None:
            at, step = 0, self.step_of(tier)
            for n, _, doc, start in window:
                doc_id, ids = self.docs[doc]
                part = ids[4 * start : 4 * (start + n)]
                row = (doc_id, start, n, zlib.crc32(part), len(ids) // 4, self.base | self.sequences, at, tier, step)
                self.rows.append((*row, part) if keep_ids else row)
                at += n
            self.sequences += 1

        def add(self, doc_id, ids: bytes) -> None:
            doc, self.next_doc = self.next_doc, self.next_doc + 1
            self.docs[doc] = (doc_id, ids)
            n = len(ids) // 4
            for start in range(0, n - longest + 1, longest):
                self.emit(longest, [(longest, 0, doc, start)])
            if n % longest:
                self.pieces.append((n % longest, doc, doc, n - n % longest))
            self.n_ids += n

        def end_round(self, last: bool) -> Iterator[pa.RecordBatch]:
            windows, rest = open_windows(self.pieces, tiers)
            for tier, window in windows + (tail_windows(rest) if last else []):
                self.emit(tier, window)
            rows = self.rows
            # A piece that was cut keeps its document until its rest is placed.
            self.begin([] if last else rest, {} if last else {p[2]: self.docs[p[2]] for p in rest})
            for at in range(0, len(rows), BATCH_ROWS):
                columns = zip(*rows[at : at + BATCH_ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

    @freed
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = tokens.encoder(vocabulary).encode, Packer(TaskContext.get().partitionId())
        for batch in batches:
            for part in cut(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    packer.add(doc_id, encode(text or "") + ending)
                    if len(packer.pieces) >= ROUND_PIECES or packer.n_ids >= ROUND_IDS:
                        yield from packer.end_round(last=False)
        yield from packer.end_round(last=True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return importable(rows).mapInArrow(task, schema_text)


def op6_multi_length_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
