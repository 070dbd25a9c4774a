"""Token ids in files of bit-plane or byte-plane blocks.

A file is a magic word, the planes of its blocks one after the other, and a footer. A block holds up to ``BLOCK`` ids as unsigned
32-bit numbers, transposed into 4 byte planes (or 32 bit planes), each plane compressed with zstandard. The footer has the chunk index, from which any
run of ids can be read without the rest, and the documents with their lengths. All-zero planes cost a few bytes.

Documents are range-partitioned by id before they are encoded, so the files in order of their first id hold all documents in ascending
order; a position in the corpus is a file's base (the ids of all files before it) plus a position in it.

Defined results: a null or empty text has only the end id; a null doc_id comes first; repeated rows are documents of their own; an empty
table has no files and no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.llm import tokens
from emberline.llm.common import AtomicFile, cut, importable, open_input, reliable_cut, scratch_path

MAGIC = b"PLANES01"
BLOCK = 65_536
END_ID = 2
LEVEL = 3


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Plane by plane, most significant first."""
    octets = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return [np.packbits(column).tobytes() for column in np.unpackbits(octets, axis=1).T]
    return [octets[:, n].tobytes() for n in range(4)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        octets = np.packbits(bits, axis=1)
    else:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(octets).view(">u4").ravel().astype("<u4")


class Writer:
    def __init__(self, folder: str, stem: str, bits: bool = False, block: int = BLOCK):
        import zstandard

        self.file = AtomicFile(folder, stem, ".planes")
        self.file.write(MAGIC)
        self.bits, self.block, self.pack = bits, block, zstandard.ZstdCompressor(level=LEVEL).compress
        self.index: list[list[int]] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.pending: list[bytes] = []
        self.n_pending = self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.pending.append(ids)
        self.n_pending += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_pending >= self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        upto = len(ids) if last else len(ids) // self.block * self.block
        for at in range(0, upto, self.block):
            part = ids[at : min(at + self.block, upto)]
            packed = [self.pack(p) for p in to_planes(part, self.bits)]
            begins = self.file.write(b"".join(packed))
            self.index.append([len(part), begins, *map(len, packed)])
        self.pending, self.n_pending = [ids[upto:].tobytes()], len(ids) - upto

    def close(self) -> str:
        self._flush(last=True)
        footer = self.pack(json.dumps({"chunks": self.index, "docs": self.docs, "lengths": self.lengths}).encode())
        self.file.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.file.close()
        return self.file.path


class Reader:
    def __init__(self, path: str):
        import zstandard

        self.unpack = zstandard.ZstdDecompressor().decompress
        self.source = open_input(path)
        size = self.source.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a complete plane file: {path}")
        n = int.from_bytes(tail[:8], "little")
        footer = json.loads(self.unpack(self._at(size - 16 - n, n)))
        self.chunks, self.docs, self.lengths = footer["chunks"], footer["docs"], footer["lengths"]
        self.firsts = np.cumsum([0, *(c[0] for c in self.chunks)])

    def _at(self, begins: int, n: int) -> bytes:
        self.source.seek(begins)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        n, begins, *sizes = self.chunks[k]
        data, planes, at = self._at(begins, sum(sizes)), [], 0
        for size in sizes:
            planes.append(self.unpack(data[at : at + size]))
            at += size
        return from_planes(planes, n)

    def run(self, start: int, length: int) -> np.ndarray:
        """``length`` ids from position ``start`` of the file; only the chunks they lie in are read."""
        if length <= 0:
            return np.zeros(0, "<u4")
        first = int(np.searchsorted(self.firsts, start, "right")) - 1
        last = int(np.searchsorted(self.firsts, start + length, "left"))
        ids = np.concatenate([self.chunk(k) for k in range(first, last)])
        return ids[start - self.firsts[first] :][:length]

    def checksums(self) -> Iterator[int]:
        """The crc32 of each document's ids, chunk after chunk, so that one chunk is in memory at a time."""
        k, ids = -1, np.zeros(0, "<u4")
        for length in self.lengths:
            crc, left = 0, length
            while left:
                if not len(ids):
                    k += 1
                    ids = self.chunk(k)
                crc = zlib.crc32(ids[:left].tobytes(), crc)
                left, ids = left - len(ids[:left]), ids[left:]
            yield crc

    def close(self) -> None:
        self.source.close()


def write_tokens(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.VOCABULARY,
    end_id: int = END_ID, bits: bool = False, block: int = BLOCK,
) -> DataFrame:
    """Write files below ``folder``; returns their manifest (path, first_doc, n_docs, n_ids), one row per file."""
    ending = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = tokens.encoder(vocabulary).encode, None
        for batch in batches:
            for part in cut(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    out = out or Writer(folder, "tokens", bits, block)
                    out.add(doc_id, encode(text or "") + ending)
        if out:
            row = [out.close()], [out.docs[0]], [len(out.docs)], [out.n_ids]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed = rows.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return importable(placed).mapInArrow(task, "path string, first_doc long, n_docs long, n_ids long")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, path: every document from the files of a stored manifest. The manifest has a row per file,
    so it is ordered on the driver."""
    files = sorted(manifest.collect(), key=lambda r: (r.first_doc is not None, r.first_doc or 0, r.path))
    based, base = [], 0
    for r in files:
        based.append((r.path, base))
        base += r.n_ids
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("path", pa.string())]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = Reader(path)
                starts = at + np.cumsum([0, *file.lengths])[:-1]
                made = [file.docs, starts, file.lengths, list(file.checksums()), [path] * len(file.docs)]
                file.close()
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, schema)], schema=schema)

    listed = spark.createDataFrame(based, "path string, base long").repartition(max(1, len(based)))
    return importable(listed).mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def op4_bit_planes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = reliable_cut(write_tokens(docs, scratch_path(spark, "tokens")), "token-files")
    return read_tokens(spark, manifest)
