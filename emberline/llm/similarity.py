"""Exact Jaccard join of documents on word shingles, with signature trees.

1. Every text becomes its set of shingle codes (64 bit); equal sets share a key, so copies are one set from here on.
2. Codes go to buckets by their upper bits, packed by batch, and those that are shared come back. A bucket knows how many sets have each of its codes. Codes of one set only
   can be in no overlap, so a set with less than the needed share of shared codes has no partner, and is done.
3. Of the sets left, the rarest codes - as many as must hold one common code of any linked pair - name the code's leader, that of its sets
   which has the fewest unshared codes. Sets that share a leader form a block; any linked pair meets in a block.
4. Blocks, cut into chunks of bounded weight, are joined in tasks: all sets are compared with the leader, then a signature tree over the
   chunk - nodes hold OR-ed code bitmaps and size ranges - is traversed against itself, and node pairs are pruned that cannot reach the overlap,
   or whose sets are linked already. What of a block with several chunks is not linked with its leader is then joined across chunks; a set
   that is further than twice the allowed distance from the leader cannot be linked with one that is near to it (the Jaccard distance is a metric).
5. Components of the links, and from sets back to documents.

A task emits a spanning forest of its links, never all pairs. All overlaps are counted on whole sets of codes; two different shingles of a pair of sets
fall together with a chance below 1e-8 (codes of 43 bits and more, more with the size of the corpus).

Defined results: documents without words have an empty set and are linked with nothing; fewer words than a shingle are one shingle; repeated rows are
linked as copies; rows with one id but different texts share the id's component only through their own links; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.common import cut, freed, fresh_name, importable, reliable_cut, small, without
from emberline.llm.components import components

SHINGLE = 5
# Two sets are linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
# Codes a bucket holds on average, and codes and sets of a chunk at most (one set may weigh more).
BUCKET_CODES, CHUNK_CODES, CHUNK_SETS = 2_000_000, 2_000_000, 4_096
# Codes that a task gathers before it deals them out.
BATCH_CODES = 1_000_000
KEY = 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# --- sets ------------------------------------------------------------------------------------------------------------------

class _WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


def shingle_codes(text: str, words: _WordCodes) -> np.ndarray:
    """The sorted distinct codes of a text's shingles. Bytes are split at ASCII white space and lower-cased A to Z only."""
    tokens = text.encode("utf-8").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    size = min(SHINGLE, len(ids))
    n = len(ids) - size + 1
    code = np.full(n, size, np.uint64)
    for k in range(size):
        code = (code ^ ids[k : k + n]) * _M1
        code ^= code >> np.uint64(32)
    code *= _M2
    return np.unique(code ^ (code >> np.uint64(29)))


def key_of(codes: np.ndarray) -> bytes:
    """12 bytes of digest and the size."""
    return xxhash.xxh3_128_digest(codes.tobytes())[: KEY - 4] + len(codes).to_bytes(4, "little")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_value(text_col).alias("h")
    )


def text_value(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (``text_value``), n_shingles, key (null for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary())])

    @freed
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordCodes()
        for batch in batches:
            for part in cut(batch):
                sets = [shingle_codes(t or "", words) for t in part.column(1).to_pylist()]
                keys = [key_of(s) if len(s) else None for s in sets]
                columns = [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return importable(_texts(docs, id_col, text_col)).mapInArrow(task, "doc_id long, h long, n_shingles long, key binary")


# --- shared codes ------------------------------------------------------------------------------------------------------------

def dealt_codes(docs: DataFrame, bits: int, id_col: str, text_col: str) -> DataFrame:
    """The different sets of a batch, dealt out by the upper ``bits`` of their codes.

    A row per batch and bucket: counts (u32, how many codes each set of the batch has there, zeros included) and codes (their lower
    40 bits, 5 bytes each, set after set). With as many buckets as the corpus asks for, two codes of a bucket fall together with a chance
    of some millionths at every size. A row with a negative bucket has the batch's keys.
    """
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("counts", pa.binary()), ("codes", pa.binary())])

    def deal(batch: int, sets: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        codes = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets.values()])
        bucket = (codes >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket, owner = bucket[order], owner[order]
        octets = np.ascontiguousarray(codes[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        edges = np.flatnonzero(np.diff(bucket)) + 1
        rows = [(-1 - batch % (1 << bits), batch, b"".join(sets), b"")]
        for s, e in zip([0, *edges], [*edges, len(bucket)]):
            counts = np.bincount(owner[s:e], minlength=len(sets)).astype("<u4")
            rows.append((int(bucket[s]), batch, counts.tobytes(), octets[s:e].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    @freed
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, sets, held, number = _WordCodes(), {}, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in cut(batch):
                for text in part.column(1).to_pylist():
                    codes = shingle_codes(text or "", words)
                    if len(codes) and (key := key_of(codes)) not in sets:
                        sets[key] = codes
                        held += len(codes)
                        if held >= BATCH_CODES:
                            yield deal(number, sets)
                            sets, held, number = {}, 0, number + 1
        if sets:
            yield deal(number, sets)

    return importable(_texts(docs, id_col, text_col)).mapInArrow(task, "bucket int, batch long, counts binary, codes binary")


def shared_codes(dealt: DataFrame, buckets: int) -> DataFrame:
    """The same rows, with those codes only that occur more than once in a bucket: their values (bucket above the 40 bits, 8 bytes
    each) and ``sets``, in how many sets of batches (u32 each). A set that stands in two batches counts twice, wherever it is met."""
    schema = pa.schema(
        [("batch", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("codes", pa.binary()), ("sets", pa.binary())]
    )

    def bucket_rows(bucket: int, parts: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        sizes = [len(octets) // 5 for _, _, octets in parts]
        code, at = np.zeros(sum(sizes), "<u8"), 0
        for (_, _, octets), n in zip(parts, sizes):
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = np.frombuffer(octets, np.uint8).reshape(-1, 5)
            code[at : at + n] = wide.view("<u8").ravel()
            at += n
        order = np.argsort(code, kind="stable")
        inorder = code[order]
        edges = np.flatnonzero(np.concatenate(([True], inorder[1:] != inorder[:-1], [True])))
        sets = np.empty(len(code), "<u4")
        sets[order] = np.repeat(np.diff(edges), np.diff(edges))
        del order, inorder
        code |= np.uint64(bucket) << np.uint64(40)
        at, rows = 0, []
        for (batch, counts, _), n in zip(parts, sizes):
            each = np.frombuffer(counts, "<u4").astype(np.int64)
            keep = sets[at : at + n] > 1
            upto = np.concatenate(([0], np.cumsum(keep)))
            ends = np.cumsum(each)
            left = (upto[ends] - upto[ends - each]).astype("<u4")
            rows.append((batch, bucket, left.tobytes(), code[at : at + n][keep].tobytes(), sets[at : at + n][keep].tobytes()))
            at += n
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    @freed
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in groups(batches, 1):
            if bucket < 0:
                columns = [[r[1] for r in rows], [bucket] * len(rows), [r[2] for r in rows], [b""] * len(rows), [b""] * len(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)
            else:
                yield from bucket_rows(bucket, [r[1:] for r in rows])

    placed = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return importable(placed).mapInArrow(task, "batch long, bucket int, counts binary, codes binary, sets binary")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted partition by their first ``keys`` columns."""
    now, rows = None, []
    for batch in batches:
        for part in cut(batch, 500):
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if row[:keys] != now and rows:
                    yield now, rows
                    rows = []
                now = row[:keys]
                rows.append(row)
    if rows:
        yield now, rows


def least_overlap(n: int) -> int:
    """Of a set of ``n`` codes, so many must be common with any set it is linked with."""
    return -(-PERCENT * n // 100)


def candidate_sets(dealt: DataFrame, buckets: int) -> DataFrame:
    """id, key, n, codes, sets of the sets whose shared codes reach the least overlap; stored."""
    schema = pa.schema([("key", pa.binary()), ("n", pa.int32()), ("codes", pa.binary()), ("sets", pa.binary())])

    def batch_rows(parts: list[tuple[int, bytes, bytes, bytes]]) -> list[tuple]:
        keys = next(counts for bucket, counts, _, _ in parts if bucket < 0)
        parts = [p for p in parts if p[0] >= 0]
        numbers = np.arange(len(keys) // KEY, dtype=np.int32)
        owner = np.concatenate([np.repeat(numbers, np.frombuffer(p[1], "<u4")) for p in parts])
        codes = np.concatenate([np.frombuffer(p[2], "<u8") for p in parts])
        sets = np.concatenate([np.frombuffer(p[3], "<u4") for p in parts])
        order = np.lexsort((codes, owner))
        owner, codes, sets = owner[order], codes[order], sets[order]
        ends = np.searchsorted(owner, numbers, "right")
        rows = []
        for k, end in enumerate(ends):
            begin = int(ends[k - 1]) if k else 0
            key = keys[KEY * k : KEY * (k + 1)]
            n = int.from_bytes(key[-4:], "little")
            if end - begin >= least_overlap(n):
                rows.append((key, n, codes[begin:end].tobytes(), sets[begin:end].tobytes()))
        return rows

    @freed
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, 1):
            found = batch_rows([r[1:] for r in rows])
            for at in range(0, len(found), 500):
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found[at : at + 500]), schema)], schema=schema)

    placed = shared_codes(dealt, buckets).repartition("batch").sortWithinPartitions("batch", "bucket")
    found = importable(placed).mapInArrow(task, "key binary, n int, codes binary, sets binary")
    stored = reliable_cut(found.withColumn("id", F.monotonically_increasing_id()), "sets")
    # A set that came from several batches is one set.
    ids = reliable_cut(stored.groupBy("key").agg(F.min("id").alias("id")).select("id"), "set-ids")
    return stored.join(small(ids), "id", "left_semi")


# --- blocks ------------------------------------------------------------------------------------------------------------------

def prefix_rows(sets: DataFrame) -> DataFrame:
    """code, id, unshared (per mille): the rarest codes of a set, of which a linked set has one among its own rarest."""
    schema = pa.schema([("code", pa.int64()), ("id", pa.int64()), ("unshared", pa.int32())])

    @freed
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, 200):
                codes, ids, unshared = [np.zeros(0, np.int64)], [], []
                for number, n, raw, counts in zip(*(c.to_pylist() for c in part.columns)):
                    code, sets_ = np.frombuffer(raw, "<u8"), np.frombuffer(counts, "<u4")
                    # Codes of one set only come first in the order of rarity.
                    take = n - least_overlap(n) + 1 - (n - len(code))
                    codes.append(code[np.lexsort((code, sets_))[: max(0, take)]].view(np.int64))
                    ids += [number] * len(codes[-1])
                    unshared += [1000 * (n - len(code)) // n] * len(codes[-1])
                columns = [np.concatenate(codes), ids, unshared]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

    return importable(sets.select("id", "n", "codes", "sets")).mapInArrow(task, "code long, id long, unshared int")


def block_members(sets: DataFrame) -> DataFrame:
    """leader, id: the blocks, leaders included; stored."""
    rows = reliable_cut(prefix_rows(sets), "rare-codes")
    leaders = (
        rows.groupBy("code").agg(F.min(F.struct("unshared", "id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        .select("code", F.col("first.id").alias("leader"))
    )
    return reliable_cut(rows.join(leaders, "code").select("leader", "id").distinct(), "blocks")


class Node:
    __slots__ = ("bits", "n_low", "n_high", "shared", "excess", "children", "first", "last")


def _needed(n: int, m: int) -> int:
    """Least overlap of linked sets of ``n`` and ``m`` codes: 100 i >= P (n + m - i)."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


class Chunk:
    """The sets of a join task, with a signature tree over them.

    A set's bitmap has a bit per code, by the code's hash. ``excess`` is the number of a set's codes beyond its bits; two sets have at most
    as many codes in common as their bitmaps have bits in common, plus the lesser excess.
    """

    LEAF, FAN = 16, 8

    def __init__(self, ids: list[int], sizes: list[int], codes: list[np.ndarray], width: int):
        # Like sizes, and of those like least codes, lie side by side.
        low = [int(((c * _M1) >> np.uint64(1)).min()) if len(c) else 0 for c in codes]
        order = sorted(range(len(ids)), key=lambda k: (sizes[k].bit_length(), low[k], sizes[k], ids[k]))
        self.ids, self.n = [ids[k] for k in order], np.array([sizes[k] for k in order], np.int64)
        self.codes = [codes[k] for k in order]
        self.shared = np.array([len(c) for c in self.codes], np.int64)
        self.bits = np.zeros((len(order), width // 64), np.uint64)
        for row, c in enumerate(self.codes):
            at = ((c * _M1) >> np.uint64(40)) % np.uint64(width)
            np.bitwise_or.at(self.bits[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.excess = self.shared - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        nodes = [self._leaf(s, min(s + self.LEAF, len(order))) for s in range(0, len(order), self.LEAF)]
        while len(nodes) > 1:
            nodes = [self._above(nodes[s : s + self.FAN]) for s in range(0, len(nodes), self.FAN)]
        self.root = nodes[0] if nodes else None

    def _leaf(self, first: int, last: int) -> Node:
        node = Node()
        node.first, node.last, node.children = first, last, ()
        node.bits = np.bitwise_or.reduce(self.bits[first:last], axis=0)
        node.n_low, node.n_high = int(self.n[first:last].min()), int(self.n[first:last].max())
        node.shared, node.excess = int(self.shared[first:last].max()), int(self.excess[first:last].max())
        return node

    @staticmethod
    def _above(children: list[Node]) -> Node:
        node = Node()
        node.first, node.last, node.children = children[0].first, children[-1].last, tuple(children)
        node.bits = np.bitwise_or.reduce([c.bits for c in children], axis=0)
        node.n_low, node.n_high = min(c.n_low for c in children), max(c.n_high for c in children)
        node.shared, node.excess = max(c.shared for c in children), max(c.excess for c in children)
        return node


def bitmap_width(codes: list[np.ndarray]) -> int:
    most = max((len(c) for c in codes), default=1)
    return min(65_536, max(512, 1 << (2 * most - 1).bit_length()))


class Groups:
    """Union-find over the sets of a task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def dual_join(a: Chunk, b: Chunk, seen: Groups) -> list[tuple[int, int]]:
    """Links between sets of ``a`` and ``b`` (which may be one chunk) that join groups not yet joined."""
    links: list[tuple[int, int]] = []
    if a.root is None or b.root is None:
        return links

    def one_group(first: Chunk, x: Node, second: Chunk, y: Node) -> bool:
        root = seen.root(first.ids[x.first])
        return all(seen.root(i) == root for i in first.ids[x.first : x.last]) and all(
            seen.root(i) == root for i in second.ids[y.first : y.last]
        )

    def possible(x: Node, y: Node) -> bool:
        if x.shared < least_overlap(y.n_low) or y.shared < least_overlap(x.n_low):
            return False
        need = _needed(x.n_low, y.n_low)
        return int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.excess, y.excess) >= need

    def leaves(x: Node, y: Node) -> None:
        rows, cols = slice(x.first, x.last), slice(y.first, y.last)
        common = np.bitwise_count(a.bits[rows, None, :] & b.bits[None, cols, :]).sum(axis=2, dtype=np.int64)
        most = common + np.minimum(a.excess[rows, None], b.excess[None, cols])
        total = a.n[rows, None] + b.n[None, cols]
        for i, j in np.argwhere((100 + PERCENT) * most >= PERCENT * total):
            i, j = int(i) + x.first, int(j) + y.first
            if (a is b and j <= i) or a.ids[i] == b.ids[j] or seen.root(a.ids[i]) == seen.root(b.ids[j]):
                continue
            p, q = a.codes[i], b.codes[j]
            at = np.searchsorted(q, p)
            both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
            if both >= _needed(int(a.n[i]), int(b.n[j])):
                seen.join(a.ids[i], b.ids[j])
                links.append((a.ids[i], b.ids[j]))

    stack = [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        if (a is b and y.last <= x.first) or not possible(x, y) or one_group(a, x, b, y):
            continue
        if not x.children and not y.children:
            leaves(x, y)
        elif not y.children or (x.children and x.last - x.first >= y.last - y.first):
            stack += [(c, y) for c in x.children]
        else:
            stack += [(x, c) for c in y.children]
    return links


def star(leader: int, ids: list[int], sizes: list[int], codes: list[np.ndarray]) -> tuple[list[bool], list[bool]]:
    """For each set: is it linked with the leader; could it be linked with a set that is."""
    k = ids.index(leader)
    lengths = np.array([len(c) for c in codes])
    both = np.zeros(len(ids), np.int64)
    if lengths.sum():
        hits = np.concatenate(([0], np.cumsum(np.isin(np.concatenate(codes), codes[k]))))
        upto = np.concatenate(([0], np.cumsum(lengths)))
        both = hits[upto[1:]] - hits[upto[:-1]]
    union = np.array(sizes) + sizes[k] - both
    linked = 100 * both >= PERCENT * union
    # Distances of linked sets are at most 1 - P/100; two such steps from the leader at most.
    near = 100 * both >= (2 * PERCENT - 100) * union
    return linked.tolist(), near.tolist()


LINK = pa.schema([("leader", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("left", pa.bool_()), ("near", pa.bool_())])
LINK_TEXT = "leader long, a long, b long, left boolean, near boolean"


def _columns(rows: list[tuple]) -> tuple[list[int], list[int], list[np.ndarray]]:
    return [r[-3] for r in rows], [r[-2] for r in rows], [np.frombuffer(r[-1], "<u8") for r in rows]


def _link_batches(found: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for rows in found:
        held += rows
        if len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), LINK)], schema=LINK)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), LINK)], schema=LINK)


def join_chunks(rows: DataFrame) -> DataFrame:
    """Links within the chunks (leader, chunk, chunks, id, n, codes), and, for blocks of several chunks, the sets not linked with the
    leader (``left``)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for (leader, _, chunks), rows in groups(batches, 3):
            if len(rows) < 2:
                continue
            ids, sizes, codes = _columns(rows)
            linked, near = star(leader, ids, sizes, codes)
            seen = Groups()
            links = [(leader, i) for i, is_linked in zip(ids, linked) if is_linked and seen.join(leader, i)]
            chunk = Chunk(ids, sizes, codes, bitmap_width(codes))
            links += dual_join(chunk, chunk, seen)
            out = [(leader, a, b, False, False) for a, b in links]
            if chunks > 1:
                out += [(leader, i, i, True, is_near) for i, is_linked, is_near in zip(ids, linked, near) if not is_linked]
            yield out

    ordered = rows.select("leader", "chunk", "chunks", "id", "n", "codes").repartition("leader", "chunk").sortWithinPartitions("leader", "chunk")
    return importable(ordered).mapInArrow(freed(lambda batches: _link_batches(found(batches))), LINK_TEXT)


def join_parts(rows: DataFrame) -> DataFrame:
    """Links between the two sides of each pair of parts (leader, kind, i, j, side, id, n, codes)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for (leader, kind, i, j), rows in groups(batches, 4):
            width = bitmap_width([np.frombuffer(r[-1], "<u8") for r in rows])
            first, second = (Chunk(*_columns([r for r in rows if r[4] == side]), width) for side in (0, 1))
            seen = Groups()
            if kind == 1:
                # The first side is linked with the leader, so it is one group.
                for x in first.ids:
                    seen.join(first.ids[0], x)
            same = kind == 0 and i == j
            yield [(leader, a, b, False, False) for a, b in dual_join(first, first if same else second, seen)]

    names = ["leader", "kind", "i", "j"]
    ordered = rows.select(*names, "side", "id", "n", "codes").repartition(*names).sortWithinPartitions(*names)
    return importable(ordered).mapInArrow(freed(lambda batches: _link_batches(found(batches))), LINK_TEXT)


def set_links(sets: DataFrame) -> DataFrame:
    """a, b: links between candidate sets that span the components of all links; stored."""
    members = block_members(sets)
    weights = sets.select("id", (F.length("codes") / 8).alias("weight"))
    blocks = members.join(weights, "id").groupBy("leader").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    sized = reliable_cut(
        blocks.filter("n > 1").select(
            "leader", F.greatest(F.ceil(F.col("n") / CHUNK_SETS), F.ceil(F.col("weight") / CHUNK_CODES)).cast("int").alias("chunks")
        ),
        "block-sizes",
    )
    placed = members.join(sized, "leader").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # A leader is in every chunk of its block.
    everywhere = sized.select(
        "leader", F.col("leader").alias("id"), "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    )
    placed = reliable_cut(placed.filter("id <> leader").select("leader", "id", "chunks", "chunk").unionByName(everywhere), "chunks")
    slim = sets.select("id", "n", "codes")
    first = reliable_cut(join_chunks(placed.join(slim, "id")), "chunk-links")
    links = first.filter("not left").select("a", "b")
    left = first.filter("left").select("leader", F.col("a").alias("id"), "near").distinct()
    if left.isEmpty():
        return links
    parts = left.groupBy("leader").agg(F.count("*").alias("n")).join(
        left.join(weights, "id").groupBy("leader").agg(F.sum("weight").alias("weight")), "leader"
    ).select("leader", F.greatest(F.ceil(F.col("n") / CHUNK_SETS), F.ceil(F.col("weight") / CHUNK_CODES)).cast("int").alias("parts"))
    left = reliable_cut(left.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")), "left")
    # Those left against each other: part i with part j.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    among = left.select("leader", "id", "part", other).select(
        "leader", F.lit(0).alias("kind"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") > F.col("other")).cast("int").alias("side"), "id",
    )
    # Those that are near enough, against the sets linked with the leader, chunk by chunk.
    near = left.filter("near")
    near_blocks = near.select("leader", "parts").distinct()
    chunks = near.join(sized, "leader").select(
        "leader", F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.col("part").alias("j"),
        F.lit(1).alias("side"), "id",
    )
    linked = placed.join(left.select("leader", "id"), ["leader", "id"], "left_anti").join(near_blocks, "leader").select(
        "leader", F.lit(1).alias("kind"), F.col("chunk").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"),
        F.lit(0).alias("side"), "id",
    )
    crossed = join_parts(among.unionByName(chunks).unionByName(linked).join(slim, "id"))
    return links.unionByName(reliable_cut(crossed.select("a", "b"), "part-links"))


def bucket_bits(docs: DataFrame, text_col: str) -> int:
    """Bits for as many buckets as the bytes of all texts ask for; a code stands for some six bytes."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return min(16, max(3, (total // 6 // BUCKET_CODES).bit_length()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, n_shingles, component_id, group_key: a row per row of ``docs``. The component is the least id among all that links reach."""
    bits = bucket_bits(docs, text_col)
    info = reliable_cut(shingle_sets(docs, id_col, text_col), "shingles")
    sets = candidate_sets(dealt_codes(docs, bits, id_col, text_col), 1 << bits)
    roots = components(set_links(sets))
    # A set's group: its component's root set, or its own key.
    named = sets.select("id", "key")
    moved = (
        roots.join(named, roots.node == named.id).select("root", F.col("key"))
        .join(named.select(F.col("id").alias("root"), F.col("key").alias("group_key")), "root").select("key", "group_key")
    )
    classes = info.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    grouped = reliable_cut(
        classes.join(moved, "key", "left").select("key", "first", F.coalesce("group_key", "key").alias("group_key")), "classes"
    )
    least = grouped.groupBy("group_key").agg(F.min("first").alias("component_id"))
    of_key = grouped.join(least, "group_key").select("key", "component_id", "group_key")
    full = info.filter("key is not null").join(of_key, "key").select("doc_id", "h", "n_shingles", "component_id", "group_key")
    empty = info.filter("key is null").select(
        "doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id"), F.col("key").alias("group_key")
    )
    return full.unionByName(empty)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: that whose id is the component's. Of several such rows the one with the least text
    hash stays, and of repeated rows one. Documents without words all stay."""
    found = reliable_cut(near_duplicates(docs, id_col, text_col).filter("group_key is not null"), "near-duplicates")
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # One row per group: the text hash that stays, and how many rows have it.
    firsts = found.filter(own).groupBy("group_key").agg(F.min("h").alias("first_h"))
    gone = found.filter(~own).select("doc_id", "h").unionByName(
        found.filter(own).join(firsts, "group_key").filter("h <> first_h").select("doc_id", "h")
    )
    kept = without(docs, id_col, text_value(text_col), reliable_cut(gone.distinct(), "gone"))
    twice = reliable_cut(found.filter(own).groupBy("doc_id", "h").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "h"), "repeated")
    if twice.isEmpty():
        return kept
    repeated = without(kept, id_col, text_value(text_col), twice)
    mark, twice_id, twice_h = (fresh_name(kept.columns, n) for n in ("__h", "__doc_id", "__twice_h"))
    others = kept.withColumn(mark, text_value(text_col))
    pairs = twice.select(F.col("doc_id").alias(twice_id), F.col("h").alias(twice_h))
    once = others.join(
        pairs, others[id_col].cast("long").eqNullSafe(F.col(twice_id)) & (F.col(mark) == F.col(twice_h)), "left_semi"
    ).dropDuplicates([id_col, mark]).drop(mark)
    return repeated.unionByName(once)


def op3_signature_trees(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id")
