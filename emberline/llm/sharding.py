"""Shards by sampled splitters: size-weighted key samples, quantile boundaries, range partition, overfull ranges subdivided.

DataFrame functions only. The key of a row is (hash of its text, id, place in the scan): it is unique, so any range can be subdivided, and
copies of one text lie side by side. Splitters only deal the work out; the shards themselves follow from exact sums of bytes.

Defined results: a null text counts as empty (crc 0, size 16); repeated rows are rows of their own; an empty table gives no rows;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from emberline.llm.common import reliable_cut

SHARDS = 40
# Rows a range should hold; ranges above twice the mean of bytes or rows are subdivided.
RANGE_ROWS, RANGES_LEAST, RANGES_MOST = 50_000, 64, 16_384
# Samples per range, drawn with a chance that grows with size.
SAMPLES = 8
OVERHEAD_BYTES = 16


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Slim rows: id, size, crc, and the key h, id, place."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("place"),
    )


def key() -> Column:
    return F.struct(F.col("h"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), F.col("place"))


def drawn(rows: DataFrame, n: int, total_bytes: int) -> list[tuple]:
    """Some ``n`` keys out of rows of ``total_bytes``, sorted, each row with a chance that grows with its size: those whose -ln(u) / size, u from a
    hash, is at most n / total_bytes. Each row is decided where it is; what comes to the driver is ``n`` give or take a few square roots of it."""
    u = (F.pmod(F.xxhash64("h", "doc_id", "place", F.lit(17)), F.lit(2**31)) + 1) / F.lit(2.0**31 + 1)
    picked = rows.filter(-F.log(u) / F.col("size") <= F.lit(n / max(1, total_bytes)))
    return sorted(tuple(r.k) for r in picked.select(key().alias("k")).collect())


def quantiles(keys: list[tuple], parts: int) -> list[tuple]:
    """At most ``parts - 1`` boundaries that cut sorted sample keys into even parts."""
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def with_range(rows: DataFrame, splitters: list[tuple], name: str = "part") -> DataFrame:
    """``rows`` with the number of splitters at or below their key, found by binary search in a constant array."""
    if not splitters:
        return rows.withColumn(name, F.lit(0))
    bounds = F.array(*[F.struct(*[F.lit(int(v)).cast("long") for v in s]) for s in splitters]).cast("array<struct<h:bigint,id:bigint,place:bigint>>")

    def step(at: Column, jump: Column) -> Column:
        ahead = at + jump
        return F.when((ahead <= len(splitters)) & (F.get("__bounds", ahead - 1) <= F.col("__key")), ahead).otherwise(at)

    jumps = F.array(*[F.lit(1 << b) for b in reversed(range(len(splitters).bit_length()))])
    search = F.aggregate(jumps, F.lit(0), step)
    return rows.withColumns({"__bounds": bounds, "__key": key()}).withColumn(name, search).drop("__bounds", "__key")


def ranges(rows: DataFrame, total_rows: int, total_bytes: int) -> tuple[DataFrame, list]:
    """Rows with their range, and (range, bytes, rows) of each in key order. Ranges that came out overfull are subdivided by fresh
    samples of their own rows, until none is left."""
    parts = max(RANGES_LEAST, min(RANGES_MOST, total_rows // RANGE_ROWS))
    splitters = quantiles(drawn(rows, parts * SAMPLES, total_bytes), parts)
    while True:
        ranged = with_range(rows, splitters)
        found = sorted(ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
        total = sum(r.bytes for r in found)
        over = [r for r in found if r.n > 1 and (r.bytes > 2 * total / parts or r.n > 2 * max(total_rows / parts, 1))]
        fresh: set[tuple] = set()
        if over and len(splitters) < 4 * parts:
            inside = ranged.filter(F.col("part").isin([r.part for r in over]))
            keys = drawn(inside, len(over) * SAMPLES, sum(r.bytes for r in over))
            fresh = set(keys) - set(splitters)
        if not fresh:
            return ranged, found
        splitters = sorted({*splitters, *fresh})


def shard_by_size(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, part: shards of near-equal bytes, each a range of keys.

    A row's shard is the one its middle byte falls into when all rows lie in key order, so a shard misses the mean by less than
    one row. Slots count a shard's rows in key order.
    """
    spark = docs.sparkSession
    rows = reliable_cut(keyed(docs, id_col, text_col), "shard-keys")
    every = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranged, found = ranges(rows, every.n, every.bytes)
    total = max(1, sum(r.bytes for r in found))
    before, at_bytes, at_rows = [], 0, 0
    for r in found:
        before.append((r.part, at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + r.bytes, at_rows + r.n
    # One row per range: at most a few times RANGES_MOST, by construction.
    offsets = spark.createDataFrame(before, "part int, bytes_before long, rows_before long")
    inside = Window.partitionBy("part").orderBy("h", "doc_id", "place")
    placed = (
        ranged.withColumns(
            {
                "upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
                "nth": F.row_number().over(inside),
            }
        )
        .join(F.broadcast(offsets), "part")
        .withColumn("middle", F.col("bytes_before") + F.col("upto") - F.col("size") / 2)
        .withColumn("shard", F.least(F.floor(F.col("middle") * shards / F.lit(total)), F.lit(shards - 1)).cast("int"))
        .withColumn("row", F.col("rows_before") + F.col("nth") - 1)
        .select("doc_id", "size", "text_crc32", "shard", "row", "part")
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"), "part"
    )


def op8_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_size(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("part").alias("range_id"),
    )
