"""URL filters: prefix rules on host and path, then a list of exact addresses in sorted digest arrays.

The list is written once as shards: the 64-bit xxhash keys of its strings in ascending order, the strings in the same order, and their
offsets. A shard holds the keys that begin with the same bits. Tasks that judge addresses map the shards they need from the shared
folder (on an object store they read them, one at a time), look all keys of a batch up by vectorised binary search, and compare the
stored strings of every hit, so that two strings with one key are told apart. Addresses are not shuffled, so a host with a third of all
rows makes no hot task.

Defined results: a null address, or one without ``://``, has an empty host and path and is judged by the list as the empty string; repeated
rows are judged each; an empty table gives no rows and an empty list blocks nothing.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.common import AtomicFile, importable, map_batches, open_input, reliable_cut, scratch_path

MAGIC = b"DIGESTS1"
# Keys of a shard: 16 MB of digests and offsets, and their strings.
SHARD_KEYS = 1_000_000
# The rules of the registered query (fixed values): address prefix and verdict.
RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. For rule lists of some hundreds at most."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rule_path))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def digest(text: str) -> int:
    """The same as Spark's ``xxhash64`` of the string, as an unsigned number."""
    return xxhash.xxh64_intdigest(text.encode("utf-8"), 42)


def build_index(listed: DataFrame, folder: str, column: str = "address") -> DataFrame:
    """Shards below ``folder``; returns their manifest (bits, shard, path, n), stored. Nulls are left out, repeated strings stored once."""
    keys = reliable_cut(listed.select(F.col(column).cast("string").alias("address")).filter("address is not null").distinct(), "listed")
    bits = max(0, (keys.count() // SHARD_KEYS).bit_length())
    # Half of the digest's bits come from a shift by one first: a shift of a signed long by 64 - 0 would be no shift.
    shard = F.shiftrightunsigned(F.shiftrightunsigned("digest", 1), 63 - bits)
    schema = pa.schema([("bits", pa.int32()), ("shard", pa.int64()), ("path", pa.string()), ("n", pa.int64())])

    def save(number: int, digests: list[int], texts: list[bytes]) -> tuple[str, int]:
        file = AtomicFile(folder, f"shard-{number}", ".digests")
        ends = np.cumsum([0, *map(len, texts)], dtype="<u8")
        file.write(MAGIC + len(texts).to_bytes(8, "little"))
        file.write(np.array(digests, "<u8").tobytes() + ends.tobytes() + b"".join(texts))
        file.close()
        return file.path, len(texts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, digests, texts, rows = None, [], [], []
        for batch in batches:
            for s, d, a in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if s != number and texts:
                    rows.append((bits, number, *save(number, digests, texts)))
                    digests, texts = [], []
                number = s
                digests.append(d & 0xFFFFFFFFFFFFFFFF)
                texts.append(a.encode("utf-8"))
        if texts:
            rows.append((bits, number, *save(number, digests, texts)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    placed = (
        keys.withColumn("digest", F.xxhash64("address"))
        .select(shard.alias("shard"), "digest", "address")
        .repartition(1 << bits, "shard")
        # Signed order within a shard is unsigned order, as all its keys have one sign, except where there is one shard only.
        .sortWithinPartitions("shard", F.expr("digest < 0"), "digest", "address")
    )
    return reliable_cut(importable(placed).mapInArrow(task, "bits int, shard long, path string, n long"), "digest-shards")


class Shard:
    def __init__(self, path: str):
        self.source = open_input(path, mapped=True)
        data = self.source.read_buffer(self.source.size())
        if data[:8].to_pybytes() != MAGIC:
            raise ValueError(f"not a digest shard: {path}")
        n = int.from_bytes(data[8:16].to_pybytes(), "little")
        self.digests = np.frombuffer(data, "<u8", n, 16)
        self.ends = np.frombuffer(data, "<u8", n + 1, 16 + 8 * n)
        self.texts, self.base = data, 16 + 8 * n + 8 * (n + 1)

    def text(self, k: int) -> bytes:
        begins = self.base + int(self.ends[k])
        return self.texts[begins : self.base + int(self.ends[k + 1])].to_pybytes()

    def holds(self, digests: np.ndarray, texts: list[bytes]) -> np.ndarray:
        at = np.searchsorted(self.digests, digests)
        hit = np.zeros(len(digests), bool)
        inside = at < len(self.digests)
        hit[inside] = self.digests[at[inside]] == digests[inside]
        for k in np.flatnonzero(hit):
            p, hit[k] = int(at[k]), False
            while p < len(self.digests) and self.digests[p] == digests[k] and not hit[k]:
                hit[k] = self.text(p) == texts[k]
                p += 1
        return hit


class Index:
    """Shards by number, opened when asked for; few stay open."""

    def __init__(self, bits: int, paths: dict[int, str], most_open: int = 8):
        self.bits, self.paths, self.most, self.open = bits, paths, most_open, OrderedDict()

    def shard(self, number: int) -> Shard | None:
        if number not in self.paths:
            return None
        if number not in self.open:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)
            self.open[number] = Shard(self.paths[number])
        self.open.move_to_end(number)
        return self.open[number]

    def holds(self, texts: list[str]) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        if not len(texts):
            return found
        digests = np.array([digest(t) for t in texts], np.uint64)
        numbers = (digests >> np.uint64(1)) >> np.uint64(63 - self.bits) if self.bits else np.zeros(len(texts), np.uint64)
        for number in np.unique(numbers):
            if shard := self.shard(int(number)):
                own = np.flatnonzero(numbers == number)
                found[own] = shard.holds(digests[own], [texts[k].encode("utf-8") for k in own])
        return found


def probe(rows: DataFrame, column: str, manifest: DataFrame) -> DataFrame:
    """All columns of ``rows`` and ``listed``. The manifest has a row per SHARD_KEYS listed strings."""
    shards = manifest.collect()
    index = Index(shards[0].bits if shards else 0, {r.shard: r.path for r in shards})
    names = {f.name: f.dataType.simpleString() for f in rows.schema}

    def look(columns: dict[str, list]) -> dict[str, list]:
        return {**columns, "listed": index.holds([t or "" for t in columns[column]]).tolist()}

    return map_batches(rows, look, ", ".join(f"`{n}` {t}" for n, t in {**names, "listed": "boolean"}.items()))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed. ``listed``: addresses (host and path) to be blocked where no rule fits."""
    manifest = build_index(listed, scratch_path(pages.sparkSession, "urls"))
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("address", F.concat("host", "path"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    return probe(rows, "address", manifest).withColumn("found", rule).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )


# Of a listed page, one character in this many is decoration.
DECORATION, DECORATED_SHARE = "*$%#", 100


def decorated(pages: DataFrame) -> DataFrame:
    """Addresses of pages full of decoration: the block list of the registered query."""
    html = F.coalesce(F.col("html"), F.lit(""))
    marks = F.length(html) - F.length(F.translate(html, DECORATION, ""))
    host, path = host_and_path(F.col("url"))
    return pages.filter((marks > 0) & (marks * DECORATED_SHARE >= F.length(html))).select(F.concat(host, path).alias("address"))


def op5_digest_array(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, decorated(pages))


ORACLE = """
WITH rules(rule, verdict) AS (
  VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')
), parts AS (
  SELECT page_id, coalesce(html, '') AS html,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, html,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), listed AS (
  SELECT DISTINCT host || path AS address FROM split
  WHERE length(html) > length(translate(html, '*$%#', ''))
    AND (length(html) - length(translate(html, '*$%#', ''))) * 100 >= length(html)
), fitting AS (
  SELECT s.page_id, s.host, s.path, s.host || s.path IN (SELECT address FROM listed) AS listed, r.rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS nth
  FROM split s LEFT JOIN rules r
    ON (s.host = split_part(r.rule, '/', 1) OR ends_with(s.host, '.' || split_part(r.rule, '/', 1)))
   AND starts_with(s.path, substr(r.rule, strpos(r.rule, '/')))
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM fitting WHERE nth = 1
"""
