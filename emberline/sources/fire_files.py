"""Fire report CSV files, with or without a geometry column."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from emberline import config as C
from emberline.session import reliable_cut
from emberline.sources.station_text import read_lines

# What may stand inside quotes, and a whole field: quoted, plain or empty. A quote opens only where a field begins.
QUOTED = '[^"]*+(?:""[^"]*+)*+'
FIELD = f'(?:"{QUOTED}"[^,]*+|[^",][^,]*+)?+'
OPENS = f'(?:{FIELD},)*+"{QUOTED}\\z'
OPEN_LEFT = "quote left open"
# Line numbers of a stretch that is followed in one go. A split of a file begins at a multiple of it, as ``line_order`` numbers lines.
STRETCH = 1 << 16


def _walked(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``flips`` and ``base`` before each row, of which ``_inside`` makes whether the row begins inside quotes.

    A row is known by where it ends when begun outside (``out0``) and inside (``out1``): it keeps the state, flips it or sets it. Flips are
    counted; ``base`` is what the last row that set the state gave, less the flips up to it.
    """
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    flips = F.coalesce(F.sum((F.col("out0") > F.col("out1")).cast("long")).over(before), F.lit(0))
    base = F.last(F.when(F.col("out0") == F.col("out1"), F.col("out0") - F.col("flips")), ignorenulls=True).over(before)
    return rows.withColumn("flips", flips).withColumn("base", base)


def _inside(entry: Column) -> Column:
    return F.pmod(F.coalesce("base", entry) + F.col("flips"), F.lit(2))


def whole_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of CSV lines (source_file, line_no, value), line breaks inside quotes put back, and the files whose last quote stays open.

    A record has the number of its first line. Files without such a break, found in one job, pass as they are. In the others the state of
    the quotes is first followed inside each stretch of a file's line numbers, whatever it begins with, then over the few rows that stand for
    the stretches, so a file with most of the lines is no single task, whether its lines are numbered through or split by split. Only lines of records with several of them are grouped. A file that ends inside
    quotes gives no records, so a lost quote does not make a record of a file's rest.
    """
    has_quote = F.col("value").contains('"')
    out0 = (has_quote & F.col("value").rlike(f"^{OPENS}")).cast("long")
    out1 = (~has_quote | F.col("value").rlike(f'^{QUOTED}(?:\\z|"[^,]*+,{OPENS})')).cast("long")
    broken = lines.filter(out0 == 1).select("source_file").distinct()
    if broken.isEmpty():
        return lines, broken
    broken = reliable_cut(broken, "csv-broken")
    own = lines.join(broken, "source_file", "left_semi").select(
        "source_file", "line_no", "value", out0.alias("out0"), out1.alias("out1"), F.expr(f"cast(line_no AS decimal(30,0)) DIV {STRETCH}").alias("split")
    )
    rows = _walked(own, ["source_file", "split"], "line_no")
    end, flipped = F.max_by(F.col("out0") - F.col("flips"), F.when(F.col("out0") == F.col("out1"), F.col("line_no"))), F.sum((F.col("out0") > F.col("out1")).cast("long"))
    splits = rows.groupBy("source_file", "split").agg(
        *[F.pmod(F.coalesce(end, F.lit(k)) + flipped, F.lit(2)).alias(f"out{k}") for k in (0, 1)],
        *[F.max(F.when(_inside(F.lit(k)) == 0, F.col("line_no"))).alias(f"start{k}") for k in (0, 1)],
    )
    entered = _walked(splits, ["source_file"], "split").withColumn("entry", _inside(F.lit(0)))
    earlier = Window.partitionBy("source_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    entered = reliable_cut(
        entered.select(
            "source_file", "split", "entry", F.when(F.col("entry") == 0, F.col("out0")).otherwise(F.col("out1")).alias("exit"),
            F.max(F.when(F.col("entry") == 0, F.col("start0")).otherwise(F.col("start1"))).over(earlier).alias("carried"),
        ),
        "csv-splits",
    )
    left_open = entered.groupBy("source_file").agg(F.max_by("exit", "split").alias("exit")).filter("exit = 1").select("source_file")
    placed = rows.join(entered.join(left_open, "source_file", "left_anti"), ["source_file", "split"]).withColumn("inside", _inside(F.col("entry")))
    so_far = Window.partitionBy("source_file", "split").orderBy("line_no")
    begun = F.last(F.when(F.col("inside") == 0, F.col("line_no")), ignorenulls=True).over(so_far)
    placed = placed.withColumn("start", F.coalesce(begun, F.col("carried")))
    alone = (F.col("inside") == 0) & (F.col("out0") == 0)
    pieces = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    several = placed.filter(~alone).groupBy("source_file", "start").agg(F.array_join(F.transform(pieces, lambda x: x["value"]), "\n").alias("value"))
    columns = ["value", "source_file", "line_no"]
    whole = lines.join(broken, "source_file", "left_anti").select(*columns)
    return whole.unionByName(placed.filter(alone).select(*columns)).unionByName(several.withColumnRenamed("start", "line_no").select(*columns)), left_open


def file_headers(lines: DataFrame) -> DataFrame:
    """source_file and header: the first line of every file of ``lines`` (source_file, line_no, value)."""
    first = lines.groupBy("source_file").agg(F.min_by(F.struct("value", "line_no"), "line_no").alias("first"))
    header = F.regexp_replace(F.trim(F.col("first.value")), "^\ufeff", "")
    return first.select("source_file", header.alias("header"), F.col("first.line_no").alias("header_no"))


def parse_layouts(
    lines: DataFrame, required: tuple[str, ...] = C.FIRE_REQUIRED
) -> tuple[DataFrame | None, DataFrame]:
    """CSV lines of many files as text columns, and the files left out with the reason.

    Headers are found in one job whatever the number of files. Only the different headers reach the driver: a plan follows the
    number of layouts, not of files. A file that lacks a required column, or ends inside quotes, gives no rows. Every row keeps its file and
    the line where it begins. Quotes inside quotes are doubled.
    """
    lines, left_open = whole_records(lines)
    # A row per file. Stored, it has a known size, so that lines meet it where they are and files are not brought together.
    headers = reliable_cut(file_headers(lines), "csv-headers")
    layouts = sorted(r.header for r in headers.select("header").distinct().toLocalIterator())
    parts, lacking = [], {}
    for header in layouts:
        names = next(csv.reader(header.splitlines(keepends=True)), [])
        missing = [c for c in required if c not in names]
        if missing:
            lacking[header] = "missing columns: " + ", ".join(missing)
            continue
        own = headers.filter(F.col("header") == header).select("source_file", "header_no")
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
        body = lines.join(own, "source_file").filter((F.col("line_no") > F.col("header_no")) & (F.trim("value") != ""))
        parts.append(body.select(F.from_csv("value", F.lit(schema), {"mode": "PERMISSIVE", "escape": '"'}).alias("r"), "source_file", "line_no").select("r.*", "source_file", "line_no"))
    reason = reduce(lambda chain, kv: chain.when(F.col("header") == kv[0], kv[1]), lacking.items(), F.when(F.lit(False), ""))
    skipped = headers.withColumn("reason", reason).filter("reason is not null").select("source_file", "reason")
    skipped = skipped.unionByName(left_open.withColumn("reason", F.lit(OPEN_LEFT)))
    if not parts:
        return None, skipped
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), skipped


def read_fire_files(
    spark: SparkSession, folder: str, required: tuple[str, ...] = C.FIRE_REQUIRED
) -> tuple[DataFrame | None, DataFrame]:
    """Union of the fire files of a folder, and the files left out with the reason. An empty file has no lines and no reason."""
    return parse_layouts(read_lines(spark, folder, "*.csv"), required)


def rename_wkt(raw: DataFrame) -> DataFrame:
    """The collector's ``WKT`` column under the name the validator reads."""
    if "WKT" in raw.columns and "geometry_wkt" not in raw.columns:
        return raw.withColumnRenamed("WKT", "geometry_wkt")
    return raw
