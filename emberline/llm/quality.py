"""Quality rules: fixed counts and limits, then robust multivariate outliers per language and source.

Every text becomes a short vector of transformed rates. For each group of language and source the minimum-covariance-determinant
estimate of centre and covariance is found by concentration steps that start from medians and absolute deviations: the three quarters of the rows
that lie nearest are summed up, which gives the next centre and covariance, until nothing moves. A last step re-weights with all rows
that are not outlying. A text whose Mahalanobis distance is far beyond what a normal cloud would show is rejected.

All rows take part in every step. A step is two grouped aggregations with map-side combine, so a group with a third of all rows is no hot
task; estimates are tables with a row per group. Groups too small for a covariance use their language's, and languages too small
that of all rows. The covariance has a floor per rate, so that a rate which is nearly always zero does not turn its first non-zero
value into an outlier; texts of few words, whose rates are noisy, have their distance reduced.

Defined results: a null text has no words and fails the base rules; null language or source is a group like any other; repeated rows are rows
of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.common import importable, map_batches, reliable_cut, small, without

LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
# Transformed rates and the least standard deviation that each is taken to have.
RATES = {
    "word_length": 0.05, "symbols": 0.10, "capitals": 0.06, "marks": 0.08, "copied_lines": 0.12, "repeated_words": 0.12,
}
KEPT_SHARE = 0.75
STEPS = 8
# A group needs this many rows for estimates of its own.
GROUP_LEAST = 200
# The distance of n words counts n / (n + SHORT) of itself; the limit leaves out a share of TAIL of a normal cloud.
SHORT, TAIL = 60, 1e-5

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MORE = "n_lines long, n_capitals long, n_letters long, n_marks long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows which the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    code = np.zeros(n, np.uint64)
    for k in range(window):
        code = code * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
        code ^= code >> np.uint64(32)
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= again
    return int(covered.sum())


def counts_of(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8").split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = len(text) - sum(map(text.count, BLANKS + SYMBOLS + ".,!?0123456789"))
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), capitals, letters, sum(map(text.count, ".,!?;:")),
    )


def text_counts(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """Counts of whole texts, with language and source."""
    names = [x.split()[0] for x in f"{COUNTS}, {MORE}".split(", ")]

    def measure(columns: dict[str, list]) -> dict[str, list]:
        found = zip(*[counts_of(t or "") for t in columns["text"]]) if columns["text"] else [[]] * len(names)
        return {**{k: columns[k] for k in ("doc_id", "lang", "source", "h")}, **dict(zip(names, map(list, found)))}

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        row_value(text_col, lang_col, source_col).alias("h"),
    )
    return map_batches(rows, measure, f"doc_id long, lang string, source string, h long, {COUNTS}, {MORE}")


def row_value(text_col: str, lang_col: str, source_col: str) -> Column:
    """A hash of all that a verdict depends on."""
    return F.xxhash64(*[F.col(c).cast("string") for c in (text_col, lang_col, source_col)])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Rates on scales on which a clean group is near to a normal cloud: logarithm, square root, arc sine."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "word_length": F.log1p(share("word_chars", "n_words")),
        "symbols": F.sqrt(share("n_symbols", "n_words")),
        "capitals": F.asin(F.sqrt(F.least(share("n_capitals", "n_letters"), F.lit(1.0)))),
        "marks": F.sqrt(share("n_marks", "n_words")),
        "copied_lines": F.sqrt(share("n_dup_lines", "n_lines")),
        "repeated_words": F.sqrt(share("n_repeat_words", "n_words")),
    }


def chi2_below(x: float, p: int) -> float:
    """Distribution function of chi-squared with an even number ``p`` of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(p // 2))


def chi2_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, p) < share else (low, middle)
    return high


def consistency(share: float, p: int) -> float:
    """What the covariance of the nearest ``share`` of a normal cloud is multiplied by to give that of the whole."""
    return share / chi2_below(chi2_quantile(share, p), p + 2)


NAMES = list(RATES)
P = len(NAMES)
ESTIMATE = "lang string, source string, centre array<double>, inverse array<double>, logdet double"


def _distance(x: str = "x", centre: str = "centre", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance, in plain arithmetic of columns."""
    d = [F.col(x)[i] - F.col(centre)[i] for i in range(P)]
    return sum(
        (d[i] * d[j] * F.col(inverse)[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)), F.lit(0.0)
    )


def _sums() -> list[Column]:
    x = F.col("x")
    moments = [x[i] for i in range(P)] + [x[i] * x[j] for i in range(P) for j in range(i, P)]
    return [F.count("*").alias("n"), *[F.sum(m).alias(f"m{k}") for k, m in enumerate(moments)]]


def _estimates(sums: DataFrame, factor: float) -> DataFrame:
    """Centre and inverse covariance from a row of sums per group."""
    floors = np.array([RATES[n] ** 2 for n in NAMES])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = [(i, j) for i in range(P) for j in range(i, P)]
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                centre = np.array([r[f"m{i}"] for i in range(P)]) / r["n"]
                second = np.zeros((P, P))
                for k, (i, j) in enumerate(upper):
                    second[i, j] = second[j, i] = r[f"m{P + k}"] / r["n"]
                cov = (second - np.outer(centre, centre)) * factor + np.diag(floors)
                out.append((r["lang"], r["source"], centre.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ESTIMATE.split(", ")])

    return importable(sums).mapInPandas(solve, ESTIMATE)


def _matched(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """A group's estimate beside each of its rows: broadcast if the groups were counted few, else a join that may be split."""
    e = small(estimates.withColumnsRenamed({"lang": "e_lang", "source": "e_source"}), 20_000)
    return rows.join(e, rows.lang.eqNullSafe(F.col("e_lang")) & rows.source.eqNullSafe(F.col("e_source"))).drop("e_lang", "e_source")


def mcd(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Estimates (ESTIMATE) per lang and source of ``rows`` (lang, source, x)."""
    keys = ["lang", "source"]
    medians = rows.groupBy(*keys).agg(
        *[F.percentile_approx(F.col("x")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"q{i}") for i in range(P)]
    )
    # Half the distance of the quartiles stands for the absolute deviation; 1.4826 makes it that of a normal law.
    scale = [F.pow(1.4826 / 2 * (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]), 2) + RATES[NAMES[i]] ** 2 for i in range(P)]
    estimates = reliable_cut(
        medians.select(
            *keys,
            F.array(*[F.col(f"q{i}")[1] for i in range(P)]).alias("centre"),
            F.array(*[1 / scale[i] if i == j else F.lit(0.0) for i in range(P) for j in range(P)]).alias("inverse"),
            sum((F.log(s) for s in scale), F.lit(0.0)).alias("logdet"),
        ),
        "mcd",
    )
    before = None
    for _ in range(steps):
        near = _matched(rows, estimates).withColumn("d", _distance())
        limits = near.groupBy(*keys).agg(F.percentile_approx("d", F.lit(KEPT_SHARE), 2000).alias("limit"))
        limits = reliable_cut(limits, "mcd-limit")
        marked = _matched(near.select(*keys, "x", "d"), limits)
        estimates = reliable_cut(_estimates(marked.filter("d <= limit").groupBy(*keys).agg(*_sums()), consistency(KEPT_SHARE, P)), "mcd")
        total = estimates.agg(F.sum("logdet")).first()[0]
        if before is not None and abs(total - before) <= 1e-4 * max(1.0, abs(before)):
            break
        before = total
    share = 0.975
    inner = _matched(rows, estimates).withColumn("d", _distance()).filter(F.col("d") <= chi2_quantile(share, P))
    return reliable_cut(_estimates(inner.groupBy(*keys).agg(*_sums()), consistency(share, P)), "mcd")


def judged(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """Counts, base_failed, distance, kept and h (``row_value``), one row per row of ``docs``."""
    counts = reliable_cut(
        text_counts(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", base_failed()), "quality-counts"
    )
    # Groups: own, the language's, or all rows'. The name of a pooled group is one no table can hold as it has a control character.
    pool = F.lit("\u0001pooled")
    groups = counts.filter(~F.col("base_failed")).groupBy("lang", "source").count()
    sizes = reliable_cut(groups.withColumn("in_lang", F.sum("count").over(_by_lang())), "quality-groups")
    named = sizes.select(
        "lang", "source",
        F.when((F.col("count") < GROUP_LEAST) & (F.col("in_lang") < GROUP_LEAST), pool).otherwise(F.col("lang")).alias("g_lang"),
        F.when(F.col("count") < GROUP_LEAST, pool).otherwise(F.col("source")).alias("g_source"),
    )
    asked = _matched(counts.filter(~F.col("base_failed")), named).withColumn("x", F.array(*rates().values()))
    x_of = reliable_cut(
        asked.select("doc_id", "h", *[c.split()[0] for c in COUNTS.split(", ")], F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), "x"),
        "quality-rates",
    )
    # Pooled estimates take all rows of the pool, large groups' too.
    everyone = _matched(counts.filter(~F.col("base_failed")), named).select("lang", "g_lang", "g_source", F.array(*rates().values()).alias("x"))
    pools = reliable_cut(named.filter(F.col("g_source") == pool).select("g_lang").distinct(), "quality-pools")
    fitted = x_of.select("lang", "source", "x").filter(~F.col("source").eqNullSafe(pool))
    fitted = fitted.unionByName(pooled_rows(everyone, pools, pool))
    estimates = mcd(reliable_cut(fitted, "quality-fit"))
    limit = chi2_quantile(1 - TAIL, P)
    scored = _matched(x_of, estimates).withColumn("distance", _distance() * F.col("n_words") / (F.col("n_words") + SHORT))
    columns = ["doc_id", *[c.split()[0] for c in COUNTS.split(", ")], "base_failed", "kept", "distance", "h"]
    good = scored.withColumns({"base_failed": F.lit(False), "kept": F.col("distance") <= limit})
    bad = counts.filter("base_failed").withColumns({"kept": F.lit(False), "distance": F.lit(None).cast("double")})
    return good.select(*columns).unionByName(bad.select(*columns))


def pooled_rows(everyone: DataFrame, pools: DataFrame, pool: Column) -> DataFrame:
    """Rows (lang, source, x) that the pooled estimates of ``pools`` (g_lang) take from all rows (lang, x), however many pools there are."""
    none = everyone.select("lang", pool.alias("source"), "x")
    if pools.isEmpty():
        return none.limit(0)
    wide = small(pools.withColumnRenamed("g_lang", "p_lang"), 20_000)
    found = everyone.join(wide, F.col("lang").eqNullSafe(F.col("p_lang"))).select("lang", pool.alias("source"), "x")
    if pools.filter(F.col("g_lang") == pool).isEmpty():
        return found
    return found.unionByName(none.withColumn("lang", pool))


def keep_good(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """The documents that pass, with all their columns."""
    found = judged(docs, id_col, text_col, lang_col, source_col)
    gone = reliable_cut(found.filter("not kept").select("doc_id", "h"), "rejected")
    return without(docs, id_col, row_value(text_col, lang_col, source_col), gone)


def _by_lang():
    from pyspark.sql.window import Window

    # Over groups, of which a language has one per source.
    return Window.partitionBy("lang")


def op10_robust_outliers(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h")
