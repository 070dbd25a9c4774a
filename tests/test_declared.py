"""Declared tables: what is refused, what stays, which version is read."""

import glob

import pytest
from pyspark.sql import functions as F

from emberline.operators import geo
from emberline.sources import declared, sinks
from emberline.sources.tables import read_csv
from tests.conftest import rows

TABLE = declared.Declared("k int, v string NOT NULL, x double", ("k",))
SCHEMA = "k int, v string, x double"


def of(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


@pytest.mark.parametrize(
    "bad",
    [
        [(1, "a", 0.0), (1, "b", 0.0)], [(1, None, 0.0)], [(None, "a", 0.0)], [(None, "a", None), (None, "b", None)],
    ],
)
def test_refused_rows_leave_the_old(spark, tmp_path, bad):
    root = str(tmp_path / "t")
    with pytest.raises(declared.DeclarationError):
        declared.write_declared(of(spark, *bad), root, TABLE)
    with pytest.raises(FileNotFoundError):
        declared.read_declared(spark, root, TABLE)
    declared.write_declared(of(spark, (7, "old", None)), root, TABLE)
    with pytest.raises(declared.DeclarationError):
        declared.write_declared(of(spark, *bad), root, TABLE)
    assert rows(declared.read_declared(spark, root, TABLE)) == [(7, "old", None)]
    assert len(glob.glob(f"{root}/versions/*")) == 1


def test_failing_job_leaves_the_old(spark, tmp_path):
    root = str(tmp_path / "t")
    declared.write_declared(of(spark, (1, "old", 0.0)), root, TABLE)
    failing = of(spark, (2, "new", 0.0)).withColumn("x", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        declared.write_declared(failing, root, TABLE)
    assert rows(declared.read_declared(spark, root, TABLE)) == [(1, "old", 0.0)]


def test_schema_is_checked_before_any_job(spark):
    for df, words in (
        (of(spark).drop("x"), "no column x"), (of(spark).withColumn("y", F.lit(1)), "undeclared column y"),
        (of(spark).withColumn("k", F.col("k").cast("long")), "k is bigint, declared int"),
    ):
        with pytest.raises(declared.DeclarationError, match=words):
            declared.conforming(df, TABLE)
    assert declared.conforming(of(spark).select("x", "v", "k"), TABLE).columns == ["k", "v", "x"]


def test_versions(spark, tmp_path):
    """The newest commit is read; the one before it stays for readers under way, older ones go. A table may be empty or read itself."""
    root = str(tmp_path / "t")
    declared.write_declared(of(spark), root, TABLE)
    assert declared.read_declared(spark, root, TABLE).count() == 0
    declared.write_declared(of(spark, (1, "a", 1.0)), root, TABLE)
    under_way = declared.read_declared(spark, root, TABLE)
    declared.write_declared(under_way.unionByName(of(spark, (2, "b", None))), root, TABLE)
    assert rows(under_way) == [(1, "a", 1.0)]
    assert rows(declared.read_declared(spark, root, TABLE, "k")) == [(1,), (2,)]
    assert len(glob.glob(f"{root}/versions/*")) == 2
    assert rows(declared.commits(spark, root), "seq", "n_rows") == [(1, 0), (2, 1), (3, 2)]


def test_without_a_key(spark):
    loose = declared.Declared("k int, v string NOT NULL, x double")
    found = declared.report(of(spark, (1, None, 0.0), (1, None, 0.0), (1, "a", 0.0)), loose).first()
    assert tuple(found) == (3, 2, 0)


def test_csv_as_other_readers_see_it(spark, tmp_path):
    import pandas as pd

    values = [(1, 'a "b", c', 0.5), (2, "two\nlines", None), (3, " \\ ", 1.0), (4, "", None), (5, None, None), (6, '"', 2.0)]
    path = str(tmp_path / "csv")
    sinks.write_csv(of(spark, *values).coalesce(1), path)
    assert rows(read_csv(spark, path, of(spark).schema)) == sorted(values)
    seen = pd.read_csv(glob.glob(f"{path}/*.csv")[0], keep_default_na=False)
    assert sorted(zip(seen.k, seen.v)) == [(k, v or "") for k, v, _ in values]


def test_dense_bin_is_cut_on_both_sides(spark):
    """All pairs of a dense bin come once, over keys of at most ``rows`` squared."""
    points = spark.range(90).select("id", (F.col("id") * 0.001).alias("lat"), (F.col("id") % 7 * 0.001).alias("lon"))
    for most in (4, 25, 1000):
        found = geo.bin_join(points, points, F.lit(1.0), F.lit(1.0), 1.0, 1.0, split_rows=most, split_left=most).select("l.id", F.col("r.id").alias("other"))
        assert found.count() == found.distinct().count() == 8100
