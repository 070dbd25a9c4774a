import os

import pytest

from conftest import rows
from emberline.functions.exprs import to_day
from emberline.operators import validate, weather
from emberline.plans import pipeline
from emberline.plans.adapters import view
from emberline.sources import fire_files, sinks, station_text
from emberline.sources.station_text import read_lines

def lines(spark, *texts):
    return spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, line_no long")


def station(sid="CA001057052", lat=" 50.1000", lon="-115.2000", elev="1234.5", name="SOMEWHERE", tail=" GSN     71000"):
    return f"{sid:<11} {lat:>8} {lon:>9} {elev:>6}    {name:<30}{tail}"


def test_station_lines(spark):
    parsed = station_text.parse_stations(
        lines(
            spark,
            station("CA000000001"),
            station("CA000000002", lat="65.0000"),
            station("CA000000003", elev="-999.9"),
            station("CA000000004", elev="6000.0"),
            station("CA000000005", lat="north"),
            "CA000000006  50.0000",
            station("CA000000007", tail=" GSN          "),
            station("CA000000008", elev=""),
            station("CA000000009", lat="50.1d"),
        )
    )
    assert rows(parsed, "station_id", "elevation", "reject") == [
        ("CA000000001", 1234.5, None),
        ("CA000000002", 1234.5, "bounds"),
        ("CA000000003", None, None),
        ("CA000000004", None, None),
        ("CA000000005", 1234.5, "format"),
        ("CA000000006", None, "short"),
        ("CA000000007", 1234.5, "short"),
        ("CA000000008", None, "format"),
        ("CA000000009", 1234.5, "format"),
    ]
    first = parsed.orderBy("station_id").first()
    assert (first.latitude, first.longitude, first.name, first.country) == (50.1, -115.2, "SOMEWHERE", "CA")
    collector = station_text.parse_stations(lines(spark, station(tail=" GSN          ")), min_len=84, strip=False)
    assert rows(collector, "reject") == [(None,)]


def test_inventory_lines(spark):
    def line(sid, element, first, last, lat=" 50.0000"):
        return f"{sid:<11} {lat:>8} {'-115.0000':>9} {element} {first} {last}"

    source = lines(
        spark,
        line("CA000000001", "TMAX", 1990, 2023),
        line("CA000000002", "TMAX", 1990, 2021),
        line("CA000000003", "TMAX", 2026, 2030),
        line("CA000000004", "WT01", 1990, 2023),
        line("CA000000005", "TMAX", 1990, 2023, lat="70.0000"),
        line("CA000000006", "TMAX", "19x0", 2023),
    )
    assert rows(station_text.parse_inventory(source), "reject") == sorted(
        [(None,), ("bounds",), ("element",), ("format",), ("years",), ("years",)], key=lambda t: (t[0] is None, str(t[0]))
    )
    assert station_text.parse_inventory(source, min_len=80).filter("reject = 'short'").count() == 6


HEAD = "CA001057052202306TMAX"
DAILY = [
    (["  -11  C", "  110  C", "  250  C"], [(1, -1.1), (2, 11.0), (3, 25.0)], [(1, -1.1), (2, 11.0), (3, 25.0)]),
    (["  -11  C", "-9999   ", "  250  C"], [(1, -1.1)], [(1, -1.1), (3, 25.0)]),
    (["  100  C", "  110  C", " -250 IC"], [(1, 10.0), (2, 11.0)], [(1, 10.0), (2, 11.0)]),
    (["  100  C", " 9990  C", "    0T C"], [(1, 10.0)], [(1, 10.0), (3, 0.0)]),
]


@pytest.mark.parametrize("groups, tokens, fixed", DAILY)
def test_daily_line_modes(spark, groups, tokens, fixed):
    source = lines(spark, HEAD + "".join(groups))
    for mode, expected in (("tokens", tokens), ("fixed", fixed)):
        found = station_text.parse_daily(source, mode).selectExpr("day(date) AS day", "value").orderBy("day").collect()
        if mode == "tokens" and "-9999" in groups[1]:
            # The glued "C-9999" shifts the pairs: tokens are -11, C-9999, 250, C, so day 2 is read.
            assert [tuple(r) for r in found] == [(2, 25.0)]
        else:
            assert [tuple(r) for r in found] == expected


def test_daily_calendar_and_units(spark):
    def month(year, month_no, element="TMAX", n=31):
        return f"CA001057052{year}{month_no:02d}{element}" + "  100  C" * n

    def days(*texts, **options):
        return station_text.parse_daily(lines(spark, *texts), **options).count()

    assert days(month(2024, 2)) == 29 and days(month(2023, 2)) == 28 and days(month(2023, 4)) == 30
    assert days(month(2021, 5)) == 0 and days(month(2026, 5)) == 0 and days(month(2023, 13)) == 0
    assert days(month(2023, 5, "WT01")) == 0 and days(month(2023, 5, n=1)) == 0
    assert rows(station_text.parse_daily(lines(spark, month(2023, 5, "SNWD", 2))), "value") == [(100.0,), (100.0,)]
    assert rows(station_text.parse_daily(lines(spark, month(2023, 5, "PRCP", 2))), "value") == [(10.0,), (10.0,)]
    with pytest.raises(ValueError):
        station_text.parse_daily(lines(spark, HEAD), "guess")


def test_later_line_of_a_file_wins(spark, tmp_path):
    path = tmp_path / "CA001057052.dly"
    path.write_text("\n".join([HEAD + "  100  C" * 2, HEAD + "  200  C" + " -9999  C"]) + "\n")
    wide = weather.weather_wide(station_text.parse_daily(station_text.read_lines(spark, str(path))))
    # The second line wins where it has a reading; its missing day does not overwrite.
    assert rows(wide.selectExpr("day(date) AS day", "tmax", "tmax_quality", "tmin")) == [
        (1, 20.0, "C", None), (2, 10.0, "C", None),
    ]


def test_year_filter_keeps_bytes_and_audit(spark, tmp_path):
    texts = [f"CA001057052{y}06TMAX  100  C   " for y in (2021, 2022, 2025, 2026)] + ["CA001057052abcd06TMAX  100  C"]
    source = lines(spark, *texts)
    kept = station_text.filter_daily_years(source, 2022, 2025)
    assert sorted(r.value for r in kept.collect()) == texts[1:3]
    sinks.write_daily_text(kept, str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out").count("station_id=CA001057052") == 1
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == texts[1:3]
    assert rows(station_text.daily_year_counts(source, 2022, 2025)) == [(2021, 1, 1), (2022, 1, 0), (2025, 1, 0), (2026, 1, 1)]


def test_station_match(spark):
    source = lines(spark, "CA000000001202306TMAX", "CA000000002202306TMAX", "US000000003202306TMAX", "CA000000004202306TMAX")
    stations = spark.createDataFrame(
        [("CA000000001", 50.0, -115.0), ("CA000000002", 70.0, -115.0), ("US000000003", 45.0, -100.0)],
        "station_id string, latitude double, longitude double",
    )
    kept, unknown = weather.match_stations(source, stations)
    assert rows(kept, "station_id") == [("CA000000001",)]
    assert rows(unknown) == [("CA000000004",)]


def test_fire_files(spark, tmp_path):
    full = "NFDBFIREID,LATITUDE,LONGITUDE,YEAR,MONTH,DAY,SIZE_HA,WKT\n"
    (tmp_path / "a.csv").write_text(full + "A1,50.1,-115.2,2023,7,14,120,POINT (-115.2 50.1)\nA2,50,-115,2023,13,1,1,\n")
    (tmp_path / "b.csv").write_text(full + "B1,bad,-115,2023,7,1,1,\n")
    (tmp_path / "c.csv").write_text("NFDBFIREID,YEAR,MONTH,DAY,SIZE_HA\nC1,2023,7,1,1\n")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "empty.csv").write_text("")
    reports, skipped = fire_files.read_fire_files(spark, str(tmp_path))
    found = {os.path.basename(r.source_file): r.reason for r in skipped.collect()}
    assert set(found) == {"c.csv"} and "LATITUDE" in found["c.csv"]
    classified = validate.classify_fires(fire_files.rename_wkt(reports))
    assert rows(classified, "NFDBFIREID", "reject") == [("A1", None), ("A2", "month"), ("B1", "format")]
    assert classified.filter("source_file LIKE '%a.csv'").count() == 2
    (tmp_path / "other").mkdir()
    (tmp_path / "c.csv").rename(tmp_path / "other" / "c.csv")
    none, all_skipped = fire_files.read_fire_files(spark, str(tmp_path / "other"))
    assert none is None and all_skipped.count() == 1


def test_csv_records_over_lines(spark, tmp_path):
    import csv
    import random

    head = "LATITUDE,LONGITUDE,YEAR,MONTH,DAY,SIZE_HA,CAUSE"
    rng = random.Random(3)
    pieces = ['a', '5" x', ' "b"', '""', '"c, d"', '"e\nf"', '"g ""h""\n\n"', '"""\n"', "", 'é', '"i\nj"']
    expected = {}
    for f in range(6):
        lines = [",".join([str(n), "-115", "2023", "7", "1", rng.choice(pieces), rng.choice(pieces)]) for n in range(120)]
        (tmp_path / f"{f}.csv").write_text("\n".join([head, *lines]) + "\n")
        with open(tmp_path / f"{f}.csv", newline="") as text:
            expected[f"{f}.csv"] = [tuple(x or None for x in r) for r in list(csv.reader(text))[1:]]
    (tmp_path / "open.csv").write_text(head + '\n1,-115,2023,7,1,1,"lost\n2,-115,2023,7,1,1,x\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            reports, skipped = fire_files.read_fire_files(spark, str(tmp_path))
            assert [(os.path.basename(r.source_file), r.reason) for r in skipped.collect()] == [("open.csv", "quote left open")]
            found = {}
            for r in reports.orderBy("line_no").collect():
                found.setdefault(os.path.basename(r.source_file), []).append(tuple(x or None for x in r[:7]))
            assert found == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_order_over_small_splits_and_packed_files(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k:05d}\n" for k in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("3000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = read_lines(spark, str(tmp_path)).orderBy("source_file", "line_no").collect()
            assert [r.value for r in found] == [f"{n}{k:05d}" for n in "abc" for k in range(3000)]
            assert len({(r.source_file, r.line_no) for r in found}) == 9000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_days_in_many_layouts(spark):
    texts = {
        "2023-07-14": True, "2023/07/14": True, "2023-7-14": True, "20230714": True, "7/14/2023": True, "14-Jul-2023": True, "Jul 14, 2023": True,
        "2023-07-14 10:20:30": True, "2023-07-14T10:20:30.5Z": True, " 2023/07/14 00:00 ": True, "2023-07-14xyz": False, "2023-13-01": False,
        "2023-02-30": False, "": False, "0000/00/00": False, "20230714 and more": False,
    }
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", to_day("t").cast("string").alias("d")).collect()
    assert {r.t: r.d for r in found} == {t: "2023-07-14" if good else None for t, good in texts.items()}


def test_collect_fires(spark):
    points = spark.createDataFrame(
        [("1", "50", "-115", "2023", "7", "1"), ("2", "50", "-115", "2023", "0", "1"), ("3", "70", "-115", "2023", "7", "1"),
         ("4", "50", "-115", "2019", "7", "1"), ("5", None, "-115", "2023", "7", "1"), ("6", "50", "-115", "-9999", "7", "1")],
        "NFDBFIREID string, LATITUDE string, LONGITUDE string, YEAR string, MONTH string, DAY string",
    )
    assert rows(pipeline.collect_fires(points), "NFDBFIREID") == [("1",)]
    shapes = spark.createDataFrame(
        [("1", "POLYGON ((-115 50, -114 50, -114 51, -115 50))", 2023, 7, 1), ("2", "POLYGON ((0 0, 1 0, 1 1, 0 0))", 2023, 7, 1)],
        "NFDBFIREID string, WKT string, YEAR int, MONTH int, DAY int",
    )
    kept = pipeline.collect_fires(shapes)
    assert rows(kept, "NFDBFIREID") == [("1",)]
    assert rows(pipeline.place_shapes(kept), "LATITUDE", "LONGITUDE") == [(50.5, -114.5)]


def test_csv_sink_writes_header_for_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "station_id string, parameter string")
    sinks.write_csv(empty, str(tmp_path / "empty"))
    assert spark.read.option("header", True).csv(str(tmp_path / "empty")).columns == ["station_id", "parameter"]


def test_a_file_numbered_through_is_followed_in_stretches(spark, monkeypatch):
    # The open quote of line 65534 ends three lines later, in the next stretch.
    n, stored, cut = 200_000, {}, fire_files.reliable_cut
    value = "CASE id WHEN 0 THEN 'A,B' WHEN 65534 THEN '1,\"x' WHEN 65537 THEN 'y\"' ELSE concat(id, ',b') END AS value"
    text = spark.range(n).selectExpr("'a.csv' AS source_file", "id AS line_no", value)

    def noted(df, name):
        stored[name] = cut(df, name)
        return stored[name]

    monkeypatch.setattr(fire_files, "reliable_cut", noted)
    reports, skipped = fire_files.parse_layouts(text, ("A", "B"))
    assert stored["csv-splits"].count() > 3 and "csv-headers" in stored
    assert skipped.isEmpty() and reports.count() == n - 4
    assert rows(reports.filter("line_no between 65533 and 65538"), "line_no", "A", "B") == [
        (65533, "65533", "b"), (65534, "1", "x\n65535,b\n65536,b\ny"), (65538, "65538", "b")
    ]


def test_daily_lines_are_made_in_several_tasks(spark, tmp_path):
    spark.range(25_000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = view(spark, str(tmp_path), "a_daily_lines")
    assert len(found.inputFiles()) == 3 and found.select("line_no").distinct().count() == 25_000
