import pytest

from conftest import rows
from emberline.operators import validate

CASES = [
    ("ok", 50.1, -115.2, 2023, 7, 14, 120.0, "POINT (-115.2 50.1)", None),
    ("box", 65.0, -115.0, 2023, 7, 14, 1.0, "", "bounds"),
    ("null lat", None, -115.0, 2023, 7, 14, 1.0, "", "bounds"),
    ("year", 50.0, -115.0, 2019, 7, 14, 1.0, "", "year"),
    ("null year", 50.0, -115.0, None, 7, 14, 1.0, "", "format"),
    ("month", 50.0, -115.0, 2023, 13, 1, 1.0, "", "month"),
    ("day", 50.0, -115.0, 2023, 6, 32, 1.0, "", "day"),
    ("date", 50.0, -115.0, 2023, 2, 30, 1.0, "", "date"),
    ("leap", 50.0, -115.0, 2024, 2, 29, 1.0, "", None),
    ("size low", 50.0, -115.0, 2023, 7, 14, -5.0, "", "size"),
    ("size high", 50.0, -115.0, 2023, 7, 14, 2e6, "", "size"),
    ("size null", 50.0, -115.0, 2023, 7, 14, None, "", None),
    ("geometry", 50.0, -115.0, 2023, 7, 14, 1.0, "CIRCLE (1 2)", "geometry"),
    ("lower", 50.0, -115.0, 2023, 7, 14, 1.0, "  multipolygon (((0 0)))", None),
    ("geometry null", 50.0, -115.0, 2023, 7, 14, 1.0, None, None),
    ("two faults", 65.0, -115.0, 2019, 13, 40, -1.0, "X", "bounds"),
]


@pytest.fixture(scope="module")
def classified(spark):
    raw = spark.createDataFrame(
        [c[:8] for c in CASES],
        "NFDBFIREID string, LATITUDE double, LONGITUDE double, YEAR int, MONTH int, DAY int, SIZE_HA double, geometry_wkt string",
    )
    return validate.classify_fires(raw)


def test_rules(classified):
    found = {r.NFDBFIREID: r.reject for r in classified.collect()}
    assert found == {c[0]: c[8] for c in CASES}


def test_text_columns_follow_the_same_rules(spark):
    raw = spark.createDataFrame(
        [tuple(None if v is None else str(v) for v in c[:8]) for c in CASES],
        "NFDBFIREID string, LATITUDE string, LONGITUDE string, YEAR string, MONTH string, DAY string, SIZE_HA string, geometry_wkt string",
    )
    found = {r.NFDBFIREID: r.reject for r in validate.classify_fires(raw).collect()}
    assert found == {c[0]: c[8] for c in CASES}


def test_defaults_and_date(classified):
    row = validate.valid(classified).filter("NFDBFIREID = 'size null'").first()
    assert row.SIZE_HA == 0.0 and row.CAUSE == "" and str(row.fire_date) == "2023-07-14"


def test_counts(classified):
    assert rows(validate.processed_counts({"wildfires": classified})) == [("wildfires", 16, 5, 11)]
    counts = {r.rule: r.n for r in validate.rule_counts({"wildfires": classified}).collect()}
    assert counts["bounds"] == 3 and counts["valid"] == 5 and sum(counts.values()) == 16
    assert validate.reject_rows(classified, "wildfires", "NFDBFIREID").count() == 11
