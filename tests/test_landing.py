"""Verdicts on landed documents and the ledger of sites without rows."""

import json

import pytest
from agropanel.sources import landing, readers


def document(state, district, series, **more):
    return json.dumps({"state": state, "district": district, "lat": 1.0, "lon": 2.0, "properties": {"parameter": series}, **more})


WHOLE = {"PRECTOTCORR": {"20200101": 1.0, "20200102": -999.0}, "T2M": {"20200102": 5.0}}
LINES = [
    document("S", "whole", WHOLE),
    document("S", "cut", WHOLE)[:-30],
    document("S", "mended", WHOLE)[:-30],
    document("S", "mended", WHOLE),
    document("S", "empty", {}),
    document("S", "none", None),
    document("S", "no days", {"PRECTOTCORR": {}}),
    document("S", "dates", {"PRECTOTCORR": {"2020-13-45": 3.0, "x": 1.0}}),
    document("S", "fill", {"PRECTOTCORR": {"20200101": -999.0, "20200102": None}}),
    document("S", "two faults", WHOLE)[:40],
    document("S", "two faults", {}),
    document(None, None, WHOLE),
    document("S", "stranger", WHOLE),
    document("S", "stranger too", {}),
    "not json at all",
    "",
]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("landing")
    (path / "a.json").write_text("\n".join(LINES))
    return landing.read_landed(spark, f"file://{path}").cache()


def test_verdicts(documents):
    found = sorted(((r["district"], r["reason"], r["n_days"]) for r in landing.verdicts(documents).collect()), key=repr)
    assert found == sorted([
        ("whole", None, 2), ("cut", landing.UNREADABLE, 0), ("mended", landing.UNREADABLE, 0), ("mended", None, 2), ("empty", landing.NO_SERIES, 0),
        ("none", landing.NO_SERIES, 0), ("no days", landing.NO_SERIES, 0), ("dates", landing.NO_DATES, 0), ("fill", landing.ONLY_FILL, 0),
        ("two faults", landing.UNREADABLE, 0), ("two faults", landing.NO_SERIES, 0), (None, landing.NO_SITE, 2), ("stranger", None, 2),
        ("stranger too", landing.NO_SERIES, 0), (None, landing.UNREADABLE, 0),
    ], key=repr)


def test_ledger(spark, documents):
    names = ["whole", "cut", "mended", "empty", "none", "no days", "dates", "fill", "two faults", "absent", "absent"]
    expected = spark.createDataFrame([("S", n) for n in names], "state string, district string")
    found = {(r["state"], r["district"]): r["error"] for r in landing.ledger(expected, landing.verdicts(documents)).collect()}
    assert found == {
        ("S", "cut"): landing.UNREADABLE, ("S", "empty"): landing.NO_SERIES, ("S", "none"): landing.NO_SERIES, ("S", "no days"): landing.NO_SERIES,
        ("S", "dates"): landing.NO_DATES, ("S", "fill"): landing.ONLY_FILL, ("S", "two faults"): f"{landing.NO_SERIES}; {landing.UNREADABLE}",
        ("S", "absent"): landing.ABSENT, ("S", "stranger"): landing.UNKNOWN, ("S", "stranger too"): f"{landing.UNKNOWN}; {landing.NO_SERIES}",
        (None, None): f"{landing.UNKNOWN}; {landing.NO_SITE}; {landing.UNREADABLE}",
    }


def test_whole_documents_give_rows(documents):
    rows = readers.clean_daily(readers.explode_payload(landing.whole_documents(documents)))
    assert rows.where("district = 'whole'").count() == 2 and rows.where("district = 'cut'").count() == 0


def test_nothing_landed(spark, documents):
    expected = spark.createDataFrame([("S", "a")], "state string, district string")
    none = landing.verdicts(documents.limit(0))
    assert [r["error"] for r in landing.ledger(expected, none).collect()] == [landing.ABSENT]
    assert landing.ledger(expected.limit(0), none).count() == 0
