import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioscope.operators import catalog as c

SCHEMA = (
    "file_id bigint, path string, file_name string, sha256 string, size bigint, kind string, department string, doc_type string, sensitivity string, doc_date string, counterparty string, title string, tags array<string>, "
    "flags struct<personal_data:double,credentials:double,payment_details:double>, pii_columns array<struct<name:string,data:string,confidence:double>>, detected map<string,int>, noise boolean, review boolean, duplicate_of string, extract_error string, loaded_at timestamp, scanned_at timestamp"
)


def frame(spark, *rows):
    names = [p.split()[0] for p in SCHEMA.split(", ") if " " in p.strip()]
    names = ["file_id", "path", "file_name", "sha256", "size", "kind", "department", "doc_type", "sensitivity", "doc_date", "counterparty", "title", "tags", "flags", "pii_columns", "detected", "noise", "review", "duplicate_of", "extract_error", "loaded_at", "scanned_at"]
    return spark.createDataFrame([tuple({"path": r.get("file_name"), **r}.get(n) for n in names) for r in rows], SCHEMA)


def test_the_last_delivery_counts(spark):
    from datetime import datetime as d

    df = frame(spark, {"file_id": 1, "size": 1, "loaded_at": d(2023, 1, 1)}, {"file_id": 1, "size": 2, "loaded_at": d(2023, 1, 2)}, {"file_id": 1, "size": 3}, {"file_id": 2, "size": 4})
    assert sorted((r["file_id"], r["size"]) for r in c.latest(df).collect()) == [(1, 2), (2, 4)]


def test_originals(spark):
    df = frame(spark, {"file_id": 1, "path": "a/x copy.txt", "sha256": "h"}, {"file_id": 2, "path": "downloads/x.txt", "sha256": "h"}, {"file_id": 3, "path": "z/x.txt", "sha256": "h"}, {"file_id": 4, "path": "n", "sha256": None}, {"file_id": 5, "path": "m", "sha256": None})
    got = {r["file_id"]: (r["original_id"], r["original_path"]) for r in c.with_original(df).collect()}
    assert got == {1: (3, "z/x.txt"), 2: (3, "z/x.txt"), 3: (3, "z/x.txt"), 4: (4, "n"), 5: (5, "m")}
    assert {r["file_id"] for r in c.originals(df).collect()} == {3, 4, 5}
    assert [r[0] for r in df.select(c.copy_score("path")).collect()] == [3, 2, 0, 0, 0]
    rec = c.with_original_record(df.withColumn("department", F.col("path")), ["department"]).collect()
    assert {(r["file_id"], r["department"], r["review"], r["duplicate_of"]) for r in rec} == {(1, "z/x.txt", False, "z/x.txt"), (2, "z/x.txt", False, "z/x.txt")}


def test_predicates_are_null_safe(spark):
    df = frame(spark, {"file_id": 1}, {"file_id": 2, "department": "hr", "tags": ["final"], "doc_date": "2025-03-02", "counterparty": "Acme GmbH", "title": "Minutes", "review": True, "noise": False, "flags": Row(0.5, None, None)}, {"file_id": 3, "noise": True}, {"file_id": 4, "duplicate_of": "x"})
    ids = lambda **k: {r["file_id"] for r in c.selected(df, **k).collect()}
    assert ids() == {1, 2} and ids(include_noise=True) == {1, 2, 3} and ids(include_duplicates=True) == {1, 2, 4}
    for k in ({"department": "hr"}, {"tag": "final"}, {"year": 2025}, {"year": "2025-03"}, {"counterparty": "ACME"}, {"text": "minutes acme"}, {"review": True}, {"pii": True}):
        assert ids(**k) == {2}, k
    assert ids(department="", year=None) == {1, 2} and ids(limit=1) == {1}


def test_targets(spark):
    df = frame(
        spark, {"file_id": 1, "file_name": "a.txt", "department": "hr", "doc_type": "contract", "doc_date": "2025-03-02", "sensitivity": "restricted"}, {"file_id": 2, "file_name": "b.txt", "duplicate_of": "x", "sensitivity": "restricted"}, {"file_id": 3, "file_name": "c.txt", "noise": True, "sensitivity": "restricted"},
        {"file_id": 4, "file_name": "d.txt", "review": True}, {"file_id": 5, "file_name": ".env", "department": "a/b", "doc_date": None},
    )
    got = {r[0]: r[1] for r in df.select("file_id", c.target()).collect()}
    assert got == {1: "_Restricted/hr/contract/2025/a.txt", 2: "_Restricted/_Duplicates/b.txt", 3: "_Noise/c.txt", 4: "_Needs review/Unclassified/d.txt", 5: "a-b/_/Undated/.env"}
    odd = {r[0]: r[1] for r in df.select("file_id", c.target("{quarter}/{month}/{stem}_{nothing}{ext}", apart=False, labels={"departments": {"hr": "People"}})).collect()}
    assert odd[1] == "Q1/03/a_.txt" and odd[5] == "Undated/Undated/.env_"


def test_targets_differ_case_ignored(spark):
    rows = ["x/a.txt", "X/A.TXT", "x/a (2).txt", "x/a.txt", "x/a.txt", "y/.env", "y/.env", "x/a (3).txt", "x/a (3).txt"]
    df = spark.createDataFrame([(k, f"p{k}", t) for k, t in enumerate(rows)], "file_id int, path string, target string")
    got = {r["file_id"]: r["target"] for r in c.unique_targets(df).collect()}
    assert len({t.lower() for t in got.values()}) == len(rows)
    assert got[0] == "x/a.txt" and got[2] == "x/a (2).txt" and got[7] == "x/a (3).txt"
    assert got[5] == "y/.env" and got[6] == "y/.env (2)"


def test_places_among_equal_keys(spark):
    df = spark.range(500).selectExpr("id", "if(id % 3 = 0, 'hot', 'k' || id % 7) AS k")
    got = c.numbered(df, ["k"], ["id"]).collect()
    for k in {r["k"] for r in got}:
        own = sorted((r["id"], r["n"]) for r in got if r["k"] == k)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_medians_and_groups(spark):
    df = spark.createDataFrame([("a", 5), ("a", 1), ("a", 9), ("a", 7), ("b", 3), ("c", None)], "g string, v int")
    assert {(r["g"], r["n"], r["median"]) for r in c.upper_median(df, "g", "v").collect()} == {("a", 4, 7), ("b", 1, 3)}
    d = frame(spark, *({"file_id": k, "department": x, "doc_type": t} for k, (x, t) in enumerate([("hr", "b"), ("hr", "a"), ("hr", "a"), (None, None)])))
    assert {tuple(r) for r in c.top_types(d).collect()} == {("hr", 3, "a (2), b (1)"), ("unclassified", 1, "other (1)")}
    assert {(r["department"], r["place"], r["more"]) for r in c.listing(d, 1).collect()} == {("hr", 1, 1), ("hr", 1, 0), ("unclassified", 1, 0)}
    assert c.tiles(d).first()["departments"] == 2


@pytest.mark.parametrize("a, b, same", [(None, None, True), ("Acme Ltd", "ACME, Ltd.", True), ("Acme", "Acme Holdings", False), ("Acmes", "Acmes Holdings", True), ("Acme", None, False), ("", None, False)])
def test_same_org(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(c.same_org(F.col("a"), F.col("b"))).first()[0] is same


def test_empty(spark):
    df = frame(spark)
    assert c.summary(df).first()["files"] == 0 and c.unique_targets(df.select("file_id", "path", c.target().alias("target"))).collect() == [] and c.listing(df).collect() == []


def test_cache_and_estimate(spark):
    work = spark.createDataFrame([("a", 32), ("b", 64), ("c", None)], "key string, chars int")
    assert {r["key"] for r in c.cache_misses(work, spark.createDataFrame([("b",), ("b",)], "key string")).collect()} == {"a", "c"}
    assert tuple(c.estimate(work).first()) == (3, 30) and tuple(c.estimate(work.limit(0)).first()) == (0, 0)
