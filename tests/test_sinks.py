import json

import pytest

from folioscope.operators import catalog as c
from folioscope.sources import sinks
from tests.test_catalog import SCHEMA, frame

ROWS = [
    {"file_id": 1, "path": "a/x.txt", "file_name": "x.txt", "department": "hr", "doc_type": "contract", "size": 3, "sha256": "h1", "tags": ["final", "pricing"], "title": 'say "hi", ok', "detected": {"email": 2, "card": 1}, "sensitivity": "restricted", "doc_date": "2025-01-02"},
    {"file_id": 2, "path": "b/y.txt", "file_name": "y.txt", "review": True, "size": 4, "title": "</script><b>"},
    {"file_id": 3, "path": "c/z.txt", "file_name": "z.txt", "duplicate_of": "a/x.txt", "size": 3}, {"file_id": 4, "path": "d|/n.txt", "file_name": "n.txt", "noise": True},
]


def full(spark):
    df = frame(spark, *ROWS)
    for name in ("target_path string", "department_confidence double", "type_confidence double", "sensitivity_confidence double"):
        n, t = name.split()
        df = df.selectExpr("*", f"CAST(NULL AS {t}) AS {n}")
    return df


def test_jsonl_and_csv_come_back(spark, tmp_path):
    df = full(spark)
    sinks.write_jsonl(df, f"{tmp_path}/j")
    back = sinks.read_jsonl(spark, f"{tmp_path}/j", SCHEMA)
    assert sorted(map(str, back.select("path", "tags", "detected").collect())) == sorted(map(str, df.select("path", "tags", "detected").collect()))
    sinks.write_csv(df, f"{tmp_path}/c")
    rows = {r["path"]: r for r in spark.read.csv(f"{tmp_path}/c", header=True, escape='"').collect()}
    assert tuple(rows["a/x.txt"].asDict()) == c.CSV_COLUMNS and len(c.CSV_COLUMNS) == 24
    assert rows["a/x.txt"]["title"] == 'say "hi", ok' and rows["a/x.txt"]["tags"] == "final; pricing" and rows["a/x.txt"]["detected"] == "card:1; email:2"
    assert sinks.run_facts(df, input="here") == {"files": 4, "filed": 1, "needs_review": 1, "restricted": 1, "duplicates": 1, "noise": 1, "failed": 0, "bytes": 10, "input": "here"}


def test_index_and_page(spark):
    df = full(spark)
    text = sinks.index_markdown(df)
    assert "## hr / contract\n\n- 2025-01-02 x.txt" in text and "## Noise\n\n- d\\|/n.txt" in text and "| hr | 1 | contract (1) |" in text
    page = sinks.report_html(df, "R & D")
    data = page.split('id=d>')[1].split("</script>")[0]
    assert "R &amp; D" in page and "<b>" not in data and len(json.loads(data)) == 4
    assert "# Guide" in sinks.guide() and sinks.index_markdown(df.limit(0)).startswith("# Index")


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"_note": 1, "folders": {"noise": "N"}, "layout": "{stem}", "departments": {"a": "1", "b": "2"}}))
    cfg = sinks.load_config(str(p))
    assert cfg["folders"]["noise"] == "N" and cfg["folders"]["review"] == "_Needs review" and "_note" not in cfg and sinks.load_config()["thresholds"]["tag"] == 0.7
    for bad in ({"layout": "{year}"}, {"types": {"a": "1"}}):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            sinks.load_config(str(p))
    sinks.write_config(str(tmp_path / "new.json"))
    assert sinks.load_config(str(tmp_path / "new.json")) == sinks.load_config()
    with pytest.raises(FileExistsError):
        sinks.write_config(str(tmp_path / "new.json"))


@pytest.mark.parametrize("mode, done", [("copy", "copied"), ("link", "linked"), ("symlink", "linked")])
def test_apply_twice_does_nothing_the_second_time(spark, tmp_path, mode, done):
    src, dst = tmp_path / "in", tmp_path / "out"
    (src / "a").mkdir(parents=True)
    (src / "a/x.txt").write_text("one")
    (src / "a/y.txt").write_text("two")
    (dst / "t").mkdir(parents=True)
    (dst / "t/y.txt").write_text("in the way")
    plan = spark.createDataFrame([("a/x.txt", "t/x.txt", 3, None), ("a/y.txt", "t/y.txt", 3, None), ("a/gone", "t/gone", 1, None)], "path string, target string, size bigint, sha256 string")
    got = {r["path"]: (r["target"], r["done"]) for r in sinks.apply_plan(plan, str(src), str(dst), mode).collect()}
    assert got == {"a/x.txt": ("t/x.txt", done), "a/y.txt": ("t/y (2).txt", "renamed"), "a/gone": ("t/gone", "missing")}
    assert (dst / "t/y.txt").read_text() == "in the way" and (dst / "t/y (2).txt").read_text() == "two" and (src / "a/x.txt").read_text() == "one"
    again = sinks.apply_plan(plan.filter("path = 'a/x.txt'"), str(src), str(dst), mode)
    assert [r["done"] for r in again.collect()] == ["skipped"]
    sinks.log_applied(again, str(tmp_path / "log"))
    assert spark.read.schema("path string").json(str(tmp_path / "log")).count() == 0


def test_apply_refuses(spark, tmp_path):
    df = spark.createDataFrame([], "path string, target string, size bigint, sha256 string")
    for dest, mode in ((tmp_path / "in/out", "copy"), (tmp_path / "in", "copy"), (tmp_path / "o", "move")):
        with pytest.raises(ValueError):
            sinks.apply_plan(df, str(tmp_path / "in"), str(dest), mode)
