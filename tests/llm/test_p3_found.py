import random

import __spark_entry__ as entry
from folioscope.llm import names
from folioscope.llm.names import class_key, distance, form, near, parties, within_one


def test_forms():
    same = ["Luver & Stovupen Logistics plc", "LUVER &AMP; STOVUPEN LOGISTICS PLC", "Stovupen Logistics, Luver", "Luver and Stovupen Log. P.L.C.", "c/o Luver / Stovupen Logistics", "Luver-Stovupen Logistics (PLC)", "The Luver + Stovupen Logistics plc [old]", "Luver Stovupen Logistics plc, Kirkmoor", "plc Luver & Stovupen Logistics - accounts", "Lüver & Stovupen Logistics plc t/a Stovupen"]
    assert len({class_key(x) for x in same}) == 1
    assert class_key("Liz Stosepell") == class_key("Mrs. STOSEPELL, Elizabeth") == class_key("Elizabeth E. Stosepell")
    assert form("E. Stosepell") == (["stosepell"], ["e"], "")
    assert class_key("Compagnie Marey SAS") != class_key("Transports Marey SAS")
    assert form(None) == form("  ") == ([], [], "")


def test_distance_is_a_metric_and_near_is_exact():
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abc", k=rnd.randrange(6))) for _ in range(40)]
    for a in words:
        for b in words:
            assert distance(a, b) == distance(b, a) and (distance(a, b) == 0) == (a == b)
            assert within_one(a, b) == (distance(a, b) <= 1)
            assert all(distance(a, c) <= distance(a, b) + distance(b, c) for c in words[:12])
    assert near(words) == {(i, j) for i in range(40) for j in range(i + 1, 40) if distance(words[i], words[j]) <= 1}


def test_parties(spark, tmp_path):
    rows = ["Varund Nareser Maschinenbau KG", "Varund Narser Maschinenbau", "V. Nareser Maschinenbau", "Nareser Maschinenbau KG", "Varund Vutedey Maschinenbau KG", "Feken Stodal Ltd", "Feken Stomal GmbH", "Theodore Nazoley", "T Nazoley", "Ted Nazoley", "Henry Stogovow", "Hal Vuger", None, "", "Theodore Nazoley"]
    df = spark.createDataFrame([(k, x, "x") for k, x in enumerate(rows)], "file_id int, counterparty string, party string")
    df.write.parquet(f"{tmp_path}/file_catalog.parquet")
    got = set(map(tuple, entry.queries()["p3_found"](spark, str(tmp_path)).collect()))
    groups = [rows[:4], rows[5:7], rows[7:10]]
    assert got == {(a, b) for g in groups for a in g for b in g if a.encode() < b.encode()}


def test_an_ambiguous_short_form_stays_alone(spark):
    rows = ["Vara Nareser Textiles", "Vilo Nareser Textiles", "V. Nareser Textiles", "Nareser Textiles", "Edward Vuger", "Theodore Vuger", "Ted Vuger"]
    got = parties(spark.createDataFrame([(x,) for x in rows], "n string")).collect()
    assert len({r["party"] for r in got}) == len(rows)


def test_pivot_cells_lose_no_pair(spark, monkeypatch):
    rnd = random.Random(2)
    monkeypatch.setattr(names, "CELL", 10)
    rows = {"Varund " + "".join(rnd.choices("aeilr", k=4)) for _ in range(250)}
    keys = sorted({class_key(x) for x in rows})
    points = names._exploded(spark.createDataFrame([(k,) for k in keys], "key string"))
    cells = names._cells(points)
    assert cells.select("cell").distinct().count() > 5
    got = set(map(tuple, names._near_links(cells).collect()))
    want = {(a, b) for a in keys for b in keys if a < b for x in [set(a.split())] for y in [set(b.split())] if x & y and distance(min(x - {"varund"}, default=""), min(y - {"varund"}, default="")) <= 1}
    assert want <= got and len(want) > 50


def test_empty(spark):
    assert parties(spark.createDataFrame([], "n string")).collect() == []
