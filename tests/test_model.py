from pyspark.sql import functions as F

from folioscope.operators import model as m

TAX = (("red", "apples cherries"), ("blue", "plums sky"), ("other", "none"))


def test_choices_ties_and_probabilities(spark):
    df = spark.createDataFrame([("Cherries and APPLES",), ("nothing",), (None,), ("sky apples",)], "t string")
    a = [r[0] for r in df.select(m.answer(m.words_of("t"), TAX)).collect()]
    assert [x["choice"] for x in a] == ["red", "red", "red", "red"] and [x["runner_up"] for x in a] == ["blue", "blue", "blue", "blue"]
    assert a[0]["confidence"] == 0.7 and a[1]["confidence"] == 0.5
    assert {p["id"]: p["p"] for p in a[0]["probabilities"]} == {"red": 0.6, "blue": 0.2, "other": 0.2}
    assert [r[0] for r in df.select(m.tag_scores(m.words_of("t"), (("x", "apples cherries"),))).collect()] == [["x"], [], [], []]


def test_request_keys_and_hashes(spark):
    df = spark.createDataFrame([("a",), ("b",)], "x string").select(m.request_key(m.request({"x": F.col("x")})), m.request_key(m.request({"x": F.col("x")}), "other"))
    keys = [k for r in df.collect() for k in r]
    assert len(set(keys)) == 4 and all(len(k) == 64 for k in keys)
    assert m.question_hash({"tags": 1, "layout": 1}) == m.question_hash({"tags": 1, "layout": 2}) != m.question_hash({"tags": 2})
    assert m.shrunk() == [6000, 3000, 1500, 750] and m.shrunk(1000) == [1000, 500]


def test_rules(spark):
    flags, cols = "struct<personal_data:double,credentials:double,payment_details:double>", "array<struct<name:string,data:string,confidence:double>>"
    rows = [
        ("restricted", 0.5, None, None, (0.1, 0.1, 0.1), None), ("restricted", 0.9, None, None, None, None), ("internal", 0.9, "confidential", "bank account numbers", (0.0, 0.9, 0.0), [("a", "salary", 0.9)]), ("public", 0.9, None, None, None, [("a", "national_id", 0.7), ("b", "salary", 0.7), ("c", "salary", 0.9), ("d", "health", 0.5)]),
        (None, None, None, None, None, None), ("restricted", 0.5, None, None, (0.6, 0.0, 0.0), []),
    ]
    df = spark.createDataFrame(rows, f"s string, c double, f string, r string, fl {flags}, cols {cols}")
    out = [tuple(r[0]) for r in df.select(m.settled(F.col("s"), F.col("c"), F.col("f"), F.col("r"), F.col("fl"), F.col("cols"))).collect()]
    assert out[0][:2] == ("confidential", None) and out[0][2][0].startswith("lowered") and out[1] == ("restricted", None, [])
    assert out[2] == ("restricted", "internal", ["detected bank account numbers", "contains credentials"])
    assert out[3] == ("restricted", "public", ["columns with national id, salary"]) and out[4] == (None, None, []) and out[5] == ("restricted", None, [])
