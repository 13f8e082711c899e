import pytest
from pyspark.sql import functions as F

from folioscope.operators import candidates as k


@pytest.mark.parametrize(
    "text, values",
    [
        ("on 2026-02-31 and 2026-13-01", ["2026-02-31"]), ("3rd of May, 2024; 12. März 2023; 1 juillet 2022, 2 juin 2021", ["2024-05-03", "2023-03-12", "2022-07-01", "2021-06-02"]), ("May 3, 2024", ["2024-05-03"]), ("03/04/2026 and 3.4.2026", ["2026-04-03"]),
        ("2024/5/6", ["2024-05-06"]), ("1979-01-01, 2101-01-01, 12345-01-01, 3 Foo 2024", []), ("é2024-01-02", ["2024-01-02"]), ("", []), (None, []),
    ],
)
def test_dates(spark, text, values):
    assert [v for v, _ in k.dates_in(text)] == values
    native = spark.createDataFrame([(text,)], "t string").select(k.date_values("t")).first()[0]
    assert (native or []) == values


def test_date_order_caps_and_contexts(spark):
    assert [v for v, _ in k.dates_in("03/04/2026", "mdy")] == ["2026-03-04"]
    many = " ".join(f"2024-01-{d:02}" for d in range(1, 29)) + " 2 May 2020 3 May 2020"
    assert len(k.dates_in(many, most=25)) == 26 and k.dates_in("x " * 60 + "due  2024-01-02\n then")[0][1].endswith("due 2024-01-02 then")
    rows = spark.createDataFrame([("due 2024-01-02 then",), (None,)], "t string").select(k.as_options(k.date_candidates("t"), "none of these").alias("o")).collect()
    assert [tuple(x) for x in rows[0]["o"]] == [("c0", '2024-01-02   (in: "...due 2024-01-02 then...")'), ("none", "none of these")] and len(rows[1]["o"]) == 1


def test_organisations():
    names = lambda t, **a: [n for n, _ in k.orgs_in(t, **a)]
    assert names("Invoice from Acme Widgets Ltd. and ACME WIDGETS LTD to Baker & Sons; Customer Services; Jane Doe Manager") == ["Acme Widgets Ltd", "Baker & Sons"]
    assert names("Harbour Print Studio met Oakridge Logistics.") == ["Harbour Print Studio", "Oakridge Logistics"]
    assert names("Acme Widgets Ltd", exclude=["Acme Widgets"]) == [] and names("we like blue sky people", known=["Blue Sky"]) == ["blue sky"]
    assert names(None) == names("") == [] and k.org_key("A & B Ltd.") == "a and b" and k.without_suffix("Acme Ltd") == "Acme Ltd" and k.without_suffix("Acme Widgets Ltd") == "Acme Widgets"


def test_corpus(spark):
    rows = [(n, "We at Acme Widgets Ltd met Baker Foods plc.") for n in range(4)] + [(9, "Nothing here."), (10, None), (11, "")]
    df = spark.createDataFrame(rows, "file_id int, text string")
    assert [tuple(r) for r in k.company(df).collect()] == [("Acme Widgets Ltd", 4, 5)]
    assert k.company(df.filter("file_id < 2")).collect() == []
    got = {(r["name"], r["n"]) for r in k.entities(df, own=["Acme Widgets"]).collect()}
    assert got == {("Baker Foods plc", 4), ("Baker Foods", 4)}
    assert k.mentions(df.limit(0)).collect() == []


def test_months(spark):
    words = ["Juillet", "juin", "März", "dicembre", "Xyz", "Marble", None]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(k.month_of(F.col("w"))).collect()] == [7, 6, 3, 12, None, 3, None]
