import random

import __spark_entry__ as entry
from folioscope.llm.leaks import RUN, Items, within, words


def runs(t):
    return {tuple(words(t)[k : k + RUN]) for k in range(len(words(t)) - RUN + 1)}


def test_as_many_as_by_comparing_all_stretches():
    rnd = random.Random(7)
    items = [(i, " ".join(rnd.choices(["a", "b", "cc", "ddd"], k=rnd.choice([11, 12, 30])))) for i in range(40)]
    held = Items(items)
    for shift in range(300):
        doc = " ".join([*rnd.choices("abc", k=shift % 17), *words(rnd.choice(items)[1])[3 : 3 + RUN - shift % 2], *rnd.choices("abc", k=9)])
        assert held.held_in(doc) == {i for i, t in items if runs(t) & runs(doc)}


def test_a_stretch_with_edits_is_found_within_its_budget_only():
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(500)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=20))) for i in range(10)]
    for edits in (1, 2, 3):
        held = Items(items, edits)
        for trial in range(40):
            i, t = rnd.choice(items)
            part = list(" ".join(t.split()[4:16]))
            for place in sorted(rnd.sample(range(5, len(part) - 5, 7), edits), reverse=True):
                part[place : place + rnd.randrange(2)] = "z" * rnd.randrange(1, 2)
            doc = " ".join(rnd.choices(vocabulary, k=8)) + " " + "".join(part) + " " + " ".join(rnd.choices(vocabulary, k=8))
            assert i in held.held_in(doc)
        assert held.held_in(" ".join(rnd.choices(vocabulary, k=60))) == set()


def test_within():
    assert within("kitten", "xxsittingxx", 2, 2) and not within("kitten", "xxsmittingxx", 1, 2) and within("abc", "abc", 0, 0)


def test_layout_and_case_are_ignored(spark, tmp_path):
    item = "One two, three four five six seven eight nine ten eleven Été"
    spark.createDataFrame([(9, item, 1), (10, None, 1), (11, "too short", 1)], "item_id bigint, text string, doc_id int").write.parquet(f"{tmp_path}/eval_items.parquet")
    docs = [(1, "so: ONE\ntwo|three-four\n\nfive_six seven eight nine ten (eleven) été!"), (1, item), (2, "two three four five six seven eight nine ten eleven été"), (3, None), (4, ""), (5, "x" * 100_000)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["p7_found"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("item_id", "bigint")] and list(map(tuple, got.collect())) == [(1, 9)]


def test_no_items_or_documents(spark):
    from folioscope.llm.leaks import leaks

    none = spark.createDataFrame([], "doc_id bigint, item_id bigint, text string")
    assert leaks(none, none).collect() == []
    assert leaks(spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "doc_id bigint, text string"), none).collect() == []
