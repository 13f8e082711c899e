import __spark_entry__ as entry
from folioscope.llm.pieces import OVERLAP, SIZE, split_items


def test_pieces_are_bounded_repeat_and_join_to_the_text(spark):
    texts = ["x" * 2000, "x" * 2001, "é𝒳 " * 3000, ("Some words here. " * 20 + "\r\n\r\n") * 30, ("a line\n" * 900) + "y" * 5000, "", None]
    rows = split_items(spark.createDataFrame(list(enumerate(texts)), "id bigint, t string"), "id", "t").collect()
    for i, t in enumerate(texts):
        p = [r["piece"] for r in sorted((r for r in rows if r["id"] == i), key=lambda r: r["piece_no"])]
        assert all(len(x) <= SIZE for x in p)
        assert all(b[:OVERLAP] == a[-OVERLAP:] for a, b in zip(p, p[1:]))
        assert "".join([*p[:1], *(x[OVERLAP:] for x in p[1:])]) == (t or "")
        assert (len(p) > 1) == (len(t or "") > SIZE)
    assert all(r["piece"].endswith("\n") for r in rows if r["id"] == 3)


def test_both_tables_are_read_and_repeats_count_once(spark, tmp_path):
    long, short = "w " * 1001, "w " * 1000
    spark.createDataFrame([(1, long), (1, long), (2, short), (3, None)], "file_id bigint, text string").write.parquet(f"{tmp_path}/file_extract.parquet")
    spark.createDataFrame([(1, long), (7, long), (8, "𝒳" * 2000)], "request_id bigint, content string").write.parquet(f"{tmp_path}/request_state.parquet")
    df = entry.queries()["p4_found"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("file_extract", 1), ("request_state", 1), ("request_state", 7)]
