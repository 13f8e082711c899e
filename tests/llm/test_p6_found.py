import __spark_entry__ as entry

KEY = "-----BEGIN PRIVATE KEY-----\r\nq7Xk2b\r\n-----END PRIVATE KEY-----\r\n"


def test_lines_of_code_and_text_come_out_once(spark, tmp_path):
    rows = [
        (1, "code", 'host = "db"\nDB_PASSWORD = "Xk29fLq!7"\n'),
        (1, "code", 'host = "db"\nDB_PASSWORD = "Xk29fLq!7"\n'),  # delivered again
        (2, "text", "note\r\n" + KEY),
        (3, "email", 'DB_PASSWORD = "Xk29fLq!7"'),
        (4, "code", None),
        (5, "text", ""),
        (6, "code", 'DB_PASSWORD = "${DB_PASSWORD}"'),
    ]
    spark.createDataFrame(rows, "file_id bigint, kind string, text string").write.parquet(f"{tmp_path}/file_extract.parquet")
    df = entry.queries()["p6_found"](spark, str(tmp_path))
    assert df.dtypes == [("file_id", "bigint"), ("line_no", "int")]
    assert sorted(map(tuple, df.collect())) == [(1, 2), (2, 2), (2, 3), (2, 4)]


def test_files_with_credentials_are_restricted(spark, tmp_path):
    text = "DB_PASSWORD = 'Xk29fLq!7'"
    spark.createDataFrame([(i, "code", text) for i in (1, 2, 3)] + [(4, "code", "x = 1"), (5, "text", text)], "file_id bigint, kind string, text string").write.parquet(f"{tmp_path}/file_extract.parquet")
    spark.createDataFrame([(1, "public"), (1, "public"), (2, "restricted"), (3, None), (4, "public")], "file_id bigint, sensitivity string").write.parquet(f"{tmp_path}/file_catalog.parquet")
    got = entry.queries()["p6_sensitivity"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "public", "restricted"), (3, None, "restricted")]
    assert {r["file_id"]: r["redacted_text"] for r in entry.queries()["p6_redacted"](spark, str(tmp_path)).collect()}[1] == "DB_PASSWORD = '[SECRET]'"
