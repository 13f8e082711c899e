from folioscope.functions import text as t


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f("t")).collect()]


def test_titles_and_clips(spark):
    assert one(spark, t.first_line, "\n# \n > * Title here \nx", "ab\ncd", None, "") == ["Title here", None, None, None]
    long = "a" * 5000 + "b" * 5000
    (c,) = one(spark, t.clipped, long)
    assert c == "a" * 4500 + "\n[... 4,000 characters skipped ...]\n" + "b" * 1500
    assert one(spark, t.clipped, "short", None) == ["short", None]
    assert [r[0] for r in spark.createDataFrame([(1,), (2048,), (3 << 20,)], "n bigint").select(t.human_size("n")).collect()] == ["1 B", "2.0 KB", "3.0 MB"]


def test_markup(spark):
    html = "<html><title> A\n B </title><style>x{}</style><p>One&nbsp;&amp; two</p><div>3 &lt; 4<br>5</div><!-- no --></html>"
    assert one(spark, t.html_to_text, html) == ["A\nB One & two\n3 < 4\n5"]
    assert one(spark, t.html_title, html, "<p>none</p>") == ["A B", None]


def test_names_and_delimiters(spark):
    assert one(spark, t.file_name, ' a/b:c*?.  ', "...", None, "x" * 99) == ["a-b-c--", "_", "_", "x" * 80]
    assert one(spark, t.extension, "a.tar.gz", ".env", "none", "x.") == [".gz", "", "", "."]
    assert one(spark, t.stem, "a.tar.gz", ".env") == ["a.tar", ".env"]
    assert one(spark, t.delimiter, "a;b;c\n1,5;2;3", "a,b;c", "a\tb", "x|y|z") == [";", ",", "\t", "|"]
    assert one(spark, lambda c: t._col(c).rlike(t.glob_pattern("~$*.t?p")), "~$x.TMP", "x.tmp", "~$a.tp") == [True, False, False]
    assert one(spark, t.squeezed, "  a  b ") == ["a b"]
