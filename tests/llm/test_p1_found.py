import __spark_entry__ as entry
from folioscope.llm.mail import aligned, inherited, own_lines, own_texts

HEAD = "From: Nora Ruddwick <nora@x.example>\nTo: Keith Stow <keith@y.example>\nDate: {}\nSubject: {}\n\n"


def lines(body, head=HEAD.format("Mon, 2 Jan 2023 10:00:00 +0000", "Re: pumps")):
    text = head + body
    return [text.split("\n")[n - 1].rstrip("\r") for n in own_lines(text)]


def test_quotes_introductions_signatures_and_notes_go():
    body = "Hi Keith,\r\n\r\nThe pumps are here.\r\n\r\nBest,\r\nNora\r\n\r\nNora Ruddwick\r\nYard Lead\r\n\r\nOn 3 May 2023, at 10:00, Keith Stow wrote:\r\n> Where are they?\r\n"
    assert lines(body) == ["Hi Keith,", "The pumps are here."]
    assert lines("Done.\n\nSent from my phone\n\nAttachments: a.pdf") == ["Done."]
    assert lines("Done.\n\nThis message is confidential and meant for its recipient.\nErase it.\n") == ["Done."]
    assert lines("Erledigt.\n\nVG Nora\n\n-----Ursprüngliche Nachricht-----\nVon: K <k@y.example>\nGesendet: 3 Mai 2023\nAn: N <n@x.example>\nBetreff: x\n\nunmarked words") == ["Erledigt."]


def test_answers_between_and_below_quotes_stay():
    body = "Keith,\n\n03/05/2023 10:00 - Keith Stow:\n> Where?\nIn the shed.\n\n> When?\nOn Friday.\n\nCheers\nNora"
    assert lines(body) == ["Keith,", "In the shed.", "On Friday."]
    assert lines("Le 03/05/2023, Zoé Lam\n<zoe@y.example> a écrit :\n> Où ?\n\nIci.") == ["Ici."]


def test_lines_that_only_look_like_them_stay():
    body = "Thanks, that settles it for our side.\nFrom: 3 March until 9 March the slipway stays closed.\nSent from the depot this morning: two pallets, both sealed.\nOn Monday the yard wrote: the crane is booked.\nPlease add the line \"this e-mail is confidential\" to the footer."
    assert lines(body) == body.split("\n")


def test_empty_and_header_only():
    assert own_lines(None) == own_lines("") == own_lines("no header\n\ntext") == own_lines(HEAD) == []


def test_alignment():
    assert aligned([0, 1, 2, 3], [5, 9, 6, 7]) == [0, 2, 3]
    assert inherited([0, 1, 2, 3, 4], [9] * 5, [20, 21, 22, 23, 24]) == set(range(12))
    assert inherited([0, 1], [9] * 2, [20, 21]) == set()


def test_unmarked_words_of_an_earlier_mail_of_the_thread_go(spark, tmp_path):
    old = "the harbour office measured the forecast of the coming season and left all the rest for the next meeting"
    rows = [
        (1, "email", "From: Keith Stow <keith@y.example>\nTo: Nora Ruddwick <nora@x.example>\nDate: Mon, 2 Jan 2023 10:00:00 +0000\nSubject: pumps\n\n" + old),
        (2, "email", HEAD.format("Tue, 3 Jan 2023 10:00:00 +0000", "Re: pumps") + "I agree.\n\n" + old),
        (2, "email", HEAD.format("Tue, 3 Jan 2023 10:00:00 +0000", "Re: pumps") + "I agree.\n\n" + old),
        (3, "email", HEAD.format("Tue, 3 Jan 2023 10:00:00 +0000", "other") + "I agree.\n\n" + old),
        (4, "email", None),
        (5, "email", ""),
        (6, "text", HEAD.format("", "") + "no mail"),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, kind string, text string").selectExpr("*", "1 AS thread", "2 AS id", "3 AS line_no")
    df.write.parquet(f"{tmp_path}/file_extract.parquet")
    got = entry.queries()["p1_found"](spark, str(tmp_path))
    assert got.dtypes == [("file_id", "bigint"), ("line_no", "int")]
    assert sorted(map(tuple, got.collect())) == [(1, 6), (2, 6), (3, 6), (3, 8)]
    assert {tuple(r) for r in own_texts(df.filter("file_id in (2, 3)")).collect()} == {(2, "I agree.\n\n" + old), (3, "I agree.\n\n" + old)}
    assert {r[1] for r in own_texts(df.filter("file_id in (1, 2)")).collect()} == {old, "I agree."}


def test_empty_table(spark):
    from folioscope.llm.mail import new_lines

    assert new_lines(spark.createDataFrame([], "file_id bigint, text string")).collect() == []
