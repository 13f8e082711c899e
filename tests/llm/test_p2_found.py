import re

import pytest

import __spark_entry__ as entry
from folioscope.llm import pii
from folioscope.llm.pii import draw, find, redact_pii, render, surrogates, units

GIVEN = frozenset(pii._STATIC)
WRAPPED = "The harbour office measured the forecast of the coming season, ask Nora\nRuddwick and all of the others for the rest of it or call +44 20 7946\n0730 as the crane is in use until next spring."


def found(text, kind="text", announced=None):
    return {(t, text[s:e]) for s, e, t, g, f in find(text, kind, announced, GIVEN) if f is None or pii._bears(g, f, GIVEN.__contains__, {"ruddwick", "verbresse"}.__contains__)}


@pytest.mark.parametrize("value", ["n.ruddwick+x@mail.firow.example", "nora (at) firow dot example", "nora [at] firow.example", "N.Ruddwick@Firow.Example"])
def test_emails(value):
    assert found(f"Reply to {value}, by Friday.") == {("email", value)}


@pytest.mark.parametrize("value", ["+44 (0)7700 900297", "(+34) 610 368 413", "0044 161 496 0292", "07700 900365", "0117 496 0546", "(0117) 496 0564", "415-555-0171", "(415) 555-0116", "415.555.0142", "030/23125-395", "0171/39 20 422", "06-39-98-48-59", "01.99.00.03.99", "600 998 510", "91 067 03 68", "(0221) 4710-719"])
def test_phones(value):
    assert found(f"Please call {value} ext. 076.") == {("phone", value)}
    assert found(f"Tel. {value}\n126 Capell Road\n") >= {("phone", value)}


@pytest.mark.parametrize("text", ["order SO 0117496", "tracking 742772111422", "EAN 4000021072472", "VAT no. GB 018633312", "part no. 580-445-12184", "SKU 245-0917", "on 01.02.2023", "company number 07415290", "PO box 672", "postgres://app:pw@db.example/x"])
def test_numbers_that_are_none(text):
    assert found(f"We have {text} here.") == set()


@pytest.mark.parametrize(
    "value, text",
    [(v, "Payroll still needs the {}.") for v in ("235-52-7694", "SL-09-67-36-A", "JW 92 17 58 C", "ATESB955648YB9NN", "70NK62693", "2 71 12 39 033 165 18", "183119362476611", "L85X21T59", "C68E74922", "95692125G", "01.219.093-R", "X7206164Z", "11 280593 H 758")]
    + [("516301245", "the passport {} of"), ("CSB803342", "pasaporte {} de"), ("48003169830", "(IdNr. {})"), ("516301245", "(passport {})")],
)
def test_identities(value, text):
    assert found("Item 12: " + text.format(value)) == {("identity", value)}


@pytest.mark.parametrize("value", ["50-52 Lepan Ave", "31C Tudegund Road", "189 Old Hurkoger Street", "123, boulevard de Sutavund", "25 ter impasse Sagan", "Avda. de Wagell, 91", "C/ Corokick 228", "Plaza Gabobick n.º 154", "Vugogardstr. 148", "Cinowweg 154b", "Am Lunard 236"])
def test_addresses(value):
    assert found(f"Witness of {value}, 00127 Tavistone") == {("address", value)}


@pytest.mark.parametrize("value", ["Nora Ruddwick", "NORA RUDDWICK", "Nora J. Ruddwick", "Ruddwick, Nora", "N. Ruddwick", "Nora O'Ruddwick-Stow", "Nora de Verbresse", "de Verbresse, Nora"])
def test_names(value):
    assert found(f"- Agreed with {value} and others") == {("name", value)}


def test_no_names():
    assert found("Dear Nora,\nFollowing the audit Nora Ruddwick Ltd and Best Regards, Nora\nYard Lead") == set()


def test_wrapped_values_stand_as_they_are():
    assert found(WRAPPED) == {("name", "Nora\nRuddwick"), ("phone", "+44 20 7946\n0730")}


def test_columns():
    text = 'Sheet "x": 3 rows x 4 columns\nemployee_id | full_name | ref | size\n12345678 | Qira Zomt | 516301245 | 1\n12345679 | Mr Zomt, Qira |  | 2\n12345670 | Una Ruddwick | WKB538876 | 3'
    assert found(text, "table", {"ref": "national_id", "size": "person_name"}) == {("name", "Qira Zomt"), ("name", "Zomt, Qira"), ("name", "Una Ruddwick"), ("identity", "516301245"), ("identity", "WKB538876")}


def test_empty():
    assert find(None) == find("") == []


def test_surrogates_keep_format_and_refer_alike():
    key = b"k"
    of = lambda t, v: render(t, v, {(k, u): draw(key, k, u, 0) for k, u in units(t, v)})
    a, b = of("phone", "+44 161 496 0292"), of("phone", "0161 496 0292")
    assert re.fullmatch(r"\+44 \d{3} \d{3} \d{4}", a) and re.sub(r"\D", "", a)[2:] == re.sub(r"\D", "", b)[1:] and a != "+44 161 496 0292"
    full, turned, short = of("name", "Nora Ruddwick"), of("name", "RUDDWICK, NORA"), of("name", "N. Ruddwick")
    assert turned == ", ".join(reversed(full.upper().split())) and short.split()[1] == full.split()[1]
    assert full.split()[0] in pii.GIVEN["f"].split()
    assert re.fullmatch(r"[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}", of("identity", "L85X21T59"))
    assert re.fullmatch(r"\w+ \(at\) \w+ dot example", of("email", "nora (at) firow dot example"))
    assert of("address", "31C Tudegund Road").endswith(" Road")


def test_surrogates_differ(spark):
    rows = [("name", f"Nora {a}{b}") for a in "BCDF" for b in ("al", "el", "il", "ol")] + [("phone", f"0161 496 {k:04}") for k in range(300)] + [("name", "Nora Bal")]
    got = surrogates(spark.createDataFrame(rows, "pii_type string, pii_value string"), b"key").collect()
    assert len(got) == len(set(rows)) == len({(r["pii_type"], r["surrogate"]) for r in got})
    assert not {r["surrogate"] for r in got} & {v for _, v in rows}


def test_query_and_redaction(spark, tmp_path, monkeypatch):
    mail = "From: Qira Zomt <qira@x.example>\n\nCall 0117 496 0546."
    rows = [(1, "email", mail, 0), (1, "email", mail, 0), (2, "email", mail.replace("Qira Zomt", "Qira Vund"), 0), (3, "text", "Ask Qira Zomt or Z. Qira or Q. Zomt", 0), (4, "text", None, 0), (5, None, "", 0)]
    df = spark.createDataFrame(rows, "file_id bigint, kind string, text string, start int")
    df.write.parquet(f"{tmp_path}/file_extract.parquet")
    spark.createDataFrame([(1, None), (9, None)], "file_id bigint, pii_columns array<struct<name string, data string, confidence double>>").write.parquet(f"{tmp_path}/file_catalog.parquet")
    want = {(i, t, v) for i in (1, 2) for t, v in (("email", "qira@x.example"), ("phone", "0117 496 0546"))} | {(1, "name", "Qira Zomt"), (2, "name", "Qira Vund"), (3, "name", "Qira Zomt"), (3, "name", "Q. Zomt")}
    for limit in (pii.BROADCAST_WORDS, 0):  # sent to every executor, and joined
        monkeypatch.setattr(pii, "BROADCAST_WORDS", limit)
        got = entry.queries()["p2_found"](spark, str(tmp_path))
        assert [c for c, _ in got.dtypes] == ["file_id", "pii_type", "pii_value"]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    out = {(r["file_id"], r["redacted_text"]) for r in redact_pii(df).collect()}
    assert (1, "From: [NAME] <[EMAIL]>\n\nCall [PHONE].") in out and (3, "Ask [NAME] or Z. Qira or [NAME]") in out and (4, None) in out and (5, "") in out
    keyed = {r["file_id"]: r["redacted_text"] for r in redact_pii(df, key=b"s").collect()}
    assert re.fullmatch(r"From: (\w+ \w+) <\w+@\w\.example>\n\nCall \d{4} \d{3} \d{4}\.", keyed[1]) and "Zomt" not in keyed[3]
    assert re.match(r"From: (\w+ \w+)", keyed[1])[1] in keyed[3]


def test_a_large_lexicon_gives_the_same_values(spark, tmp_path, monkeypatch):
    shown = "".join(f'To: "{g} {f}" <x@y.example>\n' for g in ("Qira", "Vosk", "Jean-Élo") for f in ("Zomt", "O'Vund", "Stow-Harl", "McRae"))
    texts = [
        ("email", shown),
        ("email", shown + "Regards"),
        ("table", 'Sheet "x": 3 rows x 2 columns\nbearer | n\nQira Lunt | 1\nMs Vosk Lunt | 2\nPelt Lunt | 3'),
        ("table", 'Sheet "y": 3 rows x 2 columns\nbearer | n\nPelt Lunt | 1\nDorp Lunt | 2\nKelm Zomt | 3'),
        ("text", "Ask Vosk Qira Zomt, Zomt, Qira or ZOMT, VOSK; Q. O'Vund and J.-P. McRae met Jean-Élo Stow-Harl. Stow, Q. J. is out, Harl Qira too, Lunt Pelt not."),
        ("text", "Zomt Qira Vund and Nora Zomt-Vund, then Jean-Élo Zomt, Qira de la Stow, K. Zomt Vosk Ltd, de Zomt, Vosk. Vosk\nMcRae, R. S. McRae"),
        (None, WRAPPED + " Vund, Qira Zomt"),
    ]
    rows = [(k, *x) for k, x in enumerate(texts)]
    spark.createDataFrame([*rows, (None, "text", "Qira Zomt")], "file_id bigint, kind string, text string").write.parquet(f"{tmp_path}/file_extract.parquet")
    spark.createDataFrame([(k, [("bearer", "person_name", 1.0)]) for k in (2, 3)], "file_id bigint, pii_columns array<struct<name string, data string, confidence double>>").write.parquet(f"{tmp_path}/file_catalog.parquet")
    got = []
    for limit in (pii.BROADCAST_WORDS, 0):
        monkeypatch.setattr(pii, "BROADCAST_WORDS", limit)
        got.append({tuple(r) for r in entry.queries()["p2_found"](spark, str(tmp_path)).collect()})
    assert got[0] == got[1]
    assert {(2, "name", "Qira Lunt"), (2, "name", "Pelt Lunt"), (None, "name", "Qira Zomt")} <= got[0] and (3, "name", "Dorp Lunt") not in got[0]
