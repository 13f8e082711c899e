import random

import numpy as np
import pytest

import __spark_entry__ as entry
from folioscope.llm.encoding import Information, damaged, from_utf8, pairs, repaired, segments

GOOD = "Le café à Zürich coûte 5 €, l’été – “déjà” vu. Die Geschäftsführung prüft die Größe. La atención al público. "
WORDS = "die der und le la de el que the of and in to for harbour office Prüfung Größe über für café été déjà l’été atención señor £5 €7 20 °C ä ö ü é è à ô û ñ í ó á".split()


@pytest.fixture(scope="module")
def plain():
    rnd = random.Random(4)
    return [" ".join(rnd.choices(WORDS, k=60)) + " " + GOOD for _ in range(120)]


@pytest.fixture(scope="module")
def info(plain):
    x, n = np.unique(np.concatenate([pairs(t) for t in plain]), return_counts=True)
    return Information(x, n, int(n.sum()))


@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "cp437", "mac_roman", "cp850", "cp1250", "cp1251"])
def test_bytes_of_utf8_come_back(codec, info):
    bad = GOOD.replace("”", "").encode().decode(codec, "strict" if codec == "latin-1" else "replace")
    runs = damaged(bad, info)
    out, at = "", 0
    for s, e, was in runs:
        out += bad[at:s] + (bad[s:e] if was is None else was)
        at = e
    assert len(runs) > 8 and "Größe" in out + bad[at:] and "café" in out


def test_one_byte_encodings_and_double_reading(info):
    assert [w for _, _, w in damaged(GOOD + "Die Pr¸fung der Grˆﬂe", info)] == ["ü", "öß"]
    assert [w for _, _, w in damaged(GOOD + "la atenciуn al pъblico", info)] == ["ó", "ú"]
    assert from_utf8("é".encode().decode("cp1252").encode().decode("cp1252")) == "é"
    assert damaged("caf\ufffd au lait", info)[0][2] is None


def test_citations_and_rare_letters_stay(info):
    for t in ("The printer shows Ã© where the é should be.", "La «Ñ» pidió AÇÃO y CORAÇÃO", "PÂTE À JOINT, n.º 12", "", None, "plain", "Úrsula mètres près 👍🏽", "two\xa0words"):
        assert damaged(t, info) == []


def test_segments_are_the_maximal_ones():
    rnd = random.Random(1)

    def brute(x):
        if not x:
            return []
        sums = [(sum(x[s:e]), s, e) for s in range(len(x)) for e in range(s + 1, len(x) + 1)]
        best = max(sums, key=lambda r: (r[0], -(r[2] - r[1])))
        if best[0] <= 0:
            return []
        s, e = best[1:]
        return brute(x[:s]) + [(s, e)] + [(a + e, b + e) for a, b in brute(x[e:])]

    for _ in range(300):
        x = [rnd.choice([-1, 1]) * (rnd.random() + 0.01) for _ in range(rnd.randrange(14))]
        assert segments(np.array(x)) == brute(x)


def test_query_and_repair(spark, tmp_path, plain):
    wrong = [GOOD.encode().decode("latin-1"), "Der Bericht ist in Prüfung. Die Gr\u02c6\ufb02e und Pr\u00b8fung", "caf\ufffd au lait"]
    rows = [*enumerate(plain + wrong), (len(plain), wrong[0]), (900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS id", "2 AS pair")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["p9_found"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint")]
    assert sorted(r[0] for r in got.collect()) == [len(plain) + k for k in range(3)]
    out = {r["doc_id"]: (r["repaired_text"], r["damage"]) for r in repaired(df).collect()}
    assert out[len(plain)] == (GOOD, "restored") and out[len(plain) + 2][1] == "lost" and out[0] == (plain[0], "none") and out[900] == (None, "none")


def test_empty_table(spark):
    from folioscope.llm.encoding import damaged_documents

    assert damaged_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
