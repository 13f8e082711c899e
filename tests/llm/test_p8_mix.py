import json
import os

import pytest

import __spark_entry__ as entry
from folioscope.llm import mix as m
from folioscope.llm.mix import Flow, largest_size, route, shares

SCHEMA = "source string, target_share double, max_repeats int"


@pytest.fixture(autouse=True)
def one_token_a_word(monkeypatch):
    monkeypatch.setattr(m, "encoder", lambda path: lambda texts: [len(t.split()) for t in texts])


def test_flow_is_cheapest():
    f = Flow(4)
    a, b = f.arc(0, 1, 5, 3), f.arc(0, 2, 5, 1)
    f.arc(1, 3, 9, 0), f.arc(2, 3, 3, 0), f.arc(2, 1, 9, 1)
    assert f.run(0, 3) == 10
    assert (f.room[a ^ 1], f.room[b ^ 1]) == (5, 5)


def test_route_fills_quotas_and_repeats_evenly():
    p = {json.dumps(["a"]): 100, json.dumps(["a", "b"]): 40, json.dumps(["b"]): 10, json.dumps(["x"]): 500}
    got = route(p, {"a": (0.5, 1), "b": (0.5, 3), "none": (0.0, 2)}, 120)
    by = {s: sum(n for (_, x, _), n in got.items() if x == s) for s in "ab"}
    assert by == {"a": 60, "b": 60}
    assert max(k for _, _, k in got) <= 3 and all(k == 1 for q, _, k in got if '"a"' in q)
    assert largest_size({json.dumps(["a"]): 100, json.dumps(["b"]): 10}, {"a": (0.5, 1), "b": (0.4, 2), "gone": (0.1, 1)}) == 52


def test_mix_reaches_shares_within_caps(spark):
    docs = [(k, "big", f"t{k} " * 10) for k in range(600)] + [(1000 + k, "small", f"s{k} " * 10) for k in range(20)] + [(2000, "small", "t5 " * 10), (2000, "small", "t5 " * 10), (3000, None, "x"), (3001, "big", None), (3002, "big", ""), (3003, "other", "y z")]
    targets = [("big", 0.7, 1), ("small", 0.3, 2), ("gone", 0.1, 5), (None, 0.1, 1), ("zero", None, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").selectExpr("*", "1 AS id", "2 AS key", "3 AS tokens")
    t = spark.createDataFrame(targets, SCHEMA)
    got = m.mix(df, t, size=400).collect()
    assert len({(r["doc_id"], r["source"]) for r in got}) == len(got)
    assert all(r["times"] <= {"big": 1, "small": 2}[r["source"]] for r in got)
    by = {s: sum(r["times"] * r["tokens"] for r in got if r["source"] == s) for s in ("big", "small")}
    assert abs(by["big"] - 280) <= 20 and abs(by["small"] - 120) <= 20
    assert sorted(map(tuple, got)) == sorted(map(tuple, m.mix(df, t, size=400).collect())) != sorted(map(tuple, m.mix(df, t, size=400, seed=8).collect()))
    out = {r["source"]: r for r in shares(m.mix(df, t, size=400), t).collect()}
    assert out["gone"]["tokens"] == 0 and abs(sum(r["share"] for r in out.values()) - 1) < 1e-9
    # all sources that have documents reach their share
    full = {r["source"]: r["share"] for r in shares(m.mix(df, t.filter("source != 'gone'"), fill="all"), t).collect()}
    assert abs(full["small"] - 0.3) < 0.03


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("a", 1.0, 2)], SCHEMA)
    assert m.mix(none, t).collect() == []
    assert [tuple(r) for r in shares(m.mix(none, t), t).collect()] == [("a", 1.0, 2, 0, 0, 0, 0, 0.0)]


@pytest.mark.skipif(not os.path.isdir(m.TOKENIZERS), reason="no tokenizer files")
def test_the_tokenizer(monkeypatch):
    monkeypatch.undo()
    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"):
        assert m.encoder(os.path.join(m.TOKENIZERS, name))(["", "Hello world", "<|endoftext|>"])[:2] == [0, 2]


def test_queries_are_registered():
    assert {"p8_mix", "p8_shares"} <= set(entry.queries())
