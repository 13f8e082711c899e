import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from folioscope.llm import near
from folioscope.llm.near import fingerprints, leaf_pairs, radius, sets, shard_pairs


def members(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 40 else set()


def similar(rows):
    of = {i: members(t) for i, t in rows}
    return {(a, b) for a, x in of.items() for b, y in of.items() if a < b and x and y and 5 * len(x & y) >= 3 * len(x | y)}


def texts(seed, families, copies):
    rnd = random.Random(seed)
    out = []
    for _ in range(families):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([39, 40, 45, 120, 300]))]
        for changes in range(copies):
            w = base[:]
            for _ in range(changes * len(w) // 40):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(400)}"
            out.append(rnd.choice([" ", ", ", "\n"]).join(w + ["the closing words that all the texts share here"] * rnd.randrange(2)))
    return out


def run(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, "file_id bigint, text string").selectExpr("*", "1 AS id", "2 AS cell").repartition(3).write.parquet(f"{tmp_path}/{name}/file_extract.parquet")
    df = entry.queries()["p5_found"](spark, f"{tmp_path}/{name}")
    assert df.dtypes == [("file_id_a", "bigint"), ("file_id_b", "bigint")]
    got = list(map(tuple, df.collect()))
    assert len(got) == len(set(got))
    return set(got)


def test_as_many_pairs_as_by_comparing_all(spark, tmp_path, monkeypatch):
    t = texts(5, 12, 8)
    rows = [*enumerate(t), (3, t[3]), (500, None), (501, ""), (502, t[20].upper()), (503, t[20]), (504, t[25]), (505, "x" * 200_000)]
    want = similar(dict(rows).items())
    assert len(want) > 40
    assert run(spark, tmp_path, rows, "leaves") == want
    # trees, blocks of shards, and classes too many to send
    monkeypatch.setattr(near, "LEAF", 2)
    monkeypatch.setattr(near, "SHARD", 3)
    monkeypatch.setattr(near, "SENT", 0)
    assert run(spark, tmp_path, rows, "blocks") == want
    # members that are split over all parts
    monkeypatch.setattr(near, "HOT", 1)
    assert run(spark, tmp_path, rows, "hot") == want


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, [], "empty") == set()


@pytest.mark.parametrize("leaf", [2, 48])
def test_the_trees_lose_no_pair_within_the_radius(leaf, monkeypatch):
    monkeypatch.setattr(near, "LEAF", leaf)
    doc, code = sets(texts(9, 10, 12))
    ids, n = np.unique(doc, return_counts=True)
    prints = fingerprints(doc, code)
    of = {k: set(code[doc == i].tolist()) for k, i in enumerate(ids)}
    want = {(int(ids[a]), int(ids[b])) for a in of for b in of if a < b and 5 * len(of[a] & of[b]) >= 3 * len(of[a] | of[b])}
    everything = np.arange(len(ids))
    tree = shard_pairs(ids, n, prints, everything, everything)
    assert want and want <= tree == leaf_pairs(np.zeros(len(ids)), ids, n, [p.tobytes() for p in prints])


def test_the_fingerprints_distance_is_at_most_the_difference():
    doc, code = sets(texts(2, 6, 6))
    ids, n = np.unique(doc, return_counts=True)
    prints = fingerprints(doc, code)
    for a in range(len(ids)):
        for b in range(len(ids)):
            w = min(len(prints[a]), len(prints[b]))
            d = int(np.bitwise_count(near._folded(prints[a], w) ^ near._folded(prints[b], w)).sum())
            assert d <= len(set(code[doc == ids[a]]) ^ set(code[doc == ids[b]]))
    assert radius(np.int64(100), np.int64(60)) == 40


def test_which_texts_of_a_shard_have_a_partner_there():
    rnd = np.random.default_rng(4)
    code, n = rnd.integers(0, 60, 4000), rnd.integers(38, 90, 4000)
    rest = n - rnd.integers(0, 36, 4000)
    o = np.lexsort((rest, n, code))
    code, n, rest = code[o], n[o], rest[o]
    fits = (code[:, None] == code) & (8 * np.minimum(rest[:, None], rest) >= 3 * (n[:, None] + n)) & ~np.eye(4000, dtype=bool)
    want = fits.any(1)
    assert want.any() and not want.all()
    assert near.partnered(code, n, rest).tolist() == want.tolist()


def shard(seed, size):
    """A shard as set phrases make it in a large collection: its texts share much, though few are similar."""
    rnd = random.Random(seed)
    phrases = [" ".join(f"p{k}x{j}" for j in range(8)) for k in range(60)]
    doc, code = sets([" ".join(x) for x in (rnd.sample(phrases, 12) for _ in range(size))])
    ids, n = np.unique(doc, return_counts=True)
    return doc, code, ids, n, fingerprints(doc, code)


def test_texts_of_a_shard_are_looked_up_together(monkeypatch):
    asked, query = [0], near.Tree.query

    def counted(self, *args):
        asked[0] += 1
        return query(self, *args)

    monkeypatch.setattr(near.Tree, "query", counted)
    doc, code, ids, n, prints = shard(1, 1500)
    everything = np.arange(len(ids))
    shard_pairs(ids, n, prints, everything, everything)
    assert 0 < asked[0] < len(ids)  # not at least once for each text
