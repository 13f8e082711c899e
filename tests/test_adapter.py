from folioscope.operators.adapter import ModelError, answered, asked, asked_one


def test_tries_again_and_shrinks():
    calls = []

    def ask(body):
        calls.append(len(body))
        if len(body) > 1500:
            raise ModelError("large", too_large=True)
        if len(calls) < 5:
            raise ModelError("busy", 429)
        return body[:2]

    assert asked_one(ask, lambda n: "x" * min(n, 9000), wait=0) == ("xx", None) and calls[:3] == [6000, 3000, 1500]

    def refused(body):
        raise ModelError("no", 401)

    def lost(body):
        raise OSError("gone")

    assert asked_one(refused, lambda n: "x", wait=0) == (None, "no") and asked_one(lost, lambda n: "x", tries=1, wait=0) == (None, "gone")


def test_rows_and_kept_answers(spark, tmp_path):
    def ask(body):
        if body == "bad":
            raise ModelError("bad", 400)
        return body.upper()

    df = spark.createDataFrame([("k1", "a"), ("k2", "bad"), ("k3", None), ("k1", "a")], "key string, content string")
    assert {tuple(r) for r in asked(df, ask, wait=0).collect()} == {("k1", "A", None), ("k2", None, "bad"), ("k3", "", None)}
    cache = str(tmp_path / "kept")
    first = {tuple(r) for r in answered(spark, df, ask, cache, wait=0).collect()}
    assert first == {("k1", "A", None), ("k2", None, "bad"), ("k3", "", None)}

    def never(body):
        raise ModelError("asked again: " + body, 400)

    again = {tuple(r) for r in answered(spark, df.filter("key != 'k2'"), never, cache, wait=0).collect()}
    assert again == {("k1", "A", None), ("k3", "", None)}
