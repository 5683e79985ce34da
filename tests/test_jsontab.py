"""Strict JSON checks and lexeme-preserving parsing against Python's parser, on random damage to valid texts."""

import json
import random

from pyspark.sql import functions as F

from chartq.functions import jsontab as J

TEXTS = ['{"columns":["a","NaN"],"rows":[[1.50,1e5,-0,NaN,Infinity,-Infinity,true,null,"x\\u00e9\\n 1.0 NaN",12345678901234567890123]]}',
         "[1,2]", '"a"', "1", "-Infinity", '{"a":[1,{"b":"\\\\"}]}', "", "   ", "{}", "[]", "[[],[]]", "1,2", "1],[2", '{"k":1},{"k":2}', "nul", "NaN", '"un',
         '{"a":1}}', "[1,2", '1],"x"', '{"a":"Infinity\\"",  "b": NaN }']


def _damaged(seed=5):
    rng = random.Random(seed)
    out = set(TEXTS)
    for text in TEXTS:
        for _ in range(40):
            x = list(text)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(x) + 1)
                what = rng.randrange(3)
                if what == 0:
                    del x[at:at + 1]
                else:
                    x[at:at + (what == 1)] = rng.choice('[]{},:"\\0123 -.eNanI\n\x01')
            out.add("".join(x))
    return sorted(out)


def test_strict_check_and_lexemes_agree_with_python(spark):
    rows = spark.createDataFrame([(t,) for t in _damaged()], "s string").select("s", J.strict_json_ok("s").alias("ok"), J.quote_number_lexemes("s").alias("q")).collect()
    for r in rows:
        try:
            value = json.loads(r["s"], parse_int=str, parse_float=str, parse_constant=str)
        except ValueError:
            assert not r["ok"], r["s"]
            continue
        assert r["ok"], r["s"]
        assert json.loads(r["q"]) == value
    assert sum(r["ok"] for r in rows) > 40


def test_long_texts(spark):
    text = '{"columns":["a"],"rows":[["' + "x" * 100_000 + "\\n" * 50_000 + '",' + ",".join(["1.50", '"b"'] * 20_000) + "]]}"
    row = spark.createDataFrame([(text,)], "s string").select(J.parse_table("s").alias("t")).first()
    assert row["t"]["rows"][0][1:3] == ["1.50", "b"] and len(row["t"]["rows"][0]) == 40_001


def test_nulls(spark):
    row = spark.createDataFrame([(None,)], "s string").select(J.strict_json_ok("s").alias("ok"), J.parse_table("s").alias("t"), F.size(J.parse_table("s")["rows"]).alias("n")).first()
    assert not row["ok"] and row["t"] is None
