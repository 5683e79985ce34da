import random

import pytest
from pyspark.sql import types as T

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names the operators use inside
    T.StructField("row", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fp", T.LongType()),
    T.StructField("hits", T.StringType()), T.StructField("t", T.StringType()), T.StructField("draws", T.IntegerType()),
    T.StructField("a b", T.StringType()),
])
_ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def world():
    """Rows (doc_id, text, source) with nulls, empties, copies, near copies, shared passages, ties and long texts; benchmark items."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    items = [(i, prose(rng, n, vocabulary)) for i, n in enumerate((30, 12, 10, 6, 25))] + [(4, prose(rng, 14, vocabulary)), (None, prose(rng, 11, vocabulary)),
                                                                                   (7, None), (8, " .,! ")]
    passage = prose(rng, 90, vocabulary)
    texts = [prose(rng, rng.randint(1, 220), vocabulary) for _ in range(40)]
    texts += [prose(rng, 20, vocabulary) + "\n" + passage + "  " + prose(rng, 15, vocabulary) for _ in range(6)]
    texts += [texts[3]] * 3 + [texts[4].replace(" ", "  ", 3), texts[4].upper(), texts[5] + " zz"]
    texts += ["", None, None, "   \n", "aé " * 300, "x" * 1500, items[0][1].upper(), "so " + " ".join(items[4][1].split()[3:17]) + " it",
              items[3][1], items[6][1], prose(rng, 9000, vocabulary)]
    rows = [(i, t, ("s1", "s2", None, "é", "s1")[i % 5]) for i, t in enumerate(texts)]
    rows += [(None, texts[7], "s1"), (None, None, None), rows[9], rows[9]]
    return rows, items


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "xx", s, None if t is None else len(t), "r", 0.5, 1, "h", "t", 2, "ab") for i, t, s in rows], _DOC)

    return make


@pytest.fixture(scope="session")
def docs(world, make_docs):
    return make_docs(world[0]).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def benchmark(spark, world):
    return spark.createDataFrame(world[1], _ITEM)
