"""Steps that moved or held more than they need: rewards before the join, rows of one source, type cuts, postings of a shard."""

import random
import tracemalloc

from pyspark.sql import functions as F

from chartq.functions import jsontab as J
from chartq.llm import topk
from chartq.operators import rewards as R
from chartq.operators import tables as T
from chartq.plans import q_rewards
from chartq.sources import fixtures as FX
from tests.conftest import SF_SMALL


def test_rewards_are_scored_before_the_join(spark):
    got = q_rewards._scored(spark, SF_SMALL)
    assert not {"completion", "gold_table", "e1", "e2"} & set(got.columns)
    joined = FX.fv_completions(spark, SF_SMALL).join(FX.fv_emb(spark, SF_SMALL), "idx", "left")
    want = R.score(joined, pred_embedding="e1", gold_embedding="e2").select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_rows_of_one_source_read_its_tables_only(spark):
    bar = FX.fv_chart_rows(spark, SF_SMALL, "bar")
    assert [f.rsplit("/", 1)[1] for f in bar.inputFiles()] == ["customer.parquet"]
    cells = bar.select("chart_id", "row_idx", F.explode(F.array("category", "value")).alias("cell"))
    want = FX.fv_cells(spark, SF_SMALL).where("chart_id like 'bar:%'").select("chart_id", "row_idx", "cell")
    assert cells.exceptAll(want).count() == 0 and want.exceptAll(cells).count() == 0


def test_type_accuracy_of_cut_types(spark):
    df = spark.createDataFrame([("a", "d", "<type> Bar </type>", "bar"), ("a", "d", "x", "line"), ("b", "d", None, "bar")], "run string, dataset string, completion string, chart_type string")
    cut = df.select("run", "dataset", "chart_type", T.type_cut().alias("said"))
    assert sorted(T.type_accuracy(cut, said=F.col("said")).collect()) == sorted(T.type_accuracy(df).collect())


def test_rows_sorted_as_array_sort_does(spark):
    df = spark.createDataFrame([([["b"], None, ["a", None], ["a"], [], None],), (None,), ([],)], "r array<array<string>>")
    assert all(x == y for x, y in df.select(F.array_sort("r"), J.sort_rows(F.col("r"))).collect())


def test_postings_of_a_shard_stay_narrow():
    rng = random.Random(2)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 100000}" for _ in range(150)).encode() for _ in range(4000)]
    postings = sum(len(set(topk.words(t))) for t in texts)
    tracemalloc.start()
    shard = topk.Shard(list(range(len(texts))), texts, 150.0)
    peak = tracemalloc.get_traced_memory()[1] - shard.table.nbytes
    tracemalloc.stop()
    assert peak < 46 * postings       # 41 bytes a posting; 51 with wide columns
