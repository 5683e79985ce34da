"""A hot key holding a third of all rows: the skew-safe plans still give exact answers."""

from pyspark.sql import functions as F

from chartq.functions import render as R
from chartq.operators import qa as Q
from chartq.operators.ranking import rank_in_group
from chartq.plans import q_qa as QQ
from chartq.plans.fixture_sql import FV
from chartq.sources.tables import table
from tests.conftest import SF_SMALL
from tools.check_oracle import rows_key

HOT = "case when event_id % 3 = 0 then 0 else user_id end"


def test_line_questions_with_a_hot_chart(spark, duck):
    ev = table(spark, SF_SMALL, "events").select(
        F.expr(HOT).alias("chart_id"), "event_id", F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    pts = rank_in_group(ev, ["chart_id"], ["event_id"], num_partitions=5).select("chart_id", "row_idx", "x", "y")
    got = [tuple(r) for r in QQ.rounded(Q.line_qa(pts, num=R.num)).collect()]
    hot_view = FV["fv_line"].replace("select user_id as chart_id", f"select {HOT} as chart_id").replace(
        "partition by user_id", f"partition by {HOT}")
    sql = QQ.LINE_SQL.replace(FV["fv_line"], hot_view)
    exp = duck.execute(sql).fetchall()
    assert rows_key(got) == rows_key(exp)
    n_hot = table(spark, SF_SMALL, "events").where(F.expr(f"{HOT} = 0")).count()
    assert n_hot * 3 >= table(spark, SF_SMALL, "events").count() - 3
