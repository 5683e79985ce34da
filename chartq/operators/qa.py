"""Question / answer / distractor generation from chart points (QA-*, CHT-04).

Every generator takes the long `chart_points` of one chart type and returns
the columns of `OUT`: the answers as text (numbers in the rendering `num`, in full by
default) and, where they are numbers, as full doubles, with the reasoning steps of both. The plan per type is: one `groupBy(chart_id)` of
partial-aggregable statistics (`max_by`/`min_by` with a row-order tiebreak for
pandas' first-wins `idxmax`, sums, moments, co-moments), then — only where a
question compares rows with a chart statistic — a join of that one-row-per-chart
table back to the points and a second aggregate. No window spans a whole chart:
adjacent rows meet through an equi-join on (chart_id, row_idx + 1), and quantiles
come from the skew-safe ranking. Lists are only collected after reduction to
categories / groups / variables, where the list is the answer itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartq.functions import render as R
from chartq.functions.text import col_
from chartq.operators.ranking import rank_in_group
from chartq.operators.rationales import RATIONALES

# The question texts, by question id.
QUESTIONS = {
    "QA-BAR-1": "Which bar is tallest?",
    "QA-BAR-2": "Which bar is shortest?",
    "QA-BAR-3": "What is the difference between the tallest and shortest bars?",
    "QA-BAR-4": "Give the average height of all bars.",
    "QA-BAR-5": "How many bars exceed the mean height?",
    "QA-BAR-6": "Rank the bars from highest to lowest.",
    "QA-PIE-1": "Which slice is largest?",
    "QA-PIE-2": "What percentage of the pie is {c0}?",
    "QA-PIE-3": "What is the second-smallest slice?",
    "QA-PIE-4": "How many slices are below 10 %?",
    "QA-PIE-5": "What is the combined share of {c0} and {c1}?",
    "QA-PIE-6": "Does any slice exceed 50 % of the pie?",
    "QA-GRP-1": "In group {g0}, which category bar is tallest?",
    "QA-GRP-2": "In group {g0}, what is the total bar height?",
    "QA-GRP-3": "Across all groups, which category has the highest single bar value?",
    "QA-GRP-4": "Which group’s average bar height is lowest?",
    "QA-GRP-5": "For category {c0}, what is the range across groups?",
    "QA-GRP-6": "List groups ordered by their total bar height.",
    "QA-HST-1": "What is the bin with the most observations?",
    "QA-HST-2": "How many values fall below the median?",
    "QA-HST-3": "What is the mean of the data?",
    "QA-HST-4": "What is the inter‑quartile range?",
    "QA-HST-5": "How many values are above 1 SD from the mean?",
    "QA-HST-6": "Does the distribution look right‑skewed?",
    "QA-LIN-1": "At which x does the line reach its maximum y?",
    "QA-LIN-2": "What is the largest single‑step increase in y?",
    "QA-LIN-3": "In which x‑interval does y first exceed its mean ({thr})?",
    "QA-LIN-4": "What is the average y over the whole series?",
    "QA-LIN-5": "Is the overall trend positive?",
    "QA-LIN-6": "Give the slope between the first and last points.",
    "QA-SCT-1": "What is the Pearson correlation between x and y?",
    "QA-SCT-2": "How many points have x > 0 and y > 0?",
    "QA-SCT-3": "What is the closest point to (0,0)?",
    "QA-SCT-4": "Which point has the highest y?",
    "QA-SCT-5": "What fraction of points lie above the line y = x?",
    "QA-SCT-6": "Is the relationship positive or negative?",
    "QA-BUB-1": "Which bubble is largest?",
    "QA-BUB-2": "What is the average bubble size?",
    "QA-BUB-3": "How many bubbles have size below the median?",
    "QA-BUB-4": "Which bubble has the highest y?",
    "QA-BUB-5": "Is there a positive relationship between size and y?",
    "QA-DUA-1": "At which x do the two lines cross?",
    "QA-DUA-2": "Which series has a higher final value?",
    "QA-DUA-3": "What is the max absolute gap between the two lines?",
    "QA-DUA-4": "Give the mean value of series 1.",
    "QA-DUA-5": "Is series 2 increasing overall?",
    "QA-MTX-1": "Which pair of variables has the highest Pearson correlation?",
    "QA-MTX-2": "Which variable shows the largest variance?",
    "QA-MTX-3": "Is any variable negatively correlated with all others?",
    "QA-MTX-4": "How many pairs have |corr| > 0.8?",
    "QA-MTX-5": "List variables ordered by decreasing variance.",
    "QA-STK-1": "In group {g0}, what is the total stack height?",
    "QA-STK-2": "Which series contributes most overall across all groups?",
    "QA-STK-3": "Which group has the highest total?",
    "QA-STK-4": "For group {g0}, what percentage is series {s0}?",
    "QA-STK-5": "Which series has the largest single segment?",
    "QA-MUL-1": "Which line reaches the highest y at any x?",
    "QA-MUL-2": "At the final x, which line has the lowest value?",
    "QA-MUL-3": "Which line shows the steepest average upward trend?",
    "QA-MUL-4": "How many lines have a net positive change?",
    "QA-MUL-5": "Give the mean value of each line.",
}

OUT = ["chart_id", "qid", "question", "label", "not_answer", "answer_num", "not_answer_num", "answer_rationale", "not_answer_rationale"]


class Num:
    """A numeric answer: its full double, and its text in the rendering the caller chose."""

    def __init__(self, c):
        self.value = col_(c).cast("double")

    def text(self, num) -> Column:
        return num(self.value)


class Int(Num):
    """A count or a row number."""

    def __init__(self, c):
        super().__init__(c)
        self.number = col_(c)

    def text(self, num) -> Column:
        return R.integer(self.number)


def question(qid: str, **slots) -> Column:
    """The question text with `{slot}` filled from columns."""
    out = F.lit(QUESTIONS[qid])
    for k, v in slots.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def first_max(x, v) -> Column:
    """`x` at pandas `idxmax(v)`: the largest v, first row on ties, NULL v skipped."""
    v = F.col(v) if isinstance(v, str) else v
    return F.max_by(x, F.when(v.isNotNull(), F.struct(v, -F.col("row_idx"))))


def first_min(x, v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.min_by(x, F.when(v.isNotNull(), F.struct(v, F.col("row_idx"))))


def emit(st: DataFrame, specs, num) -> DataFrame:
    """One row per (chart, question) from a one-row-per-chart statistics table: the answers as text, the full
    double of numeric answers, and the reasoning steps of both."""
    def row(qid, q, a, n):
        steps = [F.array(*[F.lit(x) for x in steps]) for steps in RATIONALES[qid]]
        text = [x.text(num) if isinstance(x, Num) else x for x in (a, n)]
        value = [x.value if isinstance(x, Num) else F.lit(None).cast("double") for x in (a, n)]
        return F.struct(F.lit(qid).alias("qid"), q.alias("question"), text[0].alias("label"), text[1].alias("not_answer"),
                        value[0].alias("answer_num"), value[1].alias("not_answer_num"),
                        steps[0].alias("answer_rationale"), steps[1].alias("not_answer_rationale"))

    return st.select("chart_id", F.inline(F.array(*[row(*spec) for spec in specs])))


def _points(df: DataFrame) -> DataFrame:
    return df.withColumn("chart_id", F.col("chart_id").cast("string"))


def _join_stats(points: DataFrame, stats: DataFrame, *cols: str) -> DataFrame:
    """Per-chart statistics back onto the points (AQE broadcasts the measured one-row-per-chart
    side when small; otherwise a skew-split sort-merge join)."""
    return points.join(stats.select("chart_id", *cols), "chart_id")


def _desc_labels(label: Column, key: Column) -> Column:
    """Labels ordered by key descending, ties by label (collected per chart after reduction)."""
    s = F.array_sort(F.collect_list(F.struct((-key).alias("k"), label.alias("l"))))
    return F.transform(s, lambda e: e["l"])


# ---- bar ------------------------------------------------------------------------------------

def bar_qa(points: DataFrame, compat: bool = False, num=R.full) -> DataFrame:
    """`compat=True` answers the ranking question with row indexes, as the reference does
    although its rationale speaks of labels (quirk Q17)."""
    p = _points(points)
    st = p.groupBy("chart_id").agg(
        first_max("category", "value").alias("am"), first_min("category", "value").alias("an"),
        F.max("value").alias("mx"), F.min("value").alias("mn"), F.avg("value").alias("mean"),
        F.array_sort(F.collect_list(F.struct(F.col("value").isNull().alias("blank"), (-F.col("value")).alias("k"), F.col("row_idx").alias("r"), F.col("category").alias("c"))))
        .alias("ranked"))
    cmp = (_join_stats(p, st, "mean").groupBy("chart_id")
           .agg(F.count_if(F.col("value") > F.col("mean")).alias("gt"), F.count_if(F.col("value") < F.col("mean")).alias("lt")))
    s = st.join(cmp, "chart_id").withColumn(
        "rank", F.transform("ranked", lambda e: e["r"].cast("string") if compat else e["c"]))
    return emit(s, [
        ("QA-BAR-1", question("QA-BAR-1"), F.col("am"), F.col("an")),
        ("QA-BAR-2", question("QA-BAR-2"), F.col("an"), F.col("am")),
        ("QA-BAR-3", question("QA-BAR-3"), Num(F.col("mx") - F.col("mn")), Num(F.col("mn") - F.col("mx"))),
        ("QA-BAR-4", question("QA-BAR-4"), Num("mean"), Num(F.col("mean") + 1)),
        ("QA-BAR-5", question("QA-BAR-5"), Int("gt"), Int("lt")),
        ("QA-BAR-6", question("QA-BAR-6"), *((R.int_list("rank"), R.int_list(F.reverse("rank"))) if compat
                                             else (R.quoted_list("rank"), R.quoted_list(F.reverse("rank"))))),
    ], num)


# ---- pie ------------------------------------------------------------------------------------

def pie_qa(points: DataFrame, num=R.full) -> DataFrame:
    """Charts with fewer than two categories raise in the reference and yield no questions."""
    p = _points(points)
    st = p.groupBy("chart_id").agg(
        F.sum("value").alias("total"), F.min_by("category", F.col("row_idx")).alias("c0"), F.min_by("value", F.col("row_idx")).alias("v0"),
        first_max("category", "value").alias("am"), first_min("category", "value").alias("an"))
    # first-seen order of categories: a top-2 per chart that Spark limits before the shuffle
    cats = p.groupBy("chart_id", "category").agg(F.min("row_idx").alias("fr"), F.sum("value").alias("cs"))
    top_c = (cats.withColumn("rn", F.row_number().over(_w("chart_id", "fr"))).where("rn <= 2")
             .groupBy("chart_id").agg(F.max(F.when(F.col("rn") == 2, F.col("category"))).alias("c1"),
                                      F.sum("cs").alias("s01"), F.count(F.lit(1)).alias("ncat")))
    # the second-smallest slice: the two smallest (value, row) and the larger of them
    low2 = (p.withColumn("rn", F.row_number().over(_w("chart_id", "value", "row_idx"))).where("rn <= 2")
            .groupBy("chart_id").agg(F.max_by("category", F.struct("value", -F.col("row_idx"))).alias("second")))
    pct = F.try_divide(F.col("value"), F.col("total")) * 100
    shares = (_join_stats(p, st, "total").groupBy("chart_id")
              .agg(F.count_if(pct < 10).alias("lt10"), F.count_if(pct > 10).alias("gt10"),
                   F.coalesce(F.bool_or(pct > 50), F.lit(False)).alias("any50"),
                   F.coalesce(F.bool_and(pct <= 50), F.lit(True)).alias("all50")))
    s = (st.join(top_c, "chart_id").join(low2, "chart_id").join(shares, "chart_id").where(F.col("ncat") >= 2)
         .withColumn("pct0", F.bround(F.try_divide(F.col("v0"), F.col("total")) * 100, 2))
         .withColumn("pct01", F.bround(F.try_divide(F.col("s01"), F.col("total")) * 100, 2)))
    return emit(s, [
        ("QA-PIE-1", question("QA-PIE-1"), F.col("am"), F.col("an")),
        ("QA-PIE-2", question("QA-PIE-2", c0=F.col("c0")), Num("pct0"), Num(F.bround(100 - F.col("pct0"), 2))),
        ("QA-PIE-3", question("QA-PIE-3"), F.col("second"), F.col("am")),
        ("QA-PIE-4", question("QA-PIE-4"), Int("lt10"), Int("gt10")),
        ("QA-PIE-5", question("QA-PIE-5", c0=F.col("c0"), c1=F.col("c1")), Num("pct01"),
         Num(F.bround(100 - F.col("pct01"), 2))),
        ("QA-PIE-6", question("QA-PIE-6"), R.boolean("any50"), R.boolean("all50")),
    ], num)


def _w(part, *order):
    from pyspark.sql import Window
    return Window.partitionBy(part).orderBy(*order)


# ---- grouped bar ----------------------------------------------------------------------------

def grouped_bar_qa(points: DataFrame, num=R.full) -> DataFrame:
    p = _points(points)
    st = p.groupBy("chart_id").agg(
        F.min_by("grp", F.col("row_idx")).alias("g0"), F.min_by("category", F.col("row_idx")).alias("c0"),
        first_max("category", "value").alias("am"), first_min("category", "value").alias("an"))
    j = _join_stats(p, st, "g0", "c0")
    in_g0 = F.col("grp") == F.col("g0")
    g0s = j.groupBy("chart_id").agg(
        first_max(F.col("category"), F.when(in_g0, F.col("value"))).alias("g0_max"),
        first_min(F.col("category"), F.when(in_g0, F.col("value"))).alias("g0_min"),
        F.sum(F.when(in_g0, F.col("value"))).alias("g0_sum"), F.min(F.when(in_g0, F.col("value"))).alias("g0_low"))
    per_g = j.groupBy("chart_id", "grp").agg(
        F.avg("value").alias("gm"), F.sum("value").alias("gs"),
        (F.max(F.when(F.col("category") == F.col("c0"), F.col("value")))
         - F.min(F.when(F.col("category") == F.col("c0"), F.col("value")))).alias("c0_range"),
        F.avg(F.when(F.col("category") == F.col("c0"), F.col("value"))).alias("c0_mean"))
    gs = per_g.groupBy("chart_id").agg(
        F.min_by("grp", F.struct("gm", "grp")).alias("low_mean"), F.min_by("grp", F.struct(-F.col("gm"), F.col("grp"))).alias("high_mean"),
        F.max("c0_range").alias("c0_range"), F.max("c0_mean").alias("c0_mean"),
        _desc_labels(F.col("grp"), F.col("gs")).alias("by_total"))
    s = st.join(g0s, "chart_id").join(gs, "chart_id")
    return emit(s, [
        ("QA-GRP-1", question("QA-GRP-1", g0=F.col("g0")), F.col("g0_max"), F.col("g0_min")),
        ("QA-GRP-2", question("QA-GRP-2", g0=F.col("g0")), Num("g0_sum"), Num("g0_low")),
        ("QA-GRP-3", question("QA-GRP-3"), F.col("am"), F.col("an")),
        ("QA-GRP-4", question("QA-GRP-4"), F.col("low_mean"), F.col("high_mean")),
        ("QA-GRP-5", question("QA-GRP-5", c0=F.col("c0")), Num("c0_range"), Num("c0_mean")),
        ("QA-GRP-6", question("QA-GRP-6"), R.quoted_list("by_total"), R.quoted_list(F.reverse("by_total"))),
    ], num)


# ---- quantiles (skew-safe) ------------------------------------------------------------------

BUCKETS = 4096


def group_quantiles(p: DataFrame, value: str, qs: dict[str, float], buckets: int = BUCKETS) -> DataFrame:
    """Exact linear-interpolation quantiles per chart (numpy's rule) by bucket counts, without sorting or collecting a chart.

    A chart's range is cut into equal buckets; their counts (at most `buckets` rows a chart) say in which buckets the neighbours of
    the wanted positions lie. A bucket of one value is an answer; only the rows of the other wanted buckets are ranked, by the
    skew-safe ranking. Charts whose range is not finite are one bucket, so the answer is exact whatever the values are."""
    v = p.select("chart_id", F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    limits = v.groupBy("chart_id").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_n"))
    width = F.col("_hi") - F.col("_lo")
    spread = (width > 0) & (width < float("inf")) & ~F.isnan(width)
    at = F.when(spread, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * buckets), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("long")
    placed = v.join(limits, "chart_id").select("chart_id", "_v", "_n", at.alias("_b"))
    counts = placed.groupBy("chart_id", "_b").agg(F.count("_v").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.max("_n").alias("_n"))
    w = Window.partitionBy("chart_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)      # at most `buckets` rows
    counts = counts.withColumn("_from", F.coalesce(F.sum("_c").over(w), F.lit(0))).withColumn("_to", F.col("_from") + F.col("_c"))
    spots = {name: F.lit(q) * (F.col("_n") - 1) for name, q in qs.items()}
    ends = F.array(*[f(x).cast("long") for x in spots.values() for f in (F.floor, F.ceil)])
    wanted = counts.where(F.exists(ends, lambda x: (x >= F.col("_from")) & (x < F.col("_to"))))
    one = F.col("_min") == F.col("_max")
    known = wanted.where(one).select("chart_id", "_n", "_from", "_to", F.col("_min").alias("_v"))
    rest = placed.drop("_n").join(wanted.where(~one).select("chart_id", "_b", "_n", "_from"), ["chart_id", "_b"])
    ranked = rank_in_group(rest, ["chart_id", "_b"], ["_v"], out="_at")
    ranked = ranked.withColumn("_from", F.col("_from") + F.col("_at"))
    j = known.union(ranked.select("chart_id", "_n", "_from", (F.col("_from") + 1).alias("_to"), "_v"))
    aggs = []
    for name, pos in spots.items():
        lo, hi = F.floor(pos), F.ceil(pos)
        here = lambda x: (x >= F.col("_from")) & (x < F.col("_to"))
        aggs += [F.max(F.when(here(lo), F.col("_v"))).alias(f"{name}_a"), F.max(F.when(here(hi), F.col("_v"))).alias(f"{name}_b"),
                 F.first(pos - lo).alias(f"{name}_t")]
    found = j.groupBy("chart_id").agg(*aggs)
    outs = []
    for name in qs:
        a, b, t = F.col(f"{name}_a"), F.col(f"{name}_b"), F.col(f"{name}_t")
        outs.append(F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t).alias(name))
    return found.select("chart_id", *outs)


# ---- histogram ------------------------------------------------------------------------------

BINS = 10


def histogram_qa(points: DataFrame, bins: int = BINS, num=R.full) -> DataFrame:
    p = _points(points)
    st = p.groupBy("chart_id").agg(
        F.min("value").alias("lo0"), F.max("value").alias("hi0"), F.count("value").alias("n"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.stddev_pop("value").alias("sdp"),
        F.skewness("value").alias("skew"), F.count(F.lit(1)).alias("rows"))
    # numpy cannot bin a blank: such a chart raises in the reference and yields nothing
    st = (st.where(F.col("rows") == F.col("n")).withColumn("lo", F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")))
          .withColumn("hi", F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")))
          .withColumn("step", (F.col("hi") - F.col("lo")) / bins))
    quant = group_quantiles(p, "value", {"q50": 0.5, "q25": 0.25, "q75": 0.75, "q10": 0.1, "q90": 0.9})
    j = _join_stats(p, st.join(quant, "chart_id"), "lo", "hi", "step", "mean", "sd", "q50")
    # numpy.histogram's uniform-bin rule, edge fix-ups included
    edge = lambda k: F.when(k == bins, F.col("hi")).otherwise(k * F.col("step") + F.col("lo"))
    k0 = ((F.col("value") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))).cast("long")
    k1 = F.when(k0 == bins, bins - 1).otherwise(k0)
    binned = j.withColumn("k1", k1).withColumn(
        "k", F.when(F.col("value") < edge(F.col("k1")), F.col("k1") - 1)
        .when((F.col("value") >= edge(F.col("k1") + 1)) & (F.col("k1") != bins - 1), F.col("k1") + 1)
        .otherwise(F.col("k1")))
    counts = binned.groupBy("chart_id").agg(
        *[F.count_if(F.col("k") == b).alias(f"b{b}") for b in range(bins)],
        F.count_if(F.col("value") < F.col("q50")).alias("lt_med"), F.count_if(F.col("value") >= F.col("q50")).alias("ge_med"),
        F.count_if(F.col("value") > F.col("mean") + F.col("sd")).alias("hi_sd"),
        F.count_if(F.col("value") < F.col("mean") - F.col("sd")).alias("lo_sd"))
    cnt = F.array(*[F.struct(F.col(f"b{b}").alias("c"), F.lit(b).alias("b")) for b in range(bins)])
    s = (st.join(quant, "chart_id").join(counts, "chart_id")
         .withColumn("cnt", cnt)
         .withColumn("kmax", F.aggregate("cnt", F.lit(0), lambda acc, e: F.when(e["c"] > F.col("cnt")[acc]["c"], e["b"]).otherwise(acc)))
         .withColumn("kmin", F.aggregate("cnt", F.lit(0), lambda acc, e: F.when(e["c"] < F.col("cnt")[acc]["c"], e["b"]).otherwise(acc))))
    e = lambda k: num(F.when(k == bins, F.col("hi")).otherwise(k * F.col("step") + F.col("lo")))
    valid = (F.col("n") >= 3) & F.col("skew").isNotNull() & ~F.isnan("skew")
    right = F.when(F.col("sdp") == 0, F.lit(False)).otherwise(valid & (F.col("skew") > 0))
    not_right = F.when((F.col("n") >= 3) & (F.col("sdp") == 0), F.lit(True)).otherwise(valid & (F.col("skew") <= 0))
    return emit(s, [
        ("QA-HST-1", question("QA-HST-1"), R.pair(e(F.col("kmax")), e(F.col("kmax") + 1)),
         R.pair(e(F.col("kmin")), e(F.col("kmin") + 1))),
        ("QA-HST-2", question("QA-HST-2"), Int("lt_med"), Int("ge_med")),
        ("QA-HST-3", question("QA-HST-3"), Num("mean"), Num(F.col("mean") + 1)),
        ("QA-HST-4", question("QA-HST-4"), Num(F.col("q75") - F.col("q25")), Num(F.col("q90") - F.col("q10"))),
        ("QA-HST-5", question("QA-HST-5"), Int("hi_sd"), Int("lo_sd")),
        ("QA-HST-6", question("QA-HST-6"), R.boolean(right), R.boolean(not_right)),
    ], num)


# ---- line -----------------------------------------------------------------------------------

def _with_prev(p: DataFrame, *cols: str) -> DataFrame:
    """Each row with the previous row's columns (`prev_<c>`), by an equi-join on the next
    position: no window over a whole chart."""
    prev = p.select("chart_id", (F.col("row_idx") + 1).alias("row_idx"), *[F.col(c).alias(f"prev_{c}") for c in cols])
    return p.join(prev, ["chart_id", "row_idx"], "left")


def line_qa(points: DataFrame, num=R.full) -> DataFrame:
    """Charts with a single point raise in the reference (empty diff) and yield nothing."""
    p = _points(points)
    st = p.groupBy("chart_id").agg(
        F.count(F.lit(1)).alias("n"), first_max("x", "y").alias("x_at_max"), first_min("x", "y").alias("x_at_min"),
        F.avg("y").alias("mean"), F.min_by("y", F.col("row_idx")).alias("y0"), F.max_by("y", F.col("row_idx")).alias("y1"),
        F.min_by("x", F.col("row_idx")).alias("x0"), F.max_by("x", F.col("row_idx")).alias("x1"))
    j = _with_prev(_join_stats(p, st, "mean"), "y")
    d = j.groupBy("chart_id").agg(
        F.max(F.col("y") - F.col("prev_y")).alias("dmax"), F.min(F.col("y") - F.col("prev_y")).alias("dmin"),
        F.min_by("x", F.when(F.col("y") > F.col("mean"), F.col("row_idx"))).alias("x_exceed"))
    s = (st.join(d, "chart_id").where(F.col("n") >= 2)
         .withColumn("slope", F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))))
    return emit(s, [
        ("QA-LIN-1", question("QA-LIN-1"), Num("x_at_max"), Num("x_at_min")),
        ("QA-LIN-2", question("QA-LIN-2"), Num("dmax"), Num("dmin")),
        ("QA-LIN-3", question("QA-LIN-3", thr=R.fmt2("mean")), Num("x_exceed"),
         Num(F.when(F.col("x_exceed").isNotNull(), F.col("x_at_min")).otherwise(F.col("x0")))),
        ("QA-LIN-4", question("QA-LIN-4"), Num("mean"), Num(F.col("mean") + 1)),
        ("QA-LIN-5", question("QA-LIN-5"), R.boolean(F.col("y1") > F.col("y0")), R.boolean(F.col("y1") <= F.col("y0"))),
        ("QA-LIN-6", question("QA-LIN-6"), Num("slope"), Num(-F.col("slope"))),
    ], num)


# ---- scatter --------------------------------------------------------------------------------

def pearson(a: str, b: str) -> Column:
    """Sample correlation as a guarded co-moment ratio (Spark's `corr` raises on a constant
    column under ANSI); NULL where pandas gives NaN. Only rows with both values count, in all
    three moments, as in pandas."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def scatter_qa(points: DataFrame, num=R.full) -> DataFrame:
    p = _points(points).withColumn("d2", F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    s = p.groupBy("chart_id").agg(
        pearson("x", "y").alias("r"),
        F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias("pp"), F.count_if((F.col("x") < 0) & (F.col("y") < 0)).alias("nn"),
        first_min(F.col("row_idx"), "d2").alias("near"), first_max(F.col("row_idx"), "d2").alias("far"),
        first_max(F.col("row_idx"), "y").alias("ymax"), first_min(F.col("row_idx"), "y").alias("ymin"),
        F.bround(F.count_if(F.col("y") > F.col("x")) / F.count(F.lit(1)), 3).alias("above"))
    pos = F.coalesce(F.col("r") > 0, F.lit(False))
    return emit(s, [
        ("QA-SCT-1", question("QA-SCT-1"), Num("r"), Num(F.when(F.col("r") == 0, F.lit(0.5)).otherwise(-F.col("r")))),
        ("QA-SCT-2", question("QA-SCT-2"), Int("pp"), Int("nn")),
        ("QA-SCT-3", question("QA-SCT-3"), Int("near"), Int("far")),
        ("QA-SCT-4", question("QA-SCT-4"), Int("ymax"), Int("ymin")),
        ("QA-SCT-5", question("QA-SCT-5"), Num("above"), Num(F.bround(1 - F.col("above"), 3))),
        ("QA-SCT-6", question("QA-SCT-6"), F.when(pos, "positive").otherwise("negative"),
         F.when(pos, "negative").otherwise("positive")),
    ], num)


# ---- bubble ---------------------------------------------------------------------------------

def bubble_qa(points: DataFrame, num=R.full) -> DataFrame:
    p = _points(points)
    st = p.groupBy("chart_id").agg(
        first_max(F.col("row_idx"), "size").alias("big"), first_min(F.col("row_idx"), "size").alias("small"), F.avg("size").alias("mean"),
        first_max(F.col("row_idx"), "y").alias("ymax"), first_min(F.col("row_idx"), "y").alias("ymin"), F.when(F.bool_and(F.col("size").isNotNull() & F.col("y").isNotNull()), pearson("size", "y")).alias("r"))  # numpy: any blank, no coefficient
    med = group_quantiles(p, "size", {"med": 0.5})
    cmp = (_join_stats(p, med, "med").groupBy("chart_id")
           .agg(F.count_if(F.col("size") < F.col("med")).alias("lt"), F.count_if(F.col("size") > F.col("med")).alias("gt")))
    s = st.join(cmp, "chart_id")
    return emit(s, [
        ("QA-BUB-1", question("QA-BUB-1"), Int("big"), Int("small")),
        ("QA-BUB-2", question("QA-BUB-2"), Num("mean"), Num(F.col("mean") + 1)),
        ("QA-BUB-3", question("QA-BUB-3"), Int("lt"), Int("gt")),
        ("QA-BUB-4", question("QA-BUB-4"), Int("ymax"), Int("ymin")),
        ("QA-BUB-5", question("QA-BUB-5"), R.boolean(F.coalesce(F.col("r") > 0, F.lit(False))),
         R.boolean(F.coalesce(F.col("r") <= 0, F.lit(False)))),
    ], num)


# ---- dual axis ------------------------------------------------------------------------------

def dual_axis_qa(points: DataFrame, compat: bool = False, num=R.full) -> DataFrame:
    """The crossing is the first row whose sign of y1 - y2 differs from the previous row's;
    its x is reported (`compat=True`: its row index, as the reference does, quirk Q18)."""
    p = _points(points).withColumn("sg", F.signum(F.col("y1") - F.col("y2")))
    j = _with_prev(p, "sg")
    s = j.groupBy("chart_id").agg(
        F.min_by(F.col("row_idx").cast("double") if compat else F.col("x"),
                 F.when(F.col("prev_sg").isNotNull() & (F.col("sg") != F.col("prev_sg")), F.col("row_idx"))).alias("cross_x"),
        F.min_by("x", F.col("row_idx")).alias("x0"), F.max_by("x", F.col("row_idx")).alias("xl"),
        F.max_by(F.col("y1") - F.col("y2"), F.col("row_idx")).alias("last_gap"),
        F.max(F.abs(F.col("y1") - F.col("y2"))).alias("gmax"), F.min(F.abs(F.col("y1") - F.col("y2"))).alias("gmin"),
        F.avg("y1").alias("m1"), F.min_by("y2", F.col("row_idx")).alias("y2_0"), F.max_by("y2", F.col("row_idx")).alias("y2_l"))
    y1_wins = F.coalesce(F.col("last_gap") > 0, F.lit(False))
    return emit(s, [
        ("QA-DUA-1", question("QA-DUA-1"), Num("cross_x"),
         Num(F.when(F.col("cross_x").isNotNull(), F.col("xl")).otherwise(F.col("x0")))),
        ("QA-DUA-2", question("QA-DUA-2"), F.when(y1_wins, "y1").otherwise("y2"), F.when(y1_wins, "y2").otherwise("y1")),
        ("QA-DUA-3", question("QA-DUA-3"), Num("gmax"), Num("gmin")),
        ("QA-DUA-4", question("QA-DUA-4"), Num("m1"), Num(F.col("m1") + 1)),
        ("QA-DUA-5", question("QA-DUA-5"), R.boolean(F.col("y2_l") > F.col("y2_0")), R.boolean(F.col("y2_l") <= F.col("y2_0"))),
    ], num)


# ---- scatter matrix -------------------------------------------------------------------------

def scatter_matrix_qa(points: DataFrame, variables, compat: bool = False, num=R.full) -> DataFrame:
    """One aggregate of co-moments for every variable pair (all partial aggregations) of a table of few, known
    columns; `scatter_matrix_long_qa` takes any columns."""
    p = _points(points)
    vs = list(variables)
    pairs = [(i, j) for i in range(len(vs)) for j in range(i + 1, len(vs))]
    st = p.groupBy("chart_id").agg(
        *[F.var_samp(v).alias(f"var_{i}") for i, v in enumerate(vs)],
        *[pearson(vs[i], vs[j]).alias(f"r_{i}_{j}") for i, j in pairs])
    return _matrix_answers(st.select(
        "chart_id",
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v"), F.col(f"var_{i}").alias("var")) for i, v in enumerate(vs)]).alias("vars"),
        F.array(*[F.struct(F.lit(k).alias("k"), F.lit(vs[i]).alias("a"), F.lit(vs[j]).alias("b"), F.col(f"r_{i}_{j}").alias("r"))
                  for k, (i, j) in enumerate(pairs)]).alias("pairs")), compat, num)


def scatter_matrix_long_qa(points: DataFrame, compat: bool = False, num=R.full) -> DataFrame:
    """The same questions from long points (chart_id, row_idx, name, value) with any variable names: the values of a row meet in one
    list of the row's variables, whose pairs are added up, and each chart's variables stand in name order."""
    p = _points(points)
    row = p.groupBy("chart_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("vs"))
    pairs_of = F.flatten(F.transform("vs", lambda a, i: F.transform(F.slice(F.col("vs"), i + 2, F.size("vs")), lambda b: F.struct(
        a["name"].alias("a"), b["name"].alias("b"), a["value"].alias("x"), b["value"].alias("y")))))
    each = row.select("chart_id", F.explode(pairs_of).alias("e")).select("chart_id", "e.*")
    both = each.groupBy("chart_id", "a", "b").agg(pearson("x", "y").alias("r"))
    pairs = both.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "r"))).alias("pairs"))
    var = p.groupBy("chart_id", "name").agg(F.var_samp("value").alias("var"))
    vs = var.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("name", "var"))).alias("vars"))
    return _matrix_answers(vs.join(pairs, "chart_id").select(
        "chart_id", F.transform("vars", lambda e, i: F.struct(i.alias("i"), e["name"].alias("v"), e["var"].alias("var"))).alias("vars"),
        F.transform("pairs", lambda e, k: F.struct(k.alias("k"), e["a"].alias("a"), e["b"].alias("b"), e["r"].alias("r"))).alias("pairs")), compat, num)


def _matrix_answers(st: DataFrame, compat: bool, num) -> DataFrame:
    """The per-chart decisions on arrays of variables (i, v, var) and pairs (k, a, b, r). "Negatively correlated with
    all others" excludes the diagonal; `compat=True` keeps the reference's always-False answer (the diagonal 1 is
    never negative, quirk Q20)."""
    up = F.transform(F.filter("pairs", lambda e: e["r"].isNotNull() & ~F.isnan(e["r"])),
                     lambda e: F.struct(F.abs(e["r"]).alias("ar"), e["k"].alias("k"), e["a"].alias("a"), e["b"].alias("b")))
    best = F.array_sort(F.transform(up, lambda e: F.struct((-e["ar"]).alias("s"), e["k"].alias("k"), e["a"].alias("a"), e["b"].alias("b"))))
    worst = F.array_sort(up)
    known = F.filter("vars", lambda e: e["var"].isNotNull())
    by_var = F.transform(F.array_sort(F.transform(known, lambda e: F.struct((-e["var"]).alias("s"), e["i"].alias("i"), e["v"].alias("v")))), lambda e: e["v"])
    low_var = F.transform(F.array_sort(F.transform(known, lambda e: F.struct(e["var"].alias("s"), e["i"].alias("i"), e["v"].alias("v")))), lambda e: e["v"])
    neg_all = F.lit(False) if compat else F.exists("vars", lambda v: F.forall(
        "pairs", lambda p: ((p["a"] != v["v"]) & (p["b"] != v["v"])) | F.coalesce(p["r"] < 0, F.lit(False))))
    quote_pair = lambda e: R.pair(F.concat(F.lit("'"), e["a"], F.lit("'")), F.concat(F.lit("'"), e["b"], F.lit("'")))
    s = st.select("chart_id", best.alias("best"), worst.alias("worst"), by_var.alias("by_var"), low_var.alias("low_var"),
                  neg_all.alias("neg_all"), F.size(F.filter(up, lambda e: e["ar"] > 0.8)).alias("hi"),
                  F.size(F.filter(up, lambda e: e["ar"] <= 0.8)).alias("lo"), F.size(up).alias("n_pairs"))
    # no defined correlation at all (constant columns): the reference raises and skips the chart
    s = s.where(F.col("n_pairs") > 0)
    return emit(s, [
        ("QA-MTX-1", question("QA-MTX-1"), quote_pair(F.get("best", 0)), quote_pair(F.get("worst", 0))),
        ("QA-MTX-2", question("QA-MTX-2"), F.get("by_var", 0), F.get("low_var", 0)),
        ("QA-MTX-3", question("QA-MTX-3"), R.boolean("neg_all"), R.boolean(~F.col("neg_all"))),
        ("QA-MTX-4", question("QA-MTX-4"), Int("hi"), Int("lo")),
        ("QA-MTX-5", question("QA-MTX-5"), R.quoted_list("by_var"), R.quoted_list(F.reverse("by_var"))),
    ], num)


# ---- stacked bar ----------------------------------------------------------------------------

def stacked_bar_qa(points: DataFrame, num=R.full) -> DataFrame:
    p = _points(points)
    st = p.groupBy("chart_id").agg(
        F.min_by("grp", F.col("row_idx")).alias("g0"), F.min_by("series", F.col("row_idx")).alias("s0"),
        first_max("series", "value").alias("seg_max"), first_min("series", "value").alias("seg_min"))
    j = _join_stats(p, st, "g0", "s0")
    per_g = j.groupBy("chart_id", "grp").agg(F.sum("value").alias("gt"), F.first("g0").alias("g0"),
                                            F.sum(F.when(F.col("series") == F.col("s0"), F.col("value"))).alias("g_s0"))
    per_s = p.groupBy("chart_id", "series").agg(F.sum("value").alias("st"))
    gs = per_g.groupBy("chart_id").agg(
        F.max(F.when(F.col("grp") == F.col("g0"), F.col("gt"))).alias("g0_total"),
        F.max(F.when(F.col("grp") == F.col("g0"), F.col("g_s0"))).alias("g0_s0"),
        F.min("gt").alias("min_total"),
        F.min_by("grp", F.struct(-F.col("gt"), F.col("grp"))).alias("g_top"), F.min_by("grp", F.struct("gt", "grp")).alias("g_low"))
    ss = per_s.groupBy("chart_id").agg(
        F.min_by("series", F.struct(-F.col("st"), F.col("series"))).alias("s_top"),
        F.min_by("series", F.struct("st", "series")).alias("s_low"))
    s = (st.join(gs, "chart_id").join(ss, "chart_id")
         .withColumn("pct", F.bround(F.try_divide(F.coalesce(F.col("g0_s0"), F.lit(0.0)), F.col("g0_total")) * 100, 2)))
    return emit(s, [
        ("QA-STK-1", question("QA-STK-1", g0=F.col("g0")), Num("g0_total"), Num("min_total")),
        ("QA-STK-2", question("QA-STK-2"), F.col("s_top"), F.col("s_low")),
        ("QA-STK-3", question("QA-STK-3"), F.col("g_top"), F.col("g_low")),
        ("QA-STK-4", question("QA-STK-4", g0=F.col("g0"), s0=F.col("s0")), Num("pct"), Num(F.bround(100 - F.col("pct"), 2))),
        ("QA-STK-5", question("QA-STK-5"), F.col("seg_max"), F.col("seg_min")),
    ], num)


# ---- multi line -----------------------------------------------------------------------------

def multi_line_qa(points: DataFrame, num=R.full) -> DataFrame:
    p = _points(points)
    ys = [c for c in points.columns if c.startswith("y")]
    aggs = [F.min_by("x", F.col("row_idx")).alias("x0"), F.max_by("x", F.col("row_idx")).alias("xl")]
    for i, c in enumerate(ys):
        aggs += [F.max(c).alias(f"mx{i}"), F.min_by(c, F.col("row_idx")).alias(f"f{i}"), F.max_by(c, F.col("row_idx")).alias(f"l{i}"),
                 F.avg(c).alias(f"m{i}")]
    st = p.groupBy("chart_id").agg(*aggs)
    slope = lambda i: F.try_divide(F.col(f"l{i}") - F.col(f"f{i}"), F.col("xl") - F.col("x0"))

    def arg(vals, largest: bool):
        """Name of the first column holding the largest / smallest value (dict / column order)."""
        arr = F.array(*[F.struct((-v if largest else v).alias("s"), F.lit(i).alias("i"), F.lit(ys[i]).alias("c"))
                        for i, v in enumerate(vals)])
        return F.get(F.array_sort(F.filter(arr, lambda e: e["s"].isNotNull())), 0)["c"]

    slopes = [slope(i) for i in range(len(ys))]
    means = lambda off: F.concat(F.lit("{"), F.concat_ws(", ", *[
        F.concat(F.lit(f"'{c}': "), num(F.col(f"m{i}") + off)) for i, c in enumerate(ys)]), F.lit("}"))
    s = st.select("chart_id", arg([F.col(f"mx{i}") for i in range(len(ys))], True).alias("line_max"),
                  arg([F.col(f"mx{i}") for i in range(len(ys))], False).alias("line_min"),
                  arg([F.col(f"l{i}") for i in range(len(ys))], False).alias("final_low"),
                  arg([F.col(f"l{i}") for i in range(len(ys))], True).alias("final_high"),
                  arg(slopes, True).alias("steep"), arg(slopes, False).alias("flat"),
                  sum((F.coalesce(sl > 0, F.lit(False)).cast("int") for sl in slopes), F.lit(0)).alias("up"),
                  sum((F.coalesce(sl <= 0, F.lit(False)).cast("int") for sl in slopes), F.lit(0)).alias("down"),
                  means(0).alias("means"), means(1).alias("means1"))
    return emit(s, [
        ("QA-MUL-1", question("QA-MUL-1"), F.col("line_max"), F.col("line_min")),
        ("QA-MUL-2", question("QA-MUL-2"), F.col("final_low"), F.col("final_high")),
        ("QA-MUL-3", question("QA-MUL-3"), F.col("steep"), F.col("flat")),
        ("QA-MUL-4", question("QA-MUL-4"), Int("up"), Int("down")),
        ("QA-MUL-5", question("QA-MUL-5"), F.col("means"), F.col("means1")),
    ], num)


GENERATORS = {
    "bar": bar_qa, "pie": pie_qa, "grouped_bar": grouped_bar_qa, "histogram": histogram_qa, "line": line_qa,
    "scatter": scatter_qa, "bubble": bubble_qa, "line_dual_axis": dual_axis_qa, "scatter_matrix": scatter_matrix_qa,
    "stacked_bar": stacked_bar_qa, "multi_line": multi_line_qa,
}


def generate(named: DataFrame, num=R.full, wide: DataFrame | None = None) -> DataFrame:
    """CHT-04: the questions of every chart of `named` cells (`profile.named_cells`), dispatched on its type, with
    `chart_type`. Types that cannot come from parsed tables (those with a time axis) have no charts here. Every generator reads its points
    several times: `wide` gives those of the types with fixed roles (`profile.wide_points`) as a stored table, partitioned by type."""
    from chartq.operators.profile import ROLES, points_of, to_points, wide_points

    wide = wide_points(named) if wide is None else wide
    parts = [GENERATORS[kind](points_of(wide, kind), num=num).withColumn("chart_type", F.lit(kind)) for kind in ROLES]
    parts.append(scatter_matrix_long_qa(to_points(named, "scatter_matrix"), num=num).withColumn("chart_type", F.lit("scatter_matrix")))
    return reduce(DataFrame.unionByName, parts)
