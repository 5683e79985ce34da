"""Generators against plain loops over random charts, and a hand-computed chart of each type."""

import math
import random

from chartq.operators import qa as Q


def answers(df, fn, *args):
    return {(r.chart_id, r.qid): r for r in fn(df, *args).collect()}


def close(a, b):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def charts(n, make, seed=11):
    rng = random.Random(seed)
    return {f"c{i}": make(rng, rng.randint(3, 12)) for i in range(n)}


def table(spark, data, schema):
    return spark.createDataFrame([(c, i, *row) for c, rows in data.items() for i, row in enumerate(rows)], f"chart_id string, row_idx long, {schema}")


def test_bars_and_slices(spark):
    data = charts(20, lambda r, n: [(f"k{j}", float(r.randint(1, 60))) for j in range(n)])
    df = table(spark, data, "category string, value double")
    bar, pie = answers(df, Q.bar_qa), answers(df, Q.pie_qa)
    for c, rows in data.items():
        top = bottom = 0
        total, over, under = 0.0, 0, 0
        for i, (_, v) in enumerate(rows):
            total += v
            top = i if v > rows[top][1] else top
            bottom = i if v < rows[bottom][1] else bottom
        for _, v in rows:
            over += v > total / len(rows)
            under += v < total / len(rows)
        assert (bar[c, "QA-BAR-1"].label, bar[c, "QA-BAR-2"].label) == (rows[top][0], rows[bottom][0])
        assert close(bar[c, "QA-BAR-3"].answer_num, rows[top][1] - rows[bottom][1])
        assert close(bar[c, "QA-BAR-4"].answer_num, total / len(rows))
        assert (bar[c, "QA-BAR-5"].answer_num, bar[c, "QA-BAR-5"].not_answer_num) == (over, under)
        small = sum(1 for _, v in rows if 100 * v < 10 * total)
        assert pie[c, "QA-PIE-4"].answer_num == small
        assert pie[c, "QA-PIE-6"].label == str(any(2 * v > total for _, v in rows))
        assert abs(pie[c, "QA-PIE-2"].answer_num - 100 * rows[0][1] / total) <= 0.005 + 1e-9
        assert abs(pie[c, "QA-PIE-5"].answer_num - 100 * (rows[0][1] + rows[1][1]) / total) <= 0.005 + 1e-9


def test_grouped_and_stacked_by_hand(spark):
    rows = [("g", "a", 1.0), ("g", "b", 5.0), ("h", "a", 4.0), ("h", "b", 2.0)]
    grouped = answers(table(spark, {"c": rows}, "grp string, category string, value double"), Q.grouped_bar_qa)
    want = {1: ("b", "a"), 2: (6.0, 1.0), 3: ("b", "a"), 4: ("g", "g"), 5: (0.0, 4.0), 6: ("['g', 'h']", "['h', 'g']")}
    for k, (yes, no) in want.items():
        r = grouped["c", f"QA-GRP-{k}"]
        assert (r.answer_num, r.not_answer_num) == (yes, no) if isinstance(yes, float) else (r.label, r.not_answer)[0] == yes
    stacked = answers(table(spark, {"c": rows}, "grp string, series string, value double"), Q.stacked_bar_qa)
    assert stacked["c", "QA-STK-1"].answer_num == 6.0
    assert (stacked["c", "QA-STK-2"].label, stacked["c", "QA-STK-2"].not_answer) == ("b", "a")
    assert abs(stacked["c", "QA-STK-4"].answer_num - 16.67) < 1e-9
    assert (stacked["c", "QA-STK-5"].label, stacked["c", "QA-STK-5"].not_answer) == ("b", "a")


def test_lines(spark):
    data = charts(20, lambda r, n: [(float(j), float(r.randint(-20, 20))) for j in range(n)])
    got = answers(table(spark, data, "x double, y double"), Q.line_qa)
    for c, rows in data.items():
        steps = [rows[i + 1][1] - rows[i][1] for i in range(len(rows) - 1)]
        mean = sum(y for _, y in rows) / len(rows)
        first = next((x for x, y in rows if y > mean), None)
        assert (got[c, "QA-LIN-2"].answer_num, got[c, "QA-LIN-2"].not_answer_num) == (max(steps), min(steps))
        assert got[c, "QA-LIN-3"].answer_num == first and f"({mean:.2f})" in got[c, "QA-LIN-3"].question
        assert close(got[c, "QA-LIN-6"].answer_num, sum(steps) / (rows[-1][0] - rows[0][0]))
        assert got[c, "QA-LIN-5"].label == str(sum(steps) > 0)


def test_crossings_and_many_lines_by_hand(spark):
    dual = answers(table(spark, {"c": [(1.0, 5.0, 1.0), (2.0, 4.0, 3.0), (3.0, 2.0, 6.0), (4.0, 9.0, 8.0)]}, "x double, y1 double, y2 double"), Q.dual_axis_qa)
    assert (dual["c", "QA-DUA-1"].answer_num, dual["c", "QA-DUA-1"].not_answer_num) == (3.0, 4.0)
    assert dual["c", "QA-DUA-2"].label == "y1" and dual["c", "QA-DUA-3"].answer_num == 4.0 and dual["c", "QA-DUA-4"].answer_num == 5.0
    many = answers(table(spark, {"c": [(0.0, 1.0, 9.0), (2.0, 5.0, 3.0)]}, "x double, y_1 double, y_2 double"), Q.multi_line_qa)
    assert [many["c", f"QA-MUL-{k}"].label for k in (1, 2, 3)] == ["y_2", "y_2", "y_1"]
    assert (many["c", "QA-MUL-4"].answer_num, many["c", "QA-MUL-4"].not_answer_num) == (1.0, 1.0)


def test_histograms(spark):
    data = charts(15, lambda r, n: [(float(r.randint(0, 40)),) for _ in range(n + 8)])
    got = answers(table(spark, data, "value double"), Q.histogram_qa)
    for c, rows in data.items():
        v = sorted(x for (x,) in rows)

        def at(q, v=v):
            lo = int(q * (len(v) - 1))
            return v[lo] + (q * (len(v) - 1) - lo) * (v[min(lo + 1, len(v) - 1)] - v[lo])

        assert got[c, "QA-HST-2"].answer_num == sum(x < at(0.5) for x in v)
        assert close(got[c, "QA-HST-4"].answer_num, at(0.75) - at(0.25)) and close(got[c, "QA-HST-4"].not_answer_num, at(0.9) - at(0.1))
        mean = sum(v) / len(v)
        sd = math.sqrt(sum((x - mean) ** 2 for x in v) / (len(v) - 1))
        assert got[c, "QA-HST-5"].answer_num == sum(x > mean + sd for x in v)


def test_points_and_bubbles(spark):
    data = charts(15, lambda r, n: [(float(r.randint(-9, 9)), float(r.randint(-9, 9)), float(r.randint(1, 30))) for _ in range(n + 3)])
    df = table(spark, data, "x double, y double, size double")
    sct, bub = answers(df, Q.scatter_qa), answers(df, Q.bubble_qa)

    def r_of(pairs):
        n = len(pairs)
        mx, my = sum(a for a, _ in pairs) / n, sum(b for _, b in pairs) / n
        sxx, syy = sum((a - mx) ** 2 for a, _ in pairs), sum((b - my) ** 2 for _, b in pairs)
        return sum((a - mx) * (b - my) for a, b in pairs) / math.sqrt(sxx * syy) if sxx and syy else None

    for c, rows in data.items():
        assert close(sct[c, "QA-SCT-1"].answer_num, r_of([(x, y) for x, y, _ in rows]))
        near = min(range(len(rows)), key=lambda i: (rows[i][0] ** 2 + rows[i][1] ** 2, i))
        assert sct[c, "QA-SCT-3"].answer_num == near
        sizes = sorted(s for *_, s in rows)
        half = len(sizes) // 2
        med = sizes[half] if len(sizes) % 2 else (sizes[half - 1] + sizes[half]) / 2
        assert bub[c, "QA-BUB-3"].answer_num == sum(s < med for s in sizes)
        assert bub[c, "QA-BUB-1"].answer_num == max(range(len(rows)), key=lambda i: (rows[i][2], -i))


def test_matrix_by_hand(spark):
    rows = [(1.0, 2.0, 9.0), (2.0, 4.0, 4.0), (3.0, 6.0, 1.0), (4.0, 8.0, 0.0)]
    got = answers(table(spark, {"c": rows}, "p double, q double, r double"), Q.scatter_matrix_qa, ["p", "q", "r"])
    assert got["c", "QA-MTX-1"].label == "('p', 'q')"
    assert (got["c", "QA-MTX-2"].label, got["c", "QA-MTX-2"].not_answer) == ("r", "p")
    assert got["c", "QA-MTX-3"].label == "True"
    assert (got["c", "QA-MTX-4"].answer_num, got["c", "QA-MTX-4"].not_answer_num) == (3.0, 0.0)
    assert got["c", "QA-MTX-5"].label == "['r', 'q', 'p']"
