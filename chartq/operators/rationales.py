"""The reasoning steps that go with each question's answer and with its distractor."""

from __future__ import annotations

# The steps, by question id: (steps of the answer, steps of the distractor).
RATIONALES: dict[str, tuple[list[str], list[str]]] = {
    "QA-BAR-1": (["identify highest bar height", "output its category label for reference"],
                 ["identify lowest bar height", "output its category label for reference"]),
    "QA-BAR-2": (["identify lowest bar height", "output its category label for reference"],
                 ["identify highest bar height", "output its category label for reference"]),
    "QA-BAR-3": (["subtract smallest bar height from tallest", "return difference numeric value"],
                 ["subtract tallest bar height from smallest", "return difference numeric value"]),
    "QA-BAR-4": (["sum all bar heights", "divide by count, return mean numeric value"],
                 ["sum heights divide by count add one", "return offset numeric value"]),
    "QA-BAR-5": (["count bars exceeding mean height", "output integer total of bars"],
                 ["count bars below mean height", "output integer total of bars"]),
    "QA-BAR-6": (["sort bar heights descending", "return ordered list of category labels"],
                 ["sort bar heights ascending", "return ordered list of category labels"]),
    "QA-PIE-1": (["identify slice with maximum value", "output corresponding category label"],
                 ["identify slice with minimum value", "output corresponding category label"]),
    "QA-PIE-2": (["divide category value by total", "multiply hundred, round percentage number"],
                 ["subtract category percentage from hundred", "output complementary percentage number"]),
    "QA-PIE-3": (["sort slice values ascending", "select second entry, output category label"],
                 ["select slice with largest value", "output category label as alternative"]),
    "QA-PIE-4": (["compute slice percentages", "count those under ten, return integer count"],
                 ["compute slice percentages", "count those over ten, return integer count"]),
    "QA-PIE-5": (["sum two category values, divide by total", "multiply hundred, round"],
                 ["subtract combined percentage from hundred", "output complementary percentage"]),
    "QA-PIE-6": (["check if any slice percentage above fifty", "return boolean value"],
                 ["check if all slice percentages at most fifty", "return boolean value"]),
    "QA-GRP-1": (["filter bars in group", "pick max value, output category label"],
                 ["filter bars in group", "pick min value, output category label"]),
    "QA-GRP-2": (["sum category bar heights within group", "return total height value"],
                 ["select smallest single bar height within group", "return numeric value"]),
    "QA-GRP-3": (["find global max bar value", "return its category label identifier"],
                 ["find global min bar value", "return its category label identifier"]),
    "QA-GRP-4": (["compute mean height per group", "choose lowest mean, output group name"],
                 ["compute mean height per group", "choose highest mean, output group name"]),
    "QA-GRP-5": (["find category max minus min across groups", "output range numeric value"],
                 ["compute category mean across groups", "output highest mean numeric value"]),
    "QA-GRP-6": (["sum bar heights per group", "sort totals descending, output group list"],
                 ["sum bar heights per group", "sort totals ascending, output group list"]),
    "QA-HST-1": (["create histogram counts", "locate bin highest count, output edge interval"],
                 ["locate bin lowest count", "output corresponding interval edges pair"]),
    "QA-HST-2": (["count data values below median threshold", "return integer count total"],
                 ["count data values at or above median", "return integer count"]),
    "QA-HST-3": (["sum values, divide by count", "return dataset mean numeric value"],
                 ["sum values, divide by count", "add one offset, return value"]),
    "QA-HST-4": (["subtract first quartile from third quartile", "output inter‑quartile range"],
                 ["compute tenth to ninetieth percentile spread", "output wider numeric range"]),
    "QA-HST-5": (["count values exceeding mean", "plus one standard deviation, return total"],
                 ["count values below mean", "minus one standard deviation, return total"]),
    "QA-HST-6": (["calculate skewness statistic", "check positive sign, return boolean right‑skew"],
                 ["calculate skewness statistic", "check nonpositive sign, return boolean"]),
    "QA-LIN-1": (["locate maximum y value in series", "return corresponding x coordinate"],
                 ["locate minimum y value in series", "return corresponding x coordinate"]),
    "QA-LIN-2": (["compute adjacent differences", "identify maximum positive jump, output magnitude value"],
                 ["compute adjacent differences", "identify maximum negative drop, output magnitude value"]),
    "QA-LIN-3": (["scan y values until exceeding mean threshold", "return corresponding x coordinate"],
                 ["return x coordinate never exceeding mean threshold", "representing alternative interval"]),
    "QA-LIN-4": (["average all y values across series", "output mean numeric value"],
                 ["average y values then add arbitrary one offset", "output resultant value"]),
    "QA-LIN-5": (["compare first and last y values", "return positive trend boolean"],
                 ["compare first and last y values", "return nonpositive trend boolean"]),
    "QA-LIN-6": (["compute slope using endpoints difference over x range", "output numeric value"],
                 ["negate computed slope value", "yield alternative opposite numeric answer"]),
    "QA-SCT-1": (["compute Pearson coefficient between x and y", "return numerical correlation value"],
                 ["negate computed correlation coefficient", "present as alternative numerical value"]),
    "QA-SCT-2": (["count points where x positive and y positive", "output total count"],
                 ["count points where x negative and y negative", "output total count"]),
    "QA-SCT-3": (["calculate Euclidean distance to origin", "select index with minimal distance value"],
                 ["calculate Euclidean distance to origin", "select index with maximal distance value"]),
    "QA-SCT-4": (["identify maximum y value across points", "return corresponding point index identifier"],
                 ["identify minimum y value across points", "return corresponding point index identifier"]),
    "QA-SCT-5": (["compute ratio of points above y equals x", "return rounded fraction"],
                 ["compute ratio of points below y equals x", "return rounded fraction"]),
    "QA-SCT-6": (["check sign of correlation", "output 'positive' when coefficient greater than zero"],
                 ["check sign of correlation", "output opposite label to actual correlation sign"]),
    "QA-BUB-1": (["scan size column values", "find maximum index, output bubble id"],
                 ["scan size column values", "find minimum index, output bubble id"]),
    "QA-BUB-2": (["sum all bubble sizes, divide by count", "output average size"],
                 ["sum sizes, divide by count", "add one offset before output"]),
    "QA-BUB-3": (["compare sizes to median", "count smaller values, return integer total"],
                 ["compare sizes to median", "count larger values, return integer total"]),
    "QA-BUB-4": (["locate maximum y value", "return corresponding bubble index identifier entry"],
                 ["locate minimum y value", "return corresponding bubble index identifier entry"]),
    "QA-BUB-5": (["compute Pearson correlation size versus y", "check sign, return boolean"],
                 ["compute correlation size versus y", "check nonpositive sign, return boolean"]),
    "QA-DUA-1": (["compute y1‑y2 sign change", "find first crossing x coordinate"],
                 ["select plot endpoint", "x value where lines remain separated"]),
    "QA-DUA-2": (["compare final y1 and y2 values", "choose greater series name"],
                 ["compare final y1 and y2 values", "choose smaller series name"]),
    "QA-DUA-3": (["take absolute y1‑y2 gap array", "report maximum absolute gap"],
                 ["take absolute y1‑y2 gap array", "report minimum absolute gap"]),
    "QA-DUA-4": (["sum series one values", "divide by count, output mean value"],
                 ["sum series one values", "divide by count, add offset value"]),
    "QA-DUA-5": (["compare first and last y2 values", "return increasing boolean flag"],
                 ["compare first and last y2 values", "return not‑increasing boolean flag"]),
    "QA-MTX-1": (["compute absolute correlations", "find highest coefficient, output variable pair"],
                 ["compute absolute correlations", "find lowest coefficient, output variable pair"]),
    "QA-MTX-2": (["calculate variance each variable", "compare values, select greatest variance variable"],
                 ["calculate variance each variable", "compare values, select smallest variance variable"]),
    "QA-MTX-3": (["check correlations below zero for each variable", "return existence boolean flag"],
                 ["check correlations nonnegative for each variable", "return existence boolean flag"]),
    "QA-MTX-4": (["count correlation pairs above threshold 0.8", "return total integer number"],
                 ["count correlation pairs at most 0.8 absolute", "return total integer number"]),
    "QA-MTX-5": (["sort variables by variance descending order", "output ordered variable list"],
                 ["sort variables by variance ascending order", "output reversed variable list"]),
    "QA-STK-1": (["sum series values in group", "report overall stack height number"],
                 ["select group minimal total value", "present as stack height number"]),
    "QA-STK-2": (["aggregate each series totals", "compare values, choose highest overall contributor"],
                 ["aggregate each series totals", "compare values, choose lowest overall contributor"]),
    "QA-STK-3": (["compare totals between groups", "identify greatest total, output group name"],
                 ["compare totals between groups", "identify smallest total, output group name"]),
    "QA-STK-4": (["calculate series value over group total", "convert ratio to percentage"],
                 ["calculate complementary percentage to series", "present complement number"]),
    "QA-STK-5": (["scan individual segment heights", "locate maximum segment, return series name"],
                 ["scan individual segment heights", "locate minimum segment, return series name"]),
    "QA-MUL-1": (["identify each line peak", "compare peaks across lines, choose highest peak value"],
                 ["identify each line minimum", "compare minima across lines, choose lowest minimum value"]),
    "QA-MUL-2": (["take values at final x coordinate", "compare all, select smallest number"],
                 ["take values at final x coordinate", "compare all, select largest number"]),
    "QA-MUL-3": (["compute average slope per line", "rank slopes descending, pick top positive change"],
                 ["compute average slope per line", "rank slopes ascending, pick lowest negative change"]),
    "QA-MUL-4": (["calculate net change each line", "count those greater than zero, return total"],
                 ["calculate net change each line", "count those not above zero, return total"]),
    "QA-MUL-5": (["for every line, sum all values", "divide by count, produce mean"],
                 ["for every line, sum all values", "divide by count, add one offset"]),
}
