"""Mixing sources to target weights, in DataFrame functions only.

A document's size is its number of words. Sources in code point order (null last) weigh 1, 2, 3, repeating,
and share the total size of all documents by weight; a target stops at `CAP` times its source's size
and the excess is shared by weight among the others.

* Blocks. Every document has a 60-bit place from a hash of its id; a source's places are cut into as many equal
  blocks as its size asks for (`BLOCK_WORDS` words on average), so a block is a random set of the source's
  documents and block order is a random order. A source is drawn in whole passes, then a last pass over
  the blocks below its boundary block, the documents of that block that still fit, in order, and one more
  document of it where that comes nearer to the target. The boundary is found through two levels of block sums of about the square
  root of the number of blocks each, so no task adds up all blocks of a hot source.
* Splitting tree. The draws of all sources are dealt to output shards of equal numbers of draws: the root holds every
  source's exact block quota; a node over several shards gives its left half a multivariate hypergeometric draw
  of its quotas (source by source, by inverting the hypergeometric distribution at a hash of the node) and
  its right half the rest, down to single shards. Quotas and draw numbers of a source are disjoint ranges, so
  each draw (pass, block) belongs to one shard.
* Each shard orders its documents by a hash.

All draws come from hashes with a seed: reruns agree. The tables of sources and of tree nodes hold one row (or array
entry) per source: sources are the mixture's configuration, and a single task orders them.

Edge cases: a null text has size 0; documents of size 0 are drawn with their block and take no words; null
sources are one source, last in order; equal ids (a null id is one id) share a place and are drawn
together; a source without words has target 0 and gives nothing; an empty table gives an empty
result; columns beyond doc_id, source and text are passed through by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartq.llm.common import stage

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK_WORDS = 50_000
SHARD_DRAWS = 64
SEED = 20
_WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(c.cast("string"), F.lit("")), F.lit(_WORD)).cast("long")


def place(doc_id: Column, seed: int = SEED) -> Column:
    """60 bits of the md5 of 'seed:doc_id'."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def block_of(at: Column, blocks: Column) -> Column:
    """floor(at / 2 ** 60 * blocks), in whole numbers."""
    return F.shiftright(F.shiftright(at, 30) * blocks, 30)


def targets(sizes: DataFrame) -> DataFrame:
    """Per source of `sizes(source, size)`: number `s`, source_size, target, whole passes, rest, blocks."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("s") % len(WEIGHTS) + 1).cast("int")).cast("double")
    per = (per.withColumn("s", F.row_number().over(order) - 1).withColumn("weight", weight)
           .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
           .withColumn("most", (F.col("source_size") * CAP).cast("double")))
    # By rising ratio of limit to weight, a source is at its limit while its share of what is left reaches it;
    # from the first one that is not, the share level only falls.
    rising = Window.orderBy(F.col("most") / F.col("weight"), "s")
    before = F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before) / left)
    per = per.withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    per = per.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level))
    size = F.greatest(F.col("source_size"), F.lit(1))
    per = per.withColumn("passes", F.floor(F.col("target") / size).cast("long"))
    return per.select("s", "source", "source_size", "target", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"),
                      F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(1)).cast("long").alias("blocks"))


def _boundary(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source with a rest: `edge`, the block in which its words end; `cut`, the last place drawn there in order; and
    `extra`, one further place whose words come nearest to what is missing then (-1: none)."""
    sums = placed.groupBy("s", "block").agg(F.sum("size").alias("w"))
    sums = stage(sums.join(sources.where("rest > 0").select("s", "rest", "blocks"), "s")
                 .withColumn("upper", F.floor(F.col("block") / F.ceil(F.sqrt("blocks"))).cast("long")))
    uppers = sums.groupBy("s", "rest", "upper").agg(F.sum("w").alias("w"))

    def at_end(rows: DataFrame, by: str) -> DataFrame:
        run = Window.partitionBy("s").orderBy(by)
        upto = rows.withColumn("upto", F.sum("w").over(run)).where("upto >= rest")
        return upto.groupBy("s").agg(F.min_by(F.struct(by, (F.col("rest") - F.col("upto") + F.col("w")).alias("rest")), by).alias("x")).select("s", "x.*")

    upper = at_end(uppers, "upper")
    block = at_end(sums.drop("rest").join(upper, ["s", "upper"]), "block")
    inside = placed.join(block, ["s", "block"]).groupBy("s", "block", "rest", "at").agg(F.sum("size").alias("w"))
    inside = inside.withColumn("upto", F.sum("w").over(Window.partitionBy("s").orderBy("at")))
    fits = F.when(F.col("upto") <= F.col("rest"), F.col("at"))
    cut = inside.groupBy("s").agg(F.coalesce(F.max(fits), F.lit(-1)).alias("cut"),
                                  (F.max("rest") - F.coalesce(F.max(F.when(fits.isNotNull(), F.col("upto"))), F.lit(0))).alias("gap"))
    off = F.abs(F.col("w") - F.col("gap"))
    return (inside.join(cut, "s").groupBy("s", "block", "cut")
            .agg(F.min(F.when((F.col("at") > F.col("cut")) & (off < F.col("gap")), F.struct(off.alias("off"), F.col("at").alias("at")))).alias("x"))
            .select("s", F.col("block").alias("edge"), "cut", F.coalesce("x.at", F.lit(-1)).alias("extra")))


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Good ones among `drawn` of `total`, where `good` of the total are: the distribution inverted at `u` in [0, 1).

    Probabilities are taken relative to the mode's and added outwards from it, over 12 standard deviations to each
    side (what lies beyond is below double precision).
    """
    low = F.greatest(drawn - (total - good), F.lit(0).cast("long"))
    high = F.least(drawn, good)
    mode = F.least(F.greatest(F.floor((drawn + 1).cast("double") * (good + 1) / (total + 2)).cast("long"), low), high)
    share = good.cast("double") / F.greatest(total, F.lit(1))
    sd = F.sqrt(F.greatest(drawn * share * (1 - share), F.lit(0.0)))
    reach = (F.ceil(sd * 12) + 12).cast("long")
    bound = F.array(F.struct(total.alias("t"), good.alias("k"), drawn.alias("n"), u.alias("u"), mode.alias("mode"),
                             F.least(high, mode + reach).alias("top"), F.greatest(low, mode - reach).alias("bottom")))

    def walk(z):
        def up(x):      # p(x) / p(x - 1)
            return (z["k"] - x + 1).cast("double") * (z["n"] - x + 1) / (x.cast("double") * (z["t"] - z["k"] - z["n"] + x))

        def down(x):    # p(x) / p(x + 1)
            return (x + 1).cast("double") * (z["t"] - z["k"] - z["n"] + x + 1) / ((z["k"] - x).cast("double") * (z["n"] - x))

        none = F.array().cast("array<bigint>")
        higher = F.when(z["top"] > z["mode"], F.sequence(z["mode"] + 1, z["top"])).otherwise(none)
        lower = F.when(z["bottom"] < z["mode"], F.sequence(z["mode"] - 1, z["bottom"], F.lit(-1).cast("long"))).otherwise(none)
        mass = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))

        def add(ratio):
            return lambda a, x: F.struct((a["p"] * ratio(x)).alias("p"), (a["sum"] + a["p"] * ratio(x)).alias("sum"))

        whole = 1 + F.aggregate(higher, mass, add(up), lambda a: a["sum"]) + F.aggregate(lower, mass, add(down), lambda a: a["sum"])

        def find(ratio):
            def step(a, x):
                p = a["p"] * ratio(x)
                return F.struct(p.alias("p"), (a["left"] - p).alias("left"), F.when((a["left"] >= 0) & (a["left"] < p), x).otherwise(a["x"]).alias("x"))
            return step

        start = F.struct(F.lit(1.0).alias("p"), (z["u"] * whole - 1).alias("left"), z["mode"].alias("x"))
        above = F.aggregate(higher, start, find(up))
        after = F.transform(F.array(above), lambda a: F.aggregate(
            lower, F.struct(F.lit(1.0).alias("p"), a["left"].alias("left"), a["x"].alias("x")), find(down), lambda b: b["x"]))
        return after[0]

    return F.transform(bound, walk)[0]


def split_quotas(quotas: DataFrame, draws: int, shards: int, seed: int = SEED) -> DataFrame:
    """Splitting tree over one row with `quota` (draws per source, an array): a row (shard, quota, start) per shard.

    `start` is the number of each source's draws in the shards before.
    """
    def slots(i: Column) -> Column:
        return F.floor(i * F.lit(draws) / F.lit(shards)).cast("long")

    node = quotas.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quota",
                         F.transform("quota", lambda q: F.lit(0).cast("long")).alias("start"))
    width, depth = shards, 0
    while width > 1:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")

        def deal(acc, q):
            i = F.size(acc["out"])
            u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), i), 11) / F.lit(float(1 << 53))
            x = _hypergeometric(acc["total"], q, acc["drawn"], u)
            return F.transform(F.array(x), lambda g: F.struct((acc["total"] - q).alias("total"), (acc["drawn"] - g).alias("drawn"),
                                                             F.concat(acc["out"], F.array(g)).alias("out")))[0]

        zero = F.struct((slots(F.col("hi")) - slots(F.col("lo"))).alias("total"), (slots(mid) - slots(F.col("lo"))).alias("drawn"),
                        F.array().cast("array<bigint>").alias("out"))
        left = F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("quota", zero, deal, lambda a: a["out"])).otherwise(F.col("quota"))
        one = F.struct(F.col("lo").alias("lo"), F.when(F.col("hi") - F.col("lo") > 1, mid).otherwise(F.col("hi")).alias("hi"),
                       F.col("left").alias("quota"), F.col("start").alias("start"))
        other = F.struct(mid.alias("lo"), F.col("hi").alias("hi"), F.zip_with("quota", "left", lambda a, b: a - b).alias("quota"),
                         F.zip_with("start", "left", lambda a, b: a + b).alias("start"))
        both = F.when(F.col("hi") - F.col("lo") > 1, F.array(one, other)).otherwise(F.array(one))
        node = node.withColumn("left", left).select(F.explode(both).alias("e")).select("e.*")
        depth, width = depth + 1, (width + 1) // 2
        if depth % 6 == 0:
            node = stage(node.repartition("lo"))
    return node.select(F.col("lo").alias("shard"), "quota", "start")


def plan(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized, sources, draws): the staged rows (doc_id, source, size, at); the per-source table with passes and
    boundary; and for each (s, block) the array `draws` of (pass, shard)."""
    sized = stage(docs.select("doc_id", "source", words().alias("size"), place(F.col("doc_id"), seed).alias("at")))
    sources = stage(targets(sized))
    placed = located(sized.select("source", "size", "at"), sources.select("s", "source", "blocks", "rest"))
    sources = stage(sources.join(_boundary(placed.drop("rest"), sources), "s", "left")
                    .withColumn("last", F.when(F.col("edge").isNull(), 0).otherwise(F.col("edge") + F.when(F.greatest("cut", "extra") >= 0, 1).otherwise(0)).cast("long"))
                    .withColumn("quota", F.when(F.col("target") > 0, F.col("passes") * F.col("blocks") + F.col("last")).otherwise(F.lit(0).cast("long"))))
    quotas = sources.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "quota"))), lambda x: x["quota"]).alias("quota"))
    n = int(sources.agg(F.sum("quota")).first()[0] or 0)
    shards = max(1, -(-n // SHARD_DRAWS))
    leaves = split_quotas(quotas, n, shards, seed)
    ranges = leaves.select("shard", F.posexplode(F.arrays_zip("quota", "start")).alias("s", "r")).where("r.quota > 0")
    numbered = (ranges.select("shard", "s", F.explode(F.sequence(F.col("r.start"), F.col("r.start") + F.col("r.quota") - 1)).alias("d"))
                .join(sources.select("s", "blocks"), "s")
                .select("s", F.pmod("d", "blocks").alias("block"), F.floor(F.col("d") / F.col("blocks")).cast("long").alias("pass"), "shard"))
    draws = numbered.groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))  # at most CAP + 1
    return sized, sources, stage(draws)


def located(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """`rows` (source, at, ...) with their source's columns and their block."""
    named = sources.withColumnRenamed("source", "_source")
    return (rows.join(named, rows.source.eqNullSafe(named._source)).drop("_source")
            .withColumn("block", block_of(F.col("at"), F.col("blocks"))))


def drawn(rows: DataFrame, sources: DataFrame, draws: DataFrame) -> DataFrame:
    """`rows` (source, at, ...) with source_size, target and `draws`, the (pass, shard) pairs that hold the row."""
    per = located(rows, sources.select("s", "source", "source_size", "target", "passes", "blocks", "edge", "cut", "extra"))
    met = per.join(draws, ["s", "block"], "left")
    in_last = F.coalesce((F.col("block") < F.col("edge")) | ((F.col("block") == F.col("edge")) & ((F.col("at") <= F.col("cut")) | (F.col("at") == F.col("extra")))), F.lit(False))
    held = F.filter("draws", lambda d: (d["pass"] < F.col("passes")) | in_last)
    return met.withColumn("draws", F.coalesce(held, F.array().cast("array<struct<pass:bigint,shard:bigint>>"))).drop("s", "block", "passes", "blocks", "edge", "cut", "extra")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixture: the columns of `docs`, then `mix_shard` and `mix_pass`; a row per draw of a document.

    Rows of a shard stand together, in random order; a `docs` column named like an added one is replaced.
    """
    _, sources, draws = plan(docs, seed)
    own = [c for c in docs.columns if c not in ("mix_shard", "mix_pass")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("source").alias("source"), place(F.col("doc_id"), seed).alias("at"))
    rows = drawn(packed, sources, draws).select("row", F.col("at").alias("at"), F.explode("draws").alias("d"))
    shuffled = rows.repartition("d.shard").sortWithinPartitions("d.shard", F.xxhash64(F.lit(seed), "d.shard", "d.pass", "at"))
    return shuffled.select("row.*", F.col("d.shard").alias("mix_shard"), F.col("d.pass").alias("mix_pass"))
