"""Image-manifest planning (IMG-01..03): arithmetic on (image_id, width, height).

Pixels are never touched; the operators plan resizes and tiles as columns, row-local
and shuffle-free. The tile grid is a literal array of at most `max_num²` candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pixel budgets (28-pixel patches).
EVAL_PIXELS = 480 * 28 * 28
TRAIN_PIXELS = 320 * 28 * 28
RATIONALE_MIN_PIXELS, RATIONALE_MAX_PIXELS = 320 * 28 * 28, 640 * 28 * 28


def resize_plan(df: DataFrame, min_pixels: int = EVAL_PIXELS, max_pixels: int = EVAL_PIXELS,
                width: str = "width", height: str = "height") -> DataFrame:
    """IMG-01: keep sizes inside [min, max] pixels, else scale by sqrt(clamped / p) and truncate."""
    w, h = F.col(width), F.col(height)
    p = w * h
    inside = (p >= min_pixels) & (p <= max_pixels)
    target = F.greatest(F.least(p, F.lit(max_pixels)), F.lit(min_pixels))
    scale = F.pow(target / p, F.lit(0.5))
    return df.withColumns({
        "new_width": F.when(inside, w).otherwise(F.floor(w * scale)).cast("bigint"),
        "new_height": F.when(inside, h).otherwise(F.floor(h * scale)).cast("bigint"),
    })


def grid_candidates(min_num: int = 1, max_num: int = 6) -> list[tuple[int, int]]:
    """(i, j) tiles with min_num <= i*j <= max_num, ordered by i*j (then i, j)."""
    c = {(i, j) for n in range(min_num, max_num + 1) for i in range(1, n + 1) for j in range(1, n + 1)
         if min_num <= i * j <= max_num}
    return sorted(c, key=lambda r: (r[0] * r[1], r[0], r[1]))


def closest_grid(width: Column, height: Column, min_num: int = 1, max_num: int = 6, image_size: int = 448) -> Column:
    """IMG-02: the grid whose aspect ratio is closest to the image's; on an equal distance a
    later candidate wins when the image area exceeds half of the candidate's tile area.
    A sequential fold (`aggregate`) over the literal candidate list."""
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in grid_candidates(min_num, max_num)])
    aspect = width.cast("double") / height.cast("double")
    area = width * height
    init = F.struct(F.lit(float("inf")).alias("d"), F.lit(1).alias("i"), F.lit(1).alias("j"))

    def step(acc, r):
        d = F.abs(aspect - r["i"].cast("double") / r["j"].cast("double"))
        better = F.struct(d.alias("d"), r["i"].alias("i"), r["j"].alias("j"))
        tie = F.struct(acc["d"].alias("d"), r["i"].alias("i"), r["j"].alias("j"))
        return (F.when(d < acc["d"], better)
                .when((d == acc["d"]) & (area > F.lit(0.5 * image_size * image_size) * r["i"] * r["j"]), tie)
                .otherwise(acc))

    return F.aggregate(grid, init, step)


def tile_grid(df: DataFrame, min_num: int = 1, max_num: int = 6, image_size: int = 448) -> DataFrame:
    g = closest_grid(F.col("width"), F.col("height"), min_num, max_num, image_size)
    return (df.withColumn("_g", g)
            .select("*", F.col("_g.i").alias("cols"), F.col("_g.j").alias("rows"))
            .withColumns({"target_width": F.col("cols") * image_size, "target_height": F.col("rows") * image_size,
                          "blocks": F.col("cols") * F.col("rows")})
            .drop("_g"))


def tile_boxes(grid: DataFrame, image_size: int = 448, use_thumbnail: bool = True) -> DataFrame:
    """IMG-03: one crop box per tile (left, top, right, bottom), plus the thumbnail when the
    image has more than one tile."""
    s = image_size
    t = grid.select("image_id", "cols", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("tile"))
    boxes = t.select("image_id", "tile", F.lit(False).alias("thumbnail"),
                     ((F.col("tile") % F.col("cols")) * s).alias("left"), (F.floor(F.col("tile") / F.col("cols")) * s).cast("int").alias("top"),
                     ((F.col("tile") % F.col("cols") + 1) * s).alias("right"),
                     ((F.floor(F.col("tile") / F.col("cols")) + 1) * s).cast("int").alias("bottom"))
    if not use_thumbnail:
        return boxes
    thumbs = grid.where(F.col("blocks") != 1).select(
        "image_id", F.col("blocks").alias("tile"), F.lit(True).alias("thumbnail"), F.lit(0).alias("left"), F.lit(0).alias("top"),
        F.lit(s).alias("right"), F.lit(s).alias("bottom"))
    return boxes.unionByName(thumbs)


def fixed_width_plan(df: DataFrame, target_width: int = 200) -> DataFrame:
    """IMG-01 variant: width fixed, height scaled proportionally and truncated."""
    return df.withColumns({"new_width": F.lit(target_width).cast("bigint"),
                           "new_height": F.floor(F.col("height") * (F.lit(float(target_width)) / F.col("width"))).cast("bigint")})


def half_size_plan(df: DataFrame) -> DataFrame:
    """IMG-01 variant: both sides halved (integer division)."""
    return df.withColumns({"new_width": F.floor(F.col("width") / 2).cast("bigint"),
                           "new_height": F.floor(F.col("height") / 2).cast("bigint")})
