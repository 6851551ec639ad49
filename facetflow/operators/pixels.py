"""Pixel values: packing, colour maps, shading, decoded normals, coordinates; small array functions.

Column functions give null for null inputs unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLANES = {"xy": ("x", "y"), "yz": ("y", "z"), "zx": ("z", "x")}


def packed(channels: Column, divide: bool) -> Column:
    """An array of 1 to 4 channels as three within [0, 1]: grey is repeated, alpha dropped; divide: values are 0 to 255. An empty one is black."""
    three = F.when(F.size(channels) == 0, F.array(*[F.lit(0.0)] * 3)).when(F.size(channels) < 3, F.array_repeat(F.get(channels, F.lit(0)), 3)).otherwise(F.slice(channels, 1, 3))
    return F.transform(three, lambda c: F.greatest(F.least(c / (255.0 if divide else 1.0), F.lit(1.0)), F.lit(0.0)))


def packed_images(pixels: DataFrame, images: DataFrame, by: list[str], least: int = 64) -> DataFrame:
    """(by, y, x, r, g, b): pixels (by, y, x, channels) as three values within [0, 1]; of an image with any value above 1 all are 0 to 255. Images (by) without pixels are `least` x `least` black ones."""
    top = pixels.groupBy(*by).agg((F.max(F.array_max("channels")) > 1).alias("_divide"))
    own = pixels.join(top, by).select(*by, "y", "x", F.when(F.col("_divide"), packed(F.col("channels"), True)).otherwise(packed(F.col("channels"), False)).alias("c"))
    at = F.explode(F.sequence(F.lit(0), F.lit(least * least - 1))).alias("i")
    empty = images.select(*by).distinct().join(top, by, "left_anti").select(*by, at).select(*by, F.expr(f"cast(i div {least} as int)").alias("y"), F.expr(f"cast(i % {least} as int)").alias("x"), F.array(*[F.lit(0.0)] * 3).alias("c"))
    return own.unionByName(empty).select(*by, "y", "x", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate("rgb")])


def projected(channels: Column, names: list[str], wanted: list[str]) -> Column:
    """The wanted channels by name; an unknown name raises ValueError."""
    return F.array(*[F.get(channels, F.lit(names.index(n))) for n in wanted])


def decoded_normal(rgb: Column) -> Column:
    """A normal from a colour within [0, 1]."""
    return F.transform(rgb, lambda c: c * 2 - 1)


def ranged(pixels: DataFrame, value: str, valid: Column, by: list[str]) -> DataFrame:
    """pixels with grey, 0 to 255: the value's place between the least and greatest of its image's valid pixels; 0 where they are one or the pixel isn't valid."""
    ends = pixels.where(valid).groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    place = (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))
    grey = F.when(valid & (F.col("_high") > F.col("_low")), F.round(255 * place)).otherwise(0.0)
    return pixels.join(ends, by, "left").withColumn("grey", grey.cast("int")).drop("_low", "_high")


def blended(base: Column, over: Column, share: float = 0.25) -> Column:
    """base with `share` of the other colour, within [0, 255]."""
    return F.zip_with(base, over, lambda a, b: F.greatest(F.least((1 - share) * a + share * b, F.lit(255.0)), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def shaded(weights: Column, normals: list[Column], light: Column) -> Column:
    """Matte light: the barycentric mean of the corners' normals, made a unit, against the light's direction, within [0, 1]; 0 where the mean vanishes."""
    times = lambda n, w: F.transform(n, lambda x: x * w)
    parts = [times(n, F.get(weights, F.lit(i))) for i, n in enumerate(normals)]
    mean = parts[0]
    for p in parts[1:]:
        mean = F.zip_with(mean, p, lambda x, y: x + y)
    size = F.sqrt(dot(mean, mean))
    return F.when(size > 0, F.greatest(F.least(dot(mean, light) / size, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)


def plane_points(points: DataFrame, keep: list[str]) -> DataFrame:
    """points (.., x, y, z) once for each coordinate plane: plane, a, b."""
    rows = F.array(*[F.struct(F.lit(name).alias("plane"), F.col(a).alias("a"), F.col(b).alias("b")) for name, (a, b) in PLANES.items()])
    return points.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def grid_points(units: DataFrame, size: int, corners: bool = False) -> DataFrame:
    """units with i, j, k, x, y, z: the places of a size x size x size grid over [-1, 1], cell centres or (corners) from end to end."""
    places = F.sequence(F.lit(0), F.lit(size - 1))
    at = (lambda c: -1 + 2 * F.col(c) / max(size - 1, 1)) if corners else (lambda c: -1 + (2 * F.col(c) + 1) / size)
    own = units.withColumn("i", F.explode(places)).withColumn("j", F.explode(places)).withColumn("k", F.explode(places))
    return own.withColumns({c: at(n).cast("double") for c, n in zip("xyz", "ijk", strict=True)})


def linspace(low: Column, high: Column, count: int) -> Column:
    """`count` values at equal distances from low to high, both included; one: low."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: low + (high - low) * i / max(count - 1, 1))


def padded_concat(first: Column, first_pads: Column, second: Column, second_pads: Column, pad: float = 0.0) -> Column:
    """Two right-padded arrays as one: the values of both without their pads (true: a pad), then pads up to the length of both."""
    own = lambda values, pads: F.filter(values, lambda _, i: ~F.get(pads, i))
    values = F.concat(own(first, first_pads), own(second, second_pads))
    return F.concat(values, F.array_repeat(F.lit(pad), (F.size(first) + F.size(second) - F.size(values)).cast("int")))
