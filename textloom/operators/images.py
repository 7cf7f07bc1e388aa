"""Images that groups share: equal files, and pictures whose average hashes are near."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import hamming, hash_bits

_SHOWN = ["group_name", "file_path", "file_name", "image_id", "source", "sha256", "ahash", "size", "width", "height"]


def exact_duplicates(images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sha256, groups, images): contents that stand in two groups or more, with all their images."""
    several = images.filter("sha256 is not null").groupBy(*keys, "sha256").agg(F.min("group_name").alias("_lo"), F.max("group_name").alias("_hi")).filter("_lo <> _hi").drop("_lo", "_hi")
    held = images.join(several, [*keys, "sha256"], "left_semi")
    return held.groupBy(*keys, "sha256").agg(F.array_sort(F.collect_set("group_name")).alias("groups"), F.array_sort(F.collect_list(F.struct("ord", *_SHOWN))).alias("images"))


def exact_image_pairs(images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi): image ids of one content that stands in two groups or more, smaller id first.

    Ids hold the file name only, so files of one name in two groups share them; pairs are on ids, as documented.
    """
    several = images.filter("sha256 is not null").groupBy(*keys, "sha256").agg(F.min("group_name").alias("_lo"), F.max("group_name").alias("_hi")).filter("_lo <> _hi").drop("_lo", "_hi")
    held = images.select(*keys, "sha256", "image_id", "ord").join(several, [*keys, "sha256"], "left_semi")
    # an id that stands for two images of one content pairs with itself
    ids = held.groupBy(*keys, "sha256", "image_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = ids.withColumnRenamed("image_id", "lo"), ids.select(*keys, "sha256", F.col("image_id").alias("hi"))
    return a.join(b, [*keys, "sha256"]).filter("lo < hi or (lo = hi and n > 1)").select(*keys, "lo", "hi").distinct()


def near_hashes(rows: DataFrame, keys: list[str], distance: int, bits: str = "bits", ident: str = "ord") -> DataFrame:
    """(keys, a, b, distance): pairs a < b of 64-bit hashes that differ in `distance` bits or fewer.

    The bits are cut into as few bands as leave two near hashes at most two bits apart in one of them. Each hash emits
    the ball of radius one around every band, so such bands meet half way, in an equi-join on wide keys: 3 bands of 21
    bits for a distance of 6. Equal hashes are first collapsed; a pair is taken in the first band that is near, at one
    of the points where its balls meet, so nothing has to be made distinct.
    """
    distance = max(0, min(64, distance))
    n = -(-(distance + 1) // 3)
    cuts = [(64 * k // n, 64 * (k + 1) // n) for k in range(n)]
    hashes = rows.select(*keys, bits).distinct()

    def part(col, k):
        lo, hi = cuts[k]
        moved = F.shiftrightunsigned(col, lo)
        return moved if hi - lo == 64 else moved.bitwiseAND(F.lit((1 << hi - lo) - 1))

    def ball(k):
        flips = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(cuts[k][1] - cuts[k][0]))]
        return F.array(*(F.struct(F.lit(k).alias("band"), part(F.col(bits), k).bitwiseXOR(F.lit(f).cast("long")).alias("value"), F.lit(f).cast("long").alias("flip")) for f in flips))

    balls = hashes.select(*keys, bits, F.explode(F.concat(*(ball(k) for k in range(n)))).alias("e")).select(*keys, bits, "e.*")
    a, b = balls.withColumnRenamed(bits, "ha"), balls.drop("flip").withColumnRenamed(bits, "hb")
    met = a.join(b.hint("merge"), [*keys, "band", "value"]).filter("ha <= hb")
    gap = F.col("ha").bitwiseXOR(F.col("hb"))
    first, here = F.lit(n), part(gap, 0)
    for k in reversed(range(n)):
        first = F.when(F.bit_count(part(gap, k)) <= 2, k).otherwise(first)
        here = F.when(F.col("band") == k, part(gap, k)).otherwise(here)
    # bands two bits apart meet at either bit, nearer ones at the left band itself among others
    at = F.when(F.bit_count(here) <= 1, F.lit(0).cast("long")).otherwise(here.bitwiseAND(F.bitwise_not(here - F.lit(1))))
    met = met.filter((first == F.col("band")) & (F.col("flip") == at)).withColumn("distance", F.bit_count(gap)).filter(F.col("distance") <= distance).select(*keys, "ha", "hb", "distance")
    left = rows.select(*keys, F.col(bits).alias("ha"), F.col(ident).alias("x"))
    right = rows.select(*keys, F.col(bits).alias("hb"), F.col(ident).alias("y"))
    pairs = met.join(left, [*keys, "ha"]).join(right, [*keys, "hb"]).filter("ha < hb or x < y")
    return pairs.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def near_duplicates(images: DataFrame, keys: list[str], distance: int = 6) -> DataFrame:
    """(keys, kind, distance, a, b): images of different groups whose hashes are near and that no exact pair covers.

    images have a unique `ord`. Null or empty hashes take no part; a hash that is no hexadecimal number of up to 16
    digits is at distance 64 from everything, so below a distance of 64 it pairs with nothing.
    """
    good = images.filter("ahash is not null and ahash rlike '^[0-9a-fA-F]{1,16}$'").withColumn("bits", hash_bits(F.col("ahash")))
    near = near_hashes(good, keys, distance)
    side = good.select(*keys, "ord", "group_name", "image_id")
    near = near.join(side.select(*keys, F.col("ord").alias("a"), F.col("group_name").alias("ga"), F.col("image_id").alias("ia")), [*keys, "a"])
    near = near.join(side.select(*keys, F.col("ord").alias("b"), F.col("group_name").alias("gb"), F.col("image_id").alias("ib")), [*keys, "b"]).filter("ga <> gb")
    known = exact_image_pairs(images, keys)
    near = near.withColumn("lo", F.least("ia", "ib")).withColumn("hi", F.greatest("ia", "ib")).join(known, [*keys, "lo", "hi"], "left_anti")
    return near.select(*keys, F.lit("ahash").alias("kind"), "distance", "a", "b")


def image_duplicates(images: DataFrame, keys: list[str], distance: int = 6) -> DataFrame:
    """(keys, kind, distance, images): exact groups and near pairs with their images."""
    exact = exact_duplicates(images, keys).select(*keys, F.lit("sha256").alias("kind"), F.lit(0).alias("distance"), F.transform("images", lambda i: i.dropFields("ord")).alias("images"))
    full = images.select(*keys, "ord", F.struct(*_SHOWN).alias("i"))
    near = near_duplicates(images, keys, distance).join(full.select(*keys, F.col("ord").alias("a"), F.col("i").alias("ia")), [*keys, "a"]).join(full.select(*keys, F.col("ord").alias("b"), F.col("i").alias("ib")), [*keys, "b"])
    return exact.unionByName(near.select(*keys, "kind", "distance", F.array("ia", "ib").alias("images")))


__all__ = ["exact_duplicates", "exact_image_pairs", "hamming", "image_duplicates", "near_duplicates", "near_hashes"]
