"""A catalogue laid out by place: stored along a space-filling curve, read by ranges of it.

``store`` keeps what every search for nearby items needs and no more: located, undrafted rows without
repeats, parsed once, in the order of a Z curve over latitude and longitude.  Rows close to each other lie
in few files and row groups, whose statistics hold short ranges of the curve; a search turns its circle
into such ranges, and the scan skips all else.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tindra.functions import geo, text
from tindra.operators.joins import radius_join
from tindra.operators.order import collapse_repeats

BITS = 24  # of each coordinate: a cell is 1.2 m high, 2.4 m wide at the equator
RANGES = 24  # of the curve that a search asks for at most
GROUP_BYTES = 4 << 20  # a row group's size, so that its statistics stay narrow


def _spread_bits(x: Column) -> Column:
    """The bits of a number, each followed by a free one.  Fixed values: the masks of halving steps."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _steps(value: Column, low: float, span: float) -> Column:
    return F.least(F.greatest(F.floor((value - low) / span * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def curve(lat: Column, lon: Column) -> Column:
    """The place on the curve; beyond the poles and the date line that of the nearest cell."""
    return _spread_bits(_steps(lon, -180, 360)).bitwiseOR(F.shiftleft(_spread_bits(_steps(lat, -90, 180)), 1))


def ranges(lat: float, lon: float, radius_m: float, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of the curve, both ends included, that hold every point within the radius.

    The curve's squares are halved from the whole map down, largest first, as long as they reach into the
    circle's box and the ranges are few enough."""
    up = radius_m / (geo.EARTH_M * math.pi / 180) * 1.000001
    south, north = lat - up, lat + up
    edge = min(90.0, max(abs(south), abs(north)))
    ratio = math.sin(min(math.pi / 2, radius_m / geo.EARTH_M)) / max(math.cos(math.radians(edge)), 1e-12)
    wide = 180.0 if edge >= 90 or ratio >= 1 else math.degrees(math.asin(ratio)) * 1.000001
    if wide >= 180:
        spans = [(-180.0, 180.0)]
    else:
        west = (lon - wide + 180) % 360 - 180
        spans = [(west, west + 2 * wide)] if west + 2 * wide <= 180 else [(west, 180.0), (-180.0, west + 2 * wide - 360)]
    clip = lambda v: max(0, min((1 << BITS) - 1, math.floor(v * (1 << BITS))))
    rows = clip((south + 90) / 180), clip((north + 90) / 180)
    boxes = [(clip((w + 180) / 360) - 1, clip((e + 180) / 360) + 1) for w, e in spans]  # a step for rounding
    rows = rows[0] - 1, rows[1] + 1

    def reach(x: int, y: int, size: int) -> int:
        """0: outside; 1: in part; 2: whole."""
        best = 0
        for low, high in boxes:
            if x <= high and x + size > low and y <= rows[1] and y + size > rows[0]:
                best = max(best, 2 if x >= low and x + size - 1 <= high and y >= rows[0] and y + size - 1 <= rows[1] else 1)
        return best

    squares, done = [(0, 0, 0, BITS)], []  # start on the curve, column, row, level
    while squares and len(squares) + len(done) <= most:
        start, x, y, level = squares.pop(0)
        kind = reach(x << level, y << level, 1 << level)
        if kind == 2 or (kind == 1 and level == 0):
            done.append((start, level))
        elif kind == 1:
            quarter = 1 << 2 * (level - 1)
            squares += [(start + k * quarter, 2 * x + (k & 1), 2 * y + (k >> 1), level - 1) for k in range(4)]
    done += [(start, level) for start, x, y, level in squares if reach(x << level, y << level, 1 << level)]
    out: list[tuple[int, int]] = []
    for start, level in sorted(done):
        end = start + (1 << 2 * level) - 1
        if out and out[-1][1] + 1 == start:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def laid_out(items: DataFrame, lodging: str) -> DataFrame:
    """id, name, lat, lon and place of the rows that a search for nearby items can return."""
    name, gps = text.nonnull(F.col("name")), geo.squeezed(F.col("gps"))
    rows = items.where(geo.has_location(F.col("gps")) & ~name.rlike(r"^[*+]") & ~text.nonnull(F.col("tag")).contains(lodging))
    rows = geo.with_point(rows.select("id", F.col("name").alias("_name"), name.alias("name"), gps.alias("gps")), "gps", "lat", "lon")
    rows = collapse_repeats(rows, F.col("name"), (F.col("gps"),), (F.col("_name").asc_nulls_first(), F.asc("id")))
    return rows.select("id", "name", "lat", "lon", curve(F.col("lat"), F.col("lon")).alias("place"))


def store(items: DataFrame, path: str, lodging: str, files: int | None = None) -> None:
    """Writes the layout; ``files`` defaults to the session's shuffle partitions."""
    n = files or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["place", "id"]  # the id spreads one crowded place over files
    laid_out(items, lodging).repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(path)


def in_reach(layout: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Rows of the layout within the radius, with ``distance_m``."""
    place = F.lit(False)
    for low, high in ranges(lat, lon, radius_m):
        place |= F.col("place").between(low, high)
    near = layout.where(place).withColumn("distance_m", geo.haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)))
    return near.where(F.col("distance_m") < radius_m)


def nearby(layout: DataFrame, lat: float, lon: float, radius_m: float = 4000, most: int = 10) -> DataFrame:
    """The nearest items by whole metres, ties by name, as ``catalogue.nearby`` gives them."""
    near = in_reach(layout, lat, lon, radius_m)
    return near.select(F.col("name").alias("key"), F.floor("distance_m").cast("long").alias("value"), "id").orderBy("value", "key", "id").limit(most)


def nearby_each(layout: DataFrame, probes: DataFrame, radius_m: float = 4000, most: int = 10) -> DataFrame:
    """The nearest items of every probe (probe, probe_lat, probe_lon): probe, rank, key, value, id.

    Ranks are cut to ``most`` before and after the shuffle by probe, so a probe in a crowd is no task of
    its own."""
    pairs = radius_join(probes, layout.select("id", "name", "lat", "lon"), radius_m, ("probe_lat", "probe_lon"), ("lat", "lon"))
    found = pairs.select("probe", F.col("name").alias("key"), F.floor("distance_m").cast("long").alias("value"), "id")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("value", "key", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
