"""Coordinates as Column expressions: validity, parsing, distance, degrees, cells."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DEGREE_KM = 111.0


def squeezed(gps: Column) -> Column:
    """The coordinate text without blanks; null becomes empty."""
    return F.replace(F.coalesce(gps, F.lit("")), F.lit(" "), F.lit(""))


def has_location(gps: Column) -> Column:
    """Whether the text can be a coordinate: not empty, not the NOLOC marker in any case, with a comma."""
    g = squeezed(gps)
    return (g != "") & (F.upper(g) != "NOLOC") & g.contains(",")


def number(text: Column) -> Column:
    """A decimal number's value; null for other text."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _bound(gps: Column, parse) -> Column:
    """``parse`` of the squeezed text, which a one-element transform evaluates once."""
    return F.get(F.transform(F.array(squeezed(gps)), parse), F.lit(0))


def _pair(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def _lenient(g: Column) -> Column:
    parts = F.split(g, ",", -1)
    return _pair(number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1))))


def _strict(g: Column) -> Column:
    return _pair(number(F.substring_index(g, ",", 1)), number(F.substr(g, F.instr(g, ",") + 1)))


def _usable(p: Column, strict: bool) -> Column:
    ok = p["lat"].isNotNull() & p["lon"].isNotNull() & ~F.isnan(p["lat"]) & ~F.isnan(p["lon"])
    return ok & p["lat"].between(60, 70) & p["lon"].between(-30, -10) if strict else ok


def lenient_point(gps: Column) -> tuple[Column, Column]:
    """Latitude and longitude from the first two comma-separated fields; nulls where either fails."""
    p = _bound(gps, _lenient)
    ok = _bound(gps, lambda g: _usable(_lenient(g), False))
    return F.when(ok, p["lat"]), F.when(ok, p["lon"])


def strict_point(gps: Column) -> tuple[Column, Column]:
    """Latitude and longitude split at the first comma only, within 60..70 N and 30..10 W."""
    p = _bound(gps, _strict)
    ok = _bound(gps, lambda g: (F.instr(g, ",") > 0) & _usable(_strict(g), True))
    return F.when(ok, p["lat"]), F.when(ok, p["lon"])


def with_point(df: DataFrame, gps: str, lat: str, lon: str, strict: bool = False, outer: bool = False) -> DataFrame:
    """Rows with their parsed point; rows without one go, or stay with nulls if ``outer``.

    The point comes out of a generator, so filters and joins on it see plain columns and the parsing
    expression stands in the plan once."""
    parse = (lambda g: F.when(F.instr(g, ",") > 0, _strict(g))) if strict else _lenient
    found = F.filter(F.transform(F.array(squeezed(F.col(gps))), parse), lambda p: F.coalesce(_usable(p, strict), F.lit(False)))
    made = df.withColumn("_point", (F.explode_outer if outer else F.explode)(found))
    return made.withColumns({lat: F.col("_point.lat"), lon: F.col("_point.lon")}).drop("_point")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once (a one-element transform binds it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(value: Column, digits: int) -> Column:
    """A double below 1,000 in size, times a power of ten (7 at most), rounded from its exact binary value,
    halves to even: a whole number without its sign.  In integers, as a double's text would round twice."""
    two = F.lit(Decimal(1 << 92))

    def steps_of(product: Column) -> Column:
        near = F.floor(product / two).cast("decimal(19,0)")  # of a rounded quotient: one off at most
        return _let(near, lambda n: F.when(n * two > product, n - 1).when((n + 1) * two <= product, n + 1).otherwise(n).cast("decimal(19,0)"))

    def to_even(product: Column, steps: Column) -> Column:
        up = lambda rest: (rest > two) | ((rest == two) & (F.pmod(steps, F.lit(2)) == 1))
        return _let((product - steps * two) * 2, lambda rest: (steps + F.when(up(rest), 1).otherwise(0)).cast("long"))

    def product_of(scaled: Column) -> Column:
        high = F.floor(scaled)
        low = F.floor((scaled - high) * (1 << 40))  # not 0 below 1 only; what is further down decides no half
        return (high.cast("decimal(19,0)") * F.lit(Decimal(1 << 40)) + low.cast("decimal(13,0)")) * F.lit(Decimal(10**digits))

    return _let(F.abs(value) * (1 << 52), lambda s: _let(product_of(s), lambda p: _let(steps_of(p), lambda n: to_even(p, n))))


def _sign(value: Column) -> Column:
    return F.when(F.startswith(value.cast("string"), F.lit("-")), "-").otherwise("")


def fixed(value: Column, digits: int) -> Column:
    """A coordinate with so many decimals."""
    one = 10**digits
    text = lambda n: F.concat(_sign(value), F.floor(n / one).cast("string"), F.lit("."), F.lpad((n % one).cast("string"), digits, "0"))
    return F.when(~F.isnan(value), _let(rounded(value, digits), text))


def shortest(value: Column, digits: int = 6) -> Column:
    """A coordinate rounded to so many decimals, without closing zeros but one; tiny ones with an exponent."""
    plain = F.regexp_replace(fixed(value, digits), r"(\.\d+?)0+$", "$1")

    def tiny(n: Column) -> Column:
        small = n.cast("string")
        tail = F.regexp_replace(F.concat(F.lit("."), F.substr(small, F.lit(2))), r"\.?0*$", "")
        power = F.lit(digits) + 1 - F.length(small)
        text = F.concat(_sign(value), F.left(small, F.lit(1)), tail, F.lit("e-"), F.lpad(power.cast("string"), 2, "0"))
        return F.when((n > 0) & (n < 10 ** (digits - 4)), text)

    return F.when(~F.isnan(value), F.coalesce(_let(rounded(value, digits), tiny), plain))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dl) * F.sin(dl)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def degrees_lat(km: float) -> float:
    return km / DEGREE_KM


def degrees_lon(km: float, lat: Column) -> Column:
    return F.lit(km) / (F.lit(DEGREE_KM) * F.cos(F.radians(lat)))


def in_box(lat: Column, lon: Column, south: float = 63, north: float = 67, west: float = -25, east: float = -13) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def gps_verdict(gps: Column) -> Column:
    """``NOLOC`` for the marker in any case, ``ok`` for a strict decimal pair, else ``invalid``."""
    g = F.trim(F.coalesce(gps, F.lit("")))
    return F.when(F.upper(g) == "NOLOC", "NOLOC").when(g.rlike(r"^-?\d+(\.\d+)?,\s*-?\d+(\.\d+)?$"), "ok").otherwise("invalid")


def milli_key(value: Column) -> Column:
    """The value rounded to thousandths, as an integer key."""
    return F.floor(value * 1000 + 0.5).cast("long")


class SmallCells:
    """Cells so small that all points of one are within the radius of each other (less than it)."""

    def __init__(self, radius_m: float):
        self.radius_m = radius_m
        self.height = radius_m / (EARTH_M * math.pi / 180) / 1.5  # two sides of 2/3: a diagonal of 0.95 radii

    def _columns(self, row: Column) -> Column:
        """Columns no wider than a row is high, where the row is widest: towards the equator."""
        low = F.least(F.least(F.abs(row), F.abs(row + 1)) * self.height, F.lit(90.0))
        return F.ceil(F.lit(360 / self.height) * F.cos(F.radians(low)) + 1).cast("long")

    def _row(self, lat: Column) -> Column:
        return F.floor(lat / self.height).cast("long")

    def _name(self, row: Column, lon: Column, columns: Column) -> Column:
        return F.concat_ws(":", row.cast("string"), F.pmod(F.floor((lon + 180) / 360 * columns), columns).cast("long").cast("string"))

    def own(self, lat: Column, lon: Column) -> Column:
        """The point's cell, as text."""
        row = self._row(lat)
        return self._name(row, lon, self._columns(row))

    def reach(self, lat: Column, lon: Column) -> Column:
        """All cells that can hold a point within the radius, the point's own included."""
        ratio = F.lit(math.sin(min(math.pi / 2, self.radius_m / EARTH_M)) * 1.000001) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
        wide = F.when(ratio >= 1, 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))

        def cells(step: int) -> Column:
            row = self._row(lat) + step
            n = self._columns(row)
            first, last = (F.floor((lon + sign * wide + 180) / 360 * n) for sign in (-1, 1))
            return F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda c: F.concat_ws(":", row.cast("string"), F.pmod(c, n).cast("long").cast("string")))

        return F.array_distinct(F.flatten(F.array(*(cells(k) for k in (-2, -1, 0, 1, 2)))))


class Cells:
    """A lattice of rows a radius high, each with columns of its own: as wide as a radius can reach in
    longitude from a neighbouring row, so points within the radius lie in neighbouring rows and there in
    neighbouring columns.  Columns wrap round at the date line; towards the poles rows have fewer, down
    to one.  A row hangs on its own latitude only, so points elsewhere in a table change nothing."""

    def __init__(self, radius_m: float):
        self.height = radius_m / (EARTH_M * math.pi / 180) * 1.000001

    def row(self, lat: Column) -> Column:
        return F.floor(lat / self.height).cast("long")

    def columns(self, row: Column) -> Column:
        """How many columns a row has."""
        edge = F.least(F.lit(90.0), (F.greatest(F.abs(row), F.abs(row + 1)) + 1) * self.height)
        shrink = F.cos(F.radians(edge))
        return F.when(shrink < 1e-9, 1).otherwise(F.greatest(F.lit(1), F.floor(360 / (F.lit(self.height * 1.01) / shrink)))).cast("long")

    def keyed(self, df: DataFrame, lat: str, lon: str) -> DataFrame:
        return self._placed(df.withColumn("_cy", self.row(F.col(lat))), lon, (0,))

    def spread(self, df: DataFrame, lat: str, lon: str) -> DataFrame:
        """A row per neighbouring cell."""
        rows = F.explode(F.array(*(self.row(F.col(lat)) + k for k in (-1, 0, 1))))
        return self._placed(df.withColumn("_cy", rows), lon, (-1, 0, 1))

    def _placed(self, df: DataFrame, lon: str, steps: tuple[int, ...]) -> DataFrame:
        n = self.columns(F.col("_cy"))
        at = lambda k: F.pmod(F.floor((F.col(lon) + 180) / 360 * n) + k, n).cast("long")
        return df.withColumn("_cx", at(0) if steps == (0,) else F.explode(F.array_distinct(F.array(*(at(k) for k in steps)))))
