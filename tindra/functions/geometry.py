"""Geometry blobs: GeoPackage header, well-known binary, and one point that stands for the shape.

All of it is arithmetic on slices of the blob, in either byte order: a number is read from the hex text of
its bytes, a double from sign, exponent and mantissa.  A blob that is cut short, or that is no such
geometry, has no point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Envelope sizes by header code, geometry types.
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
POINT, LINE, POLYGON, MULTI = 1, 2, 3, (4, 5, 6)


# In what follows ``b`` is the blob; places are SQL integers from 0.
def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to a value (a one-element transform binds it)."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _ordered(at: str, size: int, little: str) -> str:
    """SQL: the hex text of a number's bytes, highest first."""
    turned = ", ".join(f"substring(h, {2 * k - 1}, 2)" for k in range(size, 0, -1))
    return _let(f"hex(substring(b, cast({at} as int) + 1, {size}))", "h", f"if({little}, concat({turned}), h)")


def _integer(at: str, little: str) -> str:
    """SQL: an unsigned integer of four bytes."""
    return f"cast(conv({_ordered(at, 4, little)}, 16, 10) as bigint)"


def _double(at: str, little: str) -> str:
    """SQL: a double of eight bytes."""
    exponent, mantissa = "(shiftright(u, 20) & 2047)", "((u & 1048575) * 4294967296 + w)"
    odd = f"if({mantissa} = 0, double('Infinity'), double('NaN'))"
    small = f"{mantissa} * pow(2.0D, -1074)"
    size = f"case when {exponent} = 2047 then {odd} when {exponent} = 0 then {small} else (1 + {mantissa} / 4503599627370496.0D) * pow(2.0D, {exponent} - 1023) end"
    signed = f"if(u >= 2147483648, -1.0D, 1.0D) * {size}"
    half = lambda first: f"cast(conv(substring(g, {first}, 8), 16, 10) as bigint)"
    return _let(_ordered(at, 8, little), "g", _let(half(1), "u", _let(half(9), "w", signed)))


def _shape(at: str) -> str:
    """SQL: struct of byte order, type and where the type's data begins; null where the blob ends before."""
    little = f"substring(b, cast({at} as int) + 1, 1) = X'01'"
    kind = _integer(f"({at} + 1)", "e")
    return f"if({at} + 5 > length(b), null, {_let(little, 'e', f'named_struct({chr(39)}little{chr(39)}, e, {chr(39)}kind{chr(39)}, {kind} % 1000, {chr(39)}at{chr(39)}, {at} + 5)')})"


def _count(at: str) -> str:
    return f"if({at} + 4 > length(b), 0, {_integer(at, 's.little')})"


def point(blob: str) -> Column:
    """struct<lon, lat> of a geometry column (its name): a point itself, the middle vertex of a line, the mean of a
    polygon's outer ring as stored (its closing vertex counts twice), or what stands for a collection's
    first part; nulls for blobs that cannot be read."""
    header = f"8 + case {' '.join(f'when v = {k} then {n}' for k, n in ENVELOPE.items())} else 0 end"
    begin = _let("shiftright(cast(conv(hex(substring(b, 4, 1)), 16, 10) as int), 1) & 7", "v", header)
    pair = lambda at: f"if({at} + 16 > length(b), null, named_struct('lon', {_double(at, 's.little')}, 'lat', {_double(f'{at} + 8', 's.little')}))"
    line = _let(_count("s.at"), "n", f"if(n = 0, null, {_let('s.at + 4 + 16 * (n div 2)', 'q', pair('q'))})")
    vertex = lambda shift: _double(f"s.at + 8 + 16 * i + {shift}", "s.little")
    sums = f"aggregate(sequence(0, cast(n as int) - 1), named_struct('x', 0.0D, 'y', 0.0D), (t, i) -> named_struct('x', t.x + {vertex(0)}, 'y', t.y + {vertex(8)}), t -> named_struct('lon', t.x / n, 'lat', t.y / n))"
    ring = _let(f"if({_count('s.at')} = 0, 0, {_count('s.at + 4')})", "n", f"if(n = 0 or s.at + 8 + 16 * n > length(b), null, {sums})")
    simple = f"case s.kind when {POINT} then {pair('s.at')} when {LINE} then {line} when {POLYGON} then {ring} end"
    part = _let("s", "m", f"if(m.kind in {MULTI}, if({_count('m.at').replace('s.little', 'm.little')} = 0, null, {_shape('(m.at + 4)')}), m)")
    whole = _let(begin, "o", _let(_shape("o"), "s", _let(part, "s", simple)))
    standing = f"if(b is null or length(b) < 8 or substring(b, 1, 2) <> X'4750', null, {whole})"
    return F.expr(_let(f"`{blob}`", "b", standing))
