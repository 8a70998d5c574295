"""Positions: distances, boxes and cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radii in metres of the sphere in stay geometry, in haversine and in Web Mercator, and the WGS-84 axes.
STAY_RADIUS, EARTH_RADIUS = 6372795.0, 6378137.0
WGS84_A, WGS84_B = 6378137.0, 6356752.3


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def mercator_x(lon: Column) -> Column:
    return F.lit(EARTH_RADIUS) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(EARTH_RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def radius_at(lat: Column) -> Column:
    """Earth's radius at a latitude, on the WGS-84 ellipsoid."""
    c, s = F.cos(F.radians(lat)), F.sin(F.radians(lat))
    top = F.pow(WGS84_A**2 * c, 2) + F.pow(WGS84_B**2 * s, 2)
    return F.sqrt(top / (F.pow(WGS84_A * c, 2) + F.pow(WGS84_B * s, 2)))


def bounding_box(lat: Column, lon: Column, half_side: float) -> Column:
    """struct(south, west, north, east) around a point, half_side metres each way."""
    r = radius_at(lat)
    dlat = F.degrees(F.lit(half_side) / r)
    dlon = F.degrees(F.lit(half_side) / (r * F.cos(F.radians(lat))))
    return F.struct((lat - dlat).alias("south"), (lon - dlon).alias("west"), (lat + dlat).alias("north"), (lon + dlon).alias("east"))


def box_to_wkt(south: Column, west: Column, north: Column, east: Column) -> Column:
    points = [(west, south), (west, north), (east, north), (east, south), (west, south)]
    return F.concat(F.lit("POLYGON(("), F.concat_ws(",", *[F.format_string("%.6f %.6f", x, y) for x, y in points]), F.lit("))"))


def inside(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting: whether a point lies in a closed ring, an array of struct(x, y)."""
    edges = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))

    def crossed(e: Column) -> Column:
        ay, by = e["a"]["y"], e["b"]["y"]
        at = e["a"]["x"] + (lat - ay) / (by - ay) * (e["b"]["x"] - e["a"]["x"])
        return ((ay > lat) != (by > lat)) & (lon < at)

    return F.when(F.size(ring) >= 4, F.pmod(F.size(F.filter(edges, crossed)), F.lit(2)) == 1).otherwise(F.lit(False))


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    length = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
    t = F.when(length == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length)))
    return planar_distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))


#: Halves of the bits of a number of up to 32 bits are moved apart in these steps: bits, and which of them stay.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def interleaved(x: Column, y: Column) -> Column:
    """The bits of two numbers below 2 ** 31 in turn, those of ``x`` first, so that a cell's code begins with that of each cell around it."""

    def apart(v: Column) -> Column:
        for bits, mask in SPREAD:
            v = F.shiftleft(v, bits).bitwiseOR(v).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(apart(x.cast("long")), 1).bitwiseOR(apart(y.cast("long")))


def every_second_bit(code: Column) -> Column:
    """The bits at even places of a code, moved together: ``y`` of ``interleaved``, and ``x`` of the code shifted right by one."""
    v = code.bitwiseAND(F.lit(SPREAD[-1][1]))
    for (bits, _), (_, mask) in zip(SPREAD[::-1], [*SPREAD[-2::-1], (32, 0x00000000FFFFFFFF)], strict=True):
        v = F.shiftright(v, bits).bitwiseOR(v).bitwiseAND(F.lit(mask))
    return v
