"""Geography on columns, in double precision; entities without coordinates give NULL (or false)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_KM = 6371
#: Layout of polygons; continents are such rows, read from a file of the user's.
POLYGONS = "name string, corners array<struct<lat:double,lon:double>>"


def distance(lat: Column, lon: Column, to_lat: float, to_lon: float, radius_km: float = RADIUS_KM) -> Column:
    """Haversine distance in km."""
    a = F.pow(F.sin(F.radians(lat - to_lat) / 2), 2) + F.cos(F.radians(F.lit(to_lat))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - to_lon) / 2), 2)
    return radius_km * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _crosses(lat: Column, lon: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether a ray from the point crosses the edge (a, b)-(c, d)."""
    return ((b > lon) != (d > lon)) & (lat < (c - a) * (lon - b) / (d - b) + a)


def inside(lat: Column, lon: Column, corners) -> Column:
    """Even-odd rule for one polygon given as (lat, lon) pairs: an expression of its edges."""
    odd = F.lit(False)
    for (a, b), (c, d) in zip(corners, (*corners[1:], corners[0]), strict=True):
        if b != d:
            odd = odd != _crosses(lat, lon, *map(F.lit, (float(a), float(b), float(c), float(d))))
    return F.coalesce(odd, F.lit(False))


def containing(places: DataFrame, polygons: DataFrame) -> DataFrame:
    """(name, idx) of the polygons that contain each place.  Each polygon's bounding box, cut into
    cells of 10 degrees, is joined by cell; only places of its cells are tested."""
    cell = lambda x: F.floor(x / 10).cast("int")
    bound = lambda f, c: f(F.transform("corners", lambda p: p[c]))
    box = polygons.select("name", "corners", *[bound(f, c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.array_min), ("hi", F.array_max))])
    cells = box.select("name", "corners", F.explode(F.sequence(cell(F.col("lo_lat")), cell(F.col("hi_lat")))).alias("_a"), "lo_lon", "hi_lon").select("name", "corners", "_a", F.explode(F.sequence(cell(F.col("lo_lon")), cell(F.col("hi_lon")))).alias("_o"))
    near = places.withColumn("_a", cell(F.col("lat"))).withColumn("_o", cell(F.col("lon"))).join(cells, ["_a", "_o"])
    edges = F.zip_with("corners", F.concat(F.slice("corners", 2, F.size("corners")), F.slice("corners", 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    sloped = F.filter(edges, lambda e: e["p"]["lon"] != e["q"]["lon"])
    odd = F.aggregate(sloped, F.lit(False), lambda o, e: o != _crosses(F.col("lat"), F.col("lon"), e["p"]["lat"], e["p"]["lon"], e["q"]["lat"], e["q"]["lon"]))
    return near.where(odd).select("name", "idx")


def fixed_degrees(degrees: Column) -> Column:
    """Degrees as an int of 1e-7 degrees, truncated."""
    return (degrees * 1e7).cast("int")


def unit_vector(lat: Column, lon: Column) -> Column:
    """Struct (x, y, z, present) of fixed-point coordinates; zeros where absent."""
    a, o = F.radians(lat / 1e7), F.radians(lon / 1e7)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(zero(F.cos(a) * F.cos(o)).alias("x"), zero(F.cos(a) * F.sin(o)).alias("y"), zero(F.when(lon.isNotNull(), F.sin(a))).alias("z"), (lat.isNotNull() & lon.isNotNull()).alias("present"))
