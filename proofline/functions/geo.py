"""Great-circle distance and its display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import js_round

EARTH_RADIUS_M = 6371000.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Whole metres between two WGS84 points."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return js_round(F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def format_distance(metres: Column) -> Column:
    """``450 m`` below one kilometre, else kilometres in half-up tenths."""
    t = F.floor((metres + F.lit(50)) / F.lit(100))
    km = F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(" km"))
    return F.when(metres < 1000, F.concat(metres.cast("string"), F.lit(" m"))).otherwise(km)


def map_link(lat: Column, lng: Column, name: Column) -> Column:
    base = F.lit("https://www.google.com/maps/dir/?api=1&destination=")
    # encodeURIComponent writes a blank as %20 and keeps ! ' ( ) ~ unescaped
    enc = F.url_encode(name)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        enc = F.replace(enc, F.lit(coded), F.lit(plain))
    return F.concat(base, lat.cast("string"), F.lit(","), lng.cast("string"),
                    F.lit("&destination_place_id="), enc)
