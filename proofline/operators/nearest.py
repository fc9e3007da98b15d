"""Exact k nearest places on the globe for large place tables, by growing grid cells.

Points become positions on the unit sphere, so cells need no special rule at the poles or at the date line. At one level
space is cut into cubes; a user is joined, by cell key, with the places in its own and the 26 cubes around it. These hold
every place within one cube side. A user whose k-th found place is nearer than that is finished; the others go on with
cubes of twice the side. The last level has cubes as large as the globe, so everyone is finished.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m
from ..session import stage

LARGEST_SIDE = 2.0


def _position(df: DataFrame) -> DataFrame:
    lat, lng = F.radians("lat"), F.radians("lng")
    return df.withColumns({"_x": F.cos(lat) * F.cos(lng), "_y": F.cos(lat) * F.sin(lng), "_z": F.sin(lat)})


def _cube(side: float, axis: str) -> Column:
    return F.floor(F.col(axis) / side).cast("bigint")


def _first_side(places: DataFrame) -> float:
    """A side at which cubes on the sphere hold about one place, from the extent and number of the places."""
    axes = ("_x", "_y", "_z")
    s = places.agg(F.count("*").alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    if not s.n:
        return LARGEST_SIDE
    wide = sorted((s[a] for a in axes), reverse=True)
    return min(LARGEST_SIDE, max(1e-7, math.sqrt(wide[0] * max(wide[1], 1e-7) / s.n)))


def nearest_places(users: DataFrame, places: DataFrame, k: int = 1, user: str = "user_id", place: str = "place_id", same: str | None = None) -> DataFrame:
    """user, place, distance_m, place_rank: the ``k`` nearest places of every user, all if there are fewer.

    Both tables have ``lat`` and ``lng`` in degrees; ``same`` names a column that must be equal in both, such as a city.
    Ties of whole metres go to the smaller place id. Users and places without a position are left out. Joins are on
    cell keys only; what is broadcast is for the planner to decide.
    """
    by = [same] if same else []
    known = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    open_ = _position(users.filter(known).select(F.col(user).alias("_user"), "lat", "lng", *by))
    places = stage(_position(places.filter(known).select(F.col(place).alias("_place"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), "lat", "lng", *by)).drop("lat", "lng"), "places")
    side = _first_side(places)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    order = Window.partitionBy("_user").orderBy("distance_m", "_place")
    done: list[DataFrame] = []
    while True:
        last = side >= LARGEST_SIDE
        cells = open_
        for axis in "xyz":
            cells = cells.withColumn("_d", around).withColumn(f"_c{axis}", _cube(side, f"_{axis}") + F.col("_d"))
        held = places.select("_place", "_lat", "_lng", *by, *[_cube(side, f"_{a}").alias(f"_c{a}") for a in "xyz"])
        near = cells.select("_user", "lat", "lng", *by, "_cx", "_cy", "_cz").join(held, [*by, "_cx", "_cy", "_cz"])
        near = near.select("_user", "_place", haversine_m(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")).alias("distance_m"))
        near = near.withColumn("place_rank", F.row_number().over(order)).filter(F.col("place_rank") <= k)
        if last:
            done.append(near)
            break
        near = stage(near, "near")
        # whole metres of an arc whose chord is one side; one more for the rounding of both
        reach = math.floor(2 * EARTH_RADIUS_M * math.asin(side / 2)) - 1
        finished = near.filter((F.col("place_rank") == k) & (F.col("distance_m") < reach)).select("_user")
        done.append(near.join(finished, "_user", "left_semi"))
        open_ = stage(open_.join(finished, "_user", "left_anti"), "open")
        if open_.isEmpty():
            break
        side = min(LARGEST_SIDE, 2 * side)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("_user").alias(user), F.col("_place").alias(place), "distance_m", "place_rank")
