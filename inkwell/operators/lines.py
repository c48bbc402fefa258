"""The line by which a page is levelled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """How one of the detectors reads a segment."""

    y_up: bool  # angles counted against the image's y axis
    normalised: bool  # to -90..90
    level_below: float  # degrees from the horizontal
    fallback: bool  # the longest segment of any direction where none is level
    turn: int  # a page is turned by the line's angle times this


PROFILES = {
    "server": Profile(y_up=True, normalised=True, level_below=20, fallback=True, turn=-1),
    "util": Profile(y_up=False, normalised=True, level_below=15, fallback=False, turn=1),
    "local": Profile(y_up=False, normalised=False, level_below=10, fallback=False, turn=-1),
}


def length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def angle(x1: Column, y1: Column, x2: Column, y2: Column, profile: Profile) -> Column:
    """Degrees; a point has 0."""
    dy = (y1 - y2) if profile.y_up else (y2 - y1)
    raw = F.degrees(F.atan2(dy.cast("double"), (x2 - x1).cast("double")))
    if not profile.normalised:
        return raw
    return F.when(raw < -90, raw + 180).when(raw > 90, raw - 180).otherwise(raw)


def is_level(degrees: Column, profile: Profile) -> Column:
    near = F.abs(degrees) < profile.level_below
    return near if profile.normalised else near | (F.abs(degrees) > 180 - profile.level_below)


def rotation(degrees: Column, profile: Profile) -> Column:
    """What a page is turned by, so that it comes out level with the profile's own rotation.

    "server" and "util" turn counter-clockwise, "local" clockwise.
    """
    if profile.normalised:
        return degrees * profile.turn
    return F.when(degrees > 170, 180 - degrees).when(degrees < -170, -180 - degrees).otherwise(-degrees)


def geometry(segments: DataFrame, profile: str = "server") -> DataFrame:
    """``segments`` (x1, y1, x2, y2) with length, angle and is_level."""
    p = PROFILES[profile]
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    degrees = angle(*ends, p)
    return segments.select("*", length(*ends).alias("length"), degrees.alias("angle"), is_level(degrees, p).alias("is_level"))


def select_line(segments: DataFrame, keys: list[str], index: str = "line_index", profile: str = "server") -> DataFrame:
    """One row per image that has segments: the longest level one, the first of equals, and the counts.

    Where none is level, profiles with a fallback take the longest of any
    direction, with a warning; the others take none, and the angle is 0.
    """
    p = PROFILES[profile]
    own = geometry(segments, profile)
    # Segments of one image are ranked before the shuffle, as a minimum of a struct.
    rank = F.struct((~F.col("is_level")).alias("steep"), (-F.col("length")).alias("short"), F.col(index).alias("i"), *(F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")), F.col("angle").alias("a"))
    best = own.groupBy(*keys).agg(F.count("*").alias("total_lines"), F.count_if("is_level").alias("level_lines"), F.min(rank).alias("b"))
    taken = F.lit(True) if p.fallback else ~F.col("b.steep")

    def of(value: Column) -> Column:
        return F.when(taken, value)

    return best.select(
        *keys,
        "total_lines",
        "level_lines",
        of(F.col("b.i")).alias(index),
        *(of(F.col(f"b.{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")),
        of(-F.col("b.short")).alias("length"),
        of(F.col("b.a")).alias("detected_angle"),
        F.coalesce(of(rotation(F.col("b.a"), p)), F.lit(0.0)).alias("rotation_angle"),
        (taken & F.col("b.steep")).alias("warning"),
    )


def with_lines(images: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """All images; those without segments have angle 0, no line and counts of 0."""
    found = images.join(selected, keys, "left")
    return found.fillna({"total_lines": 0, "level_lines": 0, "rotation_angle": 0.0, "warning": False})
