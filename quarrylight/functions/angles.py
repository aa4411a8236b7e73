"""Angles, bearings and projections as Column expressions.

Forward at yaw t is (-sin t, -cos t) in (x, z), right is (cos t, -sin t). Compass bearings are clockwise from -z, while
place directions call +z north; both conventions are kept where they apply.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPASS_8 = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def finite(value: Column) -> Column:
    """A double, or null if it is missing, not a number or infinite."""
    v = value.try_cast("double")
    return F.when(~(F.isnan(v) | (F.abs(v) == float("inf"))), v)


def wrap360(deg: Column) -> Column:
    return F.pmod(deg, F.lit(360.0))


def circular_difference(a: Column, b: Column) -> Column:
    """Absolute difference in [0, 180]."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def wrapped_delta(deg: Column) -> Column:
    """A signed difference in (-180, 180]."""
    d = F.pmod(deg + 180, F.lit(360.0)) - 180
    return F.when(d == -180, F.lit(180.0)).otherwise(d)


def polar_distance(a: Column, b: Column, delta_deg: Column) -> Column:
    """Law of cosines for two ranges and the angle between them."""
    return F.sqrt(F.greatest(F.lit(0.0), a * a + b * b - 2 * a * b * F.cos(F.radians(F.abs(delta_deg)))))


def project(x: Column, z: Column, yaw_deg: Column, distance: Column) -> tuple[Column, Column]:
    """The point ``distance`` ahead at ``yaw``; null if anything is missing or the distance negative."""
    x, z, yaw, d = (finite(c) for c in (x, z, yaw_deg, distance))
    ok = d >= 0
    return F.when(ok, x - F.sin(F.radians(yaw)) * d), F.when(ok, z - F.cos(F.radians(yaw)) * d)


def project_from_camera(x: Column, z: Column, camera_deg: Column, bearing_deg: Column, distance: Column) -> tuple[Column, Column]:
    """A negative bearing is to the left of the camera's axis."""
    return project(x, z, finite(camera_deg) - finite(bearing_deg), distance)


def project_xyz(x: Column, y: Column, z: Column, camera_deg: Column, distance: Column, bearing_deg: Column, height: Column) -> tuple[Column, Column, Column]:
    px, pz = project_from_camera(x, z, camera_deg, bearing_deg, distance)
    return px, finite(y) + finite(height), pz


def bearing_between(sx: Column, sz: Column, tx: Column, tz: Column) -> Column:
    """Clockwise from -z in [0, 360); null for points that coincide."""
    dx, dz = tx - sx, tz - sz
    return F.when((F.abs(dx) >= 1e-9) | (F.abs(dz) >= 1e-9), wrap360(F.degrees(F.atan2(dx, -dz)) + 360))


def camera_bearing(orientation_deg: Column, bearing_deg: Column) -> Column:
    return wrap360(orientation_deg - bearing_deg)


def compass8(bearing_deg: Column) -> Column:
    index = F.floor((wrap360(bearing_deg) + 22.5) / 45).cast("int") % 8
    return F.element_at(F.array(*map(F.lit, COMPASS_8)), index + 1)


def view_direction(dx: Column, dz: Column, yaw_deg: Column, eps: float = 0.25) -> Column:
    """right, left, in front or behind as seen at ``yaw``; sideways wins ties; null within ``eps``."""
    yaw = F.radians(yaw_deg)
    right = dx * F.cos(yaw) - dz * F.sin(yaw)
    ahead = -dx * F.sin(yaw) - dz * F.cos(yaw)
    side = F.abs(right) >= F.abs(ahead)
    return (
        F.when(F.hypot(dx, dz) <= eps, F.lit(None).cast("string"))
        .when(side & (right > eps), "right").when(side & (right < -eps), "left")
        .when(~side & (ahead > eps), "in front").when(~side & (ahead < -eps), "behind")
    )


def vertical_direction(dy: Column, eps: float = 0.25) -> Column:
    return F.when(dy > eps, "above").when(dy < -eps, "below").when(dy.isNotNull(), "level")


def cardinal_direction(dx: Column, dz: Column, eps: float = 0.25) -> Column:
    """Of places: NORTH_OF is +z and wins ties; null within ``eps`` of both axes."""
    along = F.abs(dz) >= F.abs(dx)
    return (
        F.when((F.abs(dx) <= eps) & (F.abs(dz) <= eps), F.lit(None).cast("string"))
        .when(along & (dz > 0), "NORTH_OF").when(along, "SOUTH_OF")
        .when(dx > 0, "EAST_OF").otherwise("WEST_OF")
    )


def local_phrase(delta_deg: Column, depth: Column, height: Column, vertical_eps: float = 0.25) -> Column:
    """Such as "slightly right, behind, above"; empty if nothing stands out."""
    graded = lambda v, slight, least, plus, minus: F.when(F.abs(v) >= least, F.concat(F.when(F.abs(v) < slight, "slightly ").otherwise(""), F.when(v > 0, plus).otherwise(minus)))
    return F.concat_ws(
        ", ",
        graded(delta_deg, SLIGHT_DEG, NONE_DEG, "right", "left"),
        graded(depth, SLIGHT_M, NONE_M, "behind", "in front"),
        F.when(F.abs(height) >= vertical_eps, F.when(height > 0, "above").otherwise("below")),
    )


# Below the first the lateral (degrees) and depth (metres) differences count as none, below the second as slight.
NONE_DEG, SLIGHT_DEG = 5.0, 20.0
NONE_M, SLIGHT_M = 0.05, 0.75


def vertical_fov(fov_deg: Column, width: Column, height: Column) -> Column:
    return F.degrees(2 * F.atan(F.tan(F.radians(fov_deg) / 2) * height / F.greatest(width, F.lit(1.0))))


def pinhole_angles(px: Column, py: Column, width: Column, height: Column, fov_deg: Column) -> tuple[Column, Column]:
    """Bearing and elevation of a pixel's centre under a horizontal field of view; square pixels, one focal length."""
    focal = width / (2 * F.tan(F.radians(fov_deg) / 2))
    return F.degrees(F.atan((px - (width - 1) / 2) / focal)), F.degrees(F.atan(((height - 1) / 2 - py) / focal))


def planar_distance(depth: Column, bearing_deg: Column) -> Column:
    """Distance on the floor from depth along the axis; null at right angles to it and for depths that are not positive."""
    d, cos = finite(depth), F.cos(F.radians(finite(bearing_deg)))
    return F.when((d > 0) & (F.abs(cos) >= 1e-6), d / cos)


def height_from_depth(depth: Column, elevation_deg: Column) -> Column:
    return finite(depth) * F.tan(F.radians(finite(elevation_deg)))


def object_orientation(frame_deg: Column, laterality: Column, step: float, query_side: bool = False) -> Column:
    """Offset by laterality; the build and query sides have opposite signs, on purpose."""
    sign = 1 if query_side else -1
    return wrap360(frame_deg + F.when(laterality == "left", sign * step).when(laterality == "right", -sign * step).otherwise(0.0))


def valid_bearing(deg: Column) -> Column:
    v = finite(deg)
    return F.when((v >= -90) & (v <= 90), v)


def fallback_bearing(laterality: Column, step: float) -> Column:
    return F.when(laterality == "left", -step).when(laterality == "right", step).otherwise(0.0)


def yaw_of_quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Yaw about the vertical axis in whole degrees, [0, 360)."""
    yaw = F.degrees(F.atan2(2 * (w * y + x * z), 1 - 2 * (y * y + z * z)))
    return F.pmod(F.bround(yaw, 0), F.lit(360.0)).cast("int")


def scan_angles(values: Column) -> Column:
    """Sorted distinct angles in [0, 360)."""
    return F.array_sort(F.array_distinct(F.transform(values, lambda v: F.pmod(v.cast("int"), F.lit(360)))))


def nearest_scan_angle(deg: Column, angles: Column) -> Column:
    """The angle nearest on the circle; of equally near ones the first."""
    ranked = F.transform(angles, lambda a, i: F.struct(circular_difference(deg, a).alias("d"), i.alias("i"), a.alias("a")))
    return F.array_min(ranked)["a"]


def gaussian(distance: Column, sigma: float) -> Column:
    s = max(sigma, 1e-6)
    return F.exp(-(distance * distance) / (s * s))


def world_to_pixel(x: Column, z: Column, width: Column, height: Column, min_x: Column, max_x: Column, min_z: Column, max_z: Column) -> tuple[Column, Column]:
    """Pixel of a floor point in an image that spans the bounds, clipped to the image."""
    u = ((x - min_x) / F.greatest(max_x - min_x, F.lit(1e-9)) * (width - 1)).cast("int")
    v = ((z - min_z) / F.greatest(max_z - min_z, F.lit(1e-9)) * (height - 1)).cast("int")
    return F.least(F.greatest(u, F.lit(0)), width - 1), F.least(F.greatest(v, F.lit(0)), height - 1)
