"""Column functions: thresholds, ramps, labels, vectors, quaternions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(value: Column, threshold: float, tolerance: float) -> Column:
    """meets, fails or, within the tolerance of the threshold, within_tolerance."""
    return F.when(value - tolerance >= threshold, "meets").when(value + tolerance < threshold, "fails").when(value.isNotNull(), "within_tolerance")


def ramp(value: Column, bad: float, good: float) -> Column:
    """0 at ``bad``, 1 at ``good``, linear between, whichever is larger."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - bad) / (good - bad)))


def folded_case(text: Column) -> Column:
    """Case-folded: lower case, of the letters that case folding changes beyond it the sharp s and the final sigma."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ς", "σ")


def label_key(label: Column) -> Column:
    """Case-folded, runs of other than letters and digits one space, none at the ends."""
    return F.trim(F.regexp_replace(folded_case(label), r"[^\p{L}\p{N}]+", " "))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; null where a vector has no length."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / length)))


def quaternion_product(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """Hamilton's product; quaternions are (x, y, z, w)."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def rotation_angle(q: tuple[Column, ...]) -> Column:
    x, y, z, w = q
    return 2 * F.atan2(F.sqrt(x * x + y * y + z * z), F.abs(w))


def at_most(value: Column, threshold: Column | float, tolerance: float) -> Column:
    """meets, fails or, within the tolerance of the threshold, within_tolerance."""
    return F.when(value + tolerance <= threshold, "meets").when(value - tolerance > threshold, "fails").when(value.isNotNull(), "within_tolerance")
