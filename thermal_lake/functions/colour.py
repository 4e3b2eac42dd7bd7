"""Colour spaces and pixel rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sRGB to XYZ (D65) and the white point.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation, value, all in 0..1, from channels in 0..1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = top - low
    sector = F.when(top == r, (g - b) / spread).when(top == g, 2 + (b - r) / spread).otherwise(4 + (r - g) / spread) / 6
    hue = F.when(spread == 0, F.lit(0.0)).otherwise(F.when(sector < 0, sector + 1).otherwise(sector))
    return hue, F.when(top == 0, F.lit(0.0)).otherwise(spread / top), top


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (D65) from sRGB channels in 0..1."""
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    rgb = [linear(c) for c in (r, g, b)]
    root = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116)
    fx, fy, fz = (root(sum(k * c for k, c in zip(row, rgb)) / w) for row, w in zip(RGB_TO_XYZ, WHITE))
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


FEATURES = ("lab_l", "lab_a", "lab_b", "hue", "sat", "val")


def with_colour_features(px: DataFrame) -> DataFrame:
    """P26 without the z-scores: six raw features per pixel, hue, saturation and value times 100."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    l, a, bb = lab(r, g, b)
    h, s, v = hsv(r, g, b)
    return px.withColumns({"lab_l": l, "lab_a": a, "lab_b": bb, "hue": h * 100, "sat": s * 100, "val": v * 100})


def zscore_features(px: DataFrame, key: str = "image_id") -> DataFrame:
    """Features centred and scaled per image.

    Means and deviations are one small row per image, aggregated map-side first and joined
    back, so an image with a third of all pixels is never sorted or held in one task.
    """
    stats = px.groupBy(key).agg(
        *[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_samp(c).alias(f"s_{c}") for c in FEATURES])
    z = {c: F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(F.lit(0.0)) for c in FEATURES}
    return px.join(stats, key).withColumns(z).drop(*[f"m_{c}" for c in FEATURES], *[f"s_{c}" for c in FEATURES])


def brown(h: Column, s: Column, v: Column, r: Column, g: Column, b: Column) -> Column:
    """Brown (ablated) pixel."""
    return ((h > 0.025) & (h < 0.18) & (s > 0.07) & (s < 0.60) & (v > 0.18) & (v < 0.92)
            & (r > g * 0.80) & (r < g * 1.65) & (g >= b * 0.65))


def charred(l: Column, s: Column, v: Column, r: Column, g: Column, b: Column) -> Column:
    """Charred pixel."""
    return (v < 0.32) & (l < 36) & (s > 0.06) & (r < 0.42) & (g < 0.42) & (b < 0.42)
