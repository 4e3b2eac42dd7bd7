"""Two-phase placement search over seeded candidate tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import field as FL
from ..operators import placement as P
from ..session import cut

# Candidates per phase, angle range, window and noise of the second phase.
SEEDS_1, SEEDS_2 = 80, 60
ANGLE_1 = (math.radians(-15), math.radians(15))
ANGLE_2 = (0.0, math.pi)
WINDOW, NOISE = 0.10, 0.03


def uniform(*parts: Column) -> Column:
    """Repeatable number in [0, 1) from a hash of its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(2**31)) / float(2**31)


def normal(*parts: Column) -> Column:
    """Repeatable standard normal number (Box-Muller on two hashed uniforms)."""
    u, v = F.greatest(uniform(F.lit("u"), *parts), F.lit(1e-12)), uniform(F.lit("v"), *parts)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def first_candidates(searches: DataFrame, access: DataFrame, seed: int = 1, n: int = SEEDS_1) -> DataFrame:
    """Phase 1: ``n`` accessible points per (target, distribution), evenly taken in hashed order, with hashed angles.

    Points are thinned per target before they meet the distributions; a target with fewer points
    reuses them with new angles.
    """
    spread = access.withColumn("_h", uniform(F.lit(seed), "target_id", "x", "y", "z"))
    few = FL.even_sample(spread, ["target_id"], "_h", n, ties=["x", "y", "z"])
    total = few.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n"))
    rep = few.join(total, "target_id").withColumn("_rep", F.explode(F.sequence(F.lit(1), F.ceil(F.lit(n) / F.col("_n")).cast("int"))))
    j = searches.join(rep, "target_id")
    key = ["dist_id", "x", "y", "z", "_rep"]
    return j.select("target_id", "dist_id", "axis1", "axis2", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"),
                    (ANGLE_1[0] + (ANGLE_1[1] - ANGLE_1[0]) * uniform(F.lit(f"a{seed}"), *key)).alias("a1"),
                    (ANGLE_2[1] * uniform(F.lit(f"b{seed}"), *key)).alias("a2"), F.xxhash64(F.lit(seed), "target_id", *key).alias("pose_id"))


def second_candidates(best: DataFrame, limits: DataFrame, seed: int = 2, n: int = SEEDS_2) -> DataFrame:
    """Phase 2: the best pose and noisy copies of it, kept inside a tenth of every range around it.

    ``limits`` holds target_id and the low and high end of each coordinate.
    """
    b = best.join(limits, "target_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cols = {}
    ends = {"px": ("x_lo", "x_hi"), "py": ("y_lo", "y_hi"), "pz": ("z_lo", "z_hi"), "a1": ANGLE_1, "a2": ANGLE_2}
    for name, (lo, hi) in ends.items():
        lo, hi = (F.col(lo), F.col(hi)) if isinstance(lo, str) else (F.lit(lo), F.lit(hi))
        width = hi - lo
        noisy = F.col(name) + F.when(F.col("i") > 0, NOISE * width * normal(F.lit(f"{name}{seed}"), "pose_id", "i")).otherwise(F.lit(0.0))
        cols[name] = F.greatest(lo, F.col(name) - WINDOW * width, F.least(hi, F.col(name) + WINDOW * width, noisy))
    return b.select("target_id", "dist_id", "axis1", "axis2", *[c.alias(k) for k, c in cols.items()], F.xxhash64(F.lit(seed), "pose_id", "i").alias("pose_id"))


def promising(poses: DataFrame, shapes: DataFrame, sums: DataFrame, level: tuple[DataFrame, DataFrame, DataFrame, float],
              score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The scored pose with the best bound of each search, and the unscored poses that might still beat it."""
    _, frames, summary, resolution = level
    group = ["target_id", "dist_id"]
    poses = cut(poses)
    bounds = cut(P.pose_bounds(poses, shapes, sums, frames, summary, resolution))
    lead = bounds.groupBy(*group).agg(F.min_by("pose_id", F.struct("fitness_least", "pose_id")).alias("pose_id"))
    first = cut(score(bounds.join(lead, [*group, "pose_id"], "left_semi").select(*poses.columns)))
    known = first.select(*group, F.col("fitness").alias("_best"), F.col("pose_id").alias("_lead"))
    rest = bounds.join(known, group).where((F.col("fitness_least") <= F.col("_best")) & (F.col("pose_id") != F.col("_lead")))
    return first, cut(rest.select(*poses.columns))


def search(searches: DataFrame, access: DataFrame, limits: DataFrame, distributions: DataFrame, shapes: DataFrame,
           coarse: tuple[DataFrame, DataFrame, DataFrame, float], fine: tuple[DataFrame, DataFrame, DataFrame, float],
           candidates: tuple[int, int] = (SEEDS_1, SEEDS_2), rounds: tuple[int, int] = (1, 1)) -> DataFrame:
    """Best pose per (target, distribution) on the fine grid.

    ``candidates`` are drawn per search in a round of each phase, ``rounds`` how often a phase draws around what it knows: the
    first phase anew over all accessible points, the second around the best pose so far, which always stays in.

    ``coarse`` and ``fine`` are (target voxels, frames, target summary, resolution). Each phase
    scores one candidate table; only winners (one row per search) go on. Of a search's candidates the one with the best bound
    is scored first; those whose bound is above its fitness cannot win and are never expanded.
    """
    group = ["target_id", "dist_id"]

    def score(poses: DataFrame, level) -> DataFrame:
        voxels, frames, summary, resolution = level
        return P.scored(P.pose_counts(poses, distributions, shapes, voxels, frames), summary, resolution)

    def winner(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in group]
        return df.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct("fitness", "pose_id")).alias("_r")).select(*group, "_r.*")

    pose = ["target_id", "dist_id", "axis1", "axis2", "px", "py", "pz", "a1", "a2", "pose_id"]
    sums = {id(level): cut(P.summed_volume(level[0], level[1])) for level in (coarse, fine)}

    def best_of(poses: DataFrame, level) -> DataFrame:
        first, rest = promising(poses, shapes, sums[id(level)], level, lambda p: score(p, level))
        return winner(first.unionByName(score(rest, level)))

    drawn = [first_candidates(searches, access, 2 * r + 1, candidates[0]) for r in range(rounds[0])]
    best = cut(best_of(reduce(DataFrame.unionByName, drawn), coarse).select(*pose))
    for r in range(rounds[1]):
        found = best_of(second_candidates(best, limits, 2 * r + 2, candidates[1]), fine)
        if r < rounds[1] - 1:
            best = cut(found.select(*pose))
    return found
