"""Image tables: clusters, slices, component scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.colour import FEATURES
from ..session import cut
from .field import stride_sample
from .packs import entry, packed, repeated, types_of
from .skew import drop_halo, halo_window, running_sum, with_halo

IMAGE = "image_id"
BLOCK = 16_384  # pixels of an image that are clustered in one piece: some 2 MB


def clusters(px: DataFrame, k: int, restarts: int = 5, rounds: int = 400, seed: int = 1, tol: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """K-means of the z-scored features of every image, the cheapest of ``restarts`` starts.

    Every start runs until no centre moves by more than ``tol``; ``rounds`` only bounds a run that never settles. Start
    centres are the k pixels with the smallest seeded hash, so a run can be repeated.

    Pixels are packed once, in blocks of at most ``block`` of one image. An image of one block is clustered where it lies, in
    one pass. Larger ones advance together: a round sends only the k x 7 sums per (block, start) through the shuffle, and
    only for starts that still move.
    """
    hashes = {f"_h{s}": F.xxhash64(F.lit(seed), F.lit(s), "row", "col") for s in range(restarts)}
    columns = ["row", "col", *FEATURES, *hashes]
    packs = cut(packed(px.select(IMAGE, "row", "col", *FEATURES).withColumns(hashes), [IMAGE], ["row", "col"], columns, block))
    large = packs.groupBy(IMAGE).count().where("count > 1").select(IMAGE)
    pixel = types_of(px, [IMAGE, "row", "col"])
    small = packs.join(large, IMAGE, "left_anti").select(IMAGE, *columns).mapInArrow(_whole_images(k, restarts, rounds), f"{pixel}, cluster int")
    if large.isEmpty():
        return small
    return small.unionByName(_in_rounds(cut(packs.join(large, IMAGE, "left_semi")), pixel, k, restarts, rounds, tol))


def _features(b: pa.RecordBatch, r: int) -> np.ndarray:
    """Features x pixels of a pack."""
    return np.stack([entry(b.column(c), r) for c in FEATURES])


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (starts, centres, pixels) of features x pixels to (starts, centres, features)."""
    d = np.zeros((*centres.shape[:2], x.shape[1]))
    for i, v in enumerate(x):
        d += (v - centres[:, :, i, None]) ** 2
    return d


def _first_pixels(b: pa.RecordBatch, r: int, start: int, k: int) -> np.ndarray:
    """Positions of the k pixels of a pack with the smallest hash."""
    return np.lexsort([entry(b.column(c), r) for c in ("col", "row", f"_h{start}")])[:k]


def _pixels_of(b: pa.RecordBatch, clusters: Sequence[np.ndarray]) -> pa.RecordBatch:
    """The pixels of all packs of a batch, a row each."""
    image = b.column(IMAGE).take(pa.array(np.repeat(np.arange(b.num_rows), [len(c) for c in clusters])))
    cluster = np.concatenate(clusters) + 1 if clusters else np.zeros(0)
    return pa.RecordBatch.from_arrays([image, b.column("row").flatten(), b.column("col").flatten(), pa.array(cluster, pa.int32())], [IMAGE, "row", "col", "cluster"])


def _whole_images(k: int, restarts: int, rounds: int):
    """Pixels with their cluster, from packs that hold whole images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for r in range(b.num_rows):
                x = _features(b, r)
                centres = np.stack([x.T[_first_pixels(b, r, s, k)] for s in range(restarts)])
                last = None
                for _ in range(rounds):
                    at = _distances(x, centres).argmin(1)
                    if last is not None and (at == last).all():
                        break  # the same pixels: no centre moves any more
                    last = at
                    mine = at[:, None, :] == np.arange(centres.shape[1])[:, None]
                    n = mine.sum(2)
                    sums = np.stack([(mine * v).sum(2) for v in x], 2)
                    # A centre that lost all its pixels stays where it was.
                    centres = np.where(n[..., None] > 0, sums / np.maximum(n, 1)[..., None], centres)
                d = _distances(x, centres)
                cost = np.round(d.min(1).sum(1), 9)
                found.append(d.argmin(1)[cost.argmin()])
            yield _pixels_of(b, found)

    return run


def _in_rounds(packs: DataFrame, pixel: str, k: int, restarts: int, rounds: int, tol: float) -> DataFrame:
    """The same for images of several packs, all of them together."""
    image, width = pixel.split(", ")[0], len(FEATURES)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = _features(b, r)
                for s in range(restarts):
                    at = _first_pixels(b, r, s, k)
                    key = [pa.array(entry(b.column(c), r)[at]) for c in (f"_h{s}", "row", "col")]
                    yield pa.RecordBatch.from_arrays([repeated(b.column(IMAGE), r, len(at)), pa.array(np.full(len(at), s), pa.int32()), *[c.cast(pa.int64()) for c in key], pa.array(x.T[at].tolist(), pa.list_(pa.float64()))],
                                                     [IMAGE, "start", "h", "row", "col", "f"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x, runs = _features(b, r), b.column("runs")[r].as_py()
                centres = np.array([c["centres"] for c in runs])
                d = _distances(x, centres)
                at = d.argmin(1)
                for i, c in enumerate(runs):
                    mine = at[i] == np.arange(centres.shape[1])[:, None]
                    yield pa.RecordBatch.from_arrays([repeated(b.column(IMAGE), r, len(mine)), pa.array(np.full(len(mine), c["start"]), pa.int32()), pa.array(np.arange(len(mine)), pa.int32()), pa.array(mine.sum(1)),
                                                      pa.array((mine @ x.T).tolist(), pa.list_(pa.float64())), pa.array((mine * d[i].min(0)).sum(1))], [IMAGE, "start", "c", "n", "f", "cost"])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _pixels_of(b, [_distances(_features(b, r), np.array([b.column("centres")[r].as_py()])).argmin(1)[0] for r in range(b.num_rows)])

    listed = F.transform(F.sort_array(F.collect_list(F.struct("c", "f"))), lambda c: c["f"])
    summed = lambda cs: packs.join(cs.groupBy(IMAGE).agg(F.collect_list(F.struct("start", "centres")).alias("runs")), IMAGE).select(IMAGE, *FEATURES, "runs").mapInArrow(
        sums, f"{image}, start int, c int, n long, f array<double>, cost double").groupBy(IMAGE, "start", "c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("f")[i]) for i in range(width)]).alias("f"), F.sum("cost").alias("cost"))
    w = Window.partitionBy(IMAGE, "start").orderBy("h", "row", "col")
    seeds = packs.mapInArrow(first, f"{image}, start int, h long, row long, col long, f array<double>")
    moving = cut(seeds.withColumn("c", F.row_number().over(w) - 1).where(F.col("c") < k).groupBy(IMAGE, "start").agg(listed.alias("centres")))
    done = []
    for _ in range(rounds):
        # A centre that lost all its pixels stays where it was.
        old = moving.select(IMAGE, "start", F.posexplode("centres").alias("c", "_o"))
        new = summed(moving).join(old, [IMAGE, "start", "c"]).withColumn("f", F.when(F.col("n") > 0, F.transform("f", lambda v: v / F.col("n"))).otherwise(F.col("_o")))
        shift = F.aggregate(F.zip_with("f", "_o", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
        step = cut(new.groupBy(IMAGE, "start").agg(listed.alias("centres"), F.max(shift).alias("shift")))
        done.append(step.where(F.col("shift") <= tol).select(IMAGE, "start", "centres"))
        moving = step.where(F.col("shift") > tol).select(IMAGE, "start", "centres")
        if moving.isEmpty():
            break
    centres = cut(reduce(DataFrame.unionByName, [*done, moving]))
    cost = summed(centres).groupBy(IMAGE, "start").agg(F.sum("cost").alias("cost"))
    best = cost.join(centres, [IMAGE, "start"]).groupBy(IMAGE).agg(F.min_by("centres", F.struct(F.round("cost", 9), F.col("start"))).alias("centres"))
    return packs.join(best, IMAGE).select(IMAGE, "row", "col", *FEATURES, "centres").mapInArrow(assigned, f"{pixel}, cluster int")


def on_border(row: Column, col: Column, height: Column, width: Column) -> Column:
    """Border strip of max(10, 3 % of the shorter side) pixels; rows and columns count from 1."""
    strip = F.greatest(F.lit(10), F.round(F.least(height, width) * 0.03).cast("int"))
    return (row <= strip) | (row > height - strip) | (col <= strip) | (col > width - strip)


def cluster_profile(px: DataFrame) -> DataFrame:
    """Border share and mean colours per cluster, the background cluster and the object rule.

    ``px`` holds image_id, cluster, border, sat, val (0..1), lab_a, r, g, b.
    """
    p = px.groupBy(IMAGE, "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("border").alias("n_border"), F.avg("sat").alias("mean_s"), F.avg("val").alias("mean_v"),
        F.avg("lab_a").alias("mean_a"), F.avg("r").alias("mean_r"), F.avg("g").alias("mean_g"), F.avg("b").alias("mean_b"))
    back = p.groupBy(IMAGE).agg(F.max_by("cluster", F.struct(F.col("n_border"), -F.col("cluster"))).alias("background"))
    p = p.join(back, IMAGE).withColumn("border_share", F.col("n_border") / F.greatest(F.lit(1), F.col("n")))
    red = F.col("mean_r") - F.greatest("mean_g", "mean_b")
    is_red = (F.col("mean_s") > 0.18) & (F.col("mean_a") > 8) & (red > 0.03)
    bone = (F.col("mean_v") > 0.45) & (F.col("mean_s") < 0.45) & (F.col("border_share") < 0.45)
    apart = (F.col("cluster") != F.col("background")) & (F.col("border_share") < 0.55)
    return p.withColumn("object", (is_red | bone) & apart)


def component_scores(px: DataFrame, size: DataFrame) -> DataFrame:
    """Area + 1200 brown share + 1200 charred share - 3000 relative distance, per component.

    ``px`` holds image_id, root, row, col, brown, charred; ``size`` image_id, height, width,
    ref_row, ref_col.
    """
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    c = px.groupBy(IMAGE, "root").agg(F.count(F.lit(1)).alias("area"), share("brown").alias("brown"), share("charred").alias("charred"),
                                      F.avg("row").alias("c_row"), F.avg("col").alias("c_col")).join(size, IMAGE)
    away = F.hypot(F.col("c_col") - F.col("ref_col"), F.col("c_row") - F.col("ref_row")) / F.greatest("height", "width")
    return c.withColumn("score", F.col("area") + 1200 * F.col("brown") + 1200 * F.col("charred") - 3000 * away).select(
        IMAGE, "root", "area", "brown", "charred", "score")


def best_component(scores: DataFrame) -> DataFrame:
    """The highest score per image, the smaller root on ties."""
    return scores.groupBy(IMAGE).agg(F.max_by(F.struct("root", "area", "score"), F.struct(F.col("score"), -F.col("root"))).alias("_b")).select(IMAGE, "_b.*")


def numbered_segments(faces: DataFrame, keys: Sequence[str], order: str = "pos", face: str = "face", rows: int = 1_000_000) -> DataFrame:
    """A new segment starts at face 1 and after face 2."""
    w = halo_window(keys)
    f = with_halo(faces, keys, order, 1, rows)
    prev = F.lag(face).over(w)
    f = drop_halo(f.withColumn("_new", F.when(prev.isNotNull() & ((F.col(face) == 1) | (prev == 2)), 1).otherwise(0)))
    return running_sum(f, keys, order, "_new", "_c", rows).withColumn("segment", (F.col("_c") + 1).cast("int")).drop("_new", "_c")


def slice_depth(segmented: DataFrame, thickness: DataFrame, keys: Sequence[str], face: str = "face", rows: int = 1_000_000) -> DataFrame:
    """Sum of the earlier segments' thickness; face 2 adds its own.

    ``thickness`` holds (keys, segment, thickness).
    """
    t = running_sum(thickness, keys, "segment", "thickness", "_end", rows)
    j = segmented.join(t, [*keys, "segment"])
    start = F.col("_end") - F.col("thickness")
    return j.withColumn("z_mm", F.when(F.col(face) == 2, F.col("_end")).otherwise(start)).drop("_end")


def slice_cloud(px: DataFrame, slices: DataFrame, mm_per_pixel: float, group: str, target: int | None = None) -> DataFrame:
    """3-D points of masked pixels with the depth of their slice; all of them, or about ``target`` per slice.

    ``px`` holds (group, image_id, row, col) of mask pixels, ``slices`` (group, image_id, z_mm).
    """
    order = px.withColumn("_at", F.col("col").cast("long") * 2**24 + F.col("row"))
    kept = px if target is None else stride_sample(order, [group, IMAGE], "_at", target)
    return kept.join(slices, [group, IMAGE]).select(
        group, IMAGE, (F.col("col") * mm_per_pixel).alias("x"), (F.col("row") * mm_per_pixel).alias("y"), F.col("z_mm").alias("z"))


def cloud_check(cloud: DataFrame, group: str) -> DataFrame:
    """A cloud needs at least ten points on at least two depths."""
    per = cloud.groupBy(group, "z").count()
    return per.groupBy(group).agg(F.sum("count").alias("n_points"), F.count(F.lit(1)).alias("n_slices")).withColumn(
        "status", F.when(F.col("n_points") < 10, "pocos_puntos").when(F.col("n_slices") < 2, "un_solo_corte").otherwise("ok"))
