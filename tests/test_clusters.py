"""Clusters of images that are one block, and of those that are several."""

import numpy as np
import pandas as pd

from thermal_lake.functions.colour import FEATURES
from thermal_lake.operators import pixels as PX
from thermal_lake.session import cut


def test_blocks_do_not_change_clusters(spark, monkeypatch):
    rng = np.random.default_rng(3)
    px = [{"image_id": i, "row": r, "col": c, **dict(zip(FEATURES, rng.normal(3 * rng.integers(0, 3), 1, len(FEATURES))))} for i, n in ((1, 8), (2, 8), (3, 1)) for r in range(1, n + 1) for c in range(1, n + 2)]
    df = spark.createDataFrame(pd.DataFrame([*px, px[0]]))  # one pixel comes twice, and image 3 has fewer than three
    rows = lambda d: sorted(map(tuple, d.select("image_id", "row", "col", "cluster").collect()))
    written = []
    monkeypatch.setattr(PX, "cut", lambda d: written.append(1) or cut(d))
    whole = rows(PX.clusters(df, 3, 4))
    assert len(written) == 1  # the packs: no round goes through the shuffle
    assert len(whole) == 72 + 72 + 2 + 1
    assert rows(PX.clusters(df, 3, 4, block=20)) == whole
