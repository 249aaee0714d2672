"""The index of benchmark windows: few candidates for unlike ones, and all windows within the radius."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tramline.llm import decontamination


def prints(spark, values, **more):
    table = pa.table({"item_words": pa.array([20] * len(values), pa.int32()), "print": pa.array([v.tobytes() for v in values], pa.binary()), **more})
    return spark.createDataFrame(table)


def test_unlike_windows_meet_few_items_and_near_ones_all(spark):
    draw = np.random.default_rng(4)
    items = draw.integers(0, 256, (4000, 16), np.uint8)
    near = items[:300].copy()
    for i, row in enumerate(near):  # up to RADIUS bits flipped
        for bit in draw.choice(128, draw.integers(0, decontamination.RADIUS + 1), replace=False):
            near[i, bit // 8] ^= 1 << (bit % 8)
    windows = np.concatenate([near, draw.integers(0, 256, (4000, 16), np.uint8)])
    left = prints(spark, windows, passage=pa.array([str(i) for i in range(len(windows))]))
    right = prints(spark, items, item_id=pa.array(range(len(items)), pa.int64()))
    met = left.select("passage", decontamination._blocks("print")).join(right.select(decontamination._blocks("print")), ["block", "value"]).count()
    assert met / len(windows) < 1.1
    got = {(int(r.passage), r.item_id): r.distance for r in decontamination.within_radius(left, right).collect()}
    bits = lambda a: np.unpackbits(a, axis=1).astype(np.int32)
    x, y = bits(windows), bits(items)
    distance = x.sum(1)[:, None] + y.sum(1)[None] - 2 * x @ y.T
    want = {(int(i), int(j)): int(distance[i, j]) for i, j in zip(*np.nonzero(distance <= decontamination.RADIUS), strict=True)}
    assert got == want and len(got) >= 300


def test_the_bitmap_follows_the_items(spark):
    small = spark.createDataFrame([([1, 2, -3],)], "marks array<long>")
    large = spark.range(3000).select(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.xxhash64(i, "id")).alias("marks"))
    for items in (small, large):
        bitmap = decontamination._bitmap(items)
        marks = np.array([m for r in items.collect() for m in r.marks], np.int64).view(np.uint64)
        assert decontamination._is_set(bitmap, marks).all()
        assert np.unpackbits(bitmap).mean() < 0.07
    assert not decontamination._bitmap(small.limit(0)).any()
