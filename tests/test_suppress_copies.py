"""Suppression of layers with many equal boxes, against a walk in rank order."""

import numpy as np
import pytest

from fieldloom.operators.vector import greedy_suppress


@pytest.mark.parametrize("above, inclusive", [(0.3, False), (0.3, True), (1.0, False), (1.0, True)])
def test_equal_boxes_stand_for_each_other(spark, above, inclusive):
    rng = np.random.default_rng(2)
    low = rng.integers(0, 8, (160, 2)).astype(float)
    boxes = np.c_[low, low + rng.integers(0, 4, (160, 2))]
    df = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], "k int, x0 double, y0 double, x1 double, y1 double")
    area, kept = (boxes[:, 2:] - boxes[:, :2]).prod(1), []
    for i in sorted(range(len(boxes)), key=lambda i: (-area[i], i)):
        shared = [np.maximum(np.minimum(boxes[i, 2:], boxes[j, 2:]) - np.maximum(boxes[i, :2], boxes[j, :2]), 0).prod() for j in kept]
        iou = [s / (area[i] + area[j] - s) if s > 0 else 0.0 for s, j in zip(shared, kept)]
        if not any(v > 0 and (v >= above if inclusive else v > above) for v in iou):
            kept.append(i)
    out = greedy_suppress(df, "k", 5.0, above, inclusive)
    assert out.columns == df.columns and sorted(r.k for r in out.collect()) == sorted(kept)


def test_a_stack_of_copies_makes_no_pairs(spark):
    df = spark.range(30_000).selectExpr("id AS k", "0D AS x0", "0D AS y0", "1D AS x1", "1D AS y1")  # 450 million pairs
    assert [r.k for r in greedy_suppress(df, "k", 5.0, 0.5).collect()] == [0]
