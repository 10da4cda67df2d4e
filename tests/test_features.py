from __future__ import annotations

import numpy as np
import pytest

from lodestar.datagen import employees
from lodestar.functions.features import shortened, visual_words


def test_visual_words_and_short_vectors(spark):
    centres = np.array([[0.0, 0.0, 0.0], [10.0, 0.0, 0.0], [0.0, 10.0, 0.0]])
    rows = [(1, [0.1, 0.2, 0.0]), (1, [9.0, 0.0, 1.0]), (1, [0.3, 0.0, 0.0]), (2, [0.0, 8.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    assert {r["id"]: r["words"] for r in visual_words(df, "id", "v", centres).collect()} == {1: "v0:2 v1:1", 2: "v2:1"}
    short = [r["short"] for r in shortened(df, "v", 2).collect()]
    assert all(len(s) == 2 and np.linalg.norm(s) == pytest.approx(1, abs=1e-5) for s in short)


def test_employees_repeat(spark):
    a, b = employees(spark, 50).collect(), employees(spark, 50).collect()
    assert a == b and {r["id"] for r in a} == set(range(1, 51)) and all(1025 <= r["salary"] <= 15000 for r in a)
    assert employees(spark, 50, seed=2).collect() != a
