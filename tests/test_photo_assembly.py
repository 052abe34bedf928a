"""Photos put together from a pixel table with missing, odd and no cells."""

from __future__ import annotations

import numpy as np

from canopyflow.operators import images
from canopyflow.workload.image_queries import a18_files

SCHEMA = "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_suppkey bigint"


def test_cells_stand_at_their_places(spark, tmp_path):
    rows = [(0, 1, 10.0, 100.5, 0.05, 3), (0, 7, 20.0, 300.0, 0.01, 4), (63, 7, 5.0, 17.0, 0.0, 9), (5, 8, 9.0, 9.0, 0.0, 9),
            (70, None, 1.0, 1.0, 0.0, 1), (128, 2, None, 40.0, 0.0, 1), (None, 1, 1.0, 1.0, 0.0, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/lineitem.parquet")
    first = np.zeros((64, 7, 3), np.uint8)
    first[0, 0], first[0, 6], first[63, 6] = (50, 100, 53), (100, 44, 14), (25, 17, 9)
    black = np.zeros((64, 7, 3), np.uint8)
    found = a18_files(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan
    expected = {"0.png": first, "1.png": black, "2.png": black}
    got = {r.file: r.asDict() for r in found.collect()}
    assert got.keys() == expected.keys()
    for name, rgb in expected.items():
        assert {k: got[name][k] for k in images.FEATURES} == images.image_row(rgb)
